"""Catalogs of schemas: files that refer to each other by relative paths, fragments and shared names.

A catalog is a few hundred small rules held by the driver; documents are checked against it on the executors. Files are read by
Spark, so any store works; only files of the given endings below the folder count.
"""

from __future__ import annotations

import os
import posixpath
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Most bytes that the files of a catalog may have together.
MOST_BYTES = 16 << 20
ENDINGS = ("yaml", "yml", "json")


@dataclass(frozen=True)
class Place:
    """A schema at a pointer of a file."""

    catalog: Catalog = field(repr=False, compare=False)
    file: str
    pointer: str
    schema: Any = field(repr=False, compare=False)

    @property
    def name(self) -> str:
        return f"{self.file}#{self.pointer}"

    def at(self, schema: Any, pointer: str) -> Place:
        return Place(self.catalog, self.file, pointer, schema)

    def sub(self, *steps: str) -> Place:
        found = self.schema
        for s in steps:
            found = found[int(s)] if isinstance(found, list) else found[s]
        return self.at(found, "/".join([self.pointer, *steps]))

    def target(self) -> Place:
        """The place that $ref names."""
        return self.catalog.resolve(self.schema["$ref"], self.file)

    def children(self) -> list[Place]:
        """All schemas right below this one, definitions and their groups included."""
        found = []
        for word, value in self.schema.items():
            if word in ("properties", "patternProperties"):
                found += [self.sub(word, n) for n in value]
            elif word == "$defs":
                found += [self.at({"$defs": value[n]}, f"{self.pointer}/$defs/{n}") if nested(value[n]) else self.sub(word, n) for n in value]
            elif word in ("allOf", "oneOf", "anyOf"):
                found += [self.sub(word, str(i)) for i in range(len(value))]
            elif word in ("items", "if", "then", "else", "not", "additionalProperties", "propertyNames", "unevaluatedProperties"):
                found.append(self.sub(word))
        return found


def nested(definitions: Any) -> bool:
    """Whether a member of $defs is a group of schemas rather than a schema."""
    return isinstance(definitions, dict) and bool(definitions) and all(isinstance(v, dict) for v in definitions.values()) and not set(definitions) & {"type", "properties", "allOf", "oneOf", "anyOf", "$ref", "enum", "items", "not", "if", "patternProperties", "$defs"}


class Catalog:
    """Schemas by file name, with shared ones by their address."""

    def __init__(self, files: dict[str, Any], shared: dict[str, Any] | None = None):
        self.files = files | (shared or {})
        self.shared = set(shared or ())
        self._found: dict[tuple[str, str], Place] = {}

    @staticmethod
    def load(spark: SparkSession, folder: str, shared: dict[str, Any] | None = None) -> Catalog:
        """All schema files below a folder, named by their paths from it."""
        import yaml  # reads JSON too

        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        read = read.where(F.lower(F.substring_index("path", ".", -1)).isin(*ENDINGS))
        size = read.agg(F.sum("length")).first()[0] or 0
        if size > MOST_BYTES:
            raise ValueError(f"{folder} has {size} bytes of schemas, more than {MOST_BYTES}")
        rows = read.select("path", "content").collect()
        plain = [r.path.split(":", 1)[-1].lstrip("/") for r in rows]
        top = posixpath.commonpath([posixpath.dirname(p) for p in plain]) if plain else ""
        return Catalog({posixpath.relpath(p, top): yaml.load(bytes(r.content), Loader=_text_dates(yaml)) for p, r in zip(plain, rows, strict=True)}, shared)

    @staticmethod
    def of_folder(folder: str, shared: dict[str, Any] | None = None) -> Catalog:
        """The same of a folder on the driver's own disk, such as one inside this package."""
        import yaml

        paths = [os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.rsplit(".", 1)[-1] in ENDINGS]
        files = {}
        for p in sorted(paths):
            with open(p, encoding="utf-8") as f:
                files[os.path.relpath(p, folder).replace(os.sep, "/")] = yaml.load(f, Loader=_text_dates(yaml))
        return Catalog(files, shared)

    def place(self, file: str, pointer: str = "") -> Place:
        """The schema at a pointer of a file; a missing one is an error."""
        if (file, pointer) not in self._found:
            if file not in self.files:
                raise ValueError(f"{file}#{pointer} names nothing: there is no such file")
            found = self.files[file]
            for step in pointer.split("/")[1:]:
                step = step.replace("~1", "/").replace("~0", "~")
                step = int(step) if isinstance(found, list) and step.isdigit() else step
                if not (isinstance(found, dict) and step in found or isinstance(found, list) and isinstance(step, int) and step < len(found)):
                    raise ValueError(f"{file}#{pointer} names nothing")
                found = found[step]
            self._found[file, pointer] = Place(self, file, pointer, found)
        return self._found[file, pointer]

    def resolve(self, ref: str, file: str) -> Place:
        """The place that a reference found in a file names: a shared address, a relative path, a fragment, or both."""
        target, _, fragment = ref.partition("#")
        if target in self.shared:
            file = target
        elif target:
            file = posixpath.normpath(posixpath.join(posixpath.dirname(file), target))
        return self.place(file, "/" + fragment.strip("/") if fragment.strip("/") else "")


def _text_dates(yaml):
    """A YAML loader that leaves dates as text, as JSON has none."""

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [(tag, r) for tag, r in v if tag != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    return Loader
