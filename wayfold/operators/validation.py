"""Validation of JSON documents: constraints become one SQL expression over a variant, so that null, absent and wrong types differ.

A schema is a dict in JSON Schema's words, or a place in a catalog of several files; broken rules come back as an array of
struct(path, schema, message), where path points into the document and schema to the rule. Each value that a rule looks
at is bound once, with its kind, members and items, as the variable of a lambda; each branch (oneOf, anyOf, if) is bound once
with its errors and the names it knows. The expression therefore grows with the schema, not with how often results
are used. It is put together as text and parsed once, as a catalog makes tens of thousands of calls. Closure over keys
(unevaluatedProperties) counts the keys that allOf, references, holding oneOf and anyOf branches, and the taken side of if know.

Defined cases: text that is not JSON, null included, has the one error "not a JSON document", as has an object that repeats
a key; a number is an integer if it has no fraction, whatever its length; objects are equal whatever the order of their keys,
and numbers inside constants of objects and arrays are compared as written; a polygon's rings must end where they begin if
the schema asks for it by `closedRing`, a word of this module.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, Place

# The forms that are asserted for strings. Days that a month does not have are refused besides.
FORMATS = {"date-time": r"^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])[Tt](?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})\z", "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]+\z", "email": r"^[^\s@]+@[^\s@]+\z"}
_PLACE = {"type": "array", "minItems": 2, "items": {"type": "number"}}
_LINE = {"type": "array", "minItems": 2, "items": _PLACE}
_RING = {"type": "array", "minItems": 4, "items": _PLACE}
_SHAPES = {"Point": _PLACE, "LineString": _LINE, "MultiLineString": {"type": "array", "items": _LINE}, "Polygon": {"type": "array", "items": _RING}, "MultiPolygon": {"type": "array", "items": {"type": "array", "items": _RING}}}
#: Schemas of geometries, closed but for a box.
GEOMETRIES = {k: {"type": "object", "required": ["type", "coordinates"], "properties": {"type": {"enum": [k]}, "coordinates": v, "bbox": {"type": "array", "minItems": 4}}, "unevaluatedProperties": False} for k, v in _SHAPES.items()}
#: A ring that ends where it begins, and the shared schemas that catalogs name by their address.
_CLOSED_RING = _RING | {"closedRing": True}
_BOX = {"bbox": {"type": "array", "minItems": 4, "items": {"type": "number"}}}
_COORDINATES = _SHAPES | {"MultiPoint": {"type": "array", "items": _PLACE}, "Polygon": {"type": "array", "items": _CLOSED_RING}, "MultiPolygon": {"type": "array", "items": {"type": "array", "items": _CLOSED_RING}}}
GEOJSON = {f"https://geojson.org/schema/{k}.json": {"type": "object", "required": ["type", "coordinates"], "properties": {"type": {"type": "string", "enum": [k]}, "coordinates": v} | _BOX} for k, v in _COORDINATES.items()}
#: What a geometry must be is left to each feature type.
GEOJSON["https://geojson.org/schema/Feature.json"] = {"type": "object", "required": ["type", "properties", "geometry"], "properties": {"type": {"type": "string", "enum": ["Feature"]}, "id": {"type": ["number", "string"]}, "properties": {"type": ["null", "object"]}, "geometry": {"type": ["null", "object"]}} | _BOX}
#: Words that assert nothing; the last is no word of the standard, but published schemas have it.
NOTES = {"inclusiveMinimum", "default", "title", "description", "$comment", "$schema", "$id", "$defs", "examples", "deprecated"}
KNOWN = NOTES | {"type", "required", "enum", "const", "pattern", "format", "minLength", "maxLength", "minItems", "maxItems", "uniqueItems", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "items", "properties", "patternProperties", "additionalProperties", "unevaluatedProperties", "propertyNames", "minProperties", "maxProperties", "allOf", "oneOf", "anyOf", "if", "then", "else", "not", "$ref", "closedRing"}
NO_ERRORS, NO_NAMES = "cast(array() as array<struct<path:string,schema:string,message:string>>)", "cast(array() as array<string>)"


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def child(v: Column, name: str) -> Column:
    """A member of an object, or null; names may hold any character."""
    return F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), name)


def pointer(v: Column, path: str) -> Column:
    """The value that a JSON pointer names in a variant, as a variant; the whole for "", null if there is none."""
    for step in path.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        v = F.try_variant_get(v, f"$[{step}]", "variant") if step.isdigit() else child(v, step)
    return v


# Schemas


def asserts(schema: Any) -> bool:
    return schema is False or isinstance(schema, dict) and bool(set(schema) - NOTES)


def closed(schema: Any) -> bool:
    return isinstance(schema, dict) and schema.get("unevaluatedProperties") is False


def check_schema(schema: Any, root: Any = None, at: str = "#") -> None:
    """Raises an error for unknown keywords, references without a target or in a circle, and patterns and forms that do not compile."""
    home = root if isinstance(root, Place) else Catalog({"S": schema if root is None else root}).place("S")
    _check(home.at(schema, at.removeprefix("#")), set(), ())


def _check(place: Place, done: set, above: tuple) -> None:
    schema = place.schema
    if isinstance(schema, bool) or place.name in done:
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{place.name}: a schema is an object, true or false")
    if place.name in above:
        raise ValueError(f"{place.name}: the reference leads back to itself")
    for word, value in schema.items():
        if word not in KNOWN:
            raise ValueError(f"{place.name}: unknown keyword {word}")
        if word == "pattern":
            re.compile(value)
        if word == "format" and value not in FORMATS:
            raise ValueError(f"{place.name}: unknown format {value}")
        if word == "unevaluatedProperties" and not isinstance(value, bool):
            raise ValueError(f"{place.name}: unevaluatedProperties is true or false here")
        for p in value if word == "patternProperties" else ():
            re.compile(p)
    for sub in place.children() + ([place.target()] if "$ref" in schema else []):
        _check(sub, done, (*above, place.name))
    done.add(place.name)


def conjunction(place: Place) -> list[Place]:
    """The schemas that hold together at a value: the schema, its allOf and its reference; those closed on their own are not opened."""
    found, todo = [place], []
    if isinstance(place.schema, dict):
        todo = [place.sub("allOf", str(i)) for i in range(len(place.schema.get("allOf", ())))] + ([place.target()] if "$ref" in place.schema else [])
    for p in todo:
        found += [p] if closed(p.schema) else conjunction(p)
    return found


# Expressions, as SQL text


def lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def java(pattern: str) -> str:
    """A pattern whose last $ means the end and not the place before a last newline."""
    return re.sub(r"(?<!\\)\$\Z", r"\\z", pattern)


def quoted(x: Any) -> str:
    return f"'{x}'" if isinstance(x, str) else json.dumps(x)


_fresh = itertools.count()


def over(values: str, body: Callable[..., str], with_index: bool = False) -> str:
    """body of each value of an array."""
    n = next(_fresh)
    names = (f"x{n}", f"i{n}") if with_index else (f"x{n}",)
    heads = f"({', '.join(names)})" if with_index else names[0]
    return f"transform({values}, {heads} -> {body(*names)})"


def those(values: str, test: Callable[[str], str]) -> str:
    n = next(_fresh)
    return f"filter({values}, y{n} -> {test(f'y{n}')})"


def let(value: str, body: Callable[[str], str]) -> str:
    """body(value) with value computed once."""
    return f"element_at({over(f'array({value})', body)}, 1)"


def joined(parts: list[str]) -> str:
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0] if parts else NO_ERRORS


def texts(values: Iterable[str]) -> str:
    values = list(values)
    return f"array({', '.join(map(lit, values))})" if values else NO_NAMES


@dataclass(frozen=True)
class Spot:
    """A place in a document: a variant, as a column or the variable of a lambda, the names that lead on from it, and its path."""

    base: str
    steps: tuple[str, ...] = ()
    before: tuple[str, ...] = ()  # SQL of the path up to base

    def get(self, kind: str) -> str:
        """The value here as a type; null if there is none of that type. Numbers and booleans become strings, too."""
        plain = next((i for i, s in enumerate(self.steps) if not re.fullmatch(r"[A-Za-z_]\w*", s)), None)
        if plain is not None:  # a name that no path can spell is looked up in the members
            at = f"{Spot(self.base, self.steps[:plain]).get('map<string,variant>')}[{lit(self.steps[plain])}]"
            return Spot(at, self.steps[plain + 1 :]).get(kind)
        return self.base if kind == "variant" and not self.steps else f"try_variant_get({self.base}, {lit('.'.join(['$', *self.steps]))}, '{kind}')"

    @property
    def v(self) -> str:
        return self.get("variant")

    @property
    def type(self) -> str:
        return f"schema_of_variant({self.v})"

    @property
    def kind(self) -> str:
        """The JSON kind, as messages name it."""
        return f"elt(find_in_set(left({self.type}, 2), 'OB,AR,ST,BO,VO') + 1, 'number', 'object', 'array', 'string', 'boolean', 'null')"

    @property
    def numeric(self) -> str:
        return f"left({self.type}, 2) in ('BI', 'DE', 'DO', 'FL')"

    def of_kind(self, word: str) -> str:
        whole = f"({self.numeric} and {self.get('double')} % 1 = 0)"
        typed = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
        return {"object": f"{self.keys} is not null", "array": f"{self.items} is not null", "number": self.numeric, "integer": whole}.get(word) or f"{self.type} = '{typed[word]}'"

    @property
    def members(self) -> str:
        return self.get("map<string,variant>")

    @property
    def keys(self) -> str:
        return f"map_keys({self.members})"

    @property
    def items(self) -> str:
        return self.get("array<variant>")

    @property
    def path(self) -> str:
        own = [lit("".join(f"/{s}" for s in self.steps))] if self.steps else []
        parts = [*self.before, *own]
        return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0] if parts else "''"

    def child(self, name: str) -> Spot:
        return Spot(self.base, (*self.steps, name), self.before)

    def below(self, base: str, key: str) -> Spot:
        """The place of a lambda's value below this one, whose name or number is SQL."""
        own = lit("".join(f"/{s}" for s in self.steps) + "/")
        return Spot(base, (), (*self.before, own, key))


class Shared:
    """Results at fixed places that several branches ask for: they become columns, computed once for a document."""

    def __init__(self, base: str):
        self.base, self.asked, self.columns = base, Counter(), {}

    def key(self, place: Place, spot: Spot, want: bool = False):
        return (place.name, spot.steps, want) if spot.base == self.base else None


def among(v: str, values: list) -> str:
    """Whether a variant equals one of some JSON values; objects in any order of keys, numbers by value."""
    plain = [x for x in values if isinstance(x, (str, bool)) or x is None]
    tests = [f"to_json({v}) in ({', '.join(lit(json.dumps(x, ensure_ascii=False)) for x in plain)})"] if plain else []
    for x in values:
        if isinstance(x, (dict, list)):
            tests.append(f"to_json({v}) = to_json(parse_json({lit(json.dumps(x, ensure_ascii=False))}))")
        elif isinstance(x, (int, float)) and not isinstance(x, bool):
            tests.append(f"{Spot(v).numeric} and {Spot(v).get('double')} = {float(x)!r}D")
    return "(" + " or ".join(f"({t})" for t in tests) + ")"


def formed(text: str, form: str) -> str:
    good = f"{text} rlike {lit(FORMATS[form])}"
    return f"({good} and try_to_timestamp(left({text}, 10), 'yyyy-MM-dd') is not null)" if form == "date-time" else f"({good})"


def known_name(name: str, names, patterns) -> str:
    tests = ([f"{name} in ({', '.join(map(lit, names))})"] if names else []) + [f"{name} rlike {lit(java(p))}" for p in patterns]
    return f"({' or '.join(tests) or 'false'})"


def error(path: str, at: str, word: str, message: str) -> str:
    """message is SQL."""
    return f"named_struct('path', {path}, 'schema', {lit(f'{at}/{word}' if word else at)}, 'message', {message})"


def value_rules(schema: dict, spot: Spot, at: str) -> list[str]:
    """An error, or null, for each rule about a value itself."""
    found: list[str] = []
    text, items, keys, path, number = spot.get("string"), spot.items, spot.keys, spot.path, spot.get("double")
    length, string = f"char_length({text})", f"{spot.type} = 'STRING'"

    def rule(word: str, broken: str, message: str) -> None:
        found.append(f"if({broken}, {error(path, at, word, message)}, null)")

    def limits(applies: str, value: str, shown: str, **signs: str) -> None:
        for word, sign in signs.items():
            if word in schema:
                rule(word, f"{applies} and {value} {sign} {schema[word]!r}", f"concat({lit(f'{word}: got ')}, {shown}, {lit(f', want {schema[word]}')})")

    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        rule("type", f"not ({' or '.join(map(spot.of_kind, wanted))})", f"concat('got ', {spot.kind}, {lit(', want ' + ' or '.join(wanted))})")
    for word in ("enum", "const"):
        if word in schema:
            values = schema["enum"] if word == "enum" else [schema["const"]]
            rule(word, f"not {among(spot.v, values)}", lit("value must be " + ("one of " if len(values) > 1 else "") + ", ".join(map(quoted, values))))
    if "pattern" in schema:
        shown = "' does not match pattern '" + schema["pattern"].replace("\\", "\\\\") + "'"
        rule("pattern", f"{string} and not ({text} rlike {lit(java(schema['pattern']))})", f"concat('\\'', {text}, {lit(shown)})")
    if "format" in schema:
        shown = f"' is not valid {schema['format']}"
        rule("format", f"{string} and not {formed(text, schema['format'])}", f"concat('\\'', {text}, {lit(shown)})")
    limits(string, length, length, minLength="<", maxLength=">")
    limits(spot.numeric, number, text, minimum="<", maximum=">", exclusiveMinimum="<=", exclusiveMaximum=">=")
    limits(f"{items} is not null", f"size({items})", f"size({items})", minItems="<", maxItems=">")
    limits(f"{keys} is not null", f"size({keys})", f"size({keys})", minProperties="<", maxProperties=">")
    if schema.get("uniqueItems"):

        def repeated(spelled: str) -> str:
            at_once = over(spelled, lambda s, i: f"if(array_position({spelled}, {s}) <= {i}, {i}, null)", True)
            shown = lambda i: f"concat('items at ', array_position({spelled}, {spelled}[{i}]) - 1, ' and ', {i}, ' are equal')"
            return let(f"array_min({at_once})", lambda i: f"if({i} is not null, {error(path, at, 'uniqueItems', shown(i))}, null)")

        found.append(let(over(items, lambda i: f"to_json({i})"), repeated))
    if schema.get("closedRing"):
        rule("closedRing", f"size({items}) > 0 and to_json({items}[0]) <> to_json(element_at({items}, -1))", lit("the ring does not end where it begins"))
    if schema.get("required"):
        shown = lambda m: f"concat('missing propert', if(size({m}) > 1, 'ies', 'y'), ' \\'', array_join({m}, '\\', \\''), '\\'')"
        found.append(let(f"array_except({texts(schema['required'])}, {keys})", lambda m: f"if(size({m}) > 0, {error(path, at, 'required', shown(m))}, null)"))
    if schema.get("propertyNames") is False:
        rule("propertyNames", f"size({keys}) > 0", "'false schema'")
    if schema.get("additionalProperties") is False:
        extra = those(keys, lambda n: f"not {known_name(n, schema.get('properties', ()), schema.get('patternProperties', ()))}")
        shown = lambda e: f"concat('additional properties \\'', array_join({e}, '\\', \\''), '\\' not allowed')"
        found.append(let(extra, lambda e: f"if(size({e}) > 0, {error(path, at, 'additionalProperties', shown(e))}, null)"))
    return found


def simple(schema: Any) -> bool:
    """Whether a schema asks for nothing but constants at named places."""
    return isinstance(schema, dict) and set(schema) - NOTES <= {"properties", "required", "enum", "const"} and all(map(simple, schema.get("properties", {}).values()))


def has_constants(schema: dict, spot: Spot) -> str:
    """Whether a present value fits a simple schema."""
    tests = [among(spot.v, schema["enum"] if word == "enum" else [schema["const"]]) for word in ("enum", "const") if word in schema]
    if schema.get("required"):
        tests.append(f"({spot.members} is null or " + " and ".join(f"{spot.child(n).v} is not null" for n in schema["required"]) + ")")
    tests += [f"coalesce({has_constants(sub, spot.child(n))}, true)" for n, sub in schema.get("properties", {}).items() if asserts(sub)]
    return f"({' and '.join(tests) or 'true'})"


class Compiler:
    """Writes a schema as SQL. A first pass counts which results at fixed places are asked for more than once."""

    def __init__(self, base: str):
        self.shared = Shared(base)
        self.counting = True

    def compile(self, place: Place) -> tuple[dict[str, str], str]:
        """Shared columns and the errors of a whole document."""
        spot = Spot(self.shared.base)
        self.result(place, spot, False)
        self.counting = False
        found = self.result(place, spot, False)
        return {name: sql for name, sql in self.shared.columns.values()}, found

    def result(self, place: Place, spot: Spot, names: bool) -> str:
        """The errors of a present value, or struct(e, n) of them and the names that the schema knows if those are asked for."""
        is_closed = closed(place.schema)
        want = names or is_closed
        rules, found, branches, known, patterns = [], [], [], [], []
        for part in conjunction(place):
            schema = part.schema
            if part is not place and closed(schema):
                branches.append(self.result(part, spot, want))
                continue
            if schema is False:
                rules.append(error(spot.path, part.name, "false", "'false schema'"))
            if not isinstance(schema, dict):
                continue
            rules += value_rules(schema, spot, part.name)
            known += [n for n in schema.get("properties", ()) if n not in known]
            patterns += [p for p in schema.get("patternProperties", ()) if p not in patterns]
            if "additionalProperties" in schema:
                patterns.append("")  # all names are known
            found += self.inner(part, spot)
            branches += [self.choice(part, word, spot, want) for word in ("oneOf", "anyOf") if word in schema]
            if "if" in schema:
                branches.append(self.condition(part, spot, want))
            if "not" in schema:
                rules.append(f"if({self.holds(part.sub('not'), spot)}, {error(spot.path, part.name, '', lit('not failed'))}, null)")
        if rules:
            found.insert(0, f"array_compact(array({', '.join(rules)}))")
        if not want:
            return joined(found + branches)

        def closing(rs: str | None) -> str:
            errors_, names_of = list(found), None
            if rs:
                errors_.append(f"flatten({over(rs, lambda r: f'{r}.e')})")
                names_of = f"flatten({over(rs, lambda r: f'{r}.n')})"
            if is_closed:
                extra = those(spot.keys, lambda n: f"not {known_name(n, known, patterns)}")
                extra = f"array_except({extra}, {names_of})" if rs else extra
                shown = over(extra, lambda n: error(spot.below("", n).path, place.name, "unevaluatedProperties", "'false schema'"))
                errors_.append(f"coalesce({shown}, {NO_ERRORS})")
            if not names:
                return joined(errors_)
            own = [texts(known)] + ([f"coalesce({those(spot.keys, lambda n: known_name(n, (), patterns))}, {NO_NAMES})"] if patterns else [])
            return f"named_struct('e', {joined(errors_)}, 'n', concat({', '.join(own + ([names_of] if rs else []))}))"

        return let(f"array({', '.join(branches)})", closing) if branches else closing(None)

    def inner(self, place: Place, spot: Spot) -> list[str]:
        """Errors of members and items."""
        schema, found = place.schema, []

        def each(values: str) -> str:
            return f"coalesce(flatten({values}), {NO_ERRORS})"

        def entries(fits: Callable[[str], str], sub: Place) -> str:
            some = those(f"map_entries({spot.members})", lambda e: fits(f"{e}.key"))
            return each(over(some, lambda e: self.result(sub, spot.below(f"{e}.value", f"{e}.key"), False)))

        for name in schema.get("properties", {}):
            sub = place.sub("properties", name)
            if asserts(sub.schema):
                found.append(self.member(sub, spot.child(name)))
        for pattern in schema.get("patternProperties", {}):
            sub = place.sub("patternProperties", pattern)
            if asserts(sub.schema):
                found.append(entries(lambda n, p=pattern: f"{n} rlike {lit(java(p))}", sub))
        if asserts(schema.get("additionalProperties")) and schema["additionalProperties"] is not False:
            found.append(entries(lambda n: f"not {known_name(n, schema.get('properties', ()), schema.get('patternProperties', ()))}", place.sub("additionalProperties")))
        if asserts(schema.get("propertyNames")) and schema["propertyNames"] is not False:
            found.append(each(over(spot.keys, lambda n: self.result(place.sub("propertyNames"), Spot(f"cast({n} as variant)", (), (spot.path,)), False))))
        if asserts(schema.get("items")):
            found.append(each(over(spot.items, lambda v, i: self.result(place.sub("items"), spot.below(v, i), False), True)))
        return found

    def member(self, place: Place, spot: Spot) -> str:
        """Errors of a value that may be absent."""
        return self.once(self.shared.key(place, spot), NO_ERRORS, lambda: f"if({spot.v} is null, {NO_ERRORS}, {self.result(place, spot, False)})")

    def branch(self, place: Place, spot: Spot, want: bool) -> str:
        """A branch; one that is a reference and nothing else may be shared with other branches that refer there."""
        if isinstance(place.schema, dict) and set(place.schema) - NOTES == {"$ref"} and spot.steps:
            place = place.target()
            return self.once(self.shared.key(place, spot, want), "null", lambda: self.result(place, spot, want))
        return self.result(place, spot, want)

    def once(self, key, empty: str, write: Callable[[], str]) -> str:
        """What write() gives, as a column if it is asked for more than once."""
        shared = self.shared
        if key is None:
            return write()
        if self.counting:
            shared.asked[key] += 1
            return write() if shared.asked[key] == 1 else empty  # what lies below is counted with it
        if shared.asked[key] < 2:
            return write()
        if key not in shared.columns:
            sql = write()
            shared.columns[key] = (f"__wf_s{len(shared.columns)}", sql)
        return shared.columns[key][0]

    def holds(self, place: Place, spot: Spot) -> str:
        return has_constants(place.schema, spot) if simple(place.schema) else f"size({self.result(place, spot, False)}) = 0"

    def choice(self, place: Place, word: str, spot: Spot, want: bool) -> str:
        """oneOf and anyOf: each branch is bound once."""
        branches = [self.branch(place.sub(word, str(i)), spot, want) for i in range(len(place.schema[word]))]
        of = ".e" if want else ""

        def summed(bs: str, right: str) -> str:
            nothing = error(spot.path, place.name, word, lit(f"{word} failed" + (", none matched" if word == "oneOf" else "")))
            e = f"case when size({right}) = 0 then concat(array({nothing}), flatten({over(bs, lambda b: b + of)}))"
            if word == "oneOf":
                several = f"concat('oneOf failed, subschemas ', array_join({right}, ', '), ' matched')"
                e += f" when size({right}) > 1 then array({error(spot.path, place.name, word, several)})"
            e += f" else {NO_ERRORS} end"
            return f"named_struct('e', {e}, 'n', flatten({over(right, lambda i: f'{bs}[int({i})].n')}))" if want else e

        def judged(bs: str) -> str:
            return let(f"array_compact({over(bs, lambda b, i: f'if(size({b}{of}) = 0, string({i}), null)', True)})", lambda right: summed(bs, right))

        return let(f"array({', '.join(branches)})", judged)

    def condition(self, place: Place, spot: Spot, want: bool) -> str:
        """if, then and else."""
        test = place.sub("if")
        empty = f"named_struct('e', {NO_ERRORS}, 'n', {NO_NAMES})" if want else NO_ERRORS
        then, other = (self.result(place.sub(word), spot, want) if asserts(place.schema.get(word)) else empty for word in ("then", "else"))
        if not want:
            return f"if({self.holds(test, spot)}, {then}, {other})"

        def with_names(names: str) -> str:
            return let(then, lambda t: f"named_struct('e', {t}.e, 'n', concat({names}, {t}.n))")

        if simple(test.schema):
            return f"if({has_constants(test.schema, spot)}, {with_names(texts(test.schema.get('properties', ())))}, {other})"
        return let(self.result(test, spot, True), lambda c: f"if(size({c}.e) = 0, {with_names(f'{c}.n')}, {other})")


def expressions(schema: Place | dict, v: str) -> tuple[dict[str, str], str]:
    """SQL for the broken rules of a variant column, and for the columns that it reads besides."""
    place = schema if isinstance(schema, Place) else Catalog({"S": schema}).place("S")
    check_schema(place.schema, place, place.pointer)
    return Compiler(v).compile(place)


def checked(rows: DataFrame, key: str, document: str, schema: Place | dict) -> DataFrame:
    """key and errors of a JSON text column; text that is not JSON has one error."""
    broken = "array(named_struct('path', '', 'schema', 'S#', 'message', 'not a JSON document'))"
    shared, found = expressions(schema, "__wf_v")
    read = rows.select(key, F.try_parse_json(document).alias("__wf_v"))
    if shared:
        read = read.select(key, "__wf_v", *(F.expr(sql).alias(name) for name, sql in shared.items()))
    return read.select(key, F.expr(f"if(__wf_v is null, {broken}, {found})").alias("errors"))


def dispatched(rows: DataFrame, key: str, document: str, schemas: dict[tuple[str, str], Place | dict]) -> DataFrame:
    """checked() by a document's theme and type; a pair that no schema has is an error."""
    v = F.try_parse_json(document)
    read = rows.select(key, v.alias("__wf_v")).withColumns({"__wf_theme": as_text(pointer(F.col("__wf_v"), "/properties/theme")), "__wf_type": as_text(pointer(F.col("__wf_v"), "/properties/type"))})
    made = {k: Compiler("__wf_v").compile(schema if isinstance(schema, Place) else Catalog({"S": schema}).place("S")) for k, schema in schemas.items()}
    if any(shared for shared, _ in made.values()):
        raise ValueError("schemas with branches that share rules are checked as one catalog")
    branches = " ".join(f"when __wf_theme = {lit(theme)} and __wf_type = {lit(type_)} then {found}" for (theme, type_), (_, found) in made.items())
    nothing = "array(named_struct('path', '', 'schema', 'S#/oneOf', 'message', 'oneOf failed, none matched'))"
    return read.select(key, F.expr(f"case {branches} else {nothing} end").alias("errors"))


@functools.cache
def _shipped() -> str:
    return os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "catalog")


def feature_catalog(spark: SparkSession, folder: str | None = None) -> Place:
    """The root schema of a folder's catalog; by default the 15 published feature types, which ship with this package."""
    if folder is None:
        return Catalog.of_folder(_shipped(), GEOJSON).place("schema.yaml")
    return Catalog.load(spark, folder, GEOJSON).place("schema.yaml")


def each_error(found: DataFrame, key: str) -> DataFrame:
    """A row for each error. (explode_outer, as Spark would evaluate the errors twice to filter rows before an explode.)"""
    return found.select(key, F.explode_outer("errors").alias("e")).where("e is not null")


def lines(found: Column, full: bool = False) -> Column:
    """Errors as text: at '<path>' [<schema>]: <message>; the schema's file is spelled S, or in full below `schema/`."""
    at = (lambda e: F.concat(F.lit("schema/"), e["schema"])) if full else (lambda e: F.regexp_replace(e["schema"], r"^[^#]*#", "S#"))
    return F.transform(found, lambda e: F.concat(F.lit("at '"), e["path"], F.lit("' ["), at(e), F.lit("]: "), e["message"]))


def expected(document: Column) -> Column:
    """The texts that a document says its errors must contain; empty if it says none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(document), "$.properties.ext_expected_errors", "array<string>"), F.array().cast("array<string>"))


def missed(found: Column, wanted: Column) -> Column:
    """Expected texts that are part of no error's line, in either spelling."""
    text = F.concat(lines(found), lines(found, True))
    return F.filter(wanted, lambda w: ~F.exists(text, lambda line: F.contains(line, w)))


def with_default(v: Column, schema: dict, name: str, kind_: str) -> Column:
    """A member's value, or the default that the schema notes for it; validation itself never fills one in."""
    return F.coalesce(F.try_variant_get(v, f"$.{name}", kind_), F.lit(schema["properties"][name].get("default")).cast(kind_))
