"""Readers and writers of map features: GeoJSON documents and lines, CSV, labels, partitioned Parquet.

Features have id, geometry (array of struct(x, y) of a point or a line; null for other types), properties (map of strings), kind
(the geometry's type) and parts (any geometry as an array of parts, each an array of rings or of one line or point). All
reading is done by Spark, so any store works; rows without a usable geometry are left out, as are lines that are not JSON and
geometry collections (keep_bad keeps them, with null members and the line in `bad`).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import bound
from ..functions.lines import bbox, can_be_read, from_geojson, from_wkb, geojson_of_parts, geojson_of_wkt, kind_of_geojson, parts_from_geojson, to_wkb


def features_of(rows: DataFrame, text: str, keep_bad: bool = False) -> DataFrame:
    """id, geometry, properties of a column with one GeoJSON feature a row."""
    got = lambda path: F.get_json_object("text", path)
    lines = bound(rows.select(F.col(text).alias("line")), text=F.rtrim(F.regexp_replace("line", r",\s*\z", "")))
    read = bound(lines, id=F.coalesce(got("$.id"), got("$.properties.id")), shape=got("$.geometry"), properties=F.from_json(got("$.properties"), "map<string,string>"))
    known = bound(read, parts=parts_from_geojson(F.col("shape")))
    known = bound(known, kind=F.when(can_be_read(F.col("parts")), F.get_json_object("shape", "$.type")))
    lost = F.col("kind").isNull()
    parsed = known.select("id", from_geojson(F.col("shape")).alias("geometry"), "properties", "kind", F.when(~lost, F.col("parts")).alias("parts"), F.when(lost, F.col("line")).alias("bad"))
    return parsed if keep_bad else parsed.where("kind is not null").drop("bad")


def geojson_lines(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """One feature a line; commas at the ends of lines are ignored."""
    return features_of(spark.read.text(path).where("length(trim(value)) > 0"), "value", keep_bad)


def geojson_document(spark: SparkSession, path: str) -> DataFrame:
    """Each file is a FeatureCollection or one feature."""
    whole = spark.read.text(path, wholetext=True)
    many = F.variant_get(F.try_parse_json("value"), "$.features", "array<variant>")
    one = F.when(F.get_json_object("value", "$.type") == "Feature", F.array(F.try_parse_json("value")))
    return features_of(whole.select(F.explode(F.coalesce(many, one)).alias("f")).select(F.to_json("f").alias("text")), "text")


def csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """id and geometry columns by name (exact first, then names that contain it), else POINT(lon lat); the rest are properties."""
    rows = spark.read.csv(path, header=True, sep=delimiter)
    named = lambda *words: next((c for w in words for c in rows.columns if c.lower() == w), None) or next((c for w in words for c in rows.columns if w in c.lower()), None)
    shape, key = named("geometry", "wkt"), named("id")
    lon, lat = (next((c for c in rows.columns if c.lower() in names), None) for names in (("lon", "longitude"), ("lat", "latitude")))
    if shape is not None:
        text = geojson_of_wkt(F.col(f"`{shape}`"))
    elif lon is not None and lat is not None:
        x, y = F.col(f"`{lon}`").try_cast("double"), F.col(f"`{lat}`").try_cast("double")
        text = F.when(x.isNotNull() & y.isNotNull(), F.concat(F.lit('{"type":"Point","coordinates":'), F.to_json(F.array(x, y)), F.lit("}")))
    else:
        raise ValueError(f"{path} has neither a geometry column nor lon and lat")
    rest = [c for c in rows.columns if c not in (key, shape)]
    pairs = [v for c in rest for v in (F.lit(c), F.col(f"`{c}`"))]
    properties = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    ident = F.col(f"`{key}`") if key is not None else F.lit(None).cast("string")
    return rows.select(ident.alias("id"), from_geojson(text).alias("geometry"), properties.alias("properties"), kind_of_geojson(text).alias("kind"), parts_from_geojson(text).alias("parts")).where("kind is not null")


def features(spark: SparkSession, path: str, lines: bool = False, delimiter: str = ",", wanted: dict[str, str] | None = None, most: int = 0) -> DataFrame:
    """By the file's ending: geojson and json, or csv, tsv and txt; only features with the wanted properties, `most` at most (0: all)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("geojson", "json"):
        found = geojson_lines(spark, path) if lines else geojson_document(spark, path)
    elif kind in ("csv", "tsv", "txt"):
        found = csv(spark, path, "\t" if kind == "tsv" else delimiter)
    else:
        raise ValueError(f"no reader for .{kind}")
    found = having(found, wanted)
    return found.limit(most) if most > 0 else found


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by the order columns. A maximum of structs, so that the group-by combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """trace_id, point_index, wkt, label_id of a tab-separated file; rows whose index is no number are left out.

    Of several labels of a point the last one in the file counts (by file name, then by place in the file).
    """
    rows = spark.read.csv(path, sep="\t", header=False, schema="trace_id string, point_index string, wkt string, label_id string")
    numbered = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    known = numbered.withColumn("point_index", F.col("point_index").try_cast("int")).where("point_index is not null")
    return last_wins(known, ["trace_id", "point_index"], ["file", "block", "line"]).select("trace_id", "point_index", "wkt", "label_id")


def as_features(rows: DataFrame, key: str, geometry: str) -> DataFrame:
    """id (string), geometry, properties (map of strings: all other columns with a value) and connector_ids.

    Connector ids are those of the column connector_ids, else those in connectors (structs with connector_id), else none.
    """
    rest = [c for c in rows.columns if c not in (key, geometry)]
    value = lambda c: F.col(f"`{c}`").cast("string") if dict(rows.dtypes)[c].split("<")[0] not in ("array", "struct", "map") else F.to_json(f"`{c}`")
    pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), value(c).alias("value")) for c in rest)), lambda p: p["value"].isNotNull()) if rest else None
    properties = F.map_from_entries(pairs) if rest else F.create_map().cast("map<string,string>")
    ids = [F.col("connector_ids")] if "connector_ids" in rows.columns else []
    ids += [F.transform("connectors", lambda c: c["connector_id"])] if "connectors" in rows.columns else []
    return rows.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{geometry}`").alias("geometry"), properties.alias("properties"), F.coalesce(*ids, F.array().cast("array<string>")).alias("connector_ids"))


def having(feats: DataFrame, wanted: dict[str, str] | None) -> DataFrame:
    """Features whose properties have all the wanted values, in order; "*" asks for presence only.

    "id" means the feature's id and ends the list: conditions after it are not looked at.
    """
    for name, value in (wanted or {}).items():
        if name == "id":
            return feats.where(F.col("id") == value)
        at = F.try_element_at("properties", F.lit(name))
        feats = feats.where(at.isNotNull() if value == "*" else at == value)
    return feats


def write_geojson_lines(feats: DataFrame, path: str) -> None:
    """One feature a line, null members kept; features with kind and parts are written by them, others as points and lines."""
    kind = F.when(F.size("geometry") == 1, "Point").otherwise("LineString")
    parts = F.when(F.col("geometry").isNotNull(), F.array(F.array("geometry")))
    if {"kind", "parts"} <= set(feats.columns):
        kind, parts = F.coalesce("kind", kind), F.coalesce("parts", parts)
    member = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}\z', 1)
    line = F.concat(F.lit('{"type":"Feature","id":'), member(F.col("id")), F.lit(',"geometry":'), F.coalesce(geojson_of_parts(kind, parts), F.lit("null")), F.lit(',"properties":'), F.coalesce(F.to_json("properties"), F.lit("null")), F.lit("}"))
    feats.select(line.alias("value")).write.text(path)


SOURCES = "array<struct<property:string,dataset:string,record_id:string,update_time:string,confidence:double,between:array<double>>>"


def write_table(feats: DataFrame, path: str) -> None:
    """The published layout: Parquet in folders by theme and type, geometry as well-known binary with its box.

    Features without a version or sources get version 1 and no sources. Points and lines only; the file's own metadata
    about geometry columns is not written.
    """
    box = bbox(F.col("geometry"))
    box = F.struct(*(box[side].cast("float").alias(side) for side in ("xmin", "xmax", "ymin", "ymax")))
    more = {"version": F.lit(1), "sources": F.array().cast(SOURCES)}
    shaped = feats.withColumn("bbox", F.when(F.size("geometry") > 0, box)).withColumn("geometry", to_wkb(F.col("geometry")))
    shaped.withColumns({name: value for name, value in more.items() if name not in feats.columns}).write.partitionBy("theme", "type").parquet(path)


def read_table(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features of the published layout with decoded geometry; box (xmin, ymin, xmax, ymax) keeps what meets it.

    The box is compared with the column bbox, so that the scan skips row groups and no geometry outside it is decoded.
    """
    rows = spark.read.parquet(path)
    if box is not None:
        xmin, ymin, xmax, ymax = box
        rows = rows.where((F.col("bbox.xmin") <= xmax) & (F.col("bbox.xmax") >= xmin) & (F.col("bbox.ymin") <= ymax) & (F.col("bbox.ymax") >= ymin))
    return rows.withColumn("geometry", from_wkb(F.col("geometry")))


def frame(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """GeoJSON features with the coordinate system that the format fixes."""
    return (geojson_lines if lines else geojson_document)(spark, path).withColumn("crs", F.lit("EPSG:4326"))


@F.pandas_udf(StringType())
def json_of_yaml(texts: pd.Series) -> pd.Series:
    """JSON text of YAML text, with dates left as text; null for text that is not YAML."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the package yaml") from e

    class Plain(yaml.SafeLoader):
        yaml_implicit_resolvers = {c: [r for r in rs if not r[0].endswith(":timestamp")] for c, rs in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    def one(text):
        try:
            return None if text is None else json.dumps(yaml.load(text, Plain))
        except (yaml.YAMLError, TypeError, ValueError):
            return None

    return texts.map(one)


def instances(spark: SparkSession, path: str) -> DataFrame:
    """path and document (JSON text) of every .json, .yaml and .yml file below a folder, sorted by path.

    A file that does not parse has a null document. Files are read and parsed in tasks, one row each.
    """
    kind = F.lower(F.substring_index(F.col("path"), ".", -1))
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    files = files.where(kind.isin("json", "yaml", "yml"))
    plain = files.where(kind == "json").select("path", F.to_json(F.try_parse_json("value")).alias("document"))
    return plain.unionAll(files.where(kind != "json").select("path", json_of_yaml("value").alias("document"))).orderBy("path")


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated with a header; missing values are empty."""
    rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns)).write.csv(path, sep="\t", header=True, emptyValue="")
