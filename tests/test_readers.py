import json

import pytest
from pyspark.sql import functions as F

from wayfold.functions import lines
from wayfold.sources import readers

POINT = '{"type":"Feature","id":"a","geometry":{"type":"Point","coordinates":[1.5,2.5]},"properties":{"k":"v"}}'
LINE = '{"type":"Feature","id":"b","geometry":{"type":"LineString","coordinates":[[0,0],[0,1]]},"properties":{"k":"w"}}'


def shapes(df):
    return {r["id"]: [tuple(p) for p in r["geometry"]] for r in df.collect()}


WANT = {"a": [(1.5, 2.5)], "b": [(0.0, 0.0), (0.0, 1.0)]}


def test_geojson(spark, tmp_path):
    (tmp_path / "x.geojson").write_text(f'{{"type":"FeatureCollection","features":[{POINT},{LINE}]}}')
    (tmp_path / "one.json").write_text(POINT)
    (tmp_path / "y.geojson").write_text(f"{POINT},\n{LINE}\nnot json\n")
    assert shapes(readers.features(spark, str(tmp_path / "x.geojson"))) == WANT
    assert shapes(readers.features(spark, str(tmp_path / "one.json"))) == {"a": WANT["a"]}
    got = readers.features(spark, str(tmp_path / "y.geojson"), lines=True)
    assert shapes(got) == WANT
    assert shapes(readers.having(got, {"k": "w"})) == {"b": WANT["b"]} and readers.having(got, {"none": "*"}).count() == 0
    assert readers.geojson_lines(spark, str(tmp_path / "y.geojson"), keep_bad=True).where("bad is not null").count() == 1
    readers.write_geojson_lines(got, str(tmp_path / "out"))
    assert shapes(readers.geojson_lines(spark, str(tmp_path / "out"))) == WANT


def test_csv_and_labels(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,WKT,k\na,POINT (1.5 2.5),v\nb,\"LINESTRING (0 0, 0 1)\",w\nc,,z\n")
    (tmp_path / "y.csv").write_text("id,lon,lat\na,1.5,2.5\nd,x,1\n")
    assert shapes(readers.features(spark, str(tmp_path / "x.csv"))) == WANT
    assert shapes(readers.features(spark, str(tmp_path / "y.csv"))) == {"a": WANT["a"]}
    (tmp_path / "l.tsv").write_text("trace_id\tpoint_index\twkt\tlabel\nt\t0\tPOINT (1 2)\tg\n")
    assert [tuple(r) for r in readers.labels(spark, str(tmp_path / "l.tsv")).collect()] == [("t", 0, "POINT (1 2)", "g")]
    with pytest.raises(ValueError):
        readers.features(spark, "x.shp")


def test_nulls_and_empty_lines(spark):
    rows = spark.createDataFrame([("POINT EMPTY",), (None,), ("POLYGON ((0 0, 1 1))",), ("POINT (1 2)",)], "t string")
    assert [r[0] for r in rows.select(F.size(lines.from_wkt(F.col("t")))).collect()][3] == 1
    ring = F.from_json(F.lit('[{"x":0,"y":0},{"x":4,"y":0},{"x":4,"y":4},{"x":0,"y":4},{"x":0,"y":0}]'), lines.COORDINATES)
    inside = spark.range(1).select(lines.in_ring(F.lit(1.0), F.lit(1.0), ring), lines.in_ring(F.lit(5.0), F.lit(1.0), ring)).first()
    assert tuple(inside) == (True, False)


def test_printed_height_examples(spark):
    from wayfold.functions import tags

    want = {"10": 10, "   10  ": 10, "10.0": 10, "10.": 10, "10.6543": 10.6543, "10m": 10, " 10 meters": 10, "10.0 metre ": 10, "10. meter": 10, "10.6543meter": 10.6543, "10'": 3.05, "10.65 ft": 3.25, "10.65 feet ": 3.25, "10. '": 3.05, " 10.65feet ": 3.25, "10' 13\"": 3.38, "10'  13\" ": 3.38, "10'13\"": 3.38, "7\"": 0.18, "10 in": None, "tall": None, "-3": None, None: None}
    rows = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r[0]: r[1] for r in rows.select("t", tags.height_metres(F.col("t"))).collect()} == want


def test_languages_and_categories(spark):
    from wayfold.functions import tags

    want = {"en": "en", "ja_kana": "ja-Kana", "zh_pinyin": "zh-Latn-pinyin", "nan-POJ": "nan-Latn", "be-tarask": "be-Latn-tarask", "sr-Latn-RS": "sr-Latn-RS", "e": None, "en_x": None, "de-1996": "de-1996", "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r[0]: r[1] for r in rows.select("t", tags.language(F.col("t"))).collect()} == want
    line = spark.createDataFrame([("cafe; [eat_and_drink,cafe]",), ("none",), (None,)], "t string").select(tags.category_path(F.col("t")).alias("c")).collect()
    assert (line[0].c.category, line[0].c.path) == ("cafe", ["eat_and_drink", "cafe"]) and line[1].c is None and line[2].c is None


def test_long_chains_and_cycles_of_divisions(spark):
    from wayfold.operators import divisions

    chain = spark.createDataFrame([(f"d{i}", f"d{i - 1}" if i else None) for i in range(20)], "division_id string, parent_id string")
    assert divisions.ancestors(chain).where("division_id = 'd19'").count() == 20 and divisions.ancestors(chain).count() == 210
    with pytest.raises(ValueError):
        divisions.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "division_id string, parent_id string"))
    assert divisions.ancestors(chain.limit(0)).count() == 0


def test_reach_follows_metres_and_latitude(spark):
    from wayfold.operators import spatial

    def found(lat, east, most):
        y = round((lat - 32.80) * 1e6)
        points = spark.createDataFrame([(1, 0, float(east), float(y + 10))], "trace_id long, idx long, x double, y double")
        segs = spark.createDataFrame([(7, 0, y, 0, y + 2000)], "segment_id long, x1 long, y1 long, x2 long, y2 long")
        return [r.segment_id for r in spatial.nearest_segment(points, segs, most).collect()]

    assert found(32.8, 1120, 200.0) == [7] and found(32.8, 1120, 100.0) == []  # about 105 m
    assert found(60.0, -530, 30.0) == [7] and found(60.0, -560, 30.0) == []  # about 29.5 and 31.1 m
    assert found(-85.0, 2900, 30.0) == [7] and found(32.8, 4000, 500.0) == [7]


def test_all_geometry_types_and_cells(spark):
    text = {"Point": "[1,2]", "MultiPoint": "[[1,2],[3,4]]", "LineString": "[[0,0],[2,0]]", "MultiLineString": "[[[0,0],[2,0]],[[5,5],[5,6]]]", "Polygon": "[[[0,0],[4,0],[4,4],[0,4],[0,0]]]", "MultiPolygon": "[[[[0,0],[4,0],[4,4],[0,4],[0,0]]],[[[9,9],[10,9],[10,10],[9,9]]]]", "Circle": "[1]"}
    rows = spark.createDataFrame([(k, f'{{"type":"{k}","coordinates":{v}}}') for k, v in text.items()], "k string, g string").withColumn("p", lines.parts_from_geojson(F.col("g")))
    assert {r.k: r.n for r in rows.select("k", F.size("p").alias("n")).collect()} == {"Point": 1, "MultiPoint": 2, "LineString": 1, "MultiLineString": 2, "Polygon": 1, "MultiPolygon": 2, "Circle": None}
    cells = rows.where("k = 'MultiPolygon'").select(F.size(lines.multi_cells(F.col("p"), lambda part: lines.polygon_cells(part, F.lit(1.0)))).alias("n")).first()
    assert cells.n == 25 + 4  # the square reaches into a fifth row and column; the triangle's corners touch four cells
    hole = spark.range(1).select(F.size(lines.polygon_cells(F.from_json(F.lit('[[{"x":0,"y":0},{"x":9,"y":0},{"x":9,"y":9},{"x":0,"y":9},{"x":0,"y":0}],[{"x":3,"y":3},{"x":6,"y":3},{"x":6,"y":6},{"x":3,"y":6},{"x":3,"y":3}]]'), f"array<{lines.COORDINATES}>"), F.lit(1.0))).alias("n")).first()
    assert hole.n == 100 - 9
    steep = spark.range(1).select(lines.line_cells(F.from_json(F.lit('[{"x":0.5,"y":0.5},{"x":1.5,"y":3.5}]'), lines.COORDINATES), F.lit(1.0)).alias("c")).first().c
    assert sorted(map(tuple, steep)) == [(0, 0), (0, 1), (0, 2), (1, 2), (1, 3)] or sorted(map(tuple, steep)) == [(0, 0), (0, 1), (1, 2), (1, 3), (0, 2)]


def test_vehicle_and_sequences(spark):
    from wayfold.operators import rules

    entry = "array<struct<dimension:string,comparison:string,value:double,unit:string>>"
    rows = spark.createDataFrame([(1, [("weight", "greater_than", 3.5, "t")]), (2, [("height", "less_than_equal", 10.0, "ft"), ("axle_count", "equal", 2.0, None)]), (3, None), (4, [("length", "less_than", 1.0, "m")]), (5, [])], f"k int, v {entry}")
    facts = F.create_map(F.lit("weight"), F.lit(4000.0), F.lit("height"), F.lit(3.0), F.lit("axle_count"), F.lit(2.0))
    assert [r[0] for r in rows.orderBy("k").select(rules.vehicle_holds(F.col("v"), facts)).collect()] == [True, True, True, False, True]
    steps = [(1, 0, None, 10, "forward"), (1, 1, 100, 11, "forward"), (1, 2, 101, 12, "backward"), (2, 0, None, 9, "forward"), (2, 1, 99, 10, "forward"), (2, 2, 100, 11, "forward"), (2, 3, 101, 12, "forward"), (3, 0, None, 10, "forward"), (3, 1, 100, 11, "forward")]
    routes = spark.createDataFrame(steps, "route_id int, step int, connector_id int, segment_id int, heading string")
    bans = spark.createDataFrame([(1, 10, [(100, 11), (101, 12)], "backward"), (2, 9, [(99, 10), (100, 11)], "backward")], "restriction_id int, segment_id int, sequence array<struct<connector_id:int,segment_id:int>>, final_heading string")
    assert [r.route_id for r in rules.prohibited(routes, bans).collect()] == [1]


def test_published_layout(spark, tmp_path):
    rows = spark.createDataFrame([("a", [(1.5, 2.5)], "t1"), ("b", [(0.0, 0.0), (0.0, 1.0)], "t2"), ("c", None, "t2"), ("d", [], "t2")], f"id string, geometry {lines.COORDINATES}, type string")
    readers.write_table(rows.withColumn("theme", F.lit("x")), str(tmp_path / "out"))
    raw = spark.read.parquet(str(tmp_path / "out"))
    assert {"bbox", "version", "sources", "theme", "type"} <= set(raw.columns) and dict(raw.dtypes)["geometry"] == "binary"
    assert raw.where("bbox is null").count() == 2
    got = {r["id"]: r["geometry"] and [tuple(p) for p in r["geometry"]] for r in readers.read_table(spark, str(tmp_path / "out")).collect()}
    assert got == {**WANT, "c": None, "d": None}
    assert shapes(readers.read_table(spark, str(tmp_path / "out"), (1.0, 2.0, 3.0, 3.0))) == {"a": WANT["a"]}


def test_wkb_forms(spark):
    import struct

    big = struct.pack(">BIdd", 0, 1, 3.0, 4.0)
    forms = [big, big[:-1], struct.pack("<BI", 1, 3), b"", None, struct.pack("<BIIdddd", 1, 2, 2, 1.0, 2.0, 3.0, 4.0)]
    got = [r[0] and [tuple(p) for p in r[0]] for r in spark.createDataFrame([(f,) for f in forms], "w binary").select(lines.from_wkb(F.col("w"))).collect()]
    assert got == [[(3.0, 4.0)], None, None, None, None, [(1.0, 2.0), (3.0, 4.0)]]


def test_instance_files(spark, tmp_path):
    import json

    pytest.importorskip("yaml")
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.json").write_text('{"id": 1}')
    (tmp_path / "sub" / "a.yaml").write_text("id: x\nwhen: 2024-01-02T03:04:05Z\nlist: [1, 2.5, null]\n")
    (tmp_path / "bad.yml").write_text("a: [1\n")
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "notes.txt").write_text("no")
    got = [(r["path"].rsplit("/", 1)[1], r["document"] and json.loads(r["document"])) for r in readers.instances(spark, str(tmp_path)).collect()]
    assert got == [("b.json", {"id": 1}), ("bad.json", None), ("bad.yml", None), ("a.yaml", {"id": "x", "when": "2024-01-02T03:04:05Z", "list": [1, 2.5, None]})]


def test_frame(spark, tmp_path):
    (tmp_path / "x.geojson").write_text(POINT)
    assert [(r["id"], r["crs"]) for r in readers.frame(spark, str(tmp_path / "x.geojson")).collect()] == [("a", "EPSG:4326")]


SHAPES = {
    "Point": [1.5, -2], "MultiPoint": [[0, 0], [1, 1]], "LineString": [[0, 0], [1, 2]], "MultiLineString": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]],
    "Polygon": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]], "MultiPolygon": [[[[0, 0], [4, 0], [4, 4], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]], [[5, 5], [5.5, 5], [5.5, 5.5], [5, 5]]]],
}
WKT = {
    "Point": "POINT (1.5 -2)", "MultiPoint": "MULTIPOINT ((0 0), (1 1))", "LineString": "linestring(0 0,1 2)", "MultiLineString": "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))",
    "Polygon": "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MultiPolygon": "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5 5, 5.5 5, 5.5 5.5, 5 5)))",
}


def coordinates(kind, parts):
    nested = [[[[p.x, p.y] for p in ring] for ring in part] for part in parts]
    first = {"Point": nested[0][0][0], "LineString": nested[0][0], "Polygon": nested[0], "MultiPoint": [p[0][0] for p in nested], "MultiLineString": [p[0] for p in nested]}
    return first.get(kind, nested)


def test_all_geometry_types_are_read_and_written(spark, tmp_path):
    lines = [json.dumps({"type": "Feature", "id": k, "geometry": {"type": k, "coordinates": c}, "properties": {"a": "x"}}) for k, c in SHAPES.items()]
    lines += ['{"type":"Feature","id":"c","geometry":{"type":"GeometryCollection","geometries":[]},"properties":{}}', '{"type":"Feature","id":"n","geometry":null,"properties":{}}', '{"type":"Feature","id":"b","geometry":{"type":"Polygon","coordinates":[[[1,null]]]},"properties":{}}']
    (tmp_path / "a.geojson").write_text("\n".join(lines))
    got = {r.id: r for r in readers.geojson_lines(spark, str(tmp_path / "a.geojson")).collect()}
    assert {k: coordinates(k, r.parts) for k, r in got.items()} == SHAPES and all(r.kind == k and (r.geometry is not None) == (k in ("Point", "LineString")) for k, r in got.items())
    readers.write_geojson_lines(readers.geojson_lines(spark, str(tmp_path / "a.geojson")), str(tmp_path / "out"))
    again = {r.id: coordinates(r.kind, r.parts) for r in readers.geojson_lines(spark, str(tmp_path / "out")).collect()}
    assert again == SHAPES
    assert readers.geojson_lines(spark, str(tmp_path / "a.geojson"), keep_bad=True).where("bad is not null").count() == 3


def test_all_well_known_texts_are_read(spark, tmp_path):
    more = {"z": ("Point", "POINT Z (1 2 3)", [1, 2]), "m": ("MultiPoint", "MULTIPOINT (0 0, 1 1)", [[0, 0], [1, 1]]), "one": ("MultiPoint", "MULTIPOINT ((7 8))", [[7, 8]]), "e": ("LineString", "LINESTRING (1e1 .5, -2. 3)", [[10, 0.5], [-2, 3]])}
    rows = [(k, t) for k, t in WKT.items()] + [(k, t) for k, (_, t, _) in more.items()] + [("bad", "POLYGON ((0 0, 1"), ("none", "POINT EMPTY"), ("text", "hello")]
    (tmp_path / "a.csv").write_text("id;wkt\n" + "\n".join(f"{k};{t}" for k, t in rows))
    got = {r.id: (r.kind, coordinates(r.kind, r.parts)) for r in readers.csv(spark, str(tmp_path / "a.csv"), ";").collect()}
    assert got == {k: (k, c) for k, c in SHAPES.items()} | {k: (kind, c) for k, (kind, _, c) in more.items()}
