"""Comparison of a query's rows with DuckDB SQL over the same tables."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def cell(x):
    return None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(cell(x) for x in r) for r in frame.select(*names).collect()), key=repr)


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in cur.fetchall()), key=repr)
