"""Run one registered query on Spark and its SQL on DuckDB and compare every value."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return v
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


FAMILY = {
    "bigint": "int64", "int": "int32", "integer": "int32", "double": "double", "string": "text",
    "varchar": "text", "boolean": "bool",
}


def compare(spark, con, item, folder) -> str | None:
    """None when equal, else a short account of the difference."""
    df = item.run(spark, folder)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(item.sql)
    cols = [c[0] for c in cur.description]
    types = {c[0]: FAMILY.get(str(c[1]).lower(), str(c[1]).lower()) for c in cur.description}
    want_names, want = rows_of(cols, cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} vs {want_names}"
    mine = {n: FAMILY.get(t, t) for n, t in df.dtypes}
    if mine != types:
        return f"types {mine} vs {types}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. spark {str(bad[0][0])[:300]} sql {str(bad[0][1])[:300]}" if bad else None
