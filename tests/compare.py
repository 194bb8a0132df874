"""Run registered queries against their SQL oracles on DuckDB."""

from __future__ import annotations

import collections
import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
    "double": "DOUBLE", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def compare(df, con, sql) -> list[str]:
    """Differences between a Spark result and an oracle, empty when they agree."""
    problems = []
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    want_rows = cur.fetchall()
    cols = sorted(df.columns)
    if cols != sorted(names):
        return [f"columns {cols} != {sorted(names)}"]
    for f in df.schema.fields:
        mine = SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
        if mine != types[f.name] and not types[f.name].startswith('"NULL"'):
            problems.append(f"type of {f.name}: {mine} != {types[f.name]}")
    got = collections.Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    order = [names.index(c) for c in cols]
    want = collections.Counter(tuple(norm(r[i]) for i in order) for r in want_rows)
    if sum(got.values()) != sum(want.values()):
        problems.append(f"rows {sum(got.values())} != {sum(want.values())}")
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        problems.append(f"cols {cols}\n  extra {extra}\n  missing {missing}")
    return problems
