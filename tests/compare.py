"""Compare a Spark result with the rows of its SQL counterpart in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def kind(name: str) -> str:
    name = name.lower()
    for whole in ("bigint", "integer", "int", "hugeint", "smallint"):
        if name == whole:
            return {"integer": "int"}.get(name, name)
    return {"varchar": "string", "double": "double", "boolean": "boolean"}.get(name, name)


def check(df, con, sql: str) -> int:
    relation = con.sql(sql)
    want_types = {c: kind(str(t)) for c, t in zip(relation.columns, relation.types)}
    got_types = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    assert got_types == want_types, f"schemas differ: {got_types} against {want_types}"
    want = rows(relation.columns, relation.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want), f"{len(got)} rows against {len(want)}"
    for g, w in zip(got, want):
        assert g == w, f"{g} against {w}"
    return len(got)
