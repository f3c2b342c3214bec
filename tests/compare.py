"""Runs registered queries beside their SQL and compares names, types and values."""

from __future__ import annotations

import math

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def kind(type_name: str) -> str:
    low = type_name.lower()
    return {"bigint": "int64", "integer": "int32", "int": "int32", "varchar": "string"}.get(low, low)


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def sort_key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def difference(df, con, sql: str) -> str | None:
    """What differs first, or None."""
    names = sorted(df.columns)
    types = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    described = {r[0]: kind(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if types != described:
        return f"schema: spark {types}, sql {described}"
    quoted = ", ".join(f'"{n}"' for n in names)
    want = [tuple(map(plain, r)) for r in con.execute(f"SELECT {quoted} FROM ({sql})").fetchall()]
    got = [tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    if len(got) != len(want):
        return f"rows: spark {len(got)}, sql {len(want)}"
    for a, b in zip(sorted(got, key=sort_key), sorted(want, key=sort_key)):
        if a != b:
            return f"{names}: spark {a}, sql {b}"
    return None
