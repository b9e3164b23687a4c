"""Compare registered queries with their SQL, value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


# Spark's names of the checking engine's types.
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}


def differences(df, db: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty text if both results are equal, else what differs first."""
    ours = _sorted(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    result_types = result.description
    theirs = _sorted([d[0] for d in result_types], result.fetchall())
    types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result_types}
    if types != dict(df.dtypes):
        return f"types {sorted(set(dict(df.dtypes).items()) ^ set(types.items()))}"
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows and {len(theirs[1])} rows"
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            return f"{a} and {b}"
    return ""
