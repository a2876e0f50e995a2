"""Runs a registered query and its SQL, and compares the rows."""

import duckdb

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, list | tuple) else v


def differences(spark, name: str, folder: str) -> str | None:
    """None if the rows and column names are the same, else what differs."""
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, folder)
    result = db.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    a = sorted(repr(tuple(_plain(r[c]) for c in sorted(names))) for r in df.collect())
    b = sorted(repr(tuple(_plain(r[names.index(c)]) for c in sorted(names))) for r in result.fetchall())
    if a != b:
        return f"{len(a)} and {len(b)} rows; first: {next(((x, y) for x, y in zip(a, b, strict=False) if x != y), None)}"
    return None if a else "no rows"
