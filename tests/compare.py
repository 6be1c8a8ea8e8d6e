"""A query's rows beside those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        source = p if p.is_file() else p / "*.parquet"
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{source}'")
    return db


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What differs: columns, counts, the first few rows."""
    db = database(sf_dir)
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    want = rows(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    if len(have) != len(want):
        return [f"{len(have)} and {len(want)} rows", str(have[:3]), str(want[:3])]
    return [f"{a} / {b}" for a, b in zip(have, want, strict=True) if a != b][:4]
