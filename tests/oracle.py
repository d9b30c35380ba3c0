"""Run queries against their SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb


def rows(values) -> list[tuple]:
    def plain(x):
        if isinstance(x, float):
            return round(x, 6)
        return str(x) if x is not None and not isinstance(x, (int, str, bool)) else x

    return sorted((tuple(plain(x) for x in r) for r in values), key=repr)


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = db.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return [found.columns[i] for i in order], rows(tuple(r[i] for i in order) for r in found.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, rows(tuple(r) for r in df.select(*columns).collect())
