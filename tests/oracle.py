"""Comparison of a query with its SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def canonical(rows: list[dict]) -> list[tuple]:
    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 8)
        return x

    return sorted((tuple(plain(r[c]) for c in sorted(r)) for r in rows), key=repr)


def agree(spark, query, sql: str, sf_dir: str) -> None:
    mine = query(spark, sf_dir)
    theirs = connected(sf_dir).execute(sql)
    columns = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    expected = [dict(zip(columns, r, strict=True)) for r in theirs.fetchall()]
    assert canonical([r.asDict() for r in mine.collect()]) == canonical(expected)
