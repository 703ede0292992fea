"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float | decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(norm(x) for x in v)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def same(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    rows = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
