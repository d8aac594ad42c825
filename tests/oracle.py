"""Runs registered queries against their DuckDB SQL."""

from __future__ import annotations

import sys

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object).map(lambda x: None if x is None or x is pd.NA or x != x else round(float(x), 6) if isinstance(x, float) else str(x) if isinstance(x, str) else float(x) if hasattr(x, "real") else str(x))
    return df.iloc[df.astype(str).apply(lambda r: tuple(r), axis=1).argsort().to_numpy()].reset_index(drop=True) if len(df) else df


def difference(spark, sf_dir: str, con, query, sql: str) -> str:
    """Empty if both give the same rows."""
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    a, b = _sorted(ours), _sorted(theirs)
    odd = (a.astype(str) != b.astype(str)).any(axis=1)
    return f"{odd.sum()} of {len(a)} rows differ, first\n{a[odd].head(2).to_string()}\n{b[odd].head(2).to_string()}" if odd.any() else ""


if __name__ == "__main__":
    import time

    from sightline.registry import ORACLES, QUERIES
    from sightline.session import local_session

    spark, d = local_session(8, 8), "/root/testdata/sf0.01"
    con = connect(d)
    for name in sys.argv[1:] or QUERIES:
        began = time.time()
        try:
            said = difference(spark, d, con, QUERIES[name], ORACLES[name])
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{name}: {said or 'equal'} {time.time() - began:.1f} s", flush=True)
