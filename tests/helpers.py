"""Comparing a Spark result with DuckDB's."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c.sql(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if out[c].dtype.kind == "f":
            out[c] = out[c].round(5) + 0.0
        elif out[c].dtype.kind not in "iub":
            out[c] = out[c].map(lambda v: None if v is None or v is pd.NaT else str(pd.Timestamp(v)) if "date" in type(v).__name__.lower() or "time" in type(v).__name__.lower() else str(v))
    return sorted(map(repr, out.astype(object).where(out.notna(), None).values.tolist()))
