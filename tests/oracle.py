"""Runs a query's SQL in DuckDB and compares the rows, whatever their order."""

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    rows = sorted(df.itertuples(index=False, name=None), key=repr)
    return pd.DataFrame(rows, columns=df.columns, dtype=object)


def compare(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    """Empty when both hold the same rows and kinds of columns."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    kinds = {
        c: (ours[c].dtype, theirs[c].dtype) for c in ours.columns if ours[c].dtype != theirs[c].dtype
    }
    if kinds:
        return f"types {kinds}"
    a, b = normal(ours), normal(theirs)
    if not a.equals(b):
        wrong = [(x, y) for x, y in zip(a.itertuples(index=False), b.itertuples(index=False)) if x != y]
        return f"{len(wrong)} rows differ, such as {wrong[:2]}"
    return ""
