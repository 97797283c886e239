"""Compare registered queries with their SQL twins: schema, row count and exact values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v

    rows = [tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", "") for v in r))


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    relation = con.sql(sql)
    spark_schema = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema}
    duck_schema = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    duck_schema = {n: ("TIMESTAMP" if t.startswith("TIMESTAMP") else t) for n, t in duck_schema.items()}
    if spark_schema != duck_schema:
        return "schema: " + str(
            {k: (spark_schema.get(k), duck_schema.get(k)) for k in spark_schema.keys() | duck_schema.keys()
             if spark_schema.get(k) != duck_schema.get(k)}
        )
    ours, theirs = canonical(spark_df.toPandas()), canonical(relation.df())
    if len(ours) != len(theirs):
        return f"rows: {len(ours)} and {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"first difference: {a} and {b}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from cellgrid.session import local_session

    folder = sys.argv[1]
    chosen = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    twins = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in twins:
                result = compare(df, con, twins[name])
                note = "ok" if result is None else "DIFF " + result
            else:
                note = f"rows only: {len(df.collect())}"
        except Exception as err:  # report and go on with the next query
            note = f"ERROR {type(err).__name__}: {str(err)[:600]}"
        print(f"{time.time() - start:6.2f}s {name}: {note}", flush=True)
