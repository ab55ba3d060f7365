"""Compare every registered query with its SQL in DuckDB, or time them."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "NULL"
        if isinstance(x, float):
            return repr(x)
        return str(x)

    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    a, b = canonical(got), canonical(want)
    if a != b:
        only_got = [x for x in a if x not in set(b)][:3]
        only_want = [x for x in b if x not in set(a)][:3]
        return f"{sorted(got.columns)}\n  got  {only_got}\n  want {only_want}"
    if kinds(got) != kinds(want):
        return f"types {kinds(got)} against {kinds(want)}"
    return None


def main(folder: str, *wanted: str) -> None:
    import __spark_entry__ as entry
    from spanwave.session import local_session

    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = local_session(8, "compare")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, build in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            got = build(spark, folder).toPandas()
            spent = time.time() - start
            note = "rows only"
            if name in oracles:
                note = difference(got, con.execute(oracles[name]).df()) or "match"
        except Exception as error:  # noqa: BLE001
            got, spent, note = pd.DataFrame(), time.time() - start, f"ERROR {str(error)[:1200]}"
        if note not in ("match", "rows only"):
            bad.append(name)
        print(f"{name:34s} {len(got):7d} rows {spent:6.2f} s  {note}", flush=True)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
