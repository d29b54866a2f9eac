"""Run queries next to their SQL: ``python tests/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


# Spark and DuckDB names of the types results may have.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, int]:
    """What differs ('' if nothing) and the number of rows."""
    df = queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = con.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", sum(got.values())
    types = {d[0]: str(d[1]) for d in result.description}
    odd = {c: (t, types[c]) for c, t in df.dtypes if TYPES.get(t) != types[c]}
    if odd:
        return f"types {odd}", sum(got.values())
    if got != want:
        only_got = list((got - want).items())[:2]
        only_want = list((want - got).items())[:2]
        return (
            f"{sum(got.values())} rows against {sum(want.values())}; "
            f"only here {only_got}; only there {only_want}"
        ), sum(got.values())
    return "", sum(got.values())


def main() -> int:
    from feedloom.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            difference, n = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            difference, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        bad += bool(difference)
        print(f"{name:28} {n:7} rows {time.time() - start:6.2f} s  {difference or 'ok'}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
