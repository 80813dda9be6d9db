"""Run registered queries beside their SQL twins: python tests/oracle.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in row)


# Spark type -> the DuckDB type a twin must give.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(spark, con, sf_dir: str, run, sql: str) -> str | None:
    """What differs between the two results, as unordered rows, or None."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    ours = Counter(_key(tuple(r)) for r in df.select(*names).collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    order = [columns.index(n) for n in names]
    for name, kind in df.select(*names).dtypes:
        theirs = str(result.description[columns.index(name)][1])
        if theirs != TYPES[kind]:
            return f"{name} is {kind} against {theirs}"
    theirs = Counter(_key(tuple(r[i] for i in order)) for r in result.fetchall())
    if ours == theirs:
        return None
    more, less = list((ours - theirs).elements()), list((theirs - ours).elements())
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; {len(more)} only in Spark, "
        f"e.g. {str(more[:1])[:600]}; {len(less)} only in SQL, e.g. {str(less[:1])[:600]}"
    )


if __name__ == "__main__":
    import __spark_entry__ as E
    from docvec.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark, con = local_session(), connect(sf_dir)
    for name, run in E.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            found = differences(spark, con, sf_dir, run, E.oracle_sql()[name])
        except Exception as error:
            found = f"failed: {type(error).__name__} {str(error)[:1500]}"
        print(f"{name:24s} {time.time() - start:6.2f}s {found or 'equal'}", flush=True)
