"""Compare registered queries with their DuckDB SQL: python tests/oracle.py SF_DIR [NAME...]."""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(v[i] for i in order) for v in values), key=lambda r: tuple((x is None, str(type(x)) if x is None else "", str(x)) for x in r))


def compare(spark, duck, name, query, sql, sf_dir):
    """None if both give the same rows, and some; else what differs."""
    df = query(spark, sf_dir)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    rel = duck.sql(sql)
    want = rows(rel.fetchall(), rel.columns)
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        diff = next(((a, b) for a, b in zip(got[1], want[1]) if a != b), "")
        return f"{len(got[1])} and {len(want[1])} rows; first difference: {diff}"
    return None if got[1] else "no rows on either side, which proves nothing"


def connect(sf_dir):
    import duckdb

    duck = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return duck


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    duck, oracles = connect(sys.argv[1]), entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or name.startswith(("op", "pipeline")) and not sys.argv[2:]:
            continue
        began = time.time()
        try:
            said = compare(session, duck, name, query, oracles[name], sys.argv[1]) if name in oracles else f"rows only: {query(session, sys.argv[1]).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {'same' if said is None else said} ({time.time() - began:.1f} s)", flush=True)
