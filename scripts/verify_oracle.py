"""Run registered queries in Spark and their oracle statements in DuckDB and compare the results.

usage: python scripts/verify_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stockweave.queries import ORACLES, QUERIES  # noqa: E402
from stockweave.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows_of(frame, columns):
    frame = frame[columns]
    values = [frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in columns]
    rows = [tuple(str(v) if type(v).__name__ in ("Timestamp", "date", "datetime") else v for v in r) for r in zip(*values)]
    return sorted((tuple(x[:10] if isinstance(x, str) and x.endswith(" 00:00:00") else x for x in r) for r in rows), key=repr)


SPARK_KIND = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "int": "INTEGER"}


def main() -> int:
    args = sys.argv[1:]
    path = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    bad = []
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, path)
            got = df.toPandas()
            took = time.time() - started
            if name not in ORACLES:
                print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            relation = con.sql(ORACLES[name])
            want = relation.df()
            problems = []
            spark_types = {f.name: SPARK_KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
            duck_types = dict(zip(relation.columns, map(str, relation.types)))
            if spark_types != duck_types:
                problems.append(f"types {spark_types} vs {duck_types}")
            if set(got.columns) == set(want.columns):
                cols = sorted(got.columns)
                a, b = rows_of(got, cols), rows_of(want, cols)
                if len(a) != len(b):
                    problems.append(f"rows {len(a)} vs {len(b)}")
                if a != b:
                    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                    problems.append(f"values {cols} {diff}")
            if len(want) == 0:
                problems.append("no rows")
            if problems:
                bad.append(name)
                print(f"FAIL  {name} {took:.1f}s: " + "; ".join(problems), flush=True)
            else:
                print(f"ok    {name}: {len(got)} rows {took:.1f}s", flush=True)
        except Exception as exc:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR {name}: {type(exc).__name__} {str(exc)[:1500]}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} good; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
