"""Compare registered queries with their DuckDB twins: python tests/oracle_check.py [sf] [key ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from staylens.session import build_session

TABLE_NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLE_NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, (float, decimal.Decimal)):
        return ("n", round(float(value), 9))
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("n", float(value))
    if isinstance(value, (dt.date, dt.datetime)):
        return ("d", str(value))
    return ("s", value)


def _sorted(rows):
    return sorted((tuple(_cell(value) for value in row) for row in rows), key=repr)




def compare(spark, connection, sf_dir: str, key: str) -> str:
    """An empty text when equal, else what differs."""
    frame = entry.queries()[key](spark, sf_dir)
    names = sorted(frame.columns)
    got = frame.select(*names).collect()
    sql = entry.oracle_sql().get(key)
    if sql is None:
        return "" if got else "no rows"
    relation = connection.execute(sql)
    expected_names = [column[0] for column in relation.description]
    if sorted(expected_names) != names:
        return f"columns {names} vs {sorted(expected_names)}"
    types = {c[0]: str(c[1]) for c in relation.description}
    spark_types = dict(frame.dtypes)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    notes = [
        f"{name}: {spark_types[name]} vs {types[name]}" for name in names if kinds.get(spark_types[name]) != types[name]
    ]
    order = [expected_names.index(name) for name in names]
    expected = [tuple(row[i] for i in order) for row in relation.fetchall()]
    left, right = _sorted(got), _sorted(expected)
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    if not left:
        return "both empty"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ: spark {wrong[0][0]} duckdb {wrong[0][1]}"
    return f"types {notes}" if notes else ""


def main(argv):
    sf = argv[0] if argv else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    keys = argv[1:] or list(entry.queries())
    if os.environ.get("PLAIN_SESSION"):  # a session that does not know this package
        spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    else:
        spark = build_session("oracle-check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, key)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {key} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{len(keys) - bad} of {len(keys)} good")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
