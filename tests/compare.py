"""Run each registered query and its SQL twin and compare the rows."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in data)


def compare(spark, connection, folder: str, query, sql: str) -> tuple[int, str]:
    """``(row count, '' or what differs)``."""
    frame = query(spark, folder)
    ours = rows(frame.columns, frame.collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return sum(ours.values()), f"columns {sorted(frame.columns)} / {sorted(names)}"
    if ours != theirs:
        return sum(ours.values()), (
            f"{sum(ours.values())} / {sum(theirs.values())} rows; "
            f"only ours {list((ours - theirs))[:3]} only theirs {list((theirs - ours))[:3]}"
        )
    return sum(ours.values()), ""


if __name__ == "__main__":
    import pathlib

    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
    from __spark_entry__ import oracle_sql, queries
    from contactmine.session import session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                    spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, bad = duck(folder), oracle_sql(), 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            count, difference = compare(spark, connection, folder, query, oracles[name])
        except Exception as failure:
            count, difference = 0, f"{type(failure).__name__}: {str(failure)[:1500]}"
        bad += bool(difference)
        print(f"{name:34} {count:7} {time.time() - start:6.2f}s {difference or 'ok'}", flush=True)
    print("differences:", bad)
