"""Run registered queries and their SQL side by side: ``python tests/compare.py <folder> [names]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(names: list[str], records) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    shaped = []
    for record in records:
        shaped.append(tuple(record[i] for i in order))
    return sorted(shaped, key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if both give the same names and rows."""
    got_names = df.columns
    answer = con.execute(sql)
    want_names = [d[0] for d in answer.description]
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    got = rows(got_names, [tuple(r) for r in df.collect()])
    want = rows(want_names, answer.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}: only here {_only(got, want)}, only there {_only(want, got)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None


def _only(a: list, b: list) -> list:
    other = set(map(repr, b))
    return [x for x in a if repr(x) not in other][:3]


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    source = sys.argv[1]
    database = connect(source)
    oracles = entry.oracle_sql()
    bad = 0
    for key, build in entry.queries().items():
        if sys.argv[2:] and key not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            result = difference(build(session, source), database, oracles[key]) if key in oracles else "no SQL"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:600]}"
        bad += result is not None
        print(f"{key:28s} {time.time() - start:6.2f}s  {result or 'same'}", flush=True)
    print("different:", bad)
