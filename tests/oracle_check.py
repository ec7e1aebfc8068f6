"""Run registered queries next to their SQL twins and compare them as row multisets.

    python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("f", 0.0 if v == 0 else v)
    if isinstance(v, int):
        return ("i", v)
    return ("s", str(v))


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


def compare(con, sql, df):
    """None when equal, else a short text."""
    got_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got, want = rows(df.columns, got_rows), rows(names, want_rows)
    if got != want:
        return (f"{len(got_rows)} rows vs {len(want_rows)}; only here "
                f"{list((got - want).items())[:2]}; only in SQL {list((want - got).items())[:2]}")
    return None


def main():
    import __spark_entry__ as entry
    from plantwatch.session import build
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                        "spark.ui.enabled": "false",
                                        "spark.ui.showConsoleProgress": "false",
                                        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name, build_query in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            df = build_query(spark, sf)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                note = f"rows {df.count()} (no SQL)"
            else:
                note = compare(con, sql, df)
                n = df.count()
                note = f"ok {n} rows" if note is None else f"DIFF {note}"
        except Exception as e:  # report and go on with the next query
            note = f"FAIL {type(e).__name__}: {str(e)[:900]}"
        bad += note.startswith(("DIFF", "FAIL"))
        print(f"{name}: {note} [{time.time() - t:.1f}s]", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
