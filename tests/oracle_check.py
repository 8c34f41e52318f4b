"""Compare registered queries with their oracle SQL in DuckDB.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

import argparse
import datetime as dt
import decimal
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardflow.plans import registry  # noqa: E402
from wardflow.session import build_session  # noqa: E402

KINDS = {int: "int", float: "float", str: "str", bool: "bool", dt.datetime: "time", dt.date: "date",
         decimal.Decimal: "decimal", type(None): None}


def database(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(r[i] for i in order) for r in rows]
    return sorted(names), sorted(cells, key=repr)


def _kinds(rows, width):
    return [{KINDS.get(type(r[i]), type(r[i]).__name__) for r in rows} - {None} for i in range(width)]


def difference(spark_df, con, sql):
    """None when rows, columns, kinds and values agree; else a short text."""
    rel = con.sql(sql)
    want_names, want = _table(rel.columns, rel.fetchall())
    got_names, got = _table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if want_names != got_names:
        return f"columns {got_names} != {want_names}"
    if len(want) != len(got):
        return f"{len(got)} rows, oracle {len(want)}"
    kg, kw = _kinds(got, len(want_names)), _kinds(want, len(want_names))
    if kg != kw:
        return f"kinds {kg} != {kw}"
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {want_names}\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    return None


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    queries, oracles = registry.load()
    spark = build_session("oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                         "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    con = database(args.sf)
    failed = []
    for name in args.names or list(queries):
        begin = time.time()
        try:
            df = queries[name](spark, args.sf)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                note = "oracle"
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
                note = f"rows only: {n}"
        except Exception as e:  # report and go on with the next query
            problem, note = f"{type(e).__name__}: {str(e)[:1500]}", ""
        print(f"{'FAIL' if problem else 'ok  '} {name} [{note}] {time.time() - begin:.1f}s"
              + (f"\n  {problem}" if problem else ""), flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
