"""Run queries next to their oracle SQL and report the differences.

usage: python tests/verify.py [sf_dir] [name ...]
"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from furrow.session import build_session  # noqa: E402


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else repr(r[i]) for i in order) for r in rows)


def connect(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("verify", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = []
    for name in args or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            got, cols = [tuple(r) for r in df.collect()], df.columns
            took = time.time() - start
            if name not in oracle:
                print(f"{name}: rows only, {len(got)} rows, {took:.2f}s")
                continue
            cur = con.execute(oracle[name])
            want_cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            a, b = normal(got, cols), normal(want, want_cols)
            ok = sorted(cols) == sorted(want_cols) and a == b
            print(f"{name}: {'ok' if ok else 'DIFFERS'} {len(got)}/{len(want)} rows, {took:.2f}s")
            if not ok:
                bad.append(name)
                print("   columns", sorted(cols), sorted(want_cols))
                diff_a, diff_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
                print("   spark ", diff_a)
                print("   oracle", diff_b)
        except Exception as error:  # report and go on with the next query
            bad.append(name)
            print(f"{name}: ERROR {type(error).__name__}: {str(error)[:1500]}")
        sys.stdout.flush()
    print(f"{len(bad)} bad:", *bad)
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
