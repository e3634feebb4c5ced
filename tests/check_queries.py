"""Compare queries with their SQL: python tests/check_queries.py [prefix ...]  (SF_DIR selects the data)."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import harness
import __spark_entry__ as entry
from funnelwright.session import build_session


def main() -> int:
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = harness.duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [n for n in queries if not sys.argv[1:] or any(n.startswith(p) for p in sys.argv[1:])]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problems, n = harness.compare(df, oracles[name], con)
                note = "match" if n else "match EMPTY"
            else:
                problems, note = [], f"{df.count()} rows, no sql"
        except Exception as exc:  # noqa: BLE001
            problems, note = [f"{type(exc).__name__}: {str(exc)[:900]}"], ""
        bad += bool(problems)
        if problems or "EMPTY" in note or os.environ.get("VERBOSE"):
            print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {problems or note}", flush=True)
    print(f"{len(wanted)} queries, {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
