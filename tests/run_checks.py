"""Compare named queries with their SQL: python tests/run_checks.py [sf] [name...]"""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

import oracle  # noqa: E402
import __spark_entry__ as entry_points  # noqa: E402
from reviewlens.scale import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = oracle.connect(folder)
    queries, checks = entry_points.queries(), entry_points.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in checks:
                outcome = oracle.compare(fn(spark, folder), checks[name], con)
            else:
                rows = len(fn(spark, folder).collect())
                outcome = "" if rows else "no rows"
        except Exception as error:  # report and go on
            outcome = f"{type(error).__name__}: {str(error)[:int(os.environ.get("MSG", "300"))]}"
        if outcome:
            failed.append(name)
        kind = "sql " if name in checks else "rows"
        print(f"{'FAIL' if outcome else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {outcome}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
