"""Compare registered queries with their SQL: python tests/check.py [sf_dir] [name part ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from session import local_session  # noqa: E402

import __spark_entry__ as spark_entry  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = local_session(), oracle.connect(sf_dir)
    spark.sparkContext.setLogLevel("OFF")
    sql = spark_entry.oracle_sql()
    bad = 0
    for name, fn in spark_entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            if name in sql:
                said = oracle.compare(fn(spark, sf_dir), con, sql[name]) or "ok"
            else:
                said = f"rows only: {len(fn(spark, sf_dir).collect())}"
        except Exception as error:
            said = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += said != "ok" and not said.startswith("rows only")
        print(f"{name:36} {time.time() - started:6.1f}s  {said}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
