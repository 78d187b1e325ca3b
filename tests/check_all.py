"""Run every registered query against its SQL: python -m tests.check_all [sf] [name ...]"""

from __future__ import annotations

import sys
import traceback

from rankjobs.queries import registry
from rankjobs.session import local_session
from tests.compare import compare, connect

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    entries = registry()
    names = sys.argv[2:] or list(entries)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    failed = 0
    for name in names:
        run, sql = entries[name]
        try:
            problem, spark_s, sql_s, rows = compare(spark, db, run, sql, sf_dir)
        except Exception as error:  # noqa: BLE001
            problem, spark_s, sql_s, rows = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0, 0
            if "-v" in sys.argv:
                traceback.print_exc()
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} rows={rows:<8d} spark={spark_s:6.2f}s sql={sql_s:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
