"""Run every registered query against its DuckDB oracle (what the driver's gate does).

usage: python tests/run_oracle.py [sf_dir] [name-substring ...]
"""
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

from compare import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from caseflow.session import get_spark  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = get_spark("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                problems, n = compare(df, con, sqls[name])
            else:
                problems, n = [], df.count()
        except Exception as exc:  # report and continue
            problems, n = [f"{type(exc).__name__}: {str(exc)[:600]}"], -1
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{status} {name:40s} rows={n:7d} {time.time() - t:6.2f}s {'' if name in sqls else '(rows-only)'}",
              flush=True)
        for p in problems:
            print("    ", p[:1500], flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
