"""Benchmark: build the fact table once, then run the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list of registry keys, default: all Q entries).
Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
Each query is executed fully with Spark's no-op sink (all rows produced,
nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from caseflow.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus,
                      extra_conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")

    from caseflow.plans import registry
    from caseflow.plans.catalog import facts_table

    t0 = time.time()
    facts_table(spark, sf_dir).count()
    load = time.time() - t0

    wanted = os.environ.get("BENCH_QUERIES")
    names = [n for n in registry.queries() if n.startswith("q")] if not wanted else wanted.split(",")
    times: dict[str, float] = {"load_facts": round(load, 3)}
    for name in names:
        fn = registry.queries()[name]
        t = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    query_total = sum(v for k, v in times.items() if k != "load_facts")
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(query_total, 3), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "load_seconds": round(load, 3), "cpus": cpus, "n_queries": len(names),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
