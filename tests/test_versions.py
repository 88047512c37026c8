"""Versions that appear whole, the stored roll-up, files that hold narrow ranges."""
import datetime as dt
import os
import random

import pyarrow.parquet as pq
import pytest

from caseflow.operators.merge import merged_monthly
from caseflow.operators.schema import FACT_SCHEMA
from caseflow.plans import catalog, rollup, versions
from caseflow.plans import queries as Q
from pyspark.sql import functions as F

NAMES = FACT_SCHEMA.fieldNames()


def table(spark, rows):
    """Facts of (disease, state, start, source, count, county) rows."""
    data = []
    for name, state, start, source, count, county in rows:
        r = dict.fromkeys(NAMES, "x")
        r.update(disease_name=name, disease_slug=name.lower(), state=state, report_period_start=start, report_period_end=start + dt.timedelta(6),
                 data_source=source, count=count, geo_name=county)
        data.append(tuple(r[c] for c in NAMES))
    return spark.createDataFrame(data, FACT_SCHEMA)


def some_rows(n=400, seed=1):
    rng = random.Random(seed)
    return [(f"d{rng.randrange(12):02d}", rng.choice(["CA", "TX", "NY", ""]), dt.datetime(2022, 1, 2) + dt.timedelta(7 * rng.randrange(150)),
             rng.choice(["tracker", "nndss", "hospital"]), rng.choice([None, 0, 1, 5]), f"county {rng.randrange(40)}") for _ in range(n)]


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_failing_write_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "facts")
    first = catalog.write_facts(table(spark, some_rows()), path)
    before = sorted(map(str, first.collect()))
    broken = table(spark, some_rows(seed=2)).withColumn("count", F.when(F.col("state") == "TX", F.raise_error(F.lit("lost"))).otherwise(F.col("count")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        catalog.write_facts(broken, path)
    assert sorted(map(str, catalog.read_facts(spark, path).collect())) == before
    assert versions.numbers(spark, path) == [0]


def test_reader_of_the_version_before_is_not_disturbed(spark, tmp_path):
    path = str(tmp_path / "facts")
    old = catalog.write_facts(table(spark, some_rows(300)), path)
    new = catalog.write_facts(table(spark, some_rows(200, 3)), path)
    assert (old.count(), new.count(), catalog.read_facts(spark, path, 0).count()) == (300, 200, 300)
    catalog.write_facts(table(spark, some_rows(100, 4)), path)
    folders = [f for f in os.listdir(path) if f.startswith("v-")]
    assert len(folders) == 2 and versions.numbers(spark, path) == [1, 2]          # the oldest went


def test_two_writers_cannot_both_publish(spark, tmp_path):
    path = str(tmp_path / "facts")
    catalog.write_facts(table(spark, some_rows(10)), path)
    versions.publish(spark, path, {"folders": ["v-a"]}, 0)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, path, {"folders": ["v-b"]}, 0)
    assert versions.current(spark, path)["folders"] == ["v-a"]


def test_open_or_build(spark, tmp_path):
    path, built = str(tmp_path / "facts"), []

    def build():
        built.append(1)
        return table(spark, some_rows(50))

    assert catalog.open_or_build(spark, path, build).count() == 50 and len(built) == 1
    assert catalog.open_or_build(spark, path, build).count() == 50 and len(built) == 1
    [folder] = versions.current(spark, path)["folders"]
    for d, _, files in os.walk(f"{path}/{folder}"):        # half of the table is lost
        for f in files:
            if f.endswith(".parquet"):
                with open(f"{d}/{f}", "wb") as out:
                    out.write(b"PAR1")
                crc = f"{d}/.{f}.crc"
                if os.path.exists(crc):
                    os.remove(crc)
    assert catalog.open_or_build(spark, path, build).count() == 50 and len(built) == 2
    # a folder that was written but never published is no table
    table(spark, some_rows(20)).write.parquet(str(tmp_path / "other" / "v-1"))
    assert catalog.open_or_build(spark, str(tmp_path / "other"), build).count() == 50 and len(built) == 3


def test_refresh_computes_changed_parts_only(spark, tmp_path):
    root, rows = str(tmp_path / "rollup"), some_rows()
    facts = table(spark, rows)
    parts = {(r[3], r[2].strftime("%Y-%m")) for r in rows}
    assert len(rollup.refresh(facts, root)["changed"]) == len(parts)
    assert rollup.refresh(facts, root)["changed"] == [] and versions.numbers(spark, root) == [0]
    same(rollup.read(spark, root).drop("counties"), rollup.monthly_rollup(facts).select(*rollup.SCHEMA.names).drop("counties"))
    # two rows swap their counts within one part, a month goes, a row comes
    k = next(i for i, r in enumerate(rows) if r[4] == 5)
    gone = rows[0][2].strftime("%Y-%m") if rows[0][2].strftime("%Y-%m") != rows[k][2].strftime("%Y-%m") else "2024-01"
    changed = [(*r[:4], 6, r[5]) if i == k else r for i, r in enumerate(rows) if r[2].strftime("%Y-%m") != gone]
    changed.append(("new", "CA", dt.datetime(2030, 5, 5), "tracker", 9, "c"))
    told = rollup.refresh(table(spark, changed), root)["changed"]
    assert sorted(told) == sorted([f"{rows[k][3]}|{rows[k][2].strftime('%Y-%m')}-01T00:00:00", "tracker|2030-05-01T00:00:00"])
    now = rollup.monthly_rollup(table(spark, changed)).select(*rollup.SCHEMA.names).drop("counties")
    same(rollup.read(spark, root).drop("counties"), now)
    same(rollup.read(spark, root, ["tracker"], "2022-03-01", "2022-05-20").drop("counties"),
         now.where("data_source = 'tracker' AND month BETWEEN timestamp_ntz'2022-03-01' AND timestamp_ntz'2022-05-20'"))
    assert rollup.read(spark, root, ["nobody"]).count() == 0


def test_refresh_sees_repeated_rows_change(spark, tmp_path):
    root, a, b = str(tmp_path / "r"), *(("d", "CA", dt.datetime(2024, 1, 7), "tracker", n, "c") for n in (1, 2))
    rollup.refresh(table(spark, [a, a, b, b]), root)
    assert rollup.refresh(table(spark, [a, a, a, b]), root)["changed"] and rollup.read(spark, root).first()["count"] == 5


def test_queries_from_the_rollup_equal_those_from_facts(spark, tmp_path):
    facts = table(spark, some_rows(900, 7))
    rollup.refresh(facts, str(tmp_path / "r"))
    rolled = rollup.read(spark, str(tmp_path / "r"))
    order = ["tracker", "nndss"]
    for key in ("disease_name", "disease_slug"):
        want = merged_monthly(facts, order, "window", key)
        same(rollup.merged(rolled, order, key), want)
        for plan in ("ranked", "conditional"):
            same(merged_monthly(facts, order, plan, key, sources=["hospital", "tracker", "nndss"]), want)
    merged = rollup.merged(rolled, order)
    for source in (None, "hospital"):
        same(Q.summary_stats(facts, merged, source, rolled), Q.summary_stats(facts, merged_monthly(facts, order), source))
    exact, near = (Q.disease_stats(facts, merged, rollup=rolled, approx_counties=a).orderBy("disease_name").collect() for a in (False, True))
    assert len(exact) == len(near) == 12
    for x, y in zip(exact, near):
        assert x.asDict() | {"affected_counties": 0} == y.asDict() | {"affected_counties": 0}
        assert abs(x.affected_counties - y.affected_counties) <= 1


def test_unnamed_sources_are_not_lost(spark):
    with pytest.raises(Exception, match="rows of other sources"):
        merged_monthly(table(spark, some_rows()), ["tracker"], "conditional", sources=["tracker", "nndss"]).collect()


def spans(path, column):
    out = []
    for d, _, files in os.walk(path):
        for f in sorted(files):
            if f.endswith(".parquet"):
                meta = pq.ParquetFile(f"{d}/{f}").metadata
                at = [i for i in range(meta.num_columns) if meta.schema.column(i).name == column][0]
                stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
                out.append((min(s.min for s in stats), max(s.max for s in stats)))
    return out


def test_a_slug_and_a_month_range_each_skip_most_files(spark, tmp_path):
    catalog.write_facts(table(spark, [r[:3] + ("nndss",) + r[4:] for r in some_rows(6000)]), str(tmp_path / "facts"), partitions=64)
    [folder] = versions.current(spark, str(tmp_path / "facts"))["folders"]
    slugs, starts = (spans(tmp_path / "facts" / folder, c) for c in ("disease_slug", "report_period_start"))
    assert len(slugs) >= 48
    for slug in ("d00", "d05", "d11"):
        assert sum(lo <= slug <= hi for lo, hi in slugs) <= len(slugs) / 3
    for first in (dt.datetime(2022, 2, 1), dt.datetime(2023, 6, 1)):
        assert sum(lo <= first + dt.timedelta(31) and first <= hi for lo, hi in starts) <= len(starts) / 3


def test_rows_of_a_common_disease_do_not_meet_in_one_task(spark):
    rows = table(spark, some_rows())
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # as where the facts are large
    try:
        placed = catalog.clustered(rows)
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert placed.where("_cluster IS NULL").isEmpty() and placed.count() == rows.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
