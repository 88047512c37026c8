"""Plan-shape checks: the properties the operators rely on at scale."""
import os
import re

import pytest

from caseflow.operators.merge import merged_monthly
from caseflow.plans import queries as Q
from caseflow.plans import registry as R

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning)", plan))


def raw_shuffles(df):
    """Exchanges right above a scan or filter of facts, that is without a partial aggregate below them."""
    lines = [re.sub(r"^[\s:+\-*()0-9]*", "", x) for x in plan_of(df).splitlines()]
    return [(a, b) for a, b in zip(lines, lines[1:]) if a.startswith("Exchange hashpartitioning") and not re.match(
        "(Hash|ObjectHash|Sort)Aggregate|Sort|Window|Project|Exchange", b)]


def test_merge_shuffles_partial_aggregates_only(spark):
    facts, sources = R.facts(spark, SF), ["tracker", "nndss", "hospital"]
    for plan, exchanges in (("conditional", 1), ("ranked", 2), ("window", 2)):
        for rows in (facts, R._with_unlisted(facts)):
            merged = merged_monthly(rows, ["tracker", "nndss"], plan=plan, sources=sources)
            assert not raw_shuffles(merged)
            assert shuffles(plan_of(merged)) == exchanges and plan_of(merged).count("FileScan parquet") == 1, plan


def test_merged_view_reads_the_rollup_once(spark):
    merged = R.merged(spark, SF)
    plan = plan_of(merged)
    assert shuffles(plan) == 1 and plan.count("FileScan parquet") == 1 and "geo_name" not in plan
    assert "EqualTo(disease_name,measles)" in plan_of(merged.where("disease_name = 'measles'"))
    assert "GreaterThanOrEqual(month," in plan_of(merged.where("month >= timestamp_ntz'1997-01-01'"))
    facts = R.facts(spark, SF)
    for query, scans in ((Q.summary_stats(facts, merged, rollup=R.rollup(spark, SF)), 2), (Q.disease_totals(facts, merged), 1),
                         (Q.state_totals(facts, merged), 1), (Q.state_selector(facts, merged), 1), (Q.disease_stats(facts, merged), 2)):
        assert plan_of(query).count("FileScan parquet") <= scans


@pytest.mark.parametrize("name", ["q2_disease_catalog_nndss", "q17_disease_cards", "f9_trailing_days"])
def test_no_raw_fact_shuffle_without_broadcast(spark, name):
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not raw_shuffles(R.queries()[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)


def test_scan_counts(spark):
    scans = lambda df: plan_of(df).count("FileScan parquet")
    facts = R.facts(spark, SF)
    assert scans(Q.disease_catalog(facts, "nndss")) == 1
    assert scans(Q.summary_stats(facts, None, "tracker")) == 1
    assert "rangepartitioning" not in plan_of(R.queries()["q19_last_n_periods"](spark, SF))
    assert "IN (CA,NYC,MA)" in plan_of(R.queries()["q22_crossfilter"](spark, SF))


def test_dense_distribution_scans_once(spark):
    plan = plan_of(Q.age_distribution(R.facts(spark, SF)))
    assert plan.count("FileScan parquet") == 1


def test_disease_filter_reaches_scan(spark):
    facts, merged = R.facts(spark, SF), R.merged(spark, SF)
    for df in (Q.state_totals(facts, merged, "measles"), Q.national_timeseries(facts, "measles")):
        assert "EqualTo(disease_name,measles)" in plan_of(df)


def test_series_with_national_is_one_aggregate(spark):
    plan = plan_of(Q.state_timeseries(R.facts(spark, SF)))
    assert shuffles(plan) == 1 and "Expand" in plan


def test_no_python_udf_in_registered_plans(spark):
    for name in ("q15_merged_monthly", "q11_age_distribution", "q20_choropleth_bins", "s4_read_state_feed"):
        plan = plan_of(R.queries()[name](spark, SF))
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
