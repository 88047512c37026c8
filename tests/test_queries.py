import datetime as dt

from caseflow.operators.merge import merged_monthly
from caseflow.operators.schema import FACT_COLUMNS, integrity_report
from caseflow.plans import analytics as AN
from caseflow.plans import queries as Q

D = dt.datetime


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_facts_shape(fixture_facts):
    assert fixture_facts.columns == FACT_COLUMNS
    by_src = {r["data_source"]: r["n"] for r in fixture_facts.groupBy("data_source").count()
              .withColumnRenamed("count", "n").collect()}
    assert by_src == {"tracker": 7, "nndss": 6}
    assert {r["check"]: r["n_bad"] for r in integrity_report(fixture_facts).collect()} == {
        "null_required": 0, "end_before_start": 0, "negative_count": 0, "uppercase_slug": 0,
        "slug_with_space": 0}


def test_merge_priority_and_gap_fill(fixture_facts, fixture_merged):
    want = [
        ("measles", "CA", D(2024, 1, 1), "tracker", 15), ("measles", "CA", D(2024, 2, 1), "tracker", 15),
        ("measles", "CA", D(2024, 3, 1), "nndss", 6), ("measles", "NY", D(2024, 1, 1), "nndss", 1234),
        ("measles", "TX", D(2024, 1, 1), "tracker", 4), ("meningococcus", "AZ", D(2024, 1, 1), "nndss", 8),
        ("meningococcus", "CA", D(2024, 1, 1), "tracker", 5),
    ]
    cols = ("disease_name", "state", "month", "data_source", "count")
    assert rows(fixture_merged, *cols) == want
    assert rows(merged_monthly(fixture_facts, plan="window"), *cols) == want


def test_merge_winner_with_null_sum(spark):
    from caseflow.operators.schema import FACT_SCHEMA
    base = dict.fromkeys(FACT_SCHEMA.fieldNames())
    r1 = dict(base, disease_name="x", disease_slug="x", state="CA", report_period_start=D(2024, 1, 7),
              data_source="tracker", count=None)
    r2 = dict(r1, data_source="nndss", count=9)
    r3 = dict(r1, data_source="other", count=1, state="WA")
    r4 = dict(r3, data_source="another", count=2)
    df = spark.createDataFrame([tuple(r[c] for c in FACT_SCHEMA.fieldNames()) for c_ in [0]
                                for r in (r1, r2, r3, r4)], FACT_SCHEMA)
    got = rows(merged_monthly(df, plan="window"), "state", "data_source", "count")
    assert got == [("CA", "tracker", None), ("WA", "another", 2)]
    cond = rows(merged_monthly(df.where("data_source in ('tracker','nndss')"), plan="conditional"),
                "state", "data_source", "count")
    assert cond == [("CA", "tracker", None)]


def test_summary_and_totals(fixture_facts, fixture_merged):
    s = Q.summary_stats(fixture_facts, fixture_merged).first()
    assert (s["total_records"], s["disease_count"], s["total_states"], s["total_cases"]) == (13, 2, 4, 1287)
    assert s["earliest_date"] == D(2024, 1, 7) and s["latest_date"] == D(2024, 3, 16)
    assert rows(Q.disease_totals(fixture_facts, fixture_merged), "disease_name", "total_cases") == [
        ("measles", 1274), ("meningococcus", 13)]
    assert rows(Q.source_breakdown(fixture_facts), "data_source", "records", "cases") == [
        ("nndss", 6, 1255), ("tracker", 7, 39)]


def test_catalog_queries(fixture_facts):
    assert rows(Q.disease_catalog(fixture_facts), "disease_name", "sources") == [
        ("measles", "nndss,tracker"), ("meningococcus", "nndss,tracker")]
    assert rows(Q.disease_name_by_slug(fixture_facts, "measles"), "disease_name") == [("measles",)]
    assert Q.disease_name_by_slug(fixture_facts, "nope").count() == 0
    assert rows(Q.states(fixture_facts, "nndss"), "state") == [("AZ",), ("CA",), ("NY",)]


def test_national_series_double_counts_raw(fixture_facts):
    got = rows(Q.national_timeseries(fixture_facts, "measles", "month"), "period", "total_cases")
    assert got == [(D(2024, 1, 1), 1260), (D(2024, 2, 1), 15), (D(2024, 3, 1), 6)]


def test_disease_stats(fixture_facts, fixture_merged):
    r = Q.disease_stats(fixture_facts, fixture_merged, "measles").first()
    assert (r["total_cases"], r["affected_states"], r["affected_counties"], r["two_week_cases"]) == (1274, 3, 5, 6)
    all_rows = {x["disease_name"]: x["total_cases"] for x in Q.disease_stats(fixture_facts, fixture_merged).collect()}
    assert all_rows == {"measles": 1274, "meningococcus": 13}


def test_age_distribution_dense(fixture_facts):
    got = rows(Q.age_distribution(fixture_facts, "measles"), "state", "age_group", "count", "percentage")
    assert len(got) == 12
    assert ("CA", "18-24 y", 10, 66.67) in got and ("CA", "25-44 y", 5, 33.33) in got
    assert ("TX", "0-1 y", 4, 100.0) in got and ("TX", "1-4 y", 0, 0.0) in got
    assert all(p == 0.0 for s, _, _, p in got if s == "NY")
    stacked = AN.stacked_shares(Q.age_distribution(fixture_facts, "measles"))
    tops = {(r["state"]): r["y1"] for r in stacked.collect() if r["age_group"] == "25-44 y"}
    assert tops["CA"] == 100.0 and tops["TX"] == 100.0


def test_subtype_distribution(fixture_facts):
    got = rows(Q.subtype_distribution(fixture_facts, "Meningococcus"), "state", "disease_subtype_slug", "count",
               "percentage")
    assert got == [("AZ", "b", 2, 66.67), ("AZ", "unspecified", 1, 33.33),
                   ("CA", "b", 3, 60.0), ("CA", "unspecified", 2, 40.0)]


def test_state_totals_bins_selector(fixture_facts, fixture_merged):
    st = Q.state_totals(fixture_facts, fixture_merged, "measles")
    assert rows(st, "state", "fips", "cases", "min_cases", "max_cases") == [
        ("CA", "06", 36, 4, 1234), ("NY", "36", 1234, 4, 1234), ("TX", "48", 4, 4, 1234)]
    sel = rows(Q.state_selector(fixture_facts, fixture_merged, "measles"), "position", "state", "total")
    assert sel == [(1, "National", 1274), (2, "NY", 1234), (3, "CA", 36), (4, "TX", 4)]
    bins = {r["state"]: r["bin"] for r in AN.choropleth_bins(st).collect()}
    assert bins == {"TX": 0, "CA": 2, "NY": 4}
    legend = rows(AN.legend_breaks(st), "i", "lower", "upper")
    assert legend[0][1] == 4.0 and legend[-1][2] == 1234.0 and len(legend) == 5
    # month filter on merged rows: January only
    jan = Q.state_totals(fixture_facts, fixture_merged, "measles", None, "2024-01-01", "2024-01-31")
    assert rows(jan, "state", "cases") == [("CA", 15), ("NY", 1234), ("TX", 4)]
    pruned = Q.state_totals_merged_pruned(fixture_facts, lambda f: merged_monthly(f), "measles",
                                          "2024-01-15", "2024-03-31")
    assert rows(pruned, "state", "cases") == [("CA", 21)]


def test_state_timeseries_national_equals_sum(fixture_facts):
    ts = Q.state_timeseries(fixture_facts, "measles", "month")
    nat = {r["period"]: r["cases"] for r in ts.where("level = 'national'").collect()}
    per = {}
    for r in ts.where("level = 'state'").collect():
        per[r["period"]] = per.get(r["period"], 0) + r["cases"]
    assert nat == per
    sel = AN.crossfilter(ts, ["CA"], "2024-02-01", "2024-03-31").collect()
    assert sorted((r["state"], r["period"]) for r in sel) == [("CA", D(2024, 2, 1)), ("CA", D(2024, 3, 1))]
    assert AN.crossfilter(ts, ["National"]).count() == ts.count()


def test_last_n(fixture_facts):
    s = Q.national_timeseries(fixture_facts, None, "month")
    tail = rows(AN.last_n_periods(s, 2), "disease_name", "period")
    assert tail == [("measles", D(2024, 2, 1)), ("measles", D(2024, 3, 1)), ("meningococcus", D(2024, 1, 1))]
    summ = {r["disease_name"]: (r["total"], r["first_period"]) for r in AN.last_n_summary(s, 2).collect()}
    assert summ["measles"] == (21, D(2024, 2, 1))


def test_disease_cards(fixture_facts, fixture_merged):
    got = rows(Q.disease_cards(fixture_facts, fixture_merged), "disease_name", "sources", "total_cases")
    assert got == [("measles", "nndss,tracker", 1274), ("meningococcus", "nndss,tracker", 13)]


def test_results_come_in_their_order(fixture_facts, fixture_merged):
    """O1: rows as Spark hands them over, not sorted by the test."""
    def in_order(df, *keys):
        got = [tuple(r[k] for k in keys) for r in df.collect()]
        assert len(got) > 1 and got == sorted(got), got

    in_order(Q.disease_names(fixture_facts), "disease_name")
    in_order(Q.disease_catalog(fixture_facts), "disease_name", "disease_slug")
    in_order(Q.states(fixture_facts), "state")
    in_order(Q.disease_totals(fixture_facts, fixture_merged), "disease_name")
    from caseflow.plans.catalog import build_name_mapping
    in_order(build_name_mapping(fixture_facts), "disease_slug", "data_source")


def test_deduplicated_series(fixture_facts, fixture_merged):
    import pytest
    raw = {(r.disease_name, str(r.period)): r.total_cases for r in Q.national_timeseries(fixture_facts).collect()}
    once = {(r.disease_name, str(r.period)): r.total_cases for r in Q.national_timeseries(fixture_facts, dedupe=True, merged=fixture_merged).collect()}
    assert raw.keys() == once.keys() and raw != once and all(once[k] <= raw[k] for k in raw)
    assert sum(once.values()) == sum(r.total_cases for r in Q.disease_totals(fixture_facts, fixture_merged).collect())
    with pytest.raises(ValueError):
        Q.national_timeseries(fixture_facts, granularity="week", dedupe=True, merged=fixture_merged)


def test_long_selection_is_a_semi_join(spark, fixture_facts):
    from caseflow.operators import filters as FL
    chosen = ["CA", *[f"X{i}" for i in range(500)]]
    plan = FL.select_states(fixture_facts, chosen)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    frame = spark.createDataFrame([(c,) for c in chosen] * 2, "state string")
    want = sorted(map(str, fixture_facts.where("state = 'CA'").collect()))
    for selection in (chosen, frame, ["CA"]):
        assert sorted(map(str, FL.select_states(fixture_facts, selection).collect())) == want
    everything = fixture_facts.count()
    for selection in (None, [], ["CA", "National"], frame.limit(0), frame.unionByName(spark.createDataFrame([("National",)], "state string"))):
        assert FL.select_states(fixture_facts, selection).count() == everything


def test_ascii_rows_stay_out_of_python(spark):
    from caseflow.operators.conform import add_url_slugs
    rows = [("Plain", "a b"), ("Cafe\u0301", "x"), (None, "y"), (None, None), ("z", "\u00e9t\u00e9")]
    out = add_url_slugs(spark.createDataFrame(rows, "a string, b string"), ["a", "b"])
    got = {(r.a, r.b): (r.a_url_slug, r.b_url_slug) for r in out.collect()}
    assert got == {rows[0]: ("plain", "a-b"), rows[1]: ("caf", "x"), rows[2]: (None, "y"), rows[3]: (None, None), rows[4]: ("z", "t")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("Union") < plan.index("ArrowEvalPython")
