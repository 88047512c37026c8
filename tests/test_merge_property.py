"""Property: both merge plans equal a direct statement of the rule, including for a hot key."""
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from caseflow.operators.merge import merged_monthly
from caseflow.operators.schema import FACT_SCHEMA

NAMES = FACT_SCHEMA.fieldNames()
row = st.tuples(
    st.sampled_from(["hot", "hot", "hot", "cold"]),          # one disease holds most rows
    st.sampled_from(["CA", "NY", ""]),
    st.sampled_from([dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 28), dt.datetime(2024, 2, 4)]),
    st.sampled_from(["tracker", "nndss"]),
    st.one_of(st.none(), st.integers(0, 50)),
)


def expected(rows):
    sums = {}
    for name, state, start, src, count in rows:
        if not state:
            continue
        key = (name, state, dt.datetime(start.year, start.month, 1))
        cur = sums.setdefault(key, {}).get(src, ("none",))
        total = count if cur == ("none",) else (cur if count is None else (count if cur is None else cur + count))
        sums[key][src] = total
    out = set()
    for (name, state, month), by_src in sums.items():
        src = "tracker" if "tracker" in by_src else "nndss"
        out.add((name, state, month, src, by_src[src]))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=40))
def test_merge_matches_rule(spark, rows):
    data = []
    for name, state, start, src, count in rows:
        r = dict.fromkeys(NAMES)
        r.update(disease_name=name, disease_slug=name, state=state, report_period_start=start,
                 data_source=src, count=count)
        data.append(tuple(r[c] for c in NAMES))
    facts = spark.createDataFrame(data, FACT_SCHEMA)
    want = expected(rows)
    for plan in ("conditional", "window"):
        got = {tuple(r) for r in merged_monthly(facts, plan=plan)
               .select("disease_name", "state", "month", "data_source", "count").collect()}
        assert got == want, plan


dates = st.dates(min_value=dt.date(2023, 12, 1), max_value=dt.date(2024, 4, 30))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(dates, dates)
def test_month_scan_bound_is_exact(spark, fixture_facts, a, b):
    from caseflow.plans import queries as Q
    start, end = min(a, b).isoformat(), max(a, b).isoformat()
    plain = Q.state_totals(fixture_facts, merged_monthly(fixture_facts), None, None, start, end)
    pruned = Q.state_totals_merged_pruned(fixture_facts, merged_monthly, None, start, end)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, pruned.collect()))
