"""Properties of dense distributions: grid size = row keys x categories, shares sum to ~100."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from caseflow.operators.aggregates import dense_shares

row = st.tuples(st.sampled_from(["d1", "d1", "d2"]), st.sampled_from(["CA", "NY", "TX"]),
                st.one_of(st.none(), st.sampled_from(["0-1 y", "1-4 y", "65+ y"])), st.integers(0, 30))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=30))
def test_dense_shares_properties(spark, rows):
    agg = {}
    for d, s, a, c in rows:
        agg[(d, s, a)] = agg.get((d, s, a), 0) + c
    df = spark.createDataFrame([(d, s, a, c) for (d, s, a), c in agg.items()],
                               "disease string, state string, age string, count long")
    out = dense_shares(df, ["disease"], "state", "age").collect()
    for d in {k[0] for k in agg}:
        states = {k[1] for k in agg if k[0] == d}
        cats = {k[2] for k in agg if k[0] == d and k[2] is not None}
        mine = [r for r in out if r["disease"] == d]
        assert len(mine) == len(states) * len(cats)
        for s in states:
            cells = [r for r in mine if r["state"] == s]
            total = sum(r["count"] for r in cells)
            assert total == sum(c for (dd, ss, a), c in agg.items() if dd == d and ss == s and a is not None)
            pct = sum(r["percentage"] for r in cells)
            assert (abs(pct - 100) <= 0.01 * len(cells)) if total > 0 else pct == 0
