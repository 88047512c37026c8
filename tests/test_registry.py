"""The driver's correctness gate, at the smallest scale: every registered query vs its DuckDB oracle."""
import os

import pytest

import __spark_entry__ as E
from caseflow.plans import registry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    problems, _ = compare(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])
    assert not problems, problems


def test_approximate_counts_are_near(spark):
    exact = {r["disease_name"]: r for r in registry.queries()["a3_count_distinct"](spark, SF).collect()}
    for r in registry.queries()["a3_count_distinct_approx"](spark, SF).collect():
        for c in ("distinct_state", "distinct_geo_name"):
            assert abs(r[c] - exact[r["disease_name"]][c]) <= 0.1 * exact[r["disease_name"]][c] + 1


def test_entry_lists_the_registry():
    assert set(registry.queries()) <= set(E.queries()) and set(registry.oracle_sql()) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["disease_name", "state", "fips", "cases", "min_cases", "max_cases"]
