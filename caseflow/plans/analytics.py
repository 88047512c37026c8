"""Chart-side analytics as table jobs (Q19-Q22): last-N tail, quantile bins,
stacked shares, cross-filtering. Each runs on an already aggregated series
or distribution, partitioned by its group key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import columns as X
from caseflow.operators import aggregates as A
from caseflow.operators import filters as FL
from caseflow.operators import windows as W


def last_n_periods(series: DataFrame, n: int = 12, group: Iterable[str] = ("disease_name",),
                   period: str = "period") -> DataFrame:
    """Q19: the last ``n`` periods of each series (rows with no period dropped)."""
    return W.last_n(series.where(F.col(period).isNotNull()), list(group), period, n)


def last_n_summary(series: DataFrame, n: int = 12, group: Iterable[str] = ("disease_name",),
                   period: str = "period", value: str = "total_cases") -> DataFrame:
    """Total of the tail plus its first and last period."""
    tail = last_n_periods(series, n, group, period)
    return tail.groupBy(*group).agg(X.zero_if_null(F.sum(value)).alias("total"),
                                    F.min(period).alias("first_period"),
                                    F.max(period).alias("last_period"))


def choropleth_bins(state_totals: DataFrame, k: int = 5, by: Iterable[str] = ("disease_name",),
                    cases: str = "cases") -> DataFrame:
    """Q20: quantile colour class 0..k-1 of each state's total (null for zero / no data).

    Thresholds are the k-1 interior quantiles of the positive totals of the
    group (linear interpolation); class = number of thresholds <= value.
    """
    by = list(by)
    if by:  # a window over the per-state rows of each group: computed once, groups hold <= one row per state
        probs = F.array(*[F.lit(i / k) for i in range(1, k)])
        positive = F.when(F.col(cases) > 0, F.col(cases).cast("double"))
        with_breaks = state_totals.withColumn("breaks", F.percentile(positive, probs).over(Window.partitionBy(*by)))
    else:
        with_breaks = state_totals.crossJoin(F.broadcast(A.quantile_breaks(state_totals, cases, k).select("breaks")))
    return with_breaks.select(*by, "state", cases, X.quantile_bin(F.col(cases), F.col("breaks")).alias("bin"))


def legend_breaks(state_totals: DataFrame, k: int = 5, by: Iterable[str] = ("disease_name",),
                  cases: str = "cases") -> DataFrame:
    """Q20: legend rows (i, lower, upper) from [min, thresholds..., max] of the positive totals."""
    by = list(by)
    b = A.quantile_breaks(state_totals, cases, k, by)
    edges = F.concat(F.array(F.col("lo")), F.col("breaks"), F.array(F.col("hi")))
    return (b.select(*by, F.posexplode(F.slice(edges, 1, k)).alias("i", "lower"), edges.alias("_e"))
             .select(*by, F.col("i").cast("long").alias("i"), "lower",
                     F.element_at("_e", F.col("i") + 2).alias("upper")))


def stacked_shares(distribution: DataFrame, group: Iterable[str] = ("disease_name", "state"),
                   category: str = "age_group", value: str = "percentage") -> DataFrame:
    """Q21: 100 % stacked layout: per group, categories in lexical order, y0..y1 offsets.

    Offsets are summed in hundredths (integers) so they do not depend on
    floating-point addition order.
    """
    cents = distribution.withColumn("_c", F.bround(F.col(value) * 100, 0).cast("long"))
    stacked = W.stack_offsets(cents, list(group), category, "_c")
    return stacked.select(*group, category, value,
                          (F.col("y0") / 100.0).alias("y0"), (F.col("y1") / 100.0).alias("y1"))


def wide_shares(distribution: DataFrame, categories: list[str], group: Iterable[str] = ("disease_name", "state"),
                category: str = "age_group", value: str = "percentage") -> DataFrame:
    """Q21 wide form: one column per category (explicit list), missing -> 0."""
    return A.pivot_shares(distribution, list(group), category, value, categories)


def crossfilter(series: DataFrame, states: Iterable[str] | None = None, start=None, end=None,
                state: str = "state", period: str = "period") -> DataFrame:
    """Q22: apply the state selection and the date brush to any series; empty = all."""
    return FL.period_between(FL.select_states(series, states, state), start, end, period)
