"""Aggregations (A1-A15). Spark plans each as partial aggregate -> exchange -> final,
so a hot key is pre-combined on the map side before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import columns as X


def sum_cases(df: DataFrame, *keys: str, value: str = "count", out: str = "total_cases") -> DataFrame:
    """A1: SUM(count) overall or by keys; null/0 -> 0."""
    return df.groupBy(*keys).agg(X.zero_if_null(F.sum(value)).alias(out))


def count_records(df: DataFrame, *keys: str, out: str = "records") -> DataFrame:
    """A2: COUNT(*)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def count_distinct(df: DataFrame, cols: Iterable[str], by: Iterable[str] = (),
                   approx: bool = False) -> DataFrame:
    """A3: COUNT(DISTINCT c) for each column, in one aggregate (Catalyst expands once).

    ``approx`` uses HyperLogLog++ sketches: constant memory per group at any scale.
    """
    fn = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    return df.groupBy(*by).agg(*[fn(c).alias(f"distinct_{c}") for c in cols])


def date_span(df: DataFrame, by: Iterable[str] = (), start: str = "report_period_start",
              end: str = "report_period_end") -> DataFrame:
    """A4: earliest start, latest end."""
    return df.groupBy(*by).agg(F.min(start).alias("earliest_date"), F.max(end).alias("latest_date"))


def sources_list(col: str = "data_source") -> Column:
    """A5 expression: sorted, comma-joined distinct values (deterministic STRING_AGG DISTINCT).

    The set holds at most one entry per source, so it stays tiny per group.
    """
    return F.array_join(F.array_sort(F.collect_set(col)), ",")


def list_sources_by(df: DataFrame, *keys: str, out: str = "sources") -> DataFrame:
    """A5."""
    return df.groupBy(*keys).agg(sources_list().alias(out))


def sum_by_period(df: DataFrame, granularity: str = "month", *keys: str, ts: str = "report_period_start",
                  out: str = "total_cases") -> DataFrame:
    """SUM(count) by truncated period (+ keys); period = DATE_TRUNC(granularity, ts)."""
    return (df.groupBy(*keys, X.truncate_period(ts, granularity).alias("period"))
              .agg(X.zero_if_null(F.sum("count")).alias(out)))


def source_breakdown(facts: DataFrame) -> DataFrame:
    """Rows and cases per source (never filtered by source)."""
    return facts.groupBy("data_source").agg(F.count(F.lit(1)).alias("records"),
                                            F.sum("count").cast("long").alias("cases"))


def with_extent(df: DataFrame, col: str, by: Iterable[str] = (), lo: str = "min_cases",
                hi: str = "max_cases") -> DataFrame:
    """Group min and max of ``col`` next to every row.

    Meant for aggregated rows (one per state of a disease): grouped, it is a
    window partitioned by the group, so the input is computed once and no
    group is larger than its aggregate; ungrouped, a one-row aggregate is
    broadcast next to the rows (never an unpartitioned window).
    """
    by = list(by)
    if by:
        w = Window.partitionBy(*by)
        return df.withColumns({lo: F.min(col).over(w), hi: F.max(col).over(w)})
    ext = df.agg(F.min(col).alias(lo), F.max(col).alias(hi))
    return df.crossJoin(F.broadcast(ext))


def share_within(df: DataFrame, group: Iterable[str], value: str = "count", out: str = "percentage",
                 digits: int = 2) -> DataFrame:
    """A10: value / group total * 100, half-even rounded; 0 when the group total is 0.

    Meant for aggregated rows: the group total is a window partitioned by the
    group (W2), so the input is computed once.
    """
    group = list(group)
    total = F.sum(value).over(Window.partitionBy(*group))
    return (df.withColumn("_group_total", total)
              .withColumn(out, X.round_half_even(X.percent_of(F.col(value), F.col("_group_total")), digits))
              .drop("_group_total"))


def dense_shares(agg: DataFrame, by: list[str], row: str, col: str, value: str = "count",
                 out: str = "percentage", digits: int = 2,
                 row_aggs: Mapping[str, Column] | None = None) -> DataFrame:
    """J6 + A10 in one pass over an aggregate: every ``row`` x every ``col`` seen in its ``by``
    group, zero-filled, with ``value`` as a share of the row's total.

    ``agg`` has one row per (by, row, col) — ``col`` null for a row key with no
    category (it still gets a full row of zeros). The category set of a group
    comes from a window over the aggregate (one exchange on ``by``), each row
    key's counts become a map, and the grid is an explode of the category
    array against that map: no self-join, so the source is scanned once.
    Group sizes are bounded by rows x categories of one ``by`` key.
    """
    w = Window.partitionBy(*by)
    with_cats = agg.withColumn("_cats", F.array_sort(F.collect_set(col).over(w)))
    extra = dict(row_aggs or {})
    per_row = (with_cats.groupBy(*by, row)
               .agg(F.first("_cats").alias("_cats"),
                    F.map_from_entries(F.collect_list(F.when(F.col(col).isNotNull(),
                                                             F.struct(F.col(col), F.col(value))))).alias("_m"),
                    *[e.alias(k) for k, e in extra.items()]))
    total = F.aggregate(F.map_values("_m"), F.lit(0).cast("long"), lambda acc, x: acc + x)
    exploded = per_row.select(*by, row, *extra, F.explode("_cats").alias(col), "_m", total.alias("_t"))
    cnt = F.coalesce(F.try_element_at(F.col("_m"), F.col(col)), F.lit(0)).cast("long")
    return exploded.select(*by, row, *extra, col, cnt.alias(value),
                           X.round_half_even(X.percent_of(cnt, F.col("_t")), digits).alias(out))


def with_national(df: DataFrame, keys: Iterable[str], state: str = "state", value: str = "count",
                  out: str = "cases", national: str = "National") -> DataFrame:
    """Per-state detail plus a national row per key, in one aggregate (GROUPING SETS).

    Output: ``level`` ('state' | 'national'), ``state`` (``national`` label on
    national rows), keys..., ``out``. One exchange instead of two scans.
    """
    keys = list(keys)
    g = (df.groupingSets([[state, *keys], keys], state, *keys)
           .agg(X.zero_if_null(F.sum(value)).alias(out), F.grouping(state).alias("_g")))
    return g.select(
        F.when(F.col("_g") == 1, F.lit("national")).otherwise(F.lit("state")).alias("level"),
        F.when(F.col("_g") == 1, F.lit(national)).otherwise(F.col(state)).alias(state),
        *keys, out)


def quantile_breaks(df: DataFrame, col: str, k: int = 5, by: Iterable[str] = (),
                    exact: bool = True) -> DataFrame:
    """The k-1 interior quantile thresholds (linear interpolation, like R-7).

    Exact ``percentile`` holds one group's values in memory — fine on
    per-state totals (<= 60 rows per group); ``exact=False`` uses the
    fixed-memory ``percentile_approx`` sketch for large domains.
    """
    probs = [i / k for i in range(1, k)]
    fn = F.percentile if exact else (lambda c, p: F.percentile_approx(c, p, 10000))
    return df.where(F.col(col) > 0).groupBy(*by).agg(
        fn(F.col(col).cast("double"), F.array(*[F.lit(p) for p in probs])).alias("breaks"),
        F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))


def extent(df: DataFrame, col: str, by: Iterable[str] = ()) -> DataFrame:
    """min/max of a series."""
    return df.groupBy(*by).agg(F.min(col).alias("min"), F.max(col).alias("max"))


def pivot_shares(df: DataFrame, row: Iterable[str], col: str, value: str, categories: list[str]) -> DataFrame:
    """Long -> wide with an explicit category list (no extra distinct job); missing -> 0."""
    wide = df.groupBy(*row).pivot(col, categories).agg(F.first(value))
    return wide.fillna(0, subset=categories)


_AGGS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def aggregate(df: DataFrame, keys: Iterable[str], spec: Mapping[str, str | Iterable[str]]) -> DataFrame:
    """``{column: fn or [fns]}`` with fn in count/sum/avg/min/max; outputs ``<fn>_<column>``."""
    exprs = []
    for c, fns in spec.items():
        for fn in ([fns] if isinstance(fns, str) else list(fns)):
            if fn not in _AGGS:
                raise ValueError(f"unsupported aggregate {fn!r}")
            exprs.append(_AGGS[fn](F.col(c) if c != "*" else F.lit(1)).alias(f"{fn}_{c if c != '*' else 'all'}"))
    return df.groupBy(*keys).agg(*exprs)
