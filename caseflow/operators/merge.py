"""Source-priority monthly merge (Q15, with A7, W1, X8).

Rows are rolled up to (disease, state, month, source); per (disease, state,
month) the highest-priority source that has any row wins, even if its sum
is null. Sources that no priority lists rank after listed ones, by name.
Three physical plans give the same rows, each from one scan:

* ``conditional`` — the sources are known (``sources``, as a written table's
  catalogue tells them): one aggregate with a (rows, sum) pair per source, then a
  projection picks the winner. A single exchange, map-side partial aggregation
  absorbs hot keys. A row of a source not named ends the query, so none is lost.
* ``ranked`` — any sources: sums by source, then the least (rank, source) of
  each month, partially aggregated too. The second exchange carries monthly sums.
* ``window`` — as ``ranked``, with ``row_number`` (Spark plans a WindowGroupLimit).

``merge_rolled`` is the second half of ``ranked`` over monthly sums that are
stored already (``plans.rollup``): one small scan, one exchange.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import columns as X
from caseflow.functions import dims

MERGED_COLUMNS = ["disease_name", "disease_slug", "state", "month", "data_source", "count"]


def _monthly_scope(facts: DataFrame) -> DataFrame:
    return (facts.where(X.non_blank("state"))
                 .select("disease_name", "disease_slug", "state",
                         X.truncate_period("report_period_start", "month").alias("month"),
                         "data_source", "count"))


def monthly_by_source(facts: DataFrame, key: str = "disease_name") -> DataFrame:
    """SUM(count) by (disease_name, disease_slug, state, month, data_source).

    With ``key='disease_slug'`` name variants of one slug roll up together and
    the smallest name is kept.
    """
    scope = _monthly_scope(facts)
    if key == "disease_slug":
        return (scope.groupBy("disease_slug", "state", "month", "data_source")
                     .agg(F.min("disease_name").alias("disease_name"), F.sum("count").alias("count"))
                     .select(*MERGED_COLUMNS))
    return (scope.groupBy("disease_name", "disease_slug", "state", "month", "data_source")
                 .agg(F.sum("count").alias("count")))


def merged_monthly(facts: DataFrame, priority: Sequence[str] = dims.DEFAULT_PRIORITY, plan: str = "window",
                   key: str = "disease_name", sources: Collection[str] | None = None) -> DataFrame:
    """Q15: one row per (disease, state, month) from the best source available.

    ``key`` is the disease column the merge partitions by: the feeds' rule is
    ``disease_name`` (differently cased names never dedupe); ``disease_slug``
    merges them. ``sources`` names every source of ``facts``; without it the
    ``conditional`` plan cannot be made and ``ranked`` is.
    """
    if key not in ("disease_name", "disease_slug"):
        raise ValueError(f"merge key must be disease_name or disease_slug, got {key!r}")
    priority = list(priority)
    if plan == "conditional" and sources is not None:
        return _merged_conditional(facts, [*priority, *sorted(set(sources) - set(priority))], key)
    if plan in ("conditional", "ranked"):
        return merge_rolled(monthly_by_source(facts, key), priority, key)
    if plan != "window":
        raise ValueError(f"unknown merge plan {plan!r}")
    return _merged_window(facts, priority, key)


def merge_rolled(monthly: DataFrame, priority: Sequence[str] = dims.DEFAULT_PRIORITY, key: str = "disease_name") -> DataFrame:
    """Q15 over monthly sums by source (a row per disease, state, month and source, blank states left out).

    The name is a grouping column, so a filter on it, on the state or on the month
    reaches the scan of the sums.
    """
    if key == "disease_slug":
        monthly = (monthly.groupBy("disease_slug", "state", "month", "data_source")
                          .agg(F.min("disease_name").alias("disease_name"), F.sum("count").alias("count")))
    best = F.min(F.struct(X.source_rank("data_source", list(priority)).alias("rank"), "data_source", "disease_name",
                          "disease_slug", F.col("count").cast("long").alias("count")))
    merged = monthly.groupBy(key, "state", "month").agg(best.alias("best"))
    return merged.select(*[F.col(c) if c in (key, "state", "month") else F.col(f"best.{c}").alias(c) for c in MERGED_COLUMNS])


def _merged_window(facts: DataFrame, priority: list[str], key: str) -> DataFrame:
    monthly = monthly_by_source(facts, key)
    w = Window.partitionBy(key, "state", "month").orderBy(
        X.source_rank("data_source", priority), "data_source", "disease_name", "disease_slug")
    return (monthly.withColumn("_rn", F.row_number().over(w))
                   .where(F.col("_rn") == 1)
                   .select(*MERGED_COLUMNS))


def _merged_conditional(facts: DataFrame, sources: list[str], key: str) -> DataFrame:
    # disease_slug is a function of disease_name in every loader (P5 derives it),
    # so grouping by both keeps exactly one group per (disease_name, state, month).
    known = F.coalesce(F.col("data_source").isin(sources), F.lit(False))
    aggs = [F.count_if(~known).alias("_others")]
    for i, src in enumerate(sources):
        is_src = F.col("data_source") == src
        aggs += [F.count_if(is_src).alias(f"_n{i}"), F.sum(F.when(is_src, F.col("count"))).alias(f"_s{i}")]
        if key == "disease_slug":
            aggs.append(F.min(F.when(is_src, F.col("disease_name"))).alias(f"_m{i}"))
    keys = ["disease_name", "disease_slug", "state", "month"] if key == "disease_name" \
        else ["disease_slug", "state", "month"]
    g = _monthly_scope(facts).groupBy(*keys).agg(*aggs)
    unknown = F.col("_others") > 0
    source = F.when(unknown, F.raise_error(F.lit(f"rows of other sources than {', '.join(sources)}")).cast("string"))
    count, name = F.when(F.lit(False), F.lit(None).cast("long")), F.when(F.lit(False), F.lit(None).cast("string"))
    for i, src in enumerate(sources):
        has = F.col(f"_n{i}") > 0
        source, count = source.when(has, F.lit(src)), count.when(has, F.col(f"_s{i}"))
        if key == "disease_slug":
            name = name.when(has, F.col(f"_m{i}"))
    # with key disease_name the name is the grouping column itself, so a filter on it
    # is pushed through the aggregate down to the scan
    name = F.col("disease_name") if key == "disease_name" else name
    return g.select(name.alias("disease_name"), "disease_slug", "state", "month", source.alias("data_source"), count.cast("long").alias("count"))
