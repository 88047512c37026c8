"""Window operators (W1-W5) and ordering / distinct helpers.

Every window here is partitioned by a group key and runs on an already
aggregated, small input (one row per state x period or state x category),
never on raw fact rows and never as an unpartitioned window.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import columns as X


def pick_by_priority(df: DataFrame, keys: Sequence[str], source: str = "data_source",
                     priority: Sequence[str] = ("tracker",)) -> DataFrame:
    """Keep one row per key, the best-ranked source (ties by source name)."""
    w = Window.partitionBy(*keys).orderBy(X.source_rank(source, priority), source)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def with_group_total(df: DataFrame, group: Sequence[str], value: str = "count",
                     out: str = "group_total") -> DataFrame:
    """Per-group total next to each row."""
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*group)))


def last_n(df: DataFrame, group: Sequence[str], order: str = "period", n: int = 12) -> DataFrame:
    """The last ``n`` rows by ``order`` in each group (Spark plans a WindowGroupLimit)."""
    w = Window.partitionBy(*group).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def stack_offsets(df: DataFrame, group: Sequence[str], order: str, value: str = "percentage") -> DataFrame:
    """Stacked offsets per group: y1 = running sum of ``value`` in ``order``, y0 = y1 - value."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (df.withColumn("y1", F.sum(value).over(w))
              .withColumn("y0", F.col("y1") - F.col(value)))


# ------------------------------------------------------------------ O / D rows
def first_match(df: DataFrame, key: str, out: str) -> DataFrame:
    """O2: deterministic LIMIT-1 lookup per key: the smallest ``out`` value."""
    return df.groupBy(key).agg(F.min(out).alias(out))


def rank_states(df: DataFrame, by: Iterable[str] = (), state: str = "state", total: str = "total",
                pin: str = "National", out: str = "position") -> DataFrame:
    """Rank by total descending with ``pin`` first; ties by state name."""
    w = Window.partitionBy(*by).orderBy(F.when(F.col(state) == pin, 0).otherwise(1),
                                        F.col(total).desc(), F.col(state))
    return df.withColumn(out, F.row_number().over(w).cast("long"))


def collect_series(df: DataFrame, group: Sequence[str], order: str = "period", value: str = "cases",
                   out: str = "series") -> DataFrame:
    """One sorted array of (period, value) per group — packaging for small per-state series."""
    return df.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))).alias(out))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """D1."""
    return df.select(col).distinct()


def distinct_rows(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """D2."""
    return df.select(*cols).distinct()


def distinct_weeks(df: DataFrame, year: str, week: str) -> DataFrame:
    """D3: distinct (year, week) pairs without nulls."""
    return df.select(year, week).dropna().dropDuplicates()


def union_files(dfs: Iterable[DataFrame]) -> DataFrame:
    """Union by name; columns missing in some inputs become null."""
    out = None
    for df in dfs:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no inputs")
    return out


def append_sources(dfs: Iterable[DataFrame]) -> DataFrame:
    """Append conformed sources (same schema), by name."""
    out = None
    for df in dfs:
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no inputs")
    return out
