"""Joins (J1-J7; J8, re-keying by a label, is part of the subtype distribution).

Broadcast is asked for only where a side is one row by construction. All other
joins, with dimensions too, are left to Catalyst/AQE, which broadcasts a side only
after measuring it under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import dims


def attach_weeks(df: DataFrame, weeks: DataFrame, keys: Iterable[str] = ("year", "week")) -> DataFrame:
    """Left equi join of per-(year, week) dates back onto rows.

    The week table is derived from data, so its size is left for AQE to measure.
    The conform step computes the dates inline (P11) and does not need it.
    """
    return df.join(weeks, list(keys), "left")


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, out: str, dim_value: str,
           fallback: str | None = None) -> DataFrame:
    """Left dimension lookup with fallback to another column when unmatched.

    The caller's ``dim`` is broadcast only if Spark measures it as small.
    """
    d = dim.select(F.col(dim_key).alias("_k"), F.col(dim_value).alias("_v"))
    j = df.join(d, df[key] == d["_k"], "left")
    val = F.coalesce(F.col("_v"), F.col(fallback)) if fallback else F.col("_v")
    return j.withColumn(out, val).drop("_k", "_v")


def inner_lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Inner dimension join, unmatched rows dropped."""
    return df.join(dim, key, "inner")


def with_fips_join(df: DataFrame, state_col: str = "state") -> DataFrame:
    """J3 for FIPS: exact state code -> FIPS; rows without a code are dropped."""
    fips = dims.fips_df(df.sparkSession).withColumnRenamed("state", state_col)
    return inner_lookup(df, fips, state_col)


def having_source(groups: DataFrame, source: str | None, key: str = "disease_slug",
                  sources: str = "sources") -> DataFrame:
    """Of an aggregate with its set of sources per row, the rows of every ``key`` that has ``source``.

    ``groups`` is one row per (name, key) with an array of sources, so the test is a
    window over that small aggregate and the facts are scanned once.
    """
    if not source:
        return groups
    has = F.max(F.array_contains(sources, source)).over(Window.partitionBy(key))
    return groups.withColumn("_has", has).where("_has").drop("_has")


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put a one-row result next to every row.

    The side is an aggregate without groups; taking its maximum once more makes
    it one row by construction whatever the caller passes.
    """
    single = one_row.agg(*[F.max(c).alias(c) for c in one_row.columns])
    return df.crossJoin(F.broadcast(single))


def densify(rows: DataFrame, cols: DataFrame, counts: DataFrame, on_rows: list[str],
            on_cols: list[str], value: str = "count", by: list[str] | None = None) -> DataFrame:
    """Every row key x every column key (within ``by`` groups), left-joined to counts, zero-filled.

    Both sides are per-group distinct lists built from an aggregate, so the
    grid is states x categories, never a product of raw rows.
    """
    by = by or []
    grid = rows.join(cols, by, "inner") if by else rows.crossJoin(cols)
    return (grid.join(counts, by + on_rows + on_cols, "left")
                .withColumn(value, F.coalesce(F.col(value), F.lit(0)).cast("long")))


def enrich_totals(catalog: DataFrame, totals: DataFrame, key: str = "disease_name") -> DataFrame:
    """Left join of per-disease totals onto a disease list (missing -> null)."""
    return catalog.join(totals, key, "left")
