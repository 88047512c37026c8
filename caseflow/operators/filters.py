"""Filters and predicates (F3-F14). All are plain ``where`` clauses Catalyst pushes toward the scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import columns as X


def _ntz(value) -> Column:
    """A date/timestamp literal as timestamp_ntz (strings in ISO form)."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, (dt.date, dt.datetime)):
        value = value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def for_disease(df: DataFrame, name: str | Iterable[str] | None = None,
                slug: str | Iterable[str] | None = None) -> DataFrame:
    """equality (or IN) on ``disease_name`` and/or ``disease_slug``; None = no filter."""
    for col, value in (("disease_name", name), ("disease_slug", slug)):
        if value is None:
            continue
        if isinstance(value, str):
            df = df.where(F.col(col) == value)
        else:
            df = df.where(F.col(col).isin(list(value)))
    return df


def from_source(df: DataFrame, source: str | None) -> DataFrame:
    """``data_source = src`` when given (a partition filter on the written table)."""
    return df if not source else df.where(F.col("data_source") == source)


def period_within(df: DataFrame, start=None, end=None) -> DataFrame:
    """the whole reporting period inside [start, end]: ``start_col >= s AND end_col <= e``.

    ``end`` is compared as a timestamp, so a date means midnight of that day.
    """
    if start:
        df = df.where(F.col("report_period_start") >= _ntz(start))
    if end:
        df = df.where(F.col("report_period_end") <= _ntz(end))
    return df


def month_between(merged: DataFrame, start=None, end=None) -> DataFrame:
    """``month BETWEEN s AND e`` on the merged rows (month = first day of the month)."""
    if start:
        merged = merged.where(F.col("month") >= _ntz(start))
    if end:
        merged = merged.where(F.col("month") <= _ntz(end))
    return merged


def month_scan_bounds(facts: DataFrame, start=None, end=None) -> DataFrame:
    """Raw-row bound implied by F6, so the month filter reaches the Parquet scan.

    ``trunc_month(ts) >= s``  <=>  ``ts >= first month start on/after s``;
    ``trunc_month(ts) <= e``  <=>  ``ts < first day of the month after e``.
    Both are exact, so filtering raw rows first never changes merged totals.
    """
    if start:
        s = _ntz(start)
        first = F.when(F.trunc(F.to_date(s), "month").cast("timestamp_ntz") == s, s).otherwise(
            F.add_months(F.trunc(F.to_date(s), "month"), 1).cast("timestamp_ntz"))
        facts = facts.where(F.col("report_period_start") >= first)
    if end:
        e = _ntz(end)
        facts = facts.where(F.col("report_period_start")
                            < F.add_months(F.trunc(F.to_date(e), "month"), 1).cast("timestamp_ntz"))
    return facts


def apply_filters(df: DataFrame, disease: str | None = None, source: str | None = None,
                  start=None, end=None) -> DataFrame:
    """AND of the supplied predicates (disease name, source, period containment)."""
    return period_within(from_source(for_disease(df, name=disease), source), start, end)


def non_blank(df: DataFrame, col: str) -> DataFrame:
    """F7."""
    return df.where(X.non_blank(col))


def trailing_days(groups: DataFrame, end_col: str = "report_period_end", days: int = 14,
                  by: Iterable[str] = ()) -> DataFrame:
    """rows whose end is within ``days`` of the maximum end of their ``by`` group (inclusive both sides).

    Meant for rows aggregated per (group, end): the maximum is a window over that
    aggregate, so raw facts are scanned and combined once and never joined to it.
    Ungrouped, the maximum is a one-row aggregate.
    """
    by = list(by)
    if by:
        dated = groups.withColumn("_max_end", F.max(end_col).over(Window.partitionBy(*by)))
    else:
        dated = groups.crossJoin(F.broadcast(groups.agg(F.max(end_col).alias("_max_end"))))
    return (dated.where((F.col(end_col) >= X.days_before("_max_end", days)) & (F.col(end_col) <= F.col("_max_end")))
                 .drop("_max_end"))


def mappable_positive(df: DataFrame, fips: str = "fips", cases: str = "cases") -> DataFrame:
    """known FIPS code and a positive total."""
    return df.where(F.col(fips).isNotNull() & (F.col(cases) > 0))


#: A longer list of literals is handed over as a table.
LONGEST_LIST = 100


def select_states(df: DataFrame, states: Iterable[str] | DataFrame | None, col: str = "state",
                  national: str = "National") -> DataFrame:
    """state multi-select; an empty selection, or one containing ``National``, keeps all.

    A selection of any length may be a frame with a column ``col``, and a list beyond
    ``LONGEST_LIST`` becomes one: rows are then kept by a semi join to its distinct values,
    which AQE broadcasts if it measures them small, and whose values Spark turns into a
    run-time filter of the larger side if not. Whether the frame is empty or holds
    ``National`` is asked once, when the query is built (one row).
    """
    if not isinstance(states, DataFrame):
        chosen = [s for s in (states or [])]
        if not chosen or national in chosen:
            return df
        if len(chosen) <= LONGEST_LIST:
            return df.where(F.col(col).isin(chosen))
        states = df.sparkSession.createDataFrame([(s,) for s in chosen], f"`{col}` string")
    told = states.agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col(col) == national).alias("all")).first()
    if not told["n"] or told["all"]:
        return df
    return df.join(states.select(col).distinct(), col, "left_semi").select(*df.columns)


def period_between(df: DataFrame, start=None, end=None, col: str = "period") -> DataFrame:
    """inclusive period filter, applied only when both ends are given."""
    if start is None or end is None:
        return df
    return df.where(F.col(col).between(_ntz(start), _ntz(end)))


def drop_bad_periods(df: DataFrame, col: str = "period", fmt: str = "yyyy-MM-dd") -> DataFrame:
    """drop rows whose period text does not parse."""
    return df.where(F.try_to_timestamp(F.col(col).cast("string"), F.lit(fmt)).isNotNull())


def with_subtype(df: DataFrame) -> DataFrame:
    """rows that carry a subtype slug."""
    return df.where(F.col("disease_subtype_slug").isNotNull())
