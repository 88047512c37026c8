"""Stored monthly roll-up behind the merged view.

A row per (source, month, disease, state) with its sum, its number of rows, the first
period start and the last period end, and a mergeable HyperLogLog sketch of its counties.
Totals, cards, maps and summaries read these few rows instead of the facts.

The table is kept per (source, month). A refresh compares each such part's
fingerprint (rows, and an exclusive or and a sum of row hashes: one pass of one
aggregate) with the stored one, computes only the parts that changed from a scan that
is limited to their sources and months, and publishes a new version that names the old
folders of all others. The log holds a line a part: sources times months.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions import columns as X
from caseflow.operators import filters as FL
from caseflow.operators.merge import merge_rolled
from caseflow.operators.schema import FACT_COLUMNS
from caseflow.plans import versions as V

SCHEMA = T.StructType([
    T.StructField("data_source", T.StringType()), T.StructField("month", T.TimestampNTZType()),
    T.StructField("disease_name", T.StringType()), T.StructField("disease_slug", T.StringType()),
    T.StructField("state", T.StringType()), T.StructField("count", T.LongType()),
    T.StructField("records", T.LongType()), T.StructField("first_start", T.TimestampNTZType()),
    T.StructField("last_end", T.TimestampNTZType()), T.StructField("counties", T.BinaryType())])
KEYS = ("data_source", "month", "disease_name", "disease_slug", "state")
#: Sketches of 2^12 registers: a standard error of 1.6 %.
SKETCH_BITS = 12


def month_of(facts: DataFrame) -> DataFrame:
    return facts.withColumn("month", X.truncate_period("report_period_start", "month"))


def monthly_rollup(facts: DataFrame, *carry: str) -> DataFrame:
    """The roll-up of ``facts``, blank states included; ``carry`` are further grouping columns."""
    counties = F.when(X.non_blank("geo_name"), F.col("geo_name"))
    return month_of(facts).groupBy(*KEYS, *carry).agg(
        F.sum("count").cast("long").alias("count"), F.count(F.lit(1)).alias("records"),
        F.min("report_period_start").alias("first_start"), F.max("report_period_end").alias("last_end"),
        F.hll_sketch_agg(counties, SKETCH_BITS).alias("counties"))


def fingerprints(facts: DataFrame) -> DataFrame:
    """(data_source, month, rows, either, total): what tells whether a part has changed."""
    row = F.xxhash64(*FACT_COLUMNS)
    return month_of(facts).groupBy("data_source", "month").agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(row).alias("either"), F.sum(F.pmod(row, F.lit(1 << 40))).alias("total"))


def _key(source: str | None, month: dt.datetime | None) -> str:
    return f"{'' if source is None else source}|{'' if month is None else month.isoformat()}"


def refresh(facts: DataFrame, root: str, keep_versions: int = 2) -> dict:
    """Bring the roll-up at ``root`` up to date with ``facts``; tells the parts that were computed.

    The record's ``parts`` are [source, month, fingerprint, path]; ``changed`` lists their keys.
    """
    spark = facts.sparkSession
    before = V.current(spark, root) or {"parts": {}, "number": None}
    now = fingerprints(facts).orderBy("data_source", "month").collect()         # a row a source and month
    stamps = {_key(r["data_source"], r["month"]): [r["rows"], r["either"], r["total"]] for r in now}
    old = before["parts"]
    changed = [r for r in now if old.get(_key(r["data_source"], r["month"]), [None] * 3)[2] != stamps[_key(r["data_source"], r["month"])]]
    parts = {k: v for k, v in old.items() if k in stamps}
    if not changed and len(parts) == len(old) and before["number"] is not None:
        return {**before, "changed": []}
    folder = V.fresh(root)
    if changed:
        slots = spark.createDataFrame([(r["data_source"], r["month"], i) for i, r in enumerate(changed)],
                                      "data_source string, month timestamp_ntz, slot int")
        named = slots.select(F.col("data_source").alias("_source"), F.col("month").alias("_month"), "slot")
        scope = month_of(_scan_bounds(facts, changed)).join(
            F.broadcast(named), F.col("data_source").eqNullSafe(F.col("_source")) & F.col("month").eqNullSafe(F.col("_month")))
        (monthly_rollup(scope, "slot").repartition("slot").sortWithinPartitions("slot", "disease_name", "state")
         .write.partitionBy("slot").parquet(f"{root.rstrip('/')}/{folder}"))
    for i, r in enumerate(changed):
        k = _key(r["data_source"], r["month"])
        parts[k] = [r["data_source"], None if r["month"] is None else r["month"].isoformat(), stamps[k], f"{folder}/slot={i}"]
    entry = {"parts": parts, "folders": sorted({p[3].split("/")[0] for p in parts.values()})}
    made = V.publish(spark, root, entry, before["number"])
    V.sweep(spark, root, [folder], keep_versions)
    return {**made, "changed": [_key(r["data_source"], r["month"]) for r in changed]}


def _scan_bounds(facts: DataFrame, changed: list) -> DataFrame:
    """Rows that can belong to the changed parts, by filters that files and row groups are skipped by."""
    sources, months = {r["data_source"] for r in changed}, [r["month"] for r in changed]
    if None not in sources:
        facts = facts.where(F.col("data_source").isin(sorted(sources)))
    if None not in months:
        facts = FL.month_scan_bounds(facts, min(months).date().isoformat(), max(months).date().isoformat())
    return facts


def read(spark: SparkSession, root: str, sources: Iterable[str] | None = None, start=None, end=None) -> DataFrame:
    """The current roll-up; only the parts of ``sources`` and of months in [start, end] (dates or ISO texts) are opened."""
    entry = V.current(spark, root)
    if entry is None:
        raise FileNotFoundError(f"no roll-up was published at {root}")
    wanted = None if sources is None else set(sources)
    first, last = ("" if b is None else str(b)[:10] for b in (start, end))
    paths = [f"{root.rstrip('/')}/{path}" for source, month, _, path in entry["parts"].values()
             if (wanted is None or source in wanted) and (not first or (month or "") >= first) and (not last or (month or "9")[:10] <= last)]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*sorted(paths))


def by_source(rollup: DataFrame) -> DataFrame:
    """A7 from the roll-up: monthly sums by source, blank states left out as in the merged view."""
    return rollup.where(X.non_blank("state")).select("disease_name", "disease_slug", "state", "month", "data_source", "count")


def merged(rollup: DataFrame, priority: Iterable[str], key: str = "disease_name") -> DataFrame:
    """Q15 from the roll-up: one small scan, one exchange."""
    return merge_rolled(by_source(rollup), list(priority), key)


def county_counts(rollup: DataFrame, *keys: str) -> DataFrame:
    """A3 at scale: approximate distinct counties by ``keys``, from the stored sketches."""
    return rollup.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("counties")).alias("affected_counties"))
