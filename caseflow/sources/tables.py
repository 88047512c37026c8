"""Raw feeds derived from the benchmark tables (orders, customer, lineitem).

The engine's inputs are two case-count feeds. To run every operator over
tables that grow with the scale factor, both feeds are derived row-for-row
from the given tables, in the raw text form a CSV reader would deliver:

* per-state feed  <- orders JOIN customer           (one row per order)
* weekly feed     <- lineitem JOIN orders JOIN customer (one row per line)

The mapping is deterministic and integer-valued, so a SQL engine can
rebuild the same rows (see ``caseflow.plans.oracle``). It exercises the
feeds' quirks: placeholder and NA spellings, label suffixes, count text
with flags and thousands separators, non-state areas, a disease alias and
two casings of one disease name across feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Synthetic mapping of the benchmark tables onto the feeds (our own choice,
# shared with the oracle SQL so both sides build identical rows).
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
STATE_FEED_DISEASE = {"AUTOMOBILE": "measles", "BUILDING": "pertussis", "FURNITURE": "meningococcus",
                      "HOUSEHOLD": "COVID-19", "MACHINERY": "influenza"}
WEEKLY_FEED_DISEASE = {"AUTOMOBILE": "Measles", "BUILDING": "Pertussis",
                       "FURNITURE": "Meningococcal disease", "HOUSEHOLD": "COVID-19",
                       "MACHINERY": "Influenza"}
# nation key -> state code of the per-state feed
STATE_BY_NATION = ("AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "DC", "FL", "GA", "HI", "ID",
                   "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "NYC", "PR", "GU")
# nation key -> reporting area of the weekly feed (two keys are not states)
AREA_BY_NATION = ("ALABAMA", "Alaska", "ARIZONA", "U.S. Residents", "CALIFORNIA", "COLORADO",
                  "CONNECTICUT", "NEW ENGLAND", "DISTRICT OF COLUMBIA", "FLORIDA", "GEORGIA",
                  "HAWAII", "IDAHO", "ILLINOIS", "INDIANA", "IOWA", "KANSAS", "KENTUCKY",
                  "LOUISIANA", "MAINE", "MARYLAND", "Massachusetts", "NEW YORK CITY",
                  "PUERTO RICO", "GUAM")
REGION_LOCATION2 = {7: "New England"}
AGE_BY_MOD8 = ("0-1 y", "1-4 y", "5-11 y", "12-17 y", "18-24 y", "65+ y", "Total", "unknown")
STATUS_BY_ORDERSTATUS = {"F": "confirmed", "O": "probable", "P": "n/a"}
LABEL_SUFFIX_BY_LINE = {1: "", 2: ", Serogroup B", 3: ", Other serogroups", 4: ", All serogroups",
                        5: ", Imported", 6: ", Serogroups ACWY", 7: ", Unknown serogroup"}


def _case(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def state_feed_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-state feed rows as CSV text: one row per order.

    The join to customer is left to Catalyst/AQE: it becomes a broadcast
    only when the measured customer side is under the broadcast threshold.
    """
    o = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    start = F.date_sub(F.to_date("o_orderdate"), F.dayofweek("o_orderdate") - 1)
    key = F.col("o_orderkey")
    return j.select(
        F.date_format(start, "yyyy-MM-dd").alias("report_period_start"),
        F.date_format(F.date_add(start, 6), "yyyy-MM-dd").alias("report_period_end"),
        _case(F.col("c_mktsegment"), STATE_FEED_DISEASE).alias("disease_name"),
        F.when(key % 11 == 0, F.lit("NA")).otherwise(F.substring("o_orderpriority", 3, 100)).alias("disease_subtype"),
        _case(F.col("c_nationkey"), dict(enumerate(STATE_BY_NATION))).alias("state"),
        F.concat(F.lit("county-"), (F.col("o_custkey") % 50).cast("string")).alias("geo_name"),
        _case(key % 8, dict(enumerate(AGE_BY_MOD8))).alias("age_group"),
        _case(F.col("o_orderstatus"), STATUS_BY_ORDERSTATUS).alias("confirmation_status"),
        F.when(key % 97 == 0, F.lit(None).cast("string")).otherwise((key % 7).cast("string")).alias("count"),
    )


def weekly_feed_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly feed rows as CSV text (original header names): one row per line item."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner").join(c, F.col("o_custkey") == c.c_custkey, "inner")
    qty = F.col("l_quantity").cast("int").cast("string")
    line = F.col("l_linenumber")
    area = _case(F.col("c_nationkey"), dict(enumerate(AREA_BY_NATION)))
    week = F.least(F.lit(52), F.lit(1) + F.floor((F.dayofyear("l_shipdate") - 1) / 7).cast("int"))
    return j.select(
        area.alias("Reporting Area"),
        F.year("l_shipdate").cast("string").alias("Current MMWR Year"),
        week.cast("string").alias("MMWR WEEK"),
        F.concat(_case(F.col("c_mktsegment"), WEEKLY_FEED_DISEASE),
                 _case(line, LABEL_SUFFIX_BY_LINE, "")).alias("Label"),
        F.when(line == 7, F.lit("-"))
         .when(line == 6, F.concat(F.lit("1,"), F.lpad(qty, 3, "0")))
         .when(F.col("l_orderkey") % 13 == 0, F.lit("N"))
         .otherwise(qty).alias("Current week"),
        area.alias("LOCATION1"),
        _case(F.col("c_nationkey"), REGION_LOCATION2).alias("LOCATION2"),
    )
