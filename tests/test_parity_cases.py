"""Name and area rules on inputs of our own."""
from pyspark.sql import functions as F

from caseflow.functions import columns as X
from caseflow.operators import conform as C

SLUGS = {
    "Lyme Disease": "lyme-disease", "Legionnaires' disease": "legionnaires-disease", "  two  spaces ": "two-spaces",
    "under_score": "under-score", "A.B.C": "abc", "one, two": "one-two", "ZIKA": "zika", "\t": None, "": None,
}
AREAS = {"TOTAL": "national", "us residents": "national", "Pacific": "region", "mountain": "region",
         "Oregon": "state", "OR": "state", "Springfield": "state"}


def test_slug_pairs(spark):
    df = spark.createDataFrame([(k,) for k in SLUGS], "v string")
    assert {r["v"]: r["s"] for r in df.select("v", X.slug("v").alias("s")).collect()} == SLUGS


def test_area_classes(spark):
    df = spark.createDataFrame([(k,) for k in AREAS] + [(None,)], "v string")
    got = {r["v"]: r["g"] for r in df.select("v", C.classify_geo(F.col("v")).alias("g")).collect()}
    assert got == {**AREAS, None: "state"}


def test_display_names_fall_back_to_the_slug(spark):
    df = spark.createDataFrame([("west-nile-virus",), ("h5n1-influenza",)], "disease_slug string")
    assert {r["display_name"] for r in C.with_display_name(df).collect()} == {"West Nile Virus", "H5N1 Influenza"}


def test_mmwr_weeks_run_sunday_to_saturday(spark):
    df = spark.range(1, 54).select(F.lit(2031).alias("y"), F.col("id").cast("int").alias("w"))
    rows = sorted(C.mmwr_periods(df, "y", "w").collect(), key=lambda r: r["report_period_start"])
    assert all(r["report_period_start"].weekday() == 6 and (r["report_period_end"] - r["report_period_start"]).days == 6 for r in rows)
    assert all((b["report_period_start"] - a["report_period_start"]).days == 7 for a, b in zip(rows, rows[1:]))


def test_mmwr_years_out_of_range_are_null(spark):
    df = spark.createDataFrame([(0, 2), (10000, 2), (1000000000, 2), (None, 2)], "y int, w int")
    assert [r["report_period_start"] for r in C.mmwr_periods(df, "y", "w").collect()] == [None] * 4
