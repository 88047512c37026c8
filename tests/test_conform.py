import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseflow.operators import conform as C


def test_parse_labels(spark):
    cases = {
        "Measles": ("Measles", None),
        "Measles, Imported": ("Measles", None),
        "Measles, Indigenous": ("Measles", None),
        "Meningococcal disease, Serogroup B": ("Meningococcal disease", "B"),
        "Meningococcal disease, Serogroups ACWY": ("Meningococcal disease", "ACWY"),
        "Meningococcal disease, Other serogroups": ("Meningococcal disease", "unspecified"),
        "Meningococcal disease, All serogroups": ("Meningococcal disease", None),
        "Meningococcal disease, Unknown serogroup": ("Meningococcal disease", "unknown"),
        "  Pertussis  ": ("Pertussis", None),
        "Thing,": ("Thing", None),
        "A, b, c": ("A", "b, c"),
        "X, Serogroup ": ("X", None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "label string")
    rows = C.parse_labels(df, "label", "base", "sub").collect()
    assert {r["label"]: (r["base"], r["sub"]) for r in rows} == cases


def test_classify_and_code_states(spark):
    df = spark.createDataFrame([("CALIFORNIA", None), ("U.S. Residents", None), ("NEW ENGLAND", "New England"),
                                ("Atlantis", None), (None, None), ("New York City", None)],
                               "area string, loc2 string")
    out = df.select("area", C.classify_geo(F.col("area")).alias("g")) \
        .select("area", "g", C.code_states(F.col("area"), F.col("g"), F.lit(None).cast("string")).alias("s"))
    got = {r["area"]: (r["g"], r["s"]) for r in out.collect()}
    assert got["CALIFORNIA"] == ("state", "CA")
    assert got["U.S. Residents"] == ("national", "US")
    assert got["NEW ENGLAND"][0] == "region"
    assert got["Atlantis"] == ("state", "Atlantis")
    assert got[None] == ("state", None)
    assert got["New York City"] == ("state", "NYC")


@pytest.mark.parametrize("standard,expected", [("compat", dt.date(2024, 1, 7)), ("cdc", dt.date(2023, 12, 31))])
def test_mmwr_week1(spark, standard, expected):
    df = spark.createDataFrame([(2024, 1)], "y int, w int")
    assert df.select(C.mmwr_week_start(F.col("y"), F.col("w"), standard).alias("d")).first()["d"] == expected


def test_mmwr_compat_matches_rule_over_years(spark):
    rows = spark.range(1990, 2040).select(F.col("id").cast("int").alias("y")) \
        .select("y", C.mmwr_week_start(F.col("y"), F.lit(1)).alias("d")).collect()
    for r in rows:
        jan1 = dt.date(r["y"], 1, 1)
        first_sunday = jan1 + dt.timedelta(days=(6 - jan1.weekday()) % 7)
        want = first_sunday if jan1.weekday() <= 3 else first_sunday + dt.timedelta(days=7)
        assert r["d"] == want
        assert r["d"].weekday() == 6


def test_clean_counts(spark):
    vals = {"25": 25, "-": None, "N": None, "1,234": 1234, "12.5": 125, None: None, " ": None}
    df = spark.createDataFrame([(k,) for k in vals], "c string")
    got = {r["c"]: r["n"] for r in df.select("c", C.clean_counts_col(F.col("c")).alias("n")).collect()}
    assert got == vals
    strict = {r["c"]: r["n"] for r in df.select("c", C.clean_counts_col(F.col("c"), strict=True).alias("n")).collect()}
    assert strict["12.5"] is None and strict["25"] == 25


def test_state_feed_defaults_and_cleaning(spark):
    raw = spark.createDataFrame(
        [("2024-01-07", "2024-01-13", "measles", "NA", "TX", "unknown", "n/a", "4"),
         ("2024-01-07", "2024-01-13", "measles", "Not specified", "TX", "0-1 y", "confirmed", None),
         ("2024-01-07", "2024-01-13", "measles", "omicron", "TX", " ", "Confirmed", "3")],
        "report_period_start string, report_period_end string, disease_name string, disease_subtype string, "
        "reporting_jurisdiction string, age_group string, confirmation_status string, count string")
    rows = C.load_state_feed(raw).collect()
    r0, r1, r2 = rows
    assert r0["state"] == "TX" and r0["geo_name"] == "TX" and r0["geo_unit"] == "state"
    assert r0["date_type"] == "cccd" and r0["time_unit"] == "month" and r0["outcome"] == "cases"
    assert r0["disease_subtype"] is None          # 'NA' is an NA token, not 'unspecified'
    assert r0["age_group"] is None and r0["confirmation_status"] is None
    assert r1["disease_subtype"] == "unspecified" and r1["count"] is None
    assert r2["disease_subtype"] == "omicron" and r2["age_group"] is None
    assert r0["report_period_start"] == dt.datetime(2024, 1, 7)
    assert r0["data_source"] == "tracker"


def test_with_fips_and_display(spark):
    df = spark.createDataFrame([("ca",), ("NYC",), ("PR",)], "state string")
    got = {r["state"]: (r["fips"], r["back"]) for r in
           C.with_state_from_fips(C.with_fips(df), "fips", "back").collect()}
    assert got == {"ca": ("06", "CA"), "NYC": (None, None), "PR": ("72", "PR")}
    names = spark.createDataFrame([("meningococcus",), ("west-nile-virus",)], "disease_slug string")
    shown = {r["disease_slug"]: r["display_name"] for r in C.with_display_name(names).collect()}
    assert shown == {"meningococcus": "Meningococcal Disease", "west-nile-virus": "West Nile Virus"}


def test_counts_are_cleaned_once_in_the_filter_below_the_projections(spark):
    raw = spark.createDataFrame([("OHIO", "2024", "1", "Measles", "1,2", "", "")],
                                "`Reporting Area` string, `Current MMWR Year` string, `MMWR WEEK` string, "
                                "Label string, `Current week` string, LOCATION1 string, LOCATION2 string")
    facts = C.drop_null_counts(C.conform_weekly_feed(raw))
    lines = facts._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum(line.count("[^0-9]") for line in lines if "Filter" in line) == 1
    assert facts.first()["count"] == 12


def test_labels_with_any_s_of_serogroup(spark):
    labels = {"M, ſerogroup B": "ſerogroup B", "M, B ſerogroups": "B", "M, SEROGROUPS w": "w", "M, b,c": "b,c",
              "M,": None, "M ,  x ": "x", "M": None, None: None, "M, serogroup": None}
    rows = C.parse_labels(spark.createDataFrame([(k,) for k in labels], "v string"), "v").collect()
    assert {r["v"]: r["disease_subtype"] for r in rows} == labels
