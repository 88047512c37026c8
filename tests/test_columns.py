import datetime as dt

from pyspark.sql import functions as F

from caseflow.functions import columns as X


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("out")).first()["out"]


def test_slug_cases(spark):
    cases = {
        "Meningococcal disease": "meningococcal-disease",
        "U.S. Residents": "us-residents",
        "OTHER": "other",
        "Serogroup B": "serogroup-b",
        "  spaced   out_name ": "spaced-out-name",
        "--dashes--": "dashes",
        "Café Ñandú": "café-ñandú",
        "!!!": None,
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", X.slug("v").alias("s")).collect()
    got = {r["v"]: r["s"] for r in rows}
    assert got == cases


def test_url_slug(spark):
    assert one(spark, X.url_slug("v"), "Legionnaires' Disease (LD), all") == "legionnaires-disease-ld-all"


def test_url_slug_normalizes_decomposed_accents(spark):
    import unicodedata
    decomposed = unicodedata.normalize("NFD", "Café Ñandú")
    assert one(spark, X.url_slug("v"), decomposed) == one(spark, X.url_slug("v"), "Café Ñandú") == "caf-and"
    assert one(spark, X.url_slug("v", normalize=False), decomposed) == "cafe-n-andu"


def test_title_from_slug_matches_python_title(spark):
    for s in ["h1n1-influenza", "covid-19", "west-nile-virus", "e-coli"]:
        assert one(spark, X.title_from_slug("v"), s) == s.replace("-", " ").title()


def test_zfill_never_truncates(spark):
    assert one(spark, X.zfill("v", 2), "6") == "06"
    assert one(spark, X.zfill("v", 2), "123") == "123"


def test_quantile_bin(spark):
    breaks = F.array(*[F.lit(x) for x in (9.8, 14.6, 23.4, 35.6)])
    vals = [5, 9.8, 11, 46, 0]
    rows = spark.createDataFrame([(float(v),) for v in vals], "v double") \
        .select("v", X.quantile_bin("v", breaks).alias("b")).collect()
    assert {r["v"]: r["b"] for r in rows} == {5.0: 0, 9.8: 1, 11.0: 1, 46.0: 4, 0.0: None}


def test_round_half_even_and_percent(spark):
    assert one(spark, X.round_half_even(X.percent_of(F.lit(1), F.lit(32)), 2), 1) == 3.12
    assert one(spark, X.percent_of(F.lit(3), F.lit(0)), 1) == 0.0


def test_truncate_period_week_is_monday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 12),)], "ts timestamp_ntz")
    r = df.select(X.truncate_period("ts", "week").alias("w"), X.truncate_period("ts", "bogus").alias("m")).first()
    assert r["w"] == dt.datetime(2024, 1, 1)
    assert r["m"] == dt.datetime(2024, 1, 1)
    assert df.select(X.truncate_period("ts", "week")).schema.fields[0].dataType.typeName() == "timestamp_ntz"


def test_strict_granularity_raises():
    import pytest
    with pytest.raises(ValueError):
        X.check_granularity("year", strict=True)


def test_round_is_python_round(spark):
    totals = [7, 199, 400, 4000, 20000]
    rows = [(k, t) for t in totals for k in range(0, t + 1, max(1, t // 2500))] + [(k, 20000) for k in range(1, 20000, 2)]
    df = spark.createDataFrame(rows, "k long, t long")
    pct = X.percent_of("k", "t")
    for r in df.select("k", "t", pct.alias("p"), X.round_half_even(pct, 2).alias("r")).collect():
        assert r["r"] == round(r["k"] / r["t"] * 100.0, 2), r
    ties = spark.createDataFrame([(x,) for x in (0.125, 0.375, 2.5, -0.125, 0.0, 1e-9, 99.995)], "v double")
    for r in ties.select("v", X.round_half_even("v", 2).alias("r")).collect():
        assert r["r"] == round(r["v"], 2), r


def test_strip_and_slug_are_their_patterns_for_every_character(spark):
    codes = [*range(0x01, 0xD800), *range(0xE000, 0x10000), 0x1D7D8, 0x1F600]
    texts = [t.format(chr(i)) for i in codes for t in ("{0}", "a{0}", "{0}a", "a{0}B", "{0} x\n")]
    space = r"\s\x1c-\x1f"
    strip = F.regexp_replace("v", rf"(?U)^[{space}]+|[{space}]+$", "")
    s = F.regexp_replace(F.lower("v"), rf"(?U)[^\p{{L}}\p{{N}}_{space}-]", "")
    s = F.regexp_replace(F.regexp_replace(s, rf"(?U)[{space}_-]+", "-"), "^-|-$", "")
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", " ", "a__b - c", "-a", "a b\r\n"]], "v string")
    wrong = df.where(~X.py_strip("v").eqNullSafe(strip) | ~X.slug("v").eqNullSafe(F.nullif(s, F.lit(""))))
    assert wrong.collect() == []


def test_strip_and_slug_meet_unicode_patterns_behind_a_cheap_look_only(spark):
    df = spark.createDataFrame([("a b",)], "v string")
    for expr, pattern in ((X.py_strip("v"), "(?U)^["), (X.slug("v"), "(?U)[^")):
        plan = df.select(expr.alias("out"))._jdf.queryExecution().optimizedPlan().toString()
        assert pattern in plan and "CASE WHEN" in plan.split(pattern)[0]


def test_interleave_bits_takes_the_lowest_bits_in_turn(spark):
    for bits in (1, 5, 10, 16, 17, 31):
        pairs = [(a, b) for a in (0, 1, 5, 682, 1023, 65537, 2**31 - 1, -3) for b in (0, 3, 1000, 2**30 + 7, -1)]
        got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", X.interleave_bits("a", "b", bits).alias("z")).collect()
        for a, b, z in got:
            assert z == sum(((b >> i & 1) << 2 * i) | ((a >> i & 1) << 2 * i + 1) for i in range(bits))
