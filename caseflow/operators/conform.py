"""Conforming transforms: raw feed rows -> unified fact rows.

Each function is a lazy DataFrame -> DataFrame step built from column
expressions, so a whole feed conforms in a single narrow projection
(no shuffle) that Catalyst can prune and push filters through.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import columns as X
from caseflow.functions import dims
from caseflow.operators.schema import conform, tag_source


# ------------------------------------------------------------------ S6 / P6 / P7
def null_na_tokens(df: DataFrame, cols: Iterable[str] | None = None,
                   tokens: Iterable[str] = dims.NA_TOKENS) -> DataFrame:
    """CSV NA tokens (case-sensitive, exact) -> null on string columns."""
    toks = list(tokens)
    targets = [c for c in (cols if cols is not None else df.columns)
               if dict(df.dtypes).get(c) == "string"]
    return df.withColumns({c: F.when(F.col(c).isin(toks), None).otherwise(F.col(c)) for c in targets})


def placeholder_to_null(c: Column) -> Column:
    """P6 expression: placeholder spellings (trimmed, lower-case) -> null, else the value unchanged."""
    key = F.lower(X.py_strip(c))
    return F.when(c.isNull() | key.isin(list(dims.PLACEHOLDERS)), None).otherwise(c)


def null_placeholders(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P6 as a table step."""
    return df.withColumns({c: placeholder_to_null(F.col(c)) for c in cols})


def normalize_subtype(df: DataFrame, col: str = "disease_subtype") -> DataFrame:
    """Blank -> null; known spellings -> 'unspecified'; anything else keeps its casing.

    The stripped key is its own projection so the regex runs once per row.
    """
    keyed = df.withColumn("_sub_key", F.lower(X.py_strip(F.col(col))))
    mapped = X.map_lookup(F.col("_sub_key"), dims.STATE_SUBTYPE_NORMALIZATION)
    return (keyed.withColumn(col, F.when(F.col(col).isNull() | (F.col("_sub_key") == ""), None)
                                   .otherwise(F.coalesce(mapped, F.col(col))))
                 .drop("_sub_key"))


# ------------------------------------------------------------------ P1 / P2 / P5
def mirror_jurisdiction(df: DataFrame) -> DataFrame:
    """If only one of ``state`` / ``reporting_jurisdiction`` exists, copy it to the other."""
    cols = set(df.columns)
    if "reporting_jurisdiction" in cols and "state" not in cols:
        return df.withColumn("state", F.col("reporting_jurisdiction"))
    if "state" in cols and "reporting_jurisdiction" not in cols:
        return df.withColumn("reporting_jurisdiction", F.col("state"))
    return df


SLUG_DIMENSIONS = ("disease", "disease_subtype", "reporting_jurisdiction", "state",
                   "geo_name", "geo_unit", "age_group")


def add_slug_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P5: add ``<c>_slug`` for every listed column (``disease_name`` -> ``disease_slug``)."""
    out = {}
    for c in cols:
        name = "disease_slug" if c == "disease_name" else f"{c}_slug"
        out[name] = X.slug(F.col(c))
    return df.withColumns(out)


def add_url_slugs(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """X2 as a table step: add ``<c>_url_slug`` columns.

    Rows whose values are all ASCII are composed as they are and stay in the JVM; only the
    others go through the Python normaliser. The input is read by both branches, so stage it
    if it is costly.
    """
    cols = list(cols)
    other = F.coalesce(F.greatest(F.lit(False), *[F.col(c).rlike(X.NOT_ASCII) for c in cols]), F.lit(False))
    plain = df.where(~other).withColumns({f"{c}_url_slug": X.url_slug(F.col(c), normalize=False) for c in cols})
    return plain.unionByName(df.where(other).withColumns({f"{c}_url_slug": X.url_slug(F.col(c)) for c in cols}))


# ------------------------------------------------------------------ P3: state feed
DATE_FORMATS = ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy/M/d", "yyyyMMdd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy")


def parse_timestamp(c: Column) -> Column:
    """Date text from a CSV -> timestamp_ntz: ISO, else the first of DATE_FORMATS that fits, else null."""
    text = F.trim(c)
    eight = F.when(text.contains("-") | ~text.rlike("^[0-9]{8}$"), text.try_cast("timestamp_ntz"))   # else a cast reads a year of 8 digits
    return F.coalesce(eight, *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS])


def parse_int(c: Column) -> Column:
    """Integer text, decimal notation too (``2024.0``); a fraction or anything else is null."""
    number = c.try_cast("double")
    return F.coalesce(c.try_cast("int"), F.when(number == F.floor(number), number.try_cast("int")))


def conform_state_feed(raw: DataFrame) -> DataFrame:
    """Per-state feed rows (CSV header names, string values) -> unified columns.

    Defaults (``date_type='cccd'``, ``time_unit='month'``, ``geo_unit='state'``,
    ``outcome='cases'``, ``geo_name=state``) apply only when the column is absent
    from the combined feed; a column present with nulls stays null.

    Two projections: values first, then slugs of those values, so no regex
    chain is evaluated twice per row.
    """
    mirrored = "reporting_jurisdiction" not in raw.columns and "state" in raw.columns
    df = mirror_jurisdiction(raw)
    cols = set(df.columns)

    def get(name: str, default: Column | None) -> Column:
        if name in cols:
            return F.col(name)
        return default if default is not None else F.lit(None).cast("string")

    count = F.col("count") if "count" in cols else F.lit(None)
    if "count" in cols and dict(df.dtypes)["count"] == "string":
        count = F.coalesce(count.try_cast("long"), count.try_cast("double").try_cast("long"))
    values = df.select(
        parse_timestamp(F.col("report_period_start").cast("string")).alias("report_period_start"),
        parse_timestamp(F.col("report_period_end").cast("string")).alias("report_period_end"),
        get("date_type", F.lit("cccd")).alias("date_type"),
        get("time_unit", F.lit("month")).alias("time_unit"),
        F.col("disease_name"),
        get("disease_subtype", None).alias("disease_subtype"),
        F.col("reporting_jurisdiction"),
        F.col("state"),
        get("geo_name", F.col("state")).alias("geo_name"),
        get("geo_unit", F.lit("state")).alias("geo_unit"),
        placeholder_to_null(get("age_group", None)).alias("age_group"),
        placeholder_to_null(get("confirmation_status", None)).alias("confirmation_status"),
        get("outcome", F.lit("cases")).alias("outcome"),
        count.cast("long").alias("count"),
        F.col("disease_name").alias("original_disease_name"),
    )
    slugged = ["disease_name", "disease_subtype", "state", "geo_name", "geo_unit", "age_group"]
    if not mirrored:
        slugged.append("reporting_jurisdiction")
    out = add_slug_columns(normalize_subtype(values), slugged)
    if mirrored:  # the jurisdiction is a copy of the state: reuse its slug
        out = out.withColumn("reporting_jurisdiction_slug", F.col("state_slug"))
    return out


# ------------------------------------------------------------------ P8-P13: weekly feed
WEEKLY_AREA = "Reporting Area"
WEEKLY_YEAR = "Current MMWR Year"
WEEKLY_WEEK = "MMWR WEEK"
WEEKLY_LABEL = "Label"
WEEKLY_COUNT = "Current week"
WEEKLY_LOC2 = "LOCATION2"


def parse_labels(df: DataFrame, label: str, base_out: str = "_base",
                 subtype_out: str = "disease_subtype") -> DataFrame:
    """P8/X14: 'Disease, Subtype' -> (base, subtype) columns.

    No comma -> (label, null). Total-like suffixes -> null subtype. A leading
    'serogroup(s) ' and a trailing 'serogroup(s)' are removed; 'other' ->
    'unspecified'. An empty remainder is null. Each stage is its own
    projection so every regex runs once per row.
    """
    s1 = df.withColumn("_lab", X.py_strip(F.col(label)))
    s2 = s1.withColumns({
        "_has_comma": F.instr("_lab", ",") > 0,
        "_after": F.when(F.instr("_lab", ",") > 0, F.substr("_lab", F.instr("_lab", ",") + 1))
                   .when(F.col("_lab").isNotNull(), F.lit("")),
    }).withColumn("_raw_sub", X.py_strip(F.col("_after"))).drop("_after")
    trimmed = F.regexp_replace(
        F.regexp_replace("_raw_sub", r"(?i)^serogroups? ", ""),
        r"(?iU)[\s\x1c-\x1f]*serogroups?[\s\x1c-\x1f]*$", "")
    # without its first letter, which may be any that folds to an s
    has_word = F.lower("_raw_sub").contains("erogroup")
    s3 = s2.withColumns({
        base_out: F.when(F.col("_has_comma"), X.py_strip(F.substring_index("_lab", ",", 1))).otherwise(F.col("_lab")),
        "_no_suffix": F.when(has_word, X.py_strip(trimmed)).otherwise(F.col("_raw_sub")),
    })
    normalized = F.coalesce(X.map_lookup(F.lower("_no_suffix"), dims.WEEKLY_SUBTYPE_NORMALIZATION),
                            F.col("_no_suffix"))
    skip = ~F.col("_has_comma") | (F.col("_raw_sub") == "") | \
        F.lower("_raw_sub").isin(list(dims.AGGREGATE_SUBTYPES))
    s4 = s3.withColumn(subtype_out, F.when(skip, F.lit(None).cast("string"))
                       .otherwise(F.nullif(normalized, F.lit(""))))
    return s4.drop("_lab", "_has_comma", "_raw_sub", "_no_suffix")


def classify_geo(area: Column, area_slug: Column | None = None) -> Column:
    """Reporting area -> 'national' | 'region' | 'state' (null/blank -> 'state')."""
    sl = X.slug(area) if area_slug is None else area_slug
    return (F.when(area.isNull() | (area == ""), F.lit("state"))
             .when(sl.isin(list(dims.NATIONAL_SLUGS)), F.lit("national"))
             .when(sl.isin(list(dims.REGION_SLUGS)), F.lit("region"))
             .otherwise(F.lit("state")))


def code_states(area: Column, geo_unit: Column, location2: Column) -> Column:
    """P10: state -> two-letter code (unknown names kept), region -> LOCATION2 else area, national -> 'US'."""
    return (F.when(geo_unit == "state", F.coalesce(X.map_upper(area, dims.STATE_CODES), area))
             .when(geo_unit == "region", F.coalesce(location2, area))
             .when(geo_unit == "national", F.lit("US"))
             .otherwise(area))


def mmwr_week_start(year: Column, week: Column, standard: str = "compat") -> Column:
    """Epidemiological (year, week) -> Sunday starting that week, as a date.

    ``compat`` reproduces the feed's published rule: week 1 starts on the
    first Sunday on/after Jan 1 when Jan 1 falls Monday-Thursday, else one
    week later. ``cdc`` is the standard rule: the Sunday on/before Jan 4.
    A year outside 1 to 9999 gives null.
    """
    year = F.when(year.between(1, 9999), year)
    jan1 = F.make_date(year, F.lit(1), F.lit(1))
    if standard == "cdc":
        jan4 = F.make_date(year, F.lit(1), F.lit(4))
        week1 = F.date_sub(jan4, F.dayofweek(jan4) - 1)
    elif standard == "compat":
        wd = F.weekday(jan1)  # Monday = 0 .. Sunday = 6
        first_sunday = F.date_add(jan1, F.pmod(F.lit(6) - wd, F.lit(7)))
        week1 = F.when(wd <= 3, first_sunday).otherwise(F.date_add(first_sunday, 7))
    else:
        raise ValueError(f"unknown MMWR standard {standard!r}")
    return F.date_add(week1, (week - 1) * 7)


def mmwr_periods(df: DataFrame, year: str = WEEKLY_YEAR, week: str = WEEKLY_WEEK,
                 standard: str = "compat") -> DataFrame:
    """P11 as a table step: add ``report_period_start`` / ``report_period_end`` (Sunday..Saturday)."""
    start = mmwr_week_start(F.col(year), F.col(week), standard)
    return df.withColumns({
        "report_period_start": start.cast("timestamp_ntz"),
        "report_period_end": F.date_add(start, 6).cast("timestamp_ntz"),
    })


def clean_counts_col(c: Column, strict: bool = False) -> Column:
    """Keep only the digits; blank -> null. ``strict`` nulls anything that is not an integer."""
    if strict:
        return X.py_strip(c).try_cast("long")
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "").try_cast("long")    # no digits: null


def canonical_disease(slug_col: Column) -> Column:
    """Weekly-feed disease slug -> canonical slug (alias table, else unchanged)."""
    return F.coalesce(X.map_lookup(slug_col, dims.DISEASE_ALIASES), slug_col)


def conform_weekly_feed(raw: DataFrame, standard: str = "compat", strict_counts: bool = False) -> DataFrame:
    """Weekly national feed -> unified columns (all geo levels; F1/F2 are separate).

    Staged projections (area slug and label -> parsed parts -> codes and
    dates -> slugs) keep each regex evaluated once per row.
    """
    loc2 = F.col(WEEKLY_LOC2) if WEEKLY_LOC2 in raw.columns else F.lit(None).cast("string")
    s1 = raw.select(
        F.col(WEEKLY_AREA).alias("geo_name"),
        X.slug(F.col(WEEKLY_AREA)).alias("geo_name_slug"),
        parse_int(F.col(WEEKLY_YEAR)).alias("_year"),
        parse_int(F.col(WEEKLY_WEEK)).alias("_week"),
        F.col(WEEKLY_LABEL).alias("original_disease_name"),
        loc2.alias("_loc2"),
        clean_counts_col(F.col(WEEKLY_COUNT), strict_counts).alias("count"),
    )
    s2 = parse_labels(s1.withColumn("geo_unit", classify_geo(F.col("geo_name"), F.col("geo_name_slug"))),
                      "original_disease_name")
    s3 = s2.select(
        "*",
        mmwr_week_start(F.col("_year"), F.col("_week"), standard).alias("_start"),
        code_states(F.col("geo_name"), F.col("geo_unit"), F.col("_loc2")).alias("state"),
        X.slug(F.col("_base")).alias("_base_slug"),
    ).withColumn("disease_name", canonical_disease(F.col("_base_slug")))
    s4 = s3.select(
        F.col("_start").cast("timestamp_ntz").alias("report_period_start"),
        F.date_add("_start", 6).cast("timestamp_ntz").alias("report_period_end"),
        F.lit("mmwr").alias("date_type"),
        F.lit("week").alias("time_unit"),
        "disease_name", F.col("disease_name").alias("disease_slug"),
        "disease_subtype",
        F.col("state").alias("reporting_jurisdiction"),
        "state", "geo_name", "geo_name_slug", "geo_unit",
        F.lit(None).cast("string").alias("age_group"),
        F.lit(None).cast("string").alias("confirmation_status"),
        F.lit("cases").alias("outcome"),
        "count", "original_disease_name",
    )
    # jurisdiction is the state code here, and geo_unit is one of three values that
    # are already slugs, so those two slug columns need no regex work of their own
    out = add_slug_columns(s4, ["disease_subtype", "state", "age_group"])
    return out.withColumns({"reporting_jurisdiction_slug": F.col("state_slug"),
                            "geo_unit_slug": F.col("geo_unit")})


# ------------------------------------------------------------------ F1 / F2
def drop_null_counts(df: DataFrame) -> DataFrame:
    """F1."""
    return df.where(F.col("count").isNotNull())


def state_level_only(df: DataFrame) -> DataFrame:
    """F2."""
    return df.where(F.col("geo_unit") == "state")


# ------------------------------------------------------------------ P14 / P15
def with_display_name(df: DataFrame, slug_col: str = "disease_slug", out: str = "display_name") -> DataFrame:
    """Mapped display name, else the slug title-cased."""
    c = F.col(slug_col)
    return df.withColumn(out, F.coalesce(X.map_lookup(c, dims.DISPLAY_NAMES), X.title_from_slug(c)))


def with_fips(df: DataFrame, state_col: str = "state", out: str = "fips") -> DataFrame:
    """State code -> FIPS (case-insensitive); unknown -> null. 56-entry literal map, no join."""
    return df.withColumn(out, X.map_upper(F.col(state_col), dims.STATE_TO_FIPS))


def with_state_from_fips(df: DataFrame, fips_col: str = "fips", out: str = "state_code") -> DataFrame:
    """P15 reverse: FIPS (zero-padded to 2) -> state code."""
    reverse = {v: k for k, v in dims.STATE_TO_FIPS.items()}
    return df.withColumn(out, X.map_lookup(X.zfill(F.col(fips_col).cast("string"), 2), reverse))


# ------------------------------------------------------------------ K1: per-source load template
def load_state_feed(raw: DataFrame) -> DataFrame:
    """K1 for the per-state feed: NA tokens -> conform -> tag -> schema order (lazy)."""
    return conform(tag_source(conform_state_feed(null_na_tokens(raw)), "tracker"))


def load_weekly_feed(raw: DataFrame, standard: str = "compat", strict_counts: bool = False) -> DataFrame:
    """K1 for the weekly feed: NA tokens (plus ' ') -> conform -> F1 -> F2 -> tag -> schema order."""
    cleaned = null_na_tokens(raw, tokens=dims.NA_TOKENS + dims.WEEKLY_EXTRA_NA)
    facts = state_level_only(drop_null_counts(conform_weekly_feed(cleaned, standard, strict_counts)))
    return conform(tag_source(facts, "nndss"))
