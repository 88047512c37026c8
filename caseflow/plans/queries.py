"""User-facing query operators (Q1-Q14, Q17, Q18).

Each takes the fact DataFrame (and the merged DataFrame where totals must
not double count overlapping feeds) and returns tidy rows. Per-disease
operators accept ``disease=None`` to answer for every disease in one plan
(the disease becomes a grouping key), or a name to answer for one disease.
Nothing is collected: each result is one lazy plan of scans, partial
aggregates, one exchange per aggregate and joins between small aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import columns as X
from caseflow.functions import dims
from caseflow.operators import aggregates as A
from caseflow.operators import filters as FL
from caseflow.operators import joins as J
from caseflow.operators import windows as W


def _scope(facts: DataFrame, disease: str | None, source: str | None) -> DataFrame:
    return FL.from_source(FL.for_disease(facts, name=disease), source)


# ------------------------------------------------------------------ catalogue queries
def disease_names(facts: DataFrame, source: str | None = None) -> DataFrame:
    """Q1: distinct disease names (optionally of one source), sorted."""
    return W.distinct_values(FL.from_source(facts, source), "disease_name").orderBy("disease_name")


def disease_catalog(facts: DataFrame, source: str | None = None) -> DataFrame:
    """Q2: (disease_name, disease_slug, sources). With ``source``: only disease names that have
    a row from it, but listing all of their sources."""
    return _catalog(facts, source).orderBy("disease_name", "disease_slug")


def _catalog(facts: DataFrame, source: str | None) -> DataFrame:
    sets = facts.groupBy("disease_name", "disease_slug").agg(F.collect_set("data_source").alias("sources"))
    listed = J.having_source(sets, source, key="disease_slug")
    return listed.withColumn("sources", F.array_join(F.array_sort("sources"), ","))


def disease_name_by_slug(facts: DataFrame, slugs: str | list[str] | None = None) -> DataFrame:
    """Q3: slug -> name (the smallest spelling when a slug has several); absent slug -> no row."""
    return W.first_match(FL.for_disease(facts, slug=slugs), "disease_slug", "disease_name")


def sources_by_slug(facts: DataFrame, slugs: str | list[str] | None = None) -> DataFrame:
    """Q4: slug -> sorted comma list of its sources."""
    return A.list_sources_by(FL.for_disease(facts, slug=slugs), "disease_slug")


def states(facts: DataFrame, source: str | None = None) -> DataFrame:
    """Q5: distinct states, sorted."""
    return W.distinct_values(FL.from_source(facts, source), "state").orderBy("state")


# ------------------------------------------------------------------ totals
def summary_stats(facts: DataFrame, merged: DataFrame, source: str | None = None,
                  rollup: DataFrame | None = None) -> DataFrame:
    """Q6: one row of totals. ``total_cases`` comes from the merged rows when no source is
    given (no double counting), else from that source's raw rows. With ``rollup``, the
    stored monthly roll-up, the facts are not read."""
    if rollup is not None:
        parts = FL.from_source(rollup, source).groupBy("disease_name", "state").agg(
            F.sum("records").alias("_n"), F.sum("count").alias("_s"), F.min("first_start").alias("_from"), F.max("last_end").alias("_to"))
    else:
        # one pass over the rows; all six numbers come from its result, one row a disease and state
        parts = FL.from_source(facts, source).groupBy("disease_name", "state").agg(
            F.count(F.lit(1)).alias("_n"), F.sum("count").alias("_s"),
            F.min("report_period_start").alias("_from"), F.max("report_period_end").alias("_to"))
    stats = parts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_records"),
        F.count_distinct("disease_name").alias("disease_count"),
        F.count_distinct("state").alias("total_states"),
        F.sum("_s").cast("long").alias("_raw_cases"),
        F.min("_from").alias("earliest_date"),
        F.max("_to").alias("latest_date"),
    )
    if source:
        return stats.withColumnRenamed("_raw_cases", "total_cases")
    total = merged.agg(F.sum("count").cast("long").alias("total_cases"))
    return J.attach_scalar(stats.drop("_raw_cases"), total)


def source_breakdown(facts: DataFrame) -> DataFrame:
    """Q7: (data_source, records, cases); never filtered by source."""
    return A.source_breakdown(facts)


def disease_totals(facts: DataFrame, merged: DataFrame, source: str | None = None) -> DataFrame:
    """Q8: (disease_name, total_cases); merged rows when no source is given."""
    base = merged if not source else FL.from_source(facts, source)
    return A.sum_cases(base, "disease_name").orderBy("disease_name")


# ------------------------------------------------------------------ time series
def national_timeseries(facts: DataFrame, disease: str | None = None, granularity: str = "month",
                        source: str | None = None, strict: bool = False, dedupe: bool = False,
                        merged: DataFrame | None = None) -> DataFrame:
    """Q9: (disease_name, period, total_cases) summed over all states of the raw rows.

    Like the feeds' API this reads raw rows even without a source, so overlapping
    feeds add up. ``dedupe=True`` reads the ``merged`` rows instead, whose months
    take each state's best source: months only, and no single source.
    """
    g = X.check_granularity(granularity, strict)
    if not dedupe:
        return A.sum_by_period(_scope(facts, disease, source), g, "disease_name")
    if merged is None or g != "month" or source:
        raise ValueError("de-duplicated series are the merged rows' months, over all sources")
    return (FL.for_disease(merged, name=disease).groupBy("disease_name", F.col("month").alias("period"))
              .agg(X.zero_if_null(F.sum("count")).alias("total_cases")))


def state_timeseries(facts: DataFrame, disease: str | None = None, granularity: str = "month",
                     source: str | None = None, strict: bool = False) -> DataFrame:
    """Q12: (level, state, disease_name, period, cases): each state's series plus the national
    series (state = 'National'), from one GROUPING SETS aggregate."""
    g = X.check_granularity(granularity, strict)
    rows = _scope(facts, disease, source).select(
        "disease_name", "state", X.truncate_period("report_period_start", g).alias("period"), "count")
    return A.with_national(rows, ["disease_name", "period"], state="state", value="count", out="cases")


# ------------------------------------------------------------------ disease stats
def disease_stats(facts: DataFrame, merged: DataFrame, disease: str | None = None,
                  source: str | None = None, days: int = 14, rollup: DataFrame | None = None,
                  approx_counties: bool = False) -> DataFrame:
    """Q10: (disease_name, total_cases, affected_states, affected_counties, two_week_cases).

    Without a source, cases and states come from the merged rows; counties
    and the trailing-window sum always come from raw rows. The trailing
    window ends at the latest period end of the disease (inclusive, 15 days).
    The raw rows are read once, rolled up to (disease, period end, county).
    ``approx_counties`` takes the counties from the sketches of ``rollup`` (a relative
    standard error of 1.6 %): the rows are then combined by period end alone, however
    many counties there are.
    """
    raw = _scope(facts, disease, source)
    if approx_counties:
        from caseflow.plans.rollup import county_counts
        if rollup is None:
            raise ValueError("approximate counties come from a stored roll-up")
        ends = raw.groupBy("disease_name", "report_period_end").agg(F.sum("count").alias("_s"))
    else:
        county = F.when(X.non_blank("geo_name"), F.col("geo_name")).alias("_county")
        ends = raw.groupBy("disease_name", "report_period_end", county).agg(F.sum("count").alias("_s"))
    latest = F.max("report_period_end").over(Window.partitionBy("disease_name"))
    recent = F.col("report_period_end") >= X.days_before(F.col("_latest"), days)
    counties = [] if approx_counties else [F.count_distinct("_county").alias("affected_counties")]
    out = (ends.withColumn("_latest", latest).groupBy("disease_name")
               .agg(F.sum(F.when(recent, F.col("_s"))).alias("two_week_cases"), *counties))
    if approx_counties:
        out = out.join(county_counts(_scope(rollup, disease, source), "disease_name"), "disease_name", "left")
    base = FL.for_disease(merged, name=disease) if not source else raw
    totals = base.groupBy("disease_name").agg(X.zero_if_null(F.sum("count")).alias("total_cases"),
                                              F.count_distinct("state").alias("affected_states"))
    # every disease in scope has its latest-end row, so the left side lists them all
    return out.join(totals, "disease_name", "left").select(
        "disease_name",
        X.zero_if_null("total_cases").alias("total_cases"),
        X.zero_if_null("affected_states").alias("affected_states"),
        X.zero_if_null("affected_counties").alias("affected_counties"),
        X.zero_if_null("two_week_cases").alias("two_week_cases"),
    )


# ------------------------------------------------------------------ distributions
def age_distribution(facts: DataFrame, disease: str | None = None, source: str | None = None,
                     start=None, end=None) -> DataFrame:
    """Q11: (disease_name, state, age_group, count, percentage), dense.

    Every state in scope (even one without age data: all zeros) times every
    age group seen for the disease; 'total' groups and blanks excluded;
    percentage = count / state total * 100, half-even to 2 places.
    One aggregate over the facts; the grid is built from that aggregate.
    """
    scope = FL.apply_filters(facts, disease, source, start, end)
    valid_age = X.non_blank("age_group") & ~X.contains_ci("age_group", "total")
    agg = (scope.groupBy("disease_name", "state",
                         F.when(valid_age, F.col("age_group")).alias("age_group"))
                .agg(X.zero_if_null(F.sum("count")).alias("count")))
    return A.dense_shares(agg, ["disease_name"], "state", "age_group", "count", "percentage")


def subtype_distribution(facts: DataFrame, disease: str | None = None, source: str | None = None) -> DataFrame:
    """Q13: (disease_slug, state, disease_subtype_slug, count, percentage), dense within the
    states that have any subtype data. Matching is by slug; a state is labelled
    by its code (the largest spelling when one slug has several)."""
    scope = FL.from_source(facts, source)
    if disease is not None:
        scope = scope.where(F.col("disease_slug") == X.slug(F.lit(disease)))  # folded to a literal
    scope = FL.with_subtype(scope)
    agg = (scope.groupBy("disease_slug", "state_slug", "disease_subtype_slug")
                .agg(X.zero_if_null(F.sum("count")).alias("count"), F.max("state").alias("_state")))
    shares = A.dense_shares(agg, ["disease_slug"], "state_slug", "disease_subtype_slug",
                            row_aggs={"state": F.max("_state")})
    return shares.select("disease_slug", "state", "disease_subtype_slug", "count", "percentage")


# ------------------------------------------------------------------ map totals
def state_totals(facts: DataFrame, merged: DataFrame, disease: str | None = None,
                 source: str | None = None, start=None, end=None) -> DataFrame:
    """Q14: (disease_name, state, fips, cases, min_cases, max_cases) for the choropleth.

    Without a source: merged rows, months in [start, end] (the month's first
    day is compared); with a source: raw rows whose period lies inside
    [start, end]. States without a FIPS code and zero totals are dropped;
    min/max are over the kept states of each disease.
    """
    if source:
        base = FL.non_blank(FL.apply_filters(facts, disease, source, start, end), "state")
    else:
        base = FL.month_between(FL.for_disease(merged, name=disease), start, end)
    totals = base.groupBy("disease_name", "state").agg(X.zero_if_null(F.sum("count")).alias("cases"))
    mapped = FL.mappable_positive(totals.withColumn("fips", X.map_lookup(F.col("state"), dims.STATE_TO_FIPS)))
    return (A.with_extent(mapped, "cases", by=["disease_name"])
             .select("disease_name", "state", "fips", "cases", "min_cases", "max_cases"))


def state_totals_merged_pruned(facts: DataFrame, merge, disease: str | None = None, start=None,
                               end=None) -> DataFrame:
    """Q14 without a source, with the month bound pushed to the raw scan before merging.

    ``merge`` is a facts -> merged function; restricting raw rows to the months
    in range first is exact because the merge never mixes months.
    """
    pruned = FL.month_scan_bounds(FL.for_disease(facts, name=disease), start, end)
    return state_totals(pruned, merge(pruned), disease, None, start, end)


# ------------------------------------------------------------------ page compositions
def disease_cards(facts: DataFrame, merged: DataFrame, source: str | None = "tracker") -> DataFrame:
    """Q17: disease list (default: those with tracker rows; 'all' = every disease) with
    merged totals (null when a disease has none)."""
    effective = None if source == "all" else (source or "tracker")
    totals = A.sum_cases(merged, "disease_name")
    return J.enrich_totals(_catalog(facts, effective), totals, "disease_name")


def state_selector(facts: DataFrame, merged: DataFrame, disease: str | None = None) -> DataFrame:
    """Q18: (disease_name, state, total, position): mapped state totals plus 'National'
    (their sum), ranked by total with National pinned first."""
    st = state_totals(facts, merged, disease).select("disease_name", "state", "cases")
    # state rows and the National row from one GROUPING SETS pass over the state totals
    both = A.with_national(st, ["disease_name"], state="state", value="cases", out="total").drop("level")
    return W.rank_states(both, by=["disease_name"], state="state", total="total", pin="National")
