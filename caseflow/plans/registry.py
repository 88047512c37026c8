"""Registered queries: one entry per operator/query, each with its DuckDB oracle.

Every entry reads the benchmark tables at ``sf_dir`` (through the fact
table Spark derives from them), over whole tables; parameters are the
features of the query (a granularity, a date range, a state selection).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import columns as X
from caseflow.functions import dims
from caseflow.operators import aggregates as A
from caseflow.operators import conform as C
from caseflow.operators import filters as FL
from caseflow.operators import windows as W
from caseflow.operators.merge import merged_monthly, monthly_by_source
from caseflow.operators import joins as J
from caseflow.operators.schema import REQUIRED_NON_NULL, integrity_report, validate
from caseflow.plans import analytics as AN
from caseflow.plans import oracle as O
from caseflow.plans import queries as Q
from caseflow.plans import rollup as RU
from caseflow.plans.catalog import (build_name_mapping, facts_table, from_arrow, load_all, open_or_build, register_views, rollup_table,
                                    table_sources, to_arrow, to_json_rows, write_facts)
from caseflow.plans.sql import query as guarded_query
from caseflow.session import LOAD_CONF, scratch_path, session_conf
from caseflow.sources import files as FS
from caseflow.sources import tables as TB

Fn = Callable[[SparkSession, str], DataFrame]


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts_table(spark, sf)


def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollup_table(spark, sf)


def merged(spark: SparkSession, sf: str) -> DataFrame:
    """The merged view as the queries read it: from the stored monthly roll-up."""
    return RU.merged(rollup(spark, sf), dims.DEFAULT_PRIORITY)


def merged_from_facts(spark: SparkSession, sf: str, plan: str) -> DataFrame:
    return merged_monthly(facts(spark, sf), dims.DEFAULT_PRIORITY, plan=plan, sources=table_sources(spark, sf))


# ------------------------------------------------------------------ parameters
RANGE = ("1996-01-15", "1999-06-30")
XF_STATES = ["CA", "NYC", "MA"]
XF_RANGE = ("1996-01-01", "1998-12-31")
# a decomposed and a composed accent, and an apostrophe
ACCENTED = " Cafe\u0301 d'\u00e9t\u00e9"
AGE_CATEGORIES = [a for a in TB.AGE_BY_MOD8 if a not in ("Total", "unknown")]

# ------------------------------------------------------------------ oracle fragments
SUM0 = "CAST(COALESCE(SUM(count), 0) AS BIGINT)"
SRC_LIST = "string_agg(DISTINCT data_source, ',' ORDER BY data_source)"
FIPS_CASE = O.map_case("state", dims.STATE_TO_FIPS)


def _sql(select: str, merged_cte: bool = False, ctes: str = "") -> str:
    return O.facts_ctes() + (O.merged_cte() if merged_cte else "") + ctes + "\n" + select


def _age_dist_ctes(where: str = "") -> str:
    return f""",
  agg AS (SELECT disease_name, state,
                 CASE WHEN age_group IS NOT NULL AND age_group != '' AND lower(age_group) NOT LIKE '%total%'
                      THEN age_group END AS age_group,
                 COALESCE(SUM(count), 0) AS count
          FROM facts {where} GROUP BY 1, 2, 3),
  st AS (SELECT DISTINCT disease_name, state FROM agg),
  grp AS (SELECT DISTINCT disease_name, age_group FROM agg WHERE age_group IS NOT NULL),
  dense AS (SELECT st.disease_name, st.state, grp.age_group, COALESCE(a.count, 0) AS count
            FROM st JOIN grp ON st.disease_name = grp.disease_name
            LEFT JOIN agg a ON a.disease_name = st.disease_name AND a.state = st.state
                            AND a.age_group = grp.age_group),
  tot AS (SELECT disease_name, state, SUM(count) AS t FROM dense GROUP BY 1, 2),
  dist AS (SELECT d.disease_name, d.state, d.age_group, CAST(d.count AS BIGINT) AS count,
                  CASE WHEN t > 0 THEN CAST(printf('%.2f', CAST(d.count / t * 100 AS DOUBLE)) AS DOUBLE) ELSE 0.0 END AS percentage
           FROM dense d JOIN tot ON d.disease_name = tot.disease_name AND d.state = tot.state)"""


def _state_totals_ctes(source_sql: str) -> str:
    return f""",
  tot AS ({source_sql}),
  mapped AS (SELECT disease_name, state, {FIPS_CASE} AS fips, cases FROM tot),
  st AS (SELECT disease_name, state, fips, CAST(cases AS BIGINT) AS cases FROM mapped
         WHERE fips IS NOT NULL AND cases > 0),
  ext AS (SELECT disease_name, CAST(min(cases) AS BIGINT) AS min_cases, CAST(max(cases) AS BIGINT) AS max_cases
          FROM st GROUP BY 1),
  st_ext AS (SELECT st.*, ext.min_cases, ext.max_cases FROM st JOIN ext ON st.disease_name = ext.disease_name)"""


MERGED_TOTALS = f"SELECT disease_name, state, COALESCE(SUM(count), 0) AS cases FROM merged GROUP BY 1, 2"

_SERIES_CTE = f""",
  s AS (SELECT disease_name, date_trunc('month', report_period_start) AS period, {SUM0} AS total_cases
        FROM facts GROUP BY 1, 2),
  tail AS (SELECT disease_name, period, total_cases FROM
           (SELECT *, row_number() OVER (PARTITION BY disease_name ORDER BY period DESC) AS rn FROM s)
           WHERE rn <= 12)"""

_BREAKS_CTE = """,
  b AS (SELECT disease_name, quantile_cont(cases::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS br,
               min(cases)::DOUBLE AS lo, max(cases)::DOUBLE AS hi
        FROM st WHERE cases > 0 GROUP BY 1)"""


# ------------------------------------------------------------------ entries
def _entries() -> dict[str, tuple[Fn, str | None]]:
    e: dict[str, tuple[Fn, str | None]] = {}

    # --- composite queries (Q)
    e["q1_disease_names"] = (lambda s, d: Q.disease_names(facts(s, d)),
                        _sql("SELECT DISTINCT disease_name FROM facts"))
    e["q1_disease_names_nndss"] = (lambda s, d: Q.disease_names(facts(s, d), "nndss"),
                              _sql("SELECT DISTINCT disease_name FROM facts WHERE data_source = 'nndss'"))
    e["q2_disease_catalog"] = (lambda s, d: Q.disease_catalog(facts(s, d)),
                               _sql(f"SELECT disease_name, disease_slug, {SRC_LIST} AS sources FROM facts GROUP BY 1, 2"))
    e["q2_disease_catalog_nndss"] = (
        lambda s, d: Q.disease_catalog(facts(s, d), "nndss"),
        _sql(f"SELECT disease_name, disease_slug, {SRC_LIST} AS sources FROM facts WHERE disease_slug IN "
             f"(SELECT disease_slug FROM facts WHERE data_source = 'nndss') GROUP BY 1, 2"))
    e["q3_disease_name_by_slug"] = (lambda s, d: Q.disease_name_by_slug(facts(s, d)),
                                    _sql("SELECT disease_slug, min(disease_name) AS disease_name FROM facts GROUP BY 1"))
    e["q4_sources_by_slug"] = (lambda s, d: Q.sources_by_slug(facts(s, d)),
                               _sql(f"SELECT disease_slug, {SRC_LIST} AS sources FROM facts GROUP BY 1"))
    e["q5_states"] = (lambda s, d: Q.states(facts(s, d)), _sql("SELECT DISTINCT state FROM facts"))
    summary_cols = ("count(*) AS total_records, count(DISTINCT disease_name) AS disease_count, "
                    "count(DISTINCT state) AS total_states, min(report_period_start) AS earliest_date, "
                    "max(report_period_end) AS latest_date")
    e["q6_summary_stats"] = (
        lambda s, d: Q.summary_stats(facts(s, d), merged(s, d), rollup=rollup(s, d)),
        _sql(f"SELECT {summary_cols}, (SELECT CAST(SUM(count) AS BIGINT) FROM merged) AS total_cases FROM facts",
             merged_cte=True))
    e["q6_summary_stats_tracker"] = (
        lambda s, d: Q.summary_stats(facts(s, d), merged(s, d), "tracker", rollup(s, d)),
        _sql(f"SELECT {summary_cols}, CAST(SUM(count) AS BIGINT) AS total_cases FROM facts "
             f"WHERE data_source = 'tracker'"))
    e["q7_source_breakdown"] = (
        lambda s, d: Q.source_breakdown(facts(s, d)),
        _sql("SELECT data_source, count(*) AS records, CAST(SUM(count) AS BIGINT) AS cases FROM facts GROUP BY 1"))
    e["q8_disease_totals"] = (lambda s, d: Q.disease_totals(facts(s, d), merged(s, d)),
                              _sql(f"SELECT disease_name, {SUM0} AS total_cases FROM merged GROUP BY 1", True))
    e["q8_disease_totals_nndss"] = (
        lambda s, d: Q.disease_totals(facts(s, d), merged(s, d), "nndss"),
        _sql(f"SELECT disease_name, {SUM0} AS total_cases FROM facts WHERE data_source = 'nndss' GROUP BY 1"))
    for g in ("month", "week"):
        e[f"q9_national_timeseries_{g}"] = (
            (lambda g: lambda s, d: Q.national_timeseries(facts(s, d), None, g))(g),
            _sql(f"SELECT disease_name, date_trunc('{g}', report_period_start) AS period, {SUM0} AS total_cases "
                 f"FROM facts GROUP BY 1, 2"))
    e["q10_disease_stats"] = (
        lambda s, d: Q.disease_stats(facts(s, d), merged(s, d)),
        _sql("""SELECT n.disease_name,
                  CAST(COALESCE(tot.total_cases, 0) AS BIGINT) AS total_cases,
                  CAST(COALESCE(tot.affected_states, 0) AS BIGINT) AS affected_states,
                  CAST(COALESCE(c.affected_counties, 0) AS BIGINT) AS affected_counties,
                  CAST(COALESCE(two.two_week_cases, 0) AS BIGINT) AS two_week_cases
                FROM (SELECT DISTINCT disease_name FROM facts) n
                LEFT JOIN tot ON tot.disease_name = n.disease_name
                LEFT JOIN counties c ON c.disease_name = n.disease_name
                LEFT JOIN two ON two.disease_name = n.disease_name""", True,
             """,
  per_end AS (SELECT disease_name, report_period_end, SUM(count) AS s FROM facts GROUP BY 1, 2),
  mx AS (SELECT disease_name, max(report_period_end) AS mx FROM per_end GROUP BY 1),
  two AS (SELECT p.disease_name, COALESCE(SUM(s), 0) AS two_week_cases FROM per_end p
          JOIN mx ON p.disease_name = mx.disease_name
          WHERE p.report_period_end >= mx.mx - INTERVAL 14 DAYS AND p.report_period_end <= mx.mx GROUP BY 1),
  counties AS (SELECT disease_name, count(DISTINCT geo_name) AS affected_counties FROM facts
               WHERE geo_name IS NOT NULL AND geo_name != '' GROUP BY 1),
  tot AS (SELECT disease_name, COALESCE(SUM(count), 0) AS total_cases, count(DISTINCT state) AS affected_states
          FROM merged GROUP BY 1)"""))
    e["q11_age_distribution"] = (lambda s, d: Q.age_distribution(facts(s, d)),
                                 _sql("SELECT * FROM dist", ctes=_age_dist_ctes()))
    e["q11_age_distribution_tracker_range"] = (
        lambda s, d: Q.age_distribution(facts(s, d), None, "tracker", *RANGE),
        _sql("SELECT * FROM dist", ctes=_age_dist_ctes(
            f"WHERE data_source = 'tracker' AND report_period_start >= TIMESTAMP '{RANGE[0]}' "
            f"AND report_period_end <= TIMESTAMP '{RANGE[1]}'")))
    e["q11_age_distribution_nndss"] = (  # the weekly feed has no age groups: no category, no row
        lambda s, d: Q.age_distribution(facts(s, d), None, "nndss"),
        _sql("SELECT * FROM dist", ctes=_age_dist_ctes("WHERE data_source = 'nndss'")))
    e["q12_state_timeseries"] = (
        lambda s, d: Q.state_timeseries(facts(s, d)),
        _sql(f"""SELECT 'state' AS level, state, disease_name, date_trunc('month', report_period_start) AS period,
                   {SUM0} AS cases FROM facts GROUP BY 2, 3, 4
                 UNION ALL
                 SELECT 'national' AS level, 'National' AS state, disease_name,
                   date_trunc('month', report_period_start) AS period, {SUM0} AS cases FROM facts GROUP BY 3, 4"""))
    e["q9_national_timeseries_nndss"] = (
        lambda s, d: Q.national_timeseries(facts(s, d), None, "month", "nndss"),
        _sql(f"SELECT disease_name, date_trunc('month', report_period_start) AS period, {SUM0} AS total_cases "
             f"FROM facts WHERE data_source = 'nndss' GROUP BY 1, 2"))
    e["q12_state_timeseries_week"] = (
        lambda s, d: Q.state_timeseries(facts(s, d), None, "week"),
        _sql(f"""SELECT 'state' AS level, state, disease_name, date_trunc('week', report_period_start) AS period,
                   {SUM0} AS cases FROM facts GROUP BY 2, 3, 4
                 UNION ALL
                 SELECT 'national' AS level, 'National' AS state, disease_name,
                   date_trunc('week', report_period_start) AS period, {SUM0} AS cases FROM facts GROUP BY 3, 4"""))
    e["q13_subtype_distribution_tracker"] = (
        lambda s, d: Q.subtype_distribution(facts(s, d), None, "tracker"),
        _sql("""SELECT d.disease_slug, d.state, d.disease_subtype_slug, CAST(d.count AS BIGINT) AS count,
                  CASE WHEN t > 0 THEN CAST(printf('%.2f', CAST(d.count / t * 100 AS DOUBLE)) AS DOUBLE) ELSE 0.0 END AS percentage
                FROM dense d JOIN tot ON d.disease_slug = tot.disease_slug AND d.state_slug = tot.state_slug""",
             ctes=""",
  agg AS (SELECT disease_slug, state_slug, disease_subtype_slug, COALESCE(SUM(count), 0) AS count,
                 max(state) AS st FROM facts WHERE disease_subtype_slug IS NOT NULL AND data_source = 'tracker'
          GROUP BY 1, 2, 3),
  lab AS (SELECT disease_slug, state_slug, max(st) AS state FROM agg GROUP BY 1, 2),
  sub AS (SELECT DISTINCT disease_slug, disease_subtype_slug FROM agg),
  dense AS (SELECT l.disease_slug, l.state_slug, l.state, s.disease_subtype_slug, COALESCE(a.count, 0) AS count
            FROM lab l JOIN sub s ON l.disease_slug = s.disease_slug
            LEFT JOIN agg a ON a.disease_slug = l.disease_slug AND a.state_slug = l.state_slug
                            AND a.disease_subtype_slug = s.disease_subtype_slug),
  tot AS (SELECT disease_slug, state_slug, SUM(count) AS t FROM dense GROUP BY 1, 2)"""))
    e["q13_subtype_distribution"] = (
        lambda s, d: Q.subtype_distribution(facts(s, d)),
        _sql("""SELECT d.disease_slug, d.state, d.disease_subtype_slug, CAST(d.count AS BIGINT) AS count,
                  CASE WHEN t > 0 THEN CAST(printf('%.2f', CAST(d.count / t * 100 AS DOUBLE)) AS DOUBLE) ELSE 0.0 END AS percentage
                FROM dense d JOIN tot ON d.disease_slug = tot.disease_slug AND d.state_slug = tot.state_slug""",
             ctes=""",
  agg AS (SELECT disease_slug, state_slug, disease_subtype_slug, COALESCE(SUM(count), 0) AS count,
                 max(state) AS st FROM facts WHERE disease_subtype_slug IS NOT NULL GROUP BY 1, 2, 3),
  lab AS (SELECT disease_slug, state_slug, max(st) AS state FROM agg GROUP BY 1, 2),
  sub AS (SELECT DISTINCT disease_slug, disease_subtype_slug FROM agg),
  dense AS (SELECT l.disease_slug, l.state_slug, l.state, s.disease_subtype_slug, COALESCE(a.count, 0) AS count
            FROM lab l JOIN sub s ON l.disease_slug = s.disease_slug
            LEFT JOIN agg a ON a.disease_slug = l.disease_slug AND a.state_slug = l.state_slug
                            AND a.disease_subtype_slug = s.disease_subtype_slug),
  tot AS (SELECT disease_slug, state_slug, SUM(count) AS t FROM dense GROUP BY 1, 2)"""))
    e["q14_state_totals"] = (lambda s, d: Q.state_totals(facts(s, d), merged(s, d)),
                             _sql("SELECT * FROM st_ext", True, _state_totals_ctes(MERGED_TOTALS)))
    e["q14_state_totals_range"] = (
        lambda s, d: Q.state_totals(facts(s, d), merged(s, d), None, None, *RANGE),
        _sql("SELECT * FROM st_ext", True, _state_totals_ctes(
            f"SELECT disease_name, state, COALESCE(SUM(count), 0) AS cases FROM merged "
            f"WHERE month >= TIMESTAMP '{RANGE[0]}' AND month <= TIMESTAMP '{RANGE[1]}' GROUP BY 1, 2")))
    e["q14_state_totals_tracker_range"] = (
        lambda s, d: Q.state_totals(facts(s, d), merged(s, d), None, "tracker", *RANGE),
        _sql("SELECT * FROM st_ext", False, _state_totals_ctes(
            f"SELECT disease_name, state, COALESCE(SUM(count), 0) AS cases FROM facts "
            f"WHERE data_source = 'tracker' AND report_period_start >= TIMESTAMP '{RANGE[0]}' "
            f"AND report_period_end <= TIMESTAMP '{RANGE[1]}' AND state IS NOT NULL AND state != '' "
            f"GROUP BY 1, 2")))
    e["q15_merged_monthly"] = (lambda s, d: merged_from_facts(s, d, "conditional"), _sql("SELECT * FROM merged", True))
    e["q15_merged_monthly_window"] = (lambda s, d: merged_from_facts(s, d, "window"), _sql("SELECT * FROM merged", True))
    e["q15_merged_monthly_rollup"] = (lambda s, d: merged(s, d), _sql("SELECT * FROM merged", True))
    e["q14_state_totals_range_facts"] = (
        lambda s, d: Q.state_totals_merged_pruned(
            facts(s, d), lambda f: merged_monthly(f, dims.DEFAULT_PRIORITY, "conditional", sources=table_sources(s, d)), None, *RANGE),
        e["q14_state_totals_range"][1])
    e["q9_national_timeseries_dedupe"] = (
        lambda s, d: Q.national_timeseries(facts(s, d), dedupe=True, merged=merged(s, d)),
        _sql(f"SELECT disease_name, month AS period, {SUM0} AS total_cases FROM merged GROUP BY 1, 2", True))
    e["q10_disease_stats_sketches"] = (
        lambda s, d: Q.disease_stats(facts(s, d), merged(s, d), rollup=rollup(s, d), approx_counties=True), None)
    e["q16_sql_query"] = (
        lambda s, d: guarded_query(s, "SELECT data_source, disease_name, COUNT(*) AS records, "
                                      "SUM(count) AS cases FROM disease_data GROUP BY data_source, disease_name",
                                   {"disease_data": facts(s, d)}),
        _sql("SELECT data_source, disease_name, COUNT(*) AS records, CAST(SUM(count) AS BIGINT) AS cases "
             "FROM facts GROUP BY 1, 2"))
    e["q16_sql_query_merged"] = (
        lambda s, d: guarded_query(s, "WITH m AS (SELECT REPLACE(disease_name, '-', ' ') AS disease, state, count FROM disease_data_merged) "
                                      "SELECT disease, COUNT(DISTINCT state) AS states, SUM(count) AS cases FROM m "
                                      "WHERE disease <> 'a;b' GROUP BY disease",
                                   {"disease_data": facts(s, d), "disease_data_merged": merged(s, d)}),
        _sql("SELECT replace(disease_name, '-', ' ') AS disease, count(DISTINCT state) AS states, CAST(SUM(count) AS BIGINT) AS cases "
             "FROM merged GROUP BY 1", True))
    e["q17_disease_cards"] = (
        lambda s, d: Q.disease_cards(facts(s, d), merged(s, d)),
        _sql(f"""SELECT cat.*, tot.total_cases FROM cat LEFT JOIN tot ON cat.disease_name = tot.disease_name""", True,
             f""",
  cat AS (SELECT disease_name, disease_slug, {SRC_LIST} AS sources FROM facts
          WHERE disease_slug IN (SELECT disease_slug FROM facts WHERE data_source = 'tracker') GROUP BY 1, 2),
  tot AS (SELECT disease_name, {SUM0} AS total_cases FROM merged GROUP BY 1)"""))
    e["q18_state_selector"] = (
        lambda s, d: Q.state_selector(facts(s, d), merged(s, d)),
        _sql("""SELECT disease_name, state, CAST(total AS BIGINT) AS total,
                  row_number() OVER (PARTITION BY disease_name
                                     ORDER BY CASE WHEN state = 'National' THEN 0 ELSE 1 END, total DESC, state)
                  AS position
                FROM (SELECT disease_name, state, cases AS total FROM st
                      UNION ALL SELECT disease_name, 'National', SUM(cases) FROM st GROUP BY 1)""",
             True, _state_totals_ctes(MERGED_TOTALS)))
    one = "disease_name = 'pertussis'"
    e["q9_one_disease"] = (
        lambda s, d: Q.national_timeseries(facts(s, d), "pertussis"),
        _sql(f"SELECT disease_name, date_trunc('month', report_period_start) AS period, {SUM0} AS total_cases "
             f"FROM facts WHERE {one} GROUP BY 1, 2"))
    e["q10_one_disease"] = (
        lambda s, d: Q.disease_stats(facts(s, d), merged(s, d), "pertussis"),
        _sql(f"""SELECT 'pertussis' AS disease_name,
                  (SELECT {SUM0} FROM merged WHERE {one}) AS total_cases,
                  (SELECT count(DISTINCT state) FROM merged WHERE {one}) AS affected_states,
                  (SELECT count(DISTINCT geo_name) FROM facts WHERE {one} AND geo_name != '') AS affected_counties,
                  (SELECT {SUM0} FROM facts WHERE {one} AND report_period_end >=
                     (SELECT max(report_period_end) - INTERVAL 14 DAYS FROM facts WHERE {one})) AS two_week_cases""", True))
    e["q11_one_disease"] = (
        lambda s, d: Q.age_distribution(facts(s, d), "pertussis"),
        _sql("SELECT * FROM dist", ctes=_age_dist_ctes(f"WHERE {one}")))
    e["q12_one_disease"] = (
        lambda s, d: Q.state_timeseries(facts(s, d), "pertussis"),
        _sql(f"""SELECT 'state' AS level, state, disease_name, date_trunc('month', report_period_start) AS period,
                   {SUM0} AS cases FROM facts WHERE {one} GROUP BY 2, 3, 4
                 UNION ALL
                 SELECT 'national' AS level, 'National' AS state, disease_name,
                   date_trunc('month', report_period_start) AS period, {SUM0} AS cases FROM facts WHERE {one} GROUP BY 3, 4"""))
    e["q13_one_disease"] = (
        lambda s, d: Q.subtype_distribution(facts(s, d), "meningococcus"),
        e["q13_subtype_distribution"][1] + " WHERE d.disease_slug = 'meningococcus'")
    e["q14_one_disease"] = (
        lambda s, d: Q.state_totals(facts(s, d), merged(s, d), "pertussis"),
        _sql(f"SELECT * FROM st_ext WHERE {one}", True, _state_totals_ctes(MERGED_TOTALS)))
    e["x10_large_totals"] = (
        lambda s, d: TB._read(s, d, "orders").select(
            "o_orderkey", *[X.round_half_even(X.percent_of((F.col("o_orderkey") * 2 + 1) % t, F.lit(t)), 2).alias(f"pct_{t}")
                            for t in (4000, 20000)]),
        "SELECT o_orderkey, " + ", ".join(
            f"CAST(printf('%.2f', ((o_orderkey * 2 + 1) % {t})::DOUBLE / {t} * 100.0::DOUBLE) AS DOUBLE) AS pct_{t}" for t in (4000, 20000))
        + " FROM orders")
    for plan in ("conditional", "window", "ranked"):
        e[f"q15_three_sources_{plan}"] = (
            (lambda p: lambda s, d: merged_monthly(_with_unlisted(facts(s, d)), ["tracker", "nndss"], plan=p,
                                                   sources=["hospital", *table_sources(s, d)]))(plan),
            _three_sources_sql())
    e["q19_last_n_periods"] = (
        lambda s, d: AN.last_n_periods(Q.national_timeseries(facts(s, d)), 12),
        _sql("SELECT * FROM tail", ctes=_SERIES_CTE))
    e["q19_last_n_summary"] = (
        lambda s, d: AN.last_n_summary(Q.national_timeseries(facts(s, d)), 12),
        _sql("SELECT disease_name, CAST(SUM(total_cases) AS BIGINT) AS total, min(period) AS first_period, "
             "max(period) AS last_period FROM tail GROUP BY 1", ctes=_SERIES_CTE))
    e["q20_choropleth_bins"] = (
        lambda s, d: AN.choropleth_bins(Q.state_totals(facts(s, d), merged(s, d))),
        _sql("""SELECT st.disease_name, st.state, st.cases,
                  CASE WHEN st.cases IS NULL OR st.cases <= 0 THEN NULL ELSE
                    CAST((st.cases >= br[1])::INT + (st.cases >= br[2])::INT + (st.cases >= br[3])::INT
                         + (st.cases >= br[4])::INT AS BIGINT) END AS bin
                FROM st LEFT JOIN b ON st.disease_name = b.disease_name""",
             True, _state_totals_ctes(MERGED_TOTALS) + _BREAKS_CTE))
    e["q20_legend_breaks"] = (
        lambda s, d: AN.legend_breaks(Q.state_totals(facts(s, d), merged(s, d))),
        _sql("""SELECT disease_name, CAST(i AS BIGINT) AS i, e[i + 1] AS lower, e[i + 2] AS upper
                FROM (SELECT disease_name, e, unnest(range(0, 5)) AS i
                      FROM (SELECT disease_name, list_concat([lo], br, [hi]) AS e FROM b))""",
             True, _state_totals_ctes(MERGED_TOTALS) + _BREAKS_CTE))
    e["q21_stacked_shares"] = (
        lambda s, d: AN.stacked_shares(Q.age_distribution(facts(s, d))),
        _sql("""SELECT disease_name, state, age_group, percentage,
                  (SUM(c) OVER w - c) / 100.0 AS y0, SUM(c) OVER w / 100.0 AS y1
                FROM (SELECT *, CAST(CAST(printf('%.0f', CAST(percentage * 100 AS DOUBLE)) AS DOUBLE) AS BIGINT) AS c FROM dist)
                WINDOW w AS (PARTITION BY disease_name, state ORDER BY age_group
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", ctes=_age_dist_ctes()))
    wide_cols = ", ".join(f"COALESCE(max(CASE WHEN age_group = {O.q(a)} THEN percentage END), 0) AS \"{a}\""
                          for a in AGE_CATEGORIES)
    e["q21_wide_shares"] = (
        lambda s, d: AN.wide_shares(Q.age_distribution(facts(s, d)), AGE_CATEGORIES),
        _sql(f"SELECT disease_name, state, {wide_cols} FROM dist GROUP BY 1, 2", ctes=_age_dist_ctes()))
    xf_states = O.in_list(XF_STATES)
    e["q22_crossfilter"] = (
        lambda s, d: AN.crossfilter(Q.state_timeseries(
            FL.select_states(FL.month_scan_bounds(facts(s, d), *XF_RANGE), XF_STATES)), XF_STATES, *XF_RANGE),
        _sql(f"""SELECT 'state' AS level, state, disease_name, date_trunc('month', report_period_start) AS period,
                   {SUM0} AS cases FROM facts GROUP BY 2, 3, 4
                   HAVING state IN {xf_states}
                     AND date_trunc('month', report_period_start) BETWEEN TIMESTAMP '{XF_RANGE[0]}'
                                                                   AND TIMESTAMP '{XF_RANGE[1]}'"""))
    e["q23_integrity_report"] = (
        lambda s, d: integrity_report(facts(s, d)),
        _sql(_integrity_sql("facts")))
    e["q23_integrity_report_dirty"] = (
        lambda s, d: integrity_report(_dirty(facts(s, d))),
        _sql(_integrity_sql("""(SELECT * REPLACE (
               CASE WHEN count % 5 = 0 THEN NULL ELSE disease_name END AS disease_name,
               CASE WHEN count % 7 = 0 THEN NULL ELSE report_period_start END AS report_period_start,
               CASE WHEN count % 11 = 1 THEN report_period_start - INTERVAL 1 DAY ELSE report_period_end END AS report_period_end,
               CASE WHEN count % 13 = 2 THEN upper(state_slug) ELSE state_slug END AS state_slug,
               CASE WHEN count % 17 = 3 THEN 'a b' ELSE geo_unit_slug END AS geo_unit_slug,
               CASE WHEN count % 19 = 4 THEN -count ELSE count END AS count) FROM facts)""")))

    # --- catalogue / sinks (K)
    e["k8_name_mapping"] = (lambda s, d: build_name_mapping(facts(s, d)),
                            _sql("SELECT DISTINCT disease_slug, disease_name, data_source FROM facts"))
    e["a7_monthly_by_source"] = (
        lambda s, d: monthly_by_source(facts(s, d)),
        _sql("SELECT disease_name, disease_slug, state, month, data_source, CAST(count AS BIGINT) AS count "
             "FROM monthly", True))
    e["f9_trailing_days"] = (
        lambda s, d: FL.trailing_days(A.sum_cases(facts(s, d), "disease_name", "data_source", "report_period_end"),
                                      by=["disease_name", "data_source"]),
        _sql(f"""SELECT f.disease_name, f.data_source, f.report_period_end, {SUM0} AS total_cases
                 FROM facts f JOIN (SELECT disease_name, data_source, max(report_period_end) AS mx FROM facts
                                    GROUP BY 1, 2) m
                   ON f.disease_name = m.disease_name AND f.data_source = m.data_source
                 WHERE f.report_period_end >= m.mx - INTERVAL 14 DAYS AND f.report_period_end <= m.mx
                 GROUP BY 1, 2, 3"""))
    e["p14_display_names"] = (
        lambda s, d: C.with_display_name(W.distinct_values(facts(s, d), "disease_slug")),
        _sql(f"""SELECT disease_slug, COALESCE({O.map_case('disease_slug', dims.DISPLAY_NAMES)},
                   {_py_title_sql('disease_slug')}) AS display_name FROM (SELECT DISTINCT disease_slug FROM facts)"""))
    e["p15_with_fips"] = (
        lambda s, d: C.with_state_from_fips(C.with_fips(W.distinct_values(facts(s, d), "state")), "fips", "state_back"),
        _sql(f"""SELECT state, fips, {O.map_case('fips', {v: k for k, v in dims.STATE_TO_FIPS.items()})} AS state_back
                 FROM (SELECT state, {O.map_case('upper(state)', dims.STATE_TO_FIPS)} AS fips
                       FROM (SELECT DISTINCT state FROM facts))"""))

    # --- per-table column functions (X) over whole benchmark tables
    e["x1_slug_part_names"] = (
        lambda s, d: TB._read(s, d, "part").select("p_partkey", X.slug("p_name").alias("name_slug"),
                                                   X.slug("p_type").alias("type_slug"),
                                                   X.slug("p_brand").alias("brand_slug")),
        f"SELECT p_partkey, {O.slug('p_name')} AS name_slug, {O.slug('p_type')} AS type_slug, "
        f"{O.slug('p_brand')} AS brand_slug FROM part")
    e["x2_url_slug_part_names"] = (
        lambda s, d: C.add_url_slugs(TB._read(s, d, "part").select("p_partkey", F.concat(
            F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, F.lit(ACCENTED)).otherwise(F.lit(""))).alias("p_brand")), ["p_brand"]),
        f"""SELECT p_partkey, p_brand, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(nfc_normalize(p_brand)),
              chr(39), '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '-+', '-', 'g') AS p_brand_url_slug
            FROM (SELECT p_partkey, p_brand || CASE WHEN p_partkey % 3 = 0 THEN {O.q(ACCENTED)} ELSE '' END AS p_brand FROM part)""")
    e["x3_truncate_period_orders"] = (
        lambda s, d: TB._read(s, d, "orders").groupBy(
            X.truncate_period("o_orderdate", "week").alias("week"),
            X.truncate_period("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("orders")),
        "SELECT date_trunc('week', o_orderdate) AS week, date_trunc('month', o_orderdate) AS month, "
        "count(*) AS orders FROM orders GROUP BY 1, 2")
    e["x6_title_from_slug_part_names"] = (
        lambda s, d: TB._read(s, d, "part").select(
            "p_partkey", X.title_from_slug(X.slug("p_name")).alias("title")),
        f"SELECT p_partkey, {_py_title_sql(O.slug('p_name'))} AS title FROM part")
    e["x10_round_half_even_orders"] = (
        lambda s, d: TB._read(s, d, "orders").select(
            "o_orderkey",
            X.round_half_even(X.percent_of(F.col("o_orderkey") % 199,
                                           (F.col("o_orderkey") % 199) + (F.col("o_custkey") % 199) + 1), 2)
            .alias("pct")),
        "SELECT o_orderkey, CAST(printf('%.2f', CAST((o_orderkey % 199) / ((o_orderkey % 199) + (o_custkey % 199) + 1) * 100 AS DOUBLE)) AS DOUBLE) "
        "AS pct FROM orders")
    # --- conform steps (P) over the raw feeds derived from the tables
    def weekly_raw(s, d):
        return TB.weekly_feed_raw(s, d)

    e["p8_parse_labels"] = (
        lambda s, d: C.parse_labels(weekly_raw(s, d).select(F.col("Label")).distinct(), "Label", "base", "subtype"),
        O.facts_ctes() + '\nSELECT DISTINCT "Label", base, subtype FROM weekly_p3')
    e["p9_p10_geo_codes"] = (
        lambda s, d: weekly_raw(s, d).select(F.col("Reporting Area").alias("area"), F.col("LOCATION2").alias("loc2"))
        .distinct().withColumn("geo_unit", C.classify_geo(F.col("area")))
        .withColumn("state", C.code_states(F.col("area"), F.col("geo_unit"), F.col("loc2"))),
        O.facts_ctes() + '\nSELECT DISTINCT "Reporting Area" AS area, "LOCATION2" AS loc2, geo_unit, '
                         'state_code AS state FROM weekly_p3')
    e["p11_mmwr_periods"] = (
        lambda s, d: C.mmwr_periods(W.distinct_weeks(weekly_raw(s, d).select(
            F.col("Current MMWR Year").cast("int").alias("year"), F.col("MMWR WEEK").cast("int").alias("week")),
            "year", "week"), "year", "week"),
        O.facts_ctes() + "\nSELECT DISTINCT yr AS year, wk AS week, CAST(week1 + (wk - 1) * 7 AS TIMESTAMP) "
                         "AS report_period_start, CAST(week1 + (wk - 1) * 7 + 6 AS TIMESTAMP) AS report_period_end "
                         "FROM weekly_p3 WHERE yr IS NOT NULL AND wk IS NOT NULL")
    e["p12_clean_counts"] = (
        lambda s, d: weekly_raw(s, d).select(F.col("Current week").alias("text")).distinct()
        .withColumn("count", C.clean_counts_col(F.col("text"))),
        O.facts_ctes() + '\nSELECT DISTINCT "Current week" AS text, cnt AS count FROM weekly_p3')
    e["p6_p7_state_feed_values"] = (
        lambda s, d: C.normalize_subtype(C.null_placeholders(C.null_na_tokens(
            TB.state_feed_raw(s, d).select("disease_subtype", "age_group", "confirmation_status").distinct()),
            ["age_group", "confirmation_status"])).distinct(),
        O.facts_ctes() + "\nSELECT DISTINCT subtype_n AS disease_subtype, age_n AS age_group, "
                         "status_n AS confirmation_status FROM tracker_sub")
    e["j1_attach_weeks"] = (
        lambda s, d: _attach_weeks_job(weekly_raw(s, d)),
        O.facts_ctes() + "\nSELECT CAST(week1 + (wk - 1) * 7 AS TIMESTAMP) AS report_period_start, "
                         "count(*) AS line_rows FROM weekly_p3 GROUP BY 1")
    e["j2_lookup_state_codes"] = (
        lambda s, d: J.lookup(weekly_raw(s, d).select(F.upper("Reporting Area").alias("area_u")).distinct(),
                              dims.state_codes_df(s), "area_u", "state_name_upper", "code", "state_code",
                              fallback="area_u"),
        O.facts_ctes() + f"""\nSELECT area_u, COALESCE({O.map_case('area_u', dims.STATE_CODES)}, area_u) AS code
                 FROM (SELECT DISTINCT upper("Reporting Area") AS area_u FROM weekly_raw)""")
    e["j3_inner_fips_join"] = (
        lambda s, d: J.with_fips_join(A.sum_cases(merged(s, d), "disease_name", "state", out="cases")),
        _sql(f"""SELECT disease_name, state, fips, cases FROM
                   (SELECT disease_name, state, {FIPS_CASE} AS fips, {SUM0} AS cases FROM merged GROUP BY 1, 2)
                 WHERE fips IS NOT NULL""", True))

    # --- aggregates, windows and load steps not covered by a composite
    e["a2_count_records"] = (lambda s, d: A.count_records(facts(s, d), "disease_name", "data_source"),
                             _sql("SELECT disease_name, data_source, count(*) AS records FROM facts GROUP BY 1, 2"))
    e["a3_count_distinct"] = (
        lambda s, d: A.count_distinct(facts(s, d), ["state", "geo_name"], by=["disease_name"]),
        _sql("SELECT disease_name, count(DISTINCT state) AS distinct_state, count(DISTINCT geo_name) AS "
             "distinct_geo_name FROM facts GROUP BY 1"))
    e["a3_count_distinct_approx"] = (
        lambda s, d: A.count_distinct(facts(s, d), ["state", "geo_name"], by=["disease_name"], approx=True), None)
    e["a4_date_span"] = (lambda s, d: A.date_span(facts(s, d), by=["data_source"]),
                         _sql("SELECT data_source, min(report_period_start) AS earliest_date, "
                              "max(report_period_end) AS latest_date FROM facts GROUP BY 1"))
    e["a13_extent"] = (
        lambda s, d: A.extent(Q.national_timeseries(facts(s, d)), "period", by=["disease_name"]),
        _sql("SELECT disease_name, min(date_trunc('month', report_period_start)) AS min, "
             "max(date_trunc('month', report_period_start)) AS max FROM facts GROUP BY 1"))
    e["a15_aggregate"] = (
        lambda s, d: A.aggregate(facts(s, d), ["data_source"], {"count": ["count", "sum", "avg", "min", "max"]}),
        _sql("SELECT data_source, count(count) AS count_count, CAST(sum(count) AS BIGINT) AS sum_count, "
             "avg(count) AS avg_count, min(count) AS min_count, max(count) AS max_count FROM facts GROUP BY 1"))
    e["w2_with_group_total"] = (
        lambda s, d: W.with_group_total(merged(s, d), ["disease_name", "state"], "count", "group_total"),
        _sql("SELECT *, CAST(SUM(count) OVER (PARTITION BY disease_name, state) AS BIGINT) AS group_total "
             "FROM merged", True))
    e["o6_collect_series"] = (
        lambda s, d: W.collect_series(Q.state_timeseries(facts(s, d)).where("level = 'state'"),
                                      ["disease_name", "state"], "period", "cases")
        .select("disease_name", "state", F.explode("series").alias("p")).select("disease_name", "state", "p.period", "p.cases"),
        _sql(f"SELECT disease_name, state, date_trunc('month', report_period_start) AS period, {SUM0} AS cases "
             f"FROM facts GROUP BY 1, 2, 3"))
    e["a10_share_within"] = (
        lambda s, d: A.share_within(A.sum_cases(merged(s, d), "disease_name", "state", out="cases"),
                                    ["disease_name"], "cases", "percentage"),
        _sql("""SELECT t.disease_name, t.state, CAST(t.cases AS BIGINT) AS cases,
                  CASE WHEN g.total > 0 THEN CAST(printf('%.2f', CAST(t.cases / g.total * 100 AS DOUBLE)) AS DOUBLE) ELSE 0.0 END AS percentage
                FROM (SELECT disease_name, state, COALESCE(SUM(count), 0) AS cases FROM merged GROUP BY 1, 2) t
                JOIN (SELECT disease_name, SUM(count) AS total FROM merged GROUP BY 1) g
                  ON t.disease_name = g.disease_name""", True))
    e["j6_densify_sources"] = (
        lambda s, d: _densify_sources(facts(s, d)),
        _sql(f"""SELECT st.disease_name, st.state, src.data_source, COALESCE(c.records, 0) AS records
                 FROM (SELECT DISTINCT disease_name, state FROM facts) st
                 JOIN (SELECT DISTINCT disease_name, data_source FROM facts) src ON st.disease_name = src.disease_name
                 LEFT JOIN (SELECT disease_name, state, data_source, count(*) AS records FROM facts GROUP BY 1, 2, 3) c
                   ON c.disease_name = st.disease_name AND c.state = st.state AND c.data_source = src.data_source"""))
    e["w1_pick_by_priority"] = (
        lambda s, d: W.pick_by_priority(monthly_by_source(facts(s, d)), ["disease_name", "state", "month"],
                                        "data_source", dims.DEFAULT_PRIORITY),
        _sql("SELECT * FROM merged", True))
    e["k4_validate_state_feed"] = (
        lambda s, d: validate(_dirty(facts(s, d)).drop("outcome")),
        _sql("""SELECT 'missing_column' AS "check", 'outcome' AS "column", CAST(-1 AS BIGINT) AS n_bad
                UNION ALL SELECT 'null_in_required', 'disease_name', count(*) FROM facts WHERE count % 5 = 0
                UNION ALL SELECT 'null_in_required', 'report_period_start', count(*) FROM facts WHERE count % 7 = 0"""))
    e["k5_load_all"] = (
        lambda s, d: load_all(s, {"tracker": lambda sp: C.load_state_feed(TB.state_feed_raw(sp, d)),
                                  "nndss": lambda sp: C.load_weekly_feed(TB.weekly_feed_raw(sp, d)),
                                  "broken": lambda sp: facts(sp, d).withColumn("count", F.raise_error(F.lit("unreadable")).cast("long")),
                                  "dirty": lambda sp: _dirty(facts(sp, d))})[0],
        O.facts_ctes() + "\nSELECT * FROM facts")
    e["k6_fact_table"] = (lambda s, d: facts(s, d), _sql("SELECT * FROM facts"))
    e["k9_register_views"] = (
        lambda s, d: _views_query(s, d),
        _sql("SELECT m.disease_name, count(*) AS months, CAST(SUM(count) AS BIGINT) AS cases FROM merged m "
             "WHERE m.disease_slug IN (SELECT disease_slug FROM facts) GROUP BY 1", True))
    e["k6_replaced_table"] = (lambda s, d: _replaced_table(s, d), _sql("SELECT * FROM facts"))
    e["k7_open_or_build"] = (lambda s, d: _reopened_table(s, d), _sql("SELECT * FROM facts"))
    rolled_sql = """SELECT data_source, date_trunc('month', report_period_start) AS month, disease_name, disease_slug, state,
                 CAST(SUM(count) AS BIGINT) AS count, count(*) AS records, min(report_period_start) AS first_start,
                 max(report_period_end) AS last_end FROM facts GROUP BY 1, 2, 3, 4, 5"""
    e["k9_monthly_rollup"] = (lambda s, d: rollup(s, d).drop("counties"), _sql(rolled_sql))
    e["k9_refreshed_rollup"] = (lambda s, d: _refreshed_rollup(s, d).drop("counties"), _sql(rolled_sql))
    e["a3_counties_from_sketches"] = (lambda s, d: RU.county_counts(rollup(s, d), "disease_name"), None)
    e["k11_to_arrow"] = (
        lambda s, d: _arrow_round_trip(Q.national_timeseries(facts(s, d))),
        _sql(f"SELECT disease_name, date_trunc('month', report_period_start) AS period, {SUM0} AS total_cases FROM facts GROUP BY 1, 2"))
    e["k11_to_json_rows"] = (
        lambda s, d: to_json_rows(Q.national_timeseries(facts(s, d))).select(F.from_json(
            "json", "disease_name string, period string, total_cases long").alias("r")).select("r.*"),
        _sql(f"SELECT disease_name, strftime(date_trunc('month', report_period_start), '%Y-%m-%d') AS period, {SUM0} AS total_cases "
             f"FROM facts GROUP BY 1, date_trunc('month', report_period_start)"))
    e["f11_select_counties"] = (        # a county list of its own size, handed over as a table
        lambda s, d: A.sum_cases(FL.select_states(facts(s, d), _some_customers(s, d), col="geo_name"), "disease_name", "geo_name"),
        _sql(f"SELECT disease_name, geo_name, {SUM0} AS total_cases FROM facts WHERE geo_name IN "
             "(SELECT 'county-' || (c_custkey % 50) FROM customer WHERE c_custkey % 50 < 30) GROUP BY 1, 2"))
    e["f11_select_national"] = (
        lambda s, d: A.sum_cases(FL.select_states(facts(s, d), _some_customers(s, d).unionByName(
            s.createDataFrame([("National",)], "geo_name string")), col="geo_name"), "disease_name"),
        _sql(f"SELECT disease_name, {SUM0} AS total_cases FROM facts GROUP BY 1"))
    e["f13_drop_bad_periods"] = (
        lambda s, d: FL.drop_bad_periods(TB.state_feed_raw(s, d).withColumn("report_period_start", F.when(
            F.col("report_period_start").endswith("7"), F.concat(F.lit("around "), "report_period_start"))
            .otherwise(F.col("report_period_start"))), "report_period_start").agg(F.count(F.lit(1)).alias("rows")),
        O.facts_ctes() + "\nSELECT count(*) AS rows FROM tracker_raw WHERE report_period_start NOT LIKE '%7'")

    # --- file sources (S): the state feed written as CSV files, then discovered, chosen and read back
    states_sql = "SELECT DISTINCT state FROM tracker_raw WHERE state IS NOT NULL"
    newest = "'20240301-120000_' || state || '_team.csv'"
    def last_part():
        return F.element_at(F.split("path", "/"), -1)

    e["s1_discover_files"] = (
        lambda s, d: FS.discover_files(s, f"{state_feed_root(s, d)}/data/states").drop("path"),
        O.facts_ctes() + f"""\nSELECT state AS parent, {newest} AS file_name FROM ({states_sql})
                 UNION ALL SELECT state, '20240101-000000_' || state || '_old.csv' FROM ({states_sql})""")
    e["s2_latest_file_per_group"] = (
        lambda s, d: FS.latest_file_per_group(FS.discover_files(s, f"{state_feed_root(s, d)}/data/states"))
        .select("parent", "file_name", last_part().alias("path_name")),
        O.facts_ctes() + f"\nSELECT state AS parent, {newest} AS file_name, {newest} AS path_name FROM ({states_sql})")
    e["s3_latest_file"] = (
        lambda s, d: FS.latest_file(FS.discover_files(s, f"{state_feed_root(s, d)}/data/states"))
        .select(F.element_at(F.split("path", "/"), -2).alias("parent"), last_part().alias("file_name")),
        O.facts_ctes() + f"\nSELECT state AS parent, {newest} AS file_name FROM ({states_sql}) ORDER BY 2 DESC LIMIT 1")
    e["s5_read_weekly_feed"] = (lambda s, d: _loaded(C.load_weekly_feed(FS.read_weekly_feed(s, weekly_feed_root(s, d)))),
                                O.facts_ctes() + "\nSELECT * FROM weekly_facts")
    e["s7_faulty_uploads"] = (
        lambda s, d: _faulty_feed(s, d, "skip").report.select(F.element_at(F.split("path", "/"), -2).alias("parent"), "status",
                                                              "rows", "short_rows", "bad_rows"),
        O.facts_ctes() + """
SELECT state AS parent, CASE WHEN state IN ('CA', 'GA', 'MA') THEN 'skipped' ELSE 'read' END AS status,
  CAST(CASE WHEN state = 'MA' THEN 0 ELSE count(*) + CASE WHEN state IN ('CA', 'FL') THEN 1 ELSE 0 END END AS BIGINT) AS rows,
  CAST(CASE WHEN state = 'FL' THEN 1 ELSE 0 END AS BIGINT) AS short_rows,
  CAST(CASE WHEN state = 'CA' THEN 1 WHEN state = 'GA' THEN count(*) ELSE 0 END AS BIGINT) AS bad_rows
FROM tracker_raw GROUP BY state""")
    e["s7_quarantined_rows"] = (
        lambda s, d: _faulty_feed(s, d, "quarantine").rows.groupBy("reporting_jurisdiction").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.col("count").try_cast("long")).alias("cases")),
        O.facts_ctes() + """
SELECT state AS reporting_jurisdiction, CAST(count(*) + CASE WHEN state = 'FL' THEN 1 ELSE 0 END AS BIGINT) AS rows,
  CAST(sum(TRY_CAST(count AS BIGINT)) AS BIGINT) AS cases FROM tracker_raw WHERE state NOT IN ('GA', 'MA') GROUP BY 1""")
    e["x4_iso_date_orders"] = (
        lambda s, d: TB._read(s, d, "orders").select("o_orderkey", X.iso_date("o_orderdate").alias("day")),
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
    e["s4_read_state_feed"] = (lambda s, d: C.load_state_feed(FS.read_state_feed(s, state_feed_root(s, d))),
                               O.facts_ctes() + "\nSELECT * FROM tracker_facts")
    return e


def _loaded(rows: DataFrame) -> DataFrame:
    """Conformed rows staged in the shared folder, as a load does: planned with the load's settings, whatever the session has."""
    spark, staged = rows.sparkSession, scratch_path(rows.sparkSession, "loaded")
    with session_conf(spark, LOAD_CONF):
        rows.write.parquet(staged)
    return spark.read.schema(rows.schema).parquet(staged)


def _replaced_table(spark: SparkSession, sf: str) -> DataFrame:
    """K6: a table written with faulty rows first, then replaced."""
    path = scratch_path(spark, "replaced")
    write_facts(_dirty(facts(spark, sf)).na.fill("none", ["disease_slug"]), path)
    return write_facts(facts(spark, sf), path)


def _reopened_table(spark: SparkSession, sf: str) -> DataFrame:
    """K7: built by the first call, reused by the second."""
    path = scratch_path(spark, "reopened")
    open_or_build(spark, path, lambda: facts(spark, sf))

    def refuse() -> DataFrame:
        raise RuntimeError("the table was built twice")

    return open_or_build(spark, path, refuse)


def _refreshed_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """K9: a roll-up of other rows (no summers, one source's winters doubled), brought up to date."""
    root = scratch_path(spark, "refreshed")
    now = facts(spark, sf)
    month = F.month("report_period_start")
    winters = now.where((month == 1) & (F.col("data_source") == "tracker"))
    RU.refresh(now.where(month != 7).unionByName(winters), root)
    RU.refresh(now, root)
    return RU.read(spark, root)


def _some_customers(spark: SparkSession, sf: str) -> DataFrame:
    """A selection as long as the customer table, most of it repeated."""
    key = F.col("c_custkey") % 50
    return TB._read(spark, sf, "customer").where(key < 30).select(F.concat(F.lit("county-"), key.cast("string")).alias("geo_name"))


def _arrow_round_trip(df: DataFrame) -> DataFrame:
    return from_arrow(to_arrow(df), df.schema)


def _with_unlisted(facts: DataFrame) -> DataFrame:
    """Facts whose August rows come from a source that no priority lists."""
    august = F.month("report_period_start") == 8
    return facts.withColumn("data_source", F.when(august, F.lit("hospital")).otherwise(F.col("data_source")))


def _three_sources_sql() -> str:
    return _sql("""SELECT disease_name, disease_slug, state, month, data_source, CAST(count AS BIGINT) AS count FROM
                  (SELECT *, row_number() OVER (PARTITION BY disease_name, state, month ORDER BY
                     CASE data_source WHEN 'tracker' THEN 1 WHEN 'nndss' THEN 2 ELSE 3 END, data_source) AS rn FROM
                    (SELECT disease_name, disease_slug, state, date_trunc('month', report_period_start) AS month,
                       CASE WHEN month(report_period_start) = 8 THEN 'hospital' ELSE data_source END AS data_source,
                       SUM(count) AS count
                     FROM facts WHERE state IS NOT NULL AND state != '' GROUP BY 1, 2, 3, 4, 5))
                  WHERE rn = 1""")


def _dirty(facts: DataFrame) -> DataFrame:
    """Facts with every kind of fault the checks look for, in rows picked by their count."""
    n = F.col("count")
    return facts.withColumns({
        "disease_name": F.when(n % 5 == 0, F.lit(None)).otherwise(F.col("disease_name")),
        "report_period_start": F.when(n % 7 == 0, F.lit(None)).otherwise(F.col("report_period_start")),
        "report_period_end": F.when(n % 11 == 1, X.days_before("report_period_start", 1)).otherwise(F.col("report_period_end")),
        "state_slug": F.when(n % 13 == 2, F.upper("state_slug")).otherwise(F.col("state_slug")),
        "geo_unit_slug": F.when(n % 17 == 3, F.lit("a b")).otherwise(F.col("geo_unit_slug")),
        "count": F.when(n % 19 == 4, -n).otherwise(n),
    })


def _attach_weeks_job(raw: DataFrame) -> DataFrame:
    """Week dates computed once per distinct (year, week), joined back onto the line rows."""
    rows = raw.select(F.col("Current MMWR Year").try_cast("int").alias("year"),
                      F.col("MMWR WEEK").try_cast("int").alias("week"))
    weeks = C.mmwr_periods(W.distinct_weeks(rows, "year", "week"), "year", "week")
    return (J.attach_weeks(rows, weeks, ["year", "week"])
             .groupBy("report_period_start").agg(F.count(F.lit(1)).alias("line_rows")))


def _densify_sources(facts: DataFrame) -> DataFrame:
    """J6 join form: every (disease, state) x every source of the disease, zero-filled record counts.

    Both sides of the grid are per-disease distinct lists (small); the counts
    are one aggregate; the grid join is keyed by disease.
    """
    counts = A.count_records(facts, "disease_name", "state", "data_source")
    states = facts.select("disease_name", "state").distinct()
    sources = facts.select("disease_name", "data_source").distinct()
    return J.densify(states, sources, counts, ["state"], ["data_source"], "records", by=["disease_name"])


def _views_query(spark: SparkSession, sf: str) -> DataFrame:
    """K9: register the views, then query them by name with Spark SQL."""
    register_views(facts(spark, sf), merged(spark, sf))
    return spark.sql("SELECT m.disease_name, count(*) AS months, SUM(count) AS cases FROM disease_data_merged m "
                     "WHERE m.disease_slug IN (SELECT disease_slug FROM disease_name_mapping) GROUP BY 1")


_FEED_ROOTS: dict[tuple[str, str, str], str] = {}


def _feed_root(spark: SparkSession, sf: str, kind: str, write: Callable[[str], object]) -> str:
    """The folder of uploads that ``write`` makes, once per session."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), kind)
    if key not in _FEED_ROOTS:
        root = scratch_path(spark, f"feeds-{kind}")
        write(root)
        _FEED_ROOTS[key] = root
    return _FEED_ROOTS[key]


def state_feed_root(spark: SparkSession, sf: str) -> str:
    """The per-state feed derived from the tables as CSV uploads: the newest of each state, and an
    older one with other counts that was delivered later."""
    raw = TB.state_feed_raw(spark, sf)

    def write(root: str) -> None:
        FS.write_state_feed(raw, root, "20240301-120000", "team")
        FS.write_state_feed(raw.withColumn("count", F.lit("999")), root, "20240101-000000", "old")

    return _feed_root(spark, sf, "state", write)


def weekly_feed_root(spark: SparkSession, sf: str) -> str:
    """The weekly feed derived from the tables as one CSV upload, and an older one delivered later."""
    raw = TB.weekly_feed_raw(spark, sf)

    def write(root: str) -> None:
        FS.write_weekly_feed(raw, root, "20240320")
        FS.write_weekly_feed(raw.where(F.col("MMWR WEEK") == "1").withColumn("Current week", F.lit("7")), root, "20240101")

    return _feed_root(spark, sf, "weekly", write)


def _faulty_feed(spark: SparkSession, sf: str, on_error: str) -> FS.Feed:
    """The state feed with a row of many fields in California's upload, one of few in Florida's, no
    header in that of Massachusetts and another encoding in that of Georgia."""
    raw = TB.state_feed_raw(spark, sf).withColumnRenamed("state", "reporting_jurisdiction")
    columns = [c for c in raw.columns]
    state = F.col("reporting_jurisdiction")

    def write(root: str) -> None:
        rows = raw.withColumn("st", state)
        lines = rows.where("st NOT IN ('MA', 'GA')").select("st", F.lit(1).alias("at"), F.to_csv(F.struct(*columns)).alias("value"))
        states = rows.select("st").distinct().where("st <> 'GA'")
        heads = states.select("st", F.lit(0).alias("at"), F.when(F.col("st") == "MA", "").otherwise(",".join(columns)).alias("value"))
        extra = {"CA": ["CA"] * (len(columns) + 2), "FL": ["FL" if c == "reporting_jurisdiction" else "x" for c in columns][:-2]}
        faults = spark.createDataFrame([(st, 2, ",".join(fields)) for st, fields in extra.items()], "st string, at int, value string")
        draft = scratch_path(spark, "upload")
        (lines.unionByName(heads).unionByName(faults).repartition("st").sortWithinPartitions("st", "at").drop("at")
         .write.partitionBy("st").text(draft))
        (rows.where("st = 'GA'").withColumn("geo_name", F.lit("Stra\u00dfe")).repartition("st")
         .write.mode("append").options(header=True, encoding="ISO-8859-1").partitionBy("st").csv(draft))
        for path in [r["path"] for r in FS.discover_files(spark, draft, "part-*").select("path").collect()]:      # a file a state
            st = path.split("/st=")[-1].split("/")[0]
            FS._move(spark, path, f"{root}/data/states/{st}/20240301-120000_{st}_team.csv")

    return FS.read_feed(spark, FS.state_feed_paths(spark, _feed_root(spark, sf, "faulty", write)), on_error)


def _py_title_sql(x: str) -> str:
    """Title-casing of letter runs in DuckDB (oracle of X6): upper first letter of each letter run."""
    spaced = f"replace({x}, '-', ' ')"
    return (f"array_to_string(list_transform(regexp_extract_all({spaced}, '(\\p{{L}}+|[^\\p{{L}}]+)'), "
            f"lambda t: upper(t[1]) || lower(t[2:])), '')")


def _integrity_sql(table: str) -> str:
    req = " OR ".join(f"{c} IS NULL" for c in REQUIRED_NON_NULL)
    slugs = [c for c in ("disease_slug", "disease_subtype_slug", "reporting_jurisdiction_slug", "state_slug",
                         "geo_name_slug", "geo_unit_slug", "age_group_slug")]
    upper = " OR ".join(f"COALESCE({c} != lower({c}), false)" for c in slugs)
    space = " OR ".join(f"COALESCE(contains({c}, ' '), false)" for c in slugs)
    checks = [("null_required", req), ("end_before_start", "report_period_end < report_period_start"),
              ("negative_count", "count < 0"), ("uppercase_slug", upper), ("slug_with_space", space)]
    return " UNION ALL ".join(
        f"SELECT '{k}' AS check, CAST(count_if(COALESCE({v}, false)) AS BIGINT) AS n_bad FROM {table}"
        for k, v in checks)


ENTRIES = _entries()


def queries() -> dict[str, Fn]:
    return {k: v[0] for k, v in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in ENTRIES.items() if v[1] is not None}
