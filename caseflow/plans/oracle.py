"""DuckDB SQL that rebuilds the same facts as the Spark plans, for the correctness gate.

The common table expressions below derive both raw feeds from the benchmark
tables exactly as ``caseflow.sources.tables`` does, conform them as
``caseflow.operators.conform`` does, and expose ``facts`` and ``merged``.
Each registered query's oracle is ``WITH <ctes> SELECT ...``.
"""

from __future__ import annotations

from caseflow.functions import dims
from caseflow.operators.schema import REQUIRED_NON_NULL
from caseflow.sources import tables as TB


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(expr: str, mapping: dict, default: str | None = None) -> str:
    parts = " ".join(f"WHEN {expr} = {k if isinstance(k, int) else q(k)} THEN {q(v)}" for k, v in mapping.items())
    tail = f" ELSE {q(default)}" if default is not None else ""
    return f"CASE {parts}{tail} END"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g')"


def slug(x: str) -> str:
    s = f"lower({x})"
    s = rf"regexp_replace({s}, '[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f-]', '', 'g')"
    s = rf"regexp_replace({s}, '[\s\x0b\x1c-\x1f_]+', '-', 'g')"
    s = f"regexp_replace({s}, '-+', '-', 'g')"
    s = f"regexp_replace({s}, '^-|-$', '', 'g')"
    return f"NULLIF({s}, '')"


def na(x: str, extra=()) -> str:
    return f"CASE WHEN {x} IN {in_list(tuple(dims.NA_TOKENS) + tuple(extra))} THEN NULL ELSE {x} END"


def map_case(x: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"


def tracker_raw_sql() -> str:
    start = "(CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER))"
    return f"""
  tracker_raw AS (
    SELECT
      strftime({start}, '%Y-%m-%d') AS report_period_start,
      strftime({start} + 6, '%Y-%m-%d') AS report_period_end,
      {case('c_mktsegment', TB.STATE_FEED_DISEASE)} AS disease_name,
      CASE WHEN o_orderkey % 11 = 0 THEN 'NA' ELSE substring(o_orderpriority, 3, 100) END AS disease_subtype,
      {case('c_nationkey', dict(enumerate(TB.STATE_BY_NATION)))} AS state,
      'county-' || CAST(o_custkey % 50 AS VARCHAR) AS geo_name,
      {case('o_orderkey % 8', dict(enumerate(TB.AGE_BY_MOD8)))} AS age_group,
      {case('o_orderstatus', TB.STATUS_BY_ORDERSTATUS)} AS confirmation_status,
      CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS VARCHAR) END AS count
    FROM orders JOIN customer ON o_custkey = c_custkey
  )"""


def weekly_raw_sql() -> str:
    qty = "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)"
    area = case("c_nationkey", dict(enumerate(TB.AREA_BY_NATION)))
    week = "LEAST(52, 1 + CAST(floor((dayofyear(l_shipdate) - 1) / 7) AS INTEGER))"
    return f"""
  weekly_raw AS (
    SELECT
      {area} AS "Reporting Area",
      CAST(year(l_shipdate) AS VARCHAR) AS "Current MMWR Year",
      CAST({week} AS VARCHAR) AS "MMWR WEEK",
      {case('c_mktsegment', TB.WEEKLY_FEED_DISEASE)} || {case('l_linenumber', TB.LABEL_SUFFIX_BY_LINE, '')} AS "Label",
      CASE WHEN l_linenumber = 7 THEN '-'
           WHEN l_linenumber = 6 THEN '1,' || lpad({qty}, 3, '0')
           WHEN l_orderkey % 13 = 0 THEN 'N'
           ELSE {qty} END AS "Current week",
      {area} AS "LOCATION1",
      {case('c_nationkey', TB.REGION_LOCATION2)} AS "LOCATION2"
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  )"""


def tracker_facts_sql() -> str:
    sub = "disease_subtype"
    subtype = (f"CASE WHEN {sub} IS NULL OR {strip(sub)} = '' THEN NULL "
               f"ELSE COALESCE({map_case('lower(' + strip(sub) + ')', dims.STATE_SUBTYPE_NORMALIZATION)}, {sub}) END")

    def placeholder(x):
        return f"CASE WHEN {x} IS NULL OR lower({strip(x)}) IN {in_list(dims.PLACEHOLDERS)} THEN NULL ELSE {x} END"

    cols = ["report_period_start", "report_period_end", "disease_name", "disease_subtype", "state",
            "geo_name", "age_group", "confirmation_status", "count"]
    cleaned = ",\n      ".join(f"{na(c)} AS {c}" for c in cols)
    return f"""
  tracker_na AS (
    SELECT {cleaned}
    FROM tracker_raw
  ),
  tracker_sub AS (
    SELECT *, {subtype} AS subtype_n, {placeholder('age_group')} AS age_n,
           {placeholder('confirmation_status')} AS status_n
    FROM tracker_na
  ),
  tracker_facts AS (
    SELECT
      TRY_CAST(report_period_start AS TIMESTAMP) AS report_period_start,
      TRY_CAST(report_period_end AS TIMESTAMP) AS report_period_end,
      'cccd' AS date_type, 'month' AS time_unit,
      disease_name, {slug('disease_name')} AS disease_slug,
      subtype_n AS disease_subtype, {slug('subtype_n')} AS disease_subtype_slug,
      state AS reporting_jurisdiction, {slug('state')} AS reporting_jurisdiction_slug,
      state, {slug('state')} AS state_slug,
      geo_name, {slug('geo_name')} AS geo_name_slug,
      'state' AS geo_unit, 'state' AS geo_unit_slug,
      age_n AS age_group, {slug('age_n')} AS age_group_slug,
      status_n AS confirmation_status, 'cases' AS outcome,
      COALESCE(TRY_CAST(count AS BIGINT), CAST(TRY_CAST(count AS DOUBLE) AS BIGINT)) AS count,
      'tracker' AS data_source, disease_name AS original_disease_name
    FROM tracker_sub
  )"""


def weekly_facts_sql(standard: str = "compat") -> str:
    cols = ["Reporting Area", "Current MMWR Year", "MMWR WEEK", "Label", "Current week", "LOCATION1", "LOCATION2"]
    cleaned = ",\n      ".join(f'{na(chr(34) + c + chr(34), dims.WEEKLY_EXTRA_NA)} AS "{c}"' for c in cols)
    lab = strip('"Label"')
    raw_sub = strip(f"regexp_extract({lab}, '(?s)^[^,]*,(.*)$', 1)")
    no_prefix = f"regexp_replace(raw_sub, '(?i)^serogroups? ', '')"
    no_suffix = strip(rf"regexp_replace({no_prefix}, '(?i)[\s\x0b\x1c-\x1f]*serogroups?[\s\x0b\x1c-\x1f]*$', '')")
    norm = f"COALESCE({map_case('lower(no_suffix)', dims.WEEKLY_SUBTYPE_NORMALIZATION)}, no_suffix)"
    area = '"Reporting Area"'
    area_slug = slug(area)
    if standard != "compat":
        raise ValueError("oracle implements the compat week rule only")
    return f"""
  weekly_na AS (
    SELECT {cleaned}
    FROM weekly_raw
  ),
  weekly_p1 AS (
    SELECT *,
      {lab} AS lab,
      strpos({lab}, ',') > 0 AS has_comma,
      {raw_sub} AS raw_sub,
      TRY_CAST("Current MMWR Year" AS INTEGER) AS yr,
      TRY_CAST("MMWR WEEK" AS INTEGER) AS wk,
      CASE WHEN {area} IS NULL OR {area} = '' THEN 'state'
           WHEN {area_slug} IN {in_list(dims.NATIONAL_SLUGS)} THEN 'national'
           WHEN {area_slug} IN {in_list(dims.REGION_SLUGS)} THEN 'region'
           ELSE 'state' END AS geo_unit
    FROM weekly_na
  ),
  weekly_p2 AS (
    SELECT *,
      CASE WHEN has_comma THEN {strip("split_part(lab, ',', 1)")} ELSE lab END AS base,
      {no_suffix} AS no_suffix,
      make_date(yr, 1, 1) AS jan1
    FROM weekly_p1
  ),
  weekly_p3 AS (
    SELECT *,
      CASE WHEN NOT has_comma OR raw_sub = '' OR lower(raw_sub) IN {in_list(dims.AGGREGATE_SUBTYPES)} THEN NULL
           ELSE NULLIF({norm}, '') END AS subtype,
      COALESCE({map_case(slug('base'), dims.DISEASE_ALIASES)}, {slug('base')}) AS disease,
      CASE WHEN isodow(jan1) - 1 <= 3 THEN jan1 + CAST((6 - (isodow(jan1) - 1)) % 7 AS INTEGER)
           ELSE jan1 + CAST((6 - (isodow(jan1) - 1)) % 7 + 7 AS INTEGER) END AS week1,
      CASE WHEN geo_unit = 'state' THEN COALESCE({map_case(f'upper({area})', dims.STATE_CODES)}, {area})
           WHEN geo_unit = 'region' THEN COALESCE("LOCATION2", {area})
           WHEN geo_unit = 'national' THEN 'US'
           ELSE {area} END AS state_code,
      TRY_CAST(NULLIF(regexp_replace(COALESCE("Current week", ''), '[^0-9]', '', 'g'), '') AS BIGINT) AS cnt
    FROM weekly_p2
  ),
  weekly_facts AS (
    SELECT
      CAST(week1 + (wk - 1) * 7 AS TIMESTAMP) AS report_period_start,
      CAST(week1 + (wk - 1) * 7 + 6 AS TIMESTAMP) AS report_period_end,
      'mmwr' AS date_type, 'week' AS time_unit,
      disease AS disease_name, disease AS disease_slug,
      subtype AS disease_subtype, {slug('subtype')} AS disease_subtype_slug,
      state_code AS reporting_jurisdiction, {slug('state_code')} AS reporting_jurisdiction_slug,
      state_code AS state, {slug('state_code')} AS state_slug,
      {area} AS geo_name, {area_slug} AS geo_name_slug,
      geo_unit, {slug('geo_unit')} AS geo_unit_slug,
      CAST(NULL AS VARCHAR) AS age_group, CAST(NULL AS VARCHAR) AS age_group_slug,
      CAST(NULL AS VARCHAR) AS confirmation_status, 'cases' AS outcome,
      cnt AS count, 'nndss' AS data_source, "Label" AS original_disease_name
    FROM weekly_p3
    WHERE cnt IS NOT NULL AND geo_unit = 'state'
  )"""


def _gate(name: str) -> str:
    anynull = " OR ".join(f"{c} IS NULL" for c in REQUIRED_NON_NULL)
    return f"(SELECT count(*) FROM {name} WHERE {anynull}) = 0"


def facts_ctes() -> str:
    """CTEs ending in ``facts`` (23 columns, both feeds, each gated all-or-nothing)."""
    return ("WITH" + tracker_raw_sql() + "," + weekly_raw_sql() + "," + tracker_facts_sql() + ","
            + weekly_facts_sql() + f""",
  facts AS MATERIALIZED (
    SELECT * FROM weekly_facts WHERE {_gate('weekly_facts')}
    UNION ALL
    SELECT * FROM tracker_facts WHERE {_gate('tracker_facts')}
  )""")


def merged_cte(priority=dims.DEFAULT_PRIORITY) -> str:
    rank = "CASE " + " ".join(f"WHEN data_source = {q(s)} THEN {i}" for i, s in enumerate(priority, 1)) \
        + f" ELSE {len(priority) + 1} END"
    return f""",
  monthly AS (
    SELECT disease_name, disease_slug, state, date_trunc('month', report_period_start) AS month,
           data_source, SUM(count) AS count
    FROM facts WHERE state IS NOT NULL AND state != ''
    GROUP BY ALL
  ),
  merged AS MATERIALIZED (
    SELECT disease_name, disease_slug, state, month, data_source, CAST(count AS BIGINT) AS count
    FROM (SELECT *, row_number() OVER (PARTITION BY disease_name, state, month
                                       ORDER BY {rank}, data_source) AS rn FROM monthly)
    WHERE rn = 1
  )"""

