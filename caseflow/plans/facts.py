"""The unified fact table built from the benchmark tables (lazy, one plan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseflow.operators.conform import load_state_feed, load_weekly_feed
from caseflow.sources.tables import state_feed_raw, weekly_feed_raw


def facts_from_tables(spark: SparkSession, sf_dir: str, standard: str = "compat") -> DataFrame:
    """Both feeds derived from the tables, conformed and appended in name order (nndss, then tracker)."""
    weekly = load_weekly_feed(weekly_feed_raw(spark, sf_dir), standard=standard)
    state = load_state_feed(state_feed_raw(spark, sf_dir))
    return weekly.unionByName(state)
