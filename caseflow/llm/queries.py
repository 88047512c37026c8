"""Registered queries of the operators in this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseflow.llm import alignment, exact_dedup, html_text, jaccard_join, langid, licenses, merkle, mixing, packing, pii, quality, token_files, toxicity
from caseflow.session import ship_package, text_batches

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_html_text": (html_text.op1, None),
    "op2_token_files": (token_files.op2, None),
    "op3_exact_dedup": (exact_dedup.op3, exact_dedup.OP3_SQL),
    "op4_quality_rules": (quality.op4, None),
    "op5_language_id": (langid.op5, None),
    "op6_packing": (packing.op6, None),
    "op7_jaccard_join": (jaccard_join.op7, None),
    "op8_mixing": (mixing.op8, mixing.OP8_SQL),
    "op9_pii": (pii.op9, pii.OP9_SQL),
    "op10_licenses": (licenses.op10, licenses.OP10_SQL),
    "op11_merkle": (merkle.op11, merkle.OP11_SQL),
    "op12_alignment": (alignment.op12, None),
    "op13_toxicity": (toxicity.op13, None),
}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        text_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for name, (query, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
