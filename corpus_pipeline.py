"""Training-data pipeline over the documents table, a stage an operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
what it keeps, with the columns of documents but for the last, which returns packed
sequences. ``run`` writes what a stage returns as Parquet in the shared folder and
reads it for the next one.

Documents may repeat (also their ids), so stages that choose among rows tell them apart
by their file and their place in it; no stage writes texts to number them. What a
stage wrote for itself is deleted when the next one begins, unless that one still
reads it.

Defined results, for every stage: null and empty texts, repeated rows and null doc_ids
are kept or dropped as told at the stage; an empty table gives an empty one; ties go to
the row of the smallest doc_id (null last), then of the file and place that come first;
columns beside those of documents are not expected and stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import exact_dedup, jaccard_join, langid, mixing, packing
from caseflow.llm import tables as T
from caseflow.session import drop_scratch, scratch_made, scratch_path, ship_package, text_batches

#: A document whose language is less sure than this goes.
MIN_LANGUAGE_SCORE = 0.5
ROW = "_pipeline_row"
#: Tokenising and streaming state cannot be told in SQL; tests hold the run against brute force.
ORACLE_SQL = None

#: Folders that the stage before wrote for itself.
_LEFT: list[str] = []


def _bare(path: str) -> str:
    return path.split(":", 1)[-1].lstrip("/")


def _forget(spark: SparkSession, docs: DataFrame) -> None:
    """Delete what the stage before wrote for itself, unless ``docs`` reads it; make the session ready for the next one."""
    ship_package(spark)
    text_batches(spark)
    read = [_bare(f) for f in docs.inputFiles()] if _LEFT else []
    done = [p for p in _LEFT if not any(f.startswith(_bare(p)) for f in read)]
    drop_scratch(spark, done)
    _LEFT[:] = [p for p in _LEFT if p not in done]
    spark.sparkContext._jvm.System.gc()      # Spark deletes shuffles and broadcasts once their frames are collected


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose own tables go when the next one begins."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _forget(spark, docs)
        before = len(scratch_made())
        out = function(spark, docs, sf_dir)
        _LEFT.extend(scratch_made(before))
        return out

    return run_stage


def _numbered(docs: DataFrame) -> tuple[str | None, DataFrame | None, DataFrame]:
    """(folder, files, frame): ``docs`` with a number for each row. Files are None where a written copy holds the numbers."""
    spark, files = docs.sparkSession, None
    whole = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"      # not a part of the files' rows
    folders = {f.rsplit("/", 1)[0] for f in docs.inputFiles()} if whole else set()
    if len(folders) == 1:
        files = T.file_numbers(docs)
    if files is not None:
        return folders.pop(), files, T.number_rows(docs, files, ROW).drop("_file")
    path = scratch_path(spark, "numbered")
    docs.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(path)
    return path, None, spark.read.parquet(path)


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; learnt from the rows that are not held out.

    Null and empty texts, texts without a letter and unsure ones go; without labels all go.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    told = langid.label(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return told.select(*docs.columns)


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the longest original; null and empty texts are one group."""
    path, files, rows = _numbered(docs)
    verdict = exact_dedup.classify(rows, exact_dedup.keep_state(spark, path, row=ROW, files=files), row=ROW)
    dropped = T.written(verdict.where("NOT kept").select(F.col("row").alias(ROW)), "exact-dropped")
    return T.without(rows, dropped, ROW).select(*docs.columns)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of linked documents; empty texts link with nothing and stay."""
    _, _, rows = _numbered(docs)
    placed, _ = jaccard_join.join(rows.select(F.col(ROW).alias("doc_id"), "text"))
    named = placed.select(F.col("doc_id").alias(ROW), "component_id").join(rows.select(ROW, "doc_id"), ROW)
    named = T.written(named, "near-components")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"))
    dropped = named.select(ROW).join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_anti")
    return T.without(rows, T.written(dropped, "near-dropped"), ROW).select(*docs.columns)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; texts without a word add nothing to it and go."""
    _, _, rows = _numbered(docs)
    taken = mixing.mix(mixing.measured(rows, ROW), carry=(ROW,)).where("taken > 0")
    copies = taken.select(ROW, (F.col("epochs") + F.col("drawn").cast("long")).cast("int").alias("_copies"))
    return rows.join(copies, ROW).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; an empty text is a piece of the end id alone."""
    _forget(spark, docs)
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences of the documents at ``sf_dir``."""
    docs, last = T.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = T.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            drop_scratch(spark, [last])
        last = scratch_made()[-1]
    return docs
