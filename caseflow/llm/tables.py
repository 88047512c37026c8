"""Reading the tables, and small helpers the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.session import scratch_path

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The six ASCII white-space characters of the operators' word and equality rules.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which its freed memory goes back to the system.

    Python workers live on through all stages; what the allocators keep of a task would
    stand beside the next ones', and beside the heap of stages without Python.
    """

    @wraps(run)
    def run_task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of the GNU C library
        if trim:
            trim(0)

    return run_task


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def n_words(col: str = "text") -> Column:
    """Number of runs of characters other than white space (0 for null), without building an array.

    Every word but the first of a text follows white space: squeeze the runs of
    white space to one blank each, then count blanks.
    """
    blank = F.translate(text_or_empty(col), SPACES, " " * len(SPACES))
    tight = F.trim(F.regexp_replace(blank, " {2,}", " "))
    gaps = F.octet_length(tight) - F.octet_length(F.translate(tight, " ", ""))
    return F.when(tight == "", F.lit(0)).otherwise(gaps + 1).cast("long")


#: Rows of a file that a row number has room for.
FILE_ROWS = 1 << 40


def file_numbers(docs: DataFrame) -> DataFrame | None:
    """_file, _k: a number for each file that ``docs`` is read from, written; None if it is not read from files."""
    try:
        files = docs.select(F.col("_metadata.file_path").alias("_file")).distinct()
    except AnalysisException:
        return None
    by_name = Window.orderBy("_file")       # a row a file
    return written(files.select("_file", F.row_number().over(by_name).cast("long").alias("_k")), "files")


def number_rows(docs: DataFrame, files: DataFrame, row: str) -> DataFrame:
    """Add ``row``, a number from a row's file and its place in it, and ``_file``. ``files`` has a row a file."""
    placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return placed.join(F.broadcast(files), "_file").withColumn(row, F.col("_k") * FILE_ROWS + F.col("_at")).drop("_k", "_at")


#: Least and most bits of the filter of keys: at most 2^20 rows of two numbers, 16 MB, are broadcast.
KEY_BITS = (1 << 16, 1 << 26)


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_maybe``: false where their ``key`` is surely none of ``keys``.

    The keys set bits of a filter of bounded size, which is joined by the place of a row's
    bit; so most rows of another key need no shuffle to tell.
    """
    bits = min(KEY_BITS[1], max(KEY_BITS[0], 1 << (16 * max(1, keys.count())).bit_length()))
    words = keys.select(F.expr(f"pmod(xxhash64(`{key}`), {bits})").alias("_at")).groupBy(F.expr("_at div 64").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_at % 64 as int))")).alias("_bits"))
    words = written(words, "key-bits")
    met = F.col("_bits").bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {bits}) % 64 as int))")) != 0
    out = rows.join(F.broadcast(words), F.expr(f"pmod(xxhash64(`{key}`), {bits}) div 64") == F.col("_word"), "left")
    return out.withColumn("_maybe", F.coalesce(met, F.lit(False))).drop("_word", "_bits")


def only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is one of ``keys``; rows that surely are not are never shuffled."""
    return maybe_in(rows, keys, key).where("_maybe").drop("_maybe").join(keys.select(key), key, "left_semi")


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is none of ``keys``; only those are shuffled that may be."""
    told = maybe_in(rows, keys, key)
    doubtful = told.where("_maybe").drop("_maybe").join(keys.select(key), key, "left_anti")
    return told.where("NOT _maybe").drop("_maybe").unionByName(doubtful)
