"""Exact duplicates by a stateful stream over keyed state on disk (operator 3).

Documents stream through a keyed aggregation whose state lives in RocksDB, is
written to the shared checkpoint folder after every batch and never expires.
Per digest of the normalised text it retains the stable identifier of the row
that stays, the locator of its content (file) and the number of equal rows.
The state is then read back as a table. Where a digest was hit more than once,
the full normalised bytes are compared, so that equal digests alone never make
two texts equal.

Only DataFrame and SQL functions run on the executors.

Defined results: null text counts as empty, and empty texts equal each other; of
equal texts the longest original stays, then the smallest ``doc_id``, and a null
``doc_id`` comes after all others. Rows with the same ``doc_id`` and text count
as separate members of one group. An empty table gives no rows. Columns of the
input other than ``doc_id`` and ``text`` play no part and cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import tables as T
from caseflow.session import scratch_path, session_conf

#: State on disk, kept only as change logs and snapshots in the shared folder.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: do not set megabytes of disk aside for each
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def normalised(col: Column) -> Column:
    """Text without any of the six ASCII white-space characters; null is empty."""
    return F.translate(F.coalesce(col, F.lit("")), T.SPACES, "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _first(row: str) -> Column:
    """Greatest for the row of a group that stays: longest text, then smallest doc_id, null last, then smallest row."""
    return F.struct(F.length(T.text_or_empty()).alias("chars"), F.col("doc_id").isNotNull().alias("named"),
                    (-F.col("doc_id")).alias("order"), "doc_id", (-F.col(row)).alias("row_order"), F.col(row).alias("row"))


def keep_state(spark: SparkSession, source: str, bytes_per_batch: int = 64 << 30,
               digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None, row: str = "doc_id",
               files: DataFrame | None = None) -> DataFrame:
    """Run the stream over all files of ``source`` not seen by ``checkpoint`` yet; return the state as a table.

    One row per digest: keep_id, keep_row, locator (file of the row that stays), chars,
    group_size. ``row`` is a column that tells rows of one doc_id apart, if they must be;
    with ``files`` (``tables.file_numbers``) it is the number that ``tables.number_rows``
    gives. Calling it again with the same ``checkpoint`` takes in new files only.
    """
    checkpoint = checkpoint or scratch_path(spark, "dedup-state")
    schema = spark.read.parquet(source).select(*dict.fromkeys(("doc_id", "text", "doc_id" if files is not None else row))).schema
    pattern = f"{source[:-1]}[{source[-1]}]"     # a glob, since a stream takes a single file only as the match of one
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(pattern)
    if files is None:
        stream = stream.select("*", F.col("_metadata.file_path").alias("locator"))
    else:
        stream = T.number_rows(stream, files, row).withColumnRenamed("_file", "locator")
    state = (stream.select(digest(normalised(F.col("text"))).alias("digest"),
                           F.struct(_first(row).alias("first"), "locator").alias("row"))
             .groupBy("digest").agg(F.max("row").alias("row"), F.count(F.lit(1)).alias("group_size")))
    with session_conf(spark, STATE_CONF):
        query = (state.writeStream.outputMode("update").format("noop")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
        table = spark.read.format("statestore").load(checkpoint)
        value = table.schema["value"].dataType.names
        return T.written(table.select(
            F.col("key.digest").alias("digest"), F.col(f"value.{value[0]}.first.doc_id").alias("keep_id"),
            F.col(f"value.{value[0]}.first.row").alias("keep_row"),
            F.col(f"value.{value[0]}.locator").alias("locator"), F.col(f"value.{value[0]}.first.chars").alias("chars"),
            F.col(f"value.{value[1]}").alias("group_size")), "dedup-kept")


def clashes(docs: DataFrame, hits: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Those of the digests ``hits`` under which two different normalised texts stand, by comparing full bytes.

    Only texts that may have such a digest are shuffled. They are grouped by their
    bytes: equal ones collapse within each task before the shuffle, so a group of any
    size sends one row per task.
    """
    norm = normalised(F.col("text"))
    texts = T.maybe_in(docs.select(digest(norm).alias("digest"), norm.alias("norm")), hits, "digest").where("_maybe")
    texts = texts.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("rows"))
    return texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")


def _plain(path: str) -> str:
    """One spelling of a file's URI, whichever reader gave it."""
    return re.sub(":/+", ":/", unquote(path))


def earlier_texts(docs: DataFrame, state: DataFrame) -> DataFrame | None:
    """Rows of the files in which the state's hits lie and that are not among those of ``docs``.

    After a run that went on from a checkpoint, the row that stays may lie in a file read
    before; its locator says where its bytes are.
    """
    here = {_plain(f) for f in docs.inputFiles()}
    if not here:
        return None
    held = state.where("group_size > 1").select("locator").distinct().collect()      # a row a file
    away = [r.locator for r in held if _plain(r.locator) not in here]
    return docs.sparkSession.read.schema("doc_id long, text string").parquet(*away) if away else None


def classify(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha256, row: str = "doc_id") -> DataFrame:
    """doc_id, row, keep_id, group_size, kept, text_sha256 of each row, once the full bytes of all hits were compared."""
    norm = normalised(F.col("text"))
    rows = docs.select("doc_id", F.col(row).alias("row"), digest(norm).alias("digest"), F.sha2(norm, 256).alias("text_sha256"))
    before = earlier_texts(docs, state)
    texts = docs.select("text") if before is None else docs.select("text").unionByName(before.select("text"))
    apart = T.written(clashes(texts, state.where("group_size > 1").select("digest"), digest), "dedup-clashes")
    out = rows.join(state.select("digest", "keep_id", "keep_row", "group_size"), "digest")
    if not apart.isEmpty():
        # under these digests the groups are the full texts themselves
        clashing = docs.select("doc_id", F.col(row).alias("row"), norm.alias("norm"), digest(norm).alias("digest"),
                               _first(row).alias("first")).join(apart, "digest", "left_semi")
        groups = clashing.groupBy("norm").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("group_size"))
        redone = clashing.select("doc_id", "row", "digest", "norm").join(groups, "norm").select(
            "digest", "doc_id", "row", F.sha2("norm", 256).alias("text_sha256"), F.col("first.doc_id").alias("keep_id"),
            F.col("first.row").alias("keep_row"), "group_size")
        out = out.join(apart, "digest", "left_anti").unionByName(redone)
    return out.select("doc_id", "row", "keep_id", "group_size", F.col("row").eqNullSafe(F.col("keep_row")).alias("kept"), "text_sha256")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of the table: the document that stays of its equals, and their number."""
    source = f"{sf_dir.rstrip('/')}/documents.parquet"
    return classify(spark.read.parquet(source).select("doc_id", "text"), keep_state(spark, source)).drop("row")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g"""
