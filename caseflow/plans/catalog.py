"""Loading, persisting and exposing the fact table.

The fact table is written once and read by every query: a load job stages the
feeds, checks them, then writes Parquet partitioned by ``data_source`` and dealt by
range of an interleaved key of disease and month, so a file covers a few disease names and
a few months: a query for one disease skips most files by their footers, and so does
a query for a range of months. Every load is a new version (``versions``): readers see
the version before until the new one is whole, and a load that fails changes nothing.
Writing also cuts the lineage: a lost executor re-reads files, it does not recompute
the feeds. The monthly roll-up behind the merged view (``rollup``) lies beside it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.functions import columns as X
from caseflow.operators.windows import append_sources, distinct_rows
from caseflow.operators.schema import FACT_COLUMNS, FACT_SCHEMA, REQUIRED_NON_NULL, conform, validate
from caseflow.plans import rollup, versions
from caseflow.session import LOAD_CONF, drop_scratch, scratch_made, scratch_path, session_conf

log = logging.getLogger(__name__)

#: Bits of the clustering key that disease and month have each.
CLUSTER_BITS = 10
#: Ranks of up to so many slugs (some 10 MB) are broadcast.
BROADCAST_SLUGS = 100_000
#: Where a row group has too many slugs for a dictionary, a Bloom filter tells the absent ones.
FILE_OPTIONS = {"parquet.bloom.filter.enabled#disease_slug": "true", "parquet.bloom.filter.expected.ndv#disease_slug": "20000"}


def load_all(spark: SparkSession, loaders: Mapping[str, Callable[[SparkSession], DataFrame]],
             strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """K5: run every loader in name order, keep the valid ones, append them.

    A loader returns that source's rows (lazy). Each source is read once, into a
    staging table in the shared folder, which is then checked (K4) before its
    columns are conformed. A source that is invalid or fails in any way, while it
    is read too, is skipped and reported unless ``strict``; the others load.
    Returns ``(facts, report)`` where report rows are (source, status, detail).
    """
    kept, report = [], []
    for name in sorted(loaders):
        try:
            staged = scratch_path(spark, f"stage-{name}")
            rows = loaders[name](spark)
            with session_conf(spark, LOAD_CONF):
                rows.write.parquet(staged)
            rows = spark.read.schema(rows.schema).parquet(staged)
            bad = validate(rows).collect()  # at most one row per schema column
        except Exception as exc:
            if strict:
                raise
            log.error("loading %s failed: %s", name, exc)
            report.append((name, "error", str(exc)))
            continue
        if bad:
            detail = "; ".join(f"{r['check']}:{r['column']}={r['n_bad']}" for r in bad)
            if strict:
                raise ValueError(f"source {name} does not fit the fact schema: {detail}")
            report.append((name, "invalid", detail))
            continue
        kept.append(conform(rows))
        report.append((name, "loaded", ""))
    facts = append_sources([spark.createDataFrame([], FACT_SCHEMA), *kept])
    return facts, spark.createDataFrame(report, "source string, status string, detail string")


def clustered(facts: DataFrame) -> DataFrame:
    """Add ``_cluster``: bits of the disease's rank and of the month's place in the table's span, interleaved.

    The ranks are a row a disease, the span is one row; both come from two columns of ``facts``.
    The ranks are written first: planned from the size of ``facts``, the join would deal all
    rows by slug, and those of a common disease to one task.
    """
    spark = spark_of(facts)
    top = (1 << CLUSTER_BITS) - 1
    span = facts.agg(F.min("report_period_start").alias("a"), F.max("report_period_start").alias("b")).first()
    by_slug = Window.orderBy("disease_slug")        # over the distinct slugs only
    ranks = facts.select("disease_slug").distinct().select(
        F.col("disease_slug").alias("_slug"), (F.percent_rank().over(by_slug) * top).cast("int").alias("_rank"))
    told = scratch_path(spark, "slug-ranks")
    ranks.write.parquet(told)
    ranks = spark.read.schema(ranks.schema).parquet(told)
    if ranks.count() <= BROADCAST_SLUGS:
        ranks = F.broadcast(ranks)

    def months(c: Column) -> Column:
        return F.year(c) * 12 + F.month(c)

    first, last = (F.lit(v).cast("timestamp_ntz") for v in span)
    place = (months(F.col("report_period_start")) - months(first)) * top / F.greatest(months(last) - months(first), F.lit(1))
    # the month's place is a column of its own: the key uses it many times
    return (facts.join(ranks, F.col("disease_slug").eqNullSafe(F.col("_slug")), "left")
                 .withColumns({"_rank": F.coalesce("_rank", F.lit(0)), "_place": F.coalesce(place.cast("int"), F.lit(0))})
                 .withColumn("_cluster", X.interleave_bits("_rank", "_place", CLUSTER_BITS)).drop("_slug", "_rank", "_place"))


def write_facts(df: DataFrame, path: str, partitions: int | None = None, keep_versions: int = 2) -> DataFrame:
    """K6 + K10: replace the table at ``path`` by a new version; returns the table read back.

    One shuffle by range of (data_source, interleaved disease and month, state, period
    start). The range bounds come from a sample of all of them, so a hot disease or month
    is split over as many tasks as its rows need. ``df`` is read more than once: hand
    over staged rows, not a lazy feed. The log names the new version when all of it is
    written, in one rename; versions beyond ``keep_versions`` go.
    """
    spark = spark_of(df)
    before = versions.current(spark, path)
    folder = versions.fresh(path)
    keys = ("data_source", "_cluster", "state", "report_period_start")
    made = len(scratch_made())
    (clustered(conform(df))
        .repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
        .sortWithinPartitions(*keys).drop("_cluster")
        .write.options(**FILE_OPTIONS).partitionBy("data_source").parquet(f"{path.rstrip('/')}/{folder}"))
    drop_scratch(spark, scratch_made(made))
    versions.publish(spark, path, {"folders": [folder]}, before and before["number"])
    versions.sweep(spark, path, [folder], keep_versions)
    return read_facts(spark, path)


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def valid_sources(facts: DataFrame) -> dict[str, int]:
    """K4 over a written table: ``{source: rows with a null in a required column}`` (one job, tiny result)."""
    bad = F.count_if(F.greatest(*[F.col(c).isNull() for c in REQUIRED_NON_NULL]))
    return {r["data_source"]: r["n_bad"]
            for r in facts.groupBy("data_source").agg(bad.alias("n_bad")).collect()}


def read_facts(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """Read a written fact table (its current version, or version ``number``) in schema order."""
    entry = versions.current(spark, path) if number is None else versions.record(spark, path, number)
    if entry is None:
        raise FileNotFoundError(f"no fact table was published at {path}")
    [folder] = entry["folders"]
    return spark.read.schema(FACT_SCHEMA).parquet(f"{path.rstrip('/')}/{folder}").select(*FACT_COLUMNS)


def open_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """K7: reuse the table at ``path`` if it and its merged view have rows, else build and write it.

    A table of which files are missing or damaged is built anew, like one that was never
    published.
    """
    from caseflow.operators.merge import merged_monthly
    try:
        existing = read_facts(spark, path)
        if not merged_monthly(existing.limit(1)).isEmpty():
            return existing
    except (FileNotFoundError, PySparkException, Py4JJavaError) as exc:
        log.warning("rebuilding %s: %s", path, exc)
    return write_facts(build(), path)


def build_name_mapping(facts: DataFrame) -> DataFrame:
    """K8: distinct (disease_slug, disease_name, data_source), ordered by slug then source."""
    return (distinct_rows(facts, ["disease_slug", "disease_name", "data_source"])
            .orderBy("disease_slug", "data_source", "disease_name"))


def register_views(facts: DataFrame, merged: DataFrame | None = None,
                   names: tuple[str, str, str] = ("disease_data", "disease_data_merged",
                                                  "disease_name_mapping")) -> None:
    """K9: expose the fact table, the merged view and the name mapping by name."""
    facts.createOrReplaceTempView(names[0])
    if merged is not None:
        merged.createOrReplaceTempView(names[1])
    build_name_mapping(facts).createOrReplaceTempView(names[2])


def result_shape(df: DataFrame) -> dict[str, object]:
    """Column names and number of rows of a result (one count job)."""
    return {"columns": df.columns, "row_count": df.count()}


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row; date/timestamp values as ``yyyy-MM-dd``.

    Distributed: every executor formats its own rows; nothing is gathered on
    the driver.
    """
    cols = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t in ("date", "timestamp", "timestamp_ntz"):
            cols.append(X.iso_date(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def to_arrow(df: DataFrame) -> DataFrame:
    """The result as Arrow IPC streams, (batch, columns, row_count, arrow) a row.

    Distributed: each task turns its Arrow batches into streams of their own (schema and
    one batch), which any Arrow reader opens; nothing is gathered on the driver. A result
    without rows has no streams; ``result_shape`` tells its columns.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"batch": [i], "columns": [names], "row_count": [len(batch)], "arrow": [sink.getvalue().to_pybytes()]},
                                             pa.schema([("batch", pa.int32()), ("columns", pa.list_(pa.string())), ("row_count", pa.int64()), ("arrow", pa.binary())]))

    return df.mapInArrow(run, "batch int, columns array<string>, row_count long, arrow binary")


def from_arrow(streams: DataFrame, schema) -> DataFrame:
    """The rows of ``to_arrow`` streams, read back on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("arrow").to_pylist():
                with pa.ipc.open_stream(raw) as stream:
                    yield from stream

    return streams.select("arrow").mapInArrow(run, schema)


# ------------------------------------------------------------------ registry fact table
_BUILT: dict[tuple[str, str], tuple[str, list[str]]] = {}
_FRAMES: dict[tuple[str, str, str], DataFrame] = {}


def _built(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    """(folder, valid sources) of the tables derived from ``sf_dir``, written once per session."""
    from caseflow.plans.facts import facts_from_tables

    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _BUILT:
        root, staged = scratch_path(spark, "facts"), scratch_path(spark, "stage-facts")
        with session_conf(spark, LOAD_CONF):
            facts_from_tables(spark, sf_dir).write.partitionBy("data_source").parquet(staged)
            rows = spark.read.schema(FACT_SCHEMA).parquet(staged)
            report = valid_sources(rows)
            for src, n_bad in sorted(report.items()):
                if n_bad:
                    log.error("source %s rejected: %d rows with nulls in required columns", src, n_bad)
            keep = sorted(s for s, n in report.items() if n == 0)
            written = write_facts(rows.where(F.col("data_source").isin(keep)), f"{root}/facts")
            rollup.refresh(written, f"{root}/rollup")
            drop_scratch(spark, [staged])
        _BUILT[key] = (root, keep)
    return _BUILT[key]


def facts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table derived from the benchmark tables at ``sf_dir``, written once per session.

    The first call derives both feeds in one plan and stages them in the shared
    checkpoint folder (the conform work runs exactly once), checks every source from the
    staged columns, keeps only sources with no null in a required column (all-or-nothing
    per source, like a load), and writes the table and its roll-up from the staged rows.
    Later calls in the same application reuse the written table.
    """
    root, _ = _built(spark, sf_dir)
    if (*_key(spark, sf_dir), "facts") not in _FRAMES:  # a DataFrame is an immutable plan: list the files once, reuse it
        _FRAMES[(*_key(spark, sf_dir), "facts")] = read_facts(spark, f"{root}/facts")
    return _FRAMES[(*_key(spark, sf_dir), "facts")]


def rollup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored monthly roll-up of ``facts_table``."""
    root, _ = _built(spark, sf_dir)
    if (*_key(spark, sf_dir), "rollup") not in _FRAMES:
        _FRAMES[(*_key(spark, sf_dir), "rollup")] = rollup.read(spark, f"{root}/rollup")
    return _FRAMES[(*_key(spark, sf_dir), "rollup")]


def table_sources(spark: SparkSession, sf_dir: str) -> list[str]:
    """The sources of ``facts_table``, known since it was loaded."""
    return _built(spark, sf_dir)[1]


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir.rstrip("/")


# ------------------------------------------------------------------ production load
def build_fact_table(spark: SparkSession, path: str, state_feed_root: str | None = None,
                     weekly_feed_root: str | None = None, strict: bool = False,
                     priority: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Load the CSV feeds, write the fact table and its roll-up under ``path`` and register the views.

    The batch counterpart of the feeds' startup load: each given feed root is
    read (newest uploads), conformed and validated (an invalid source is
    skipped and reported unless ``strict``); the valid sources are written
    once; ``disease_data``, ``disease_data_merged`` and
    ``disease_name_mapping`` are registered over the written table.
    Returns ``(facts, merged, report)``.
    """
    from caseflow.functions import dims
    from caseflow.operators.conform import load_state_feed, load_weekly_feed
    from caseflow.sources.files import read_state_feed, read_weekly_feed

    def need(df: DataFrame | None, what: str) -> DataFrame:
        if df is None:
            raise ValueError(f"no {what} files found")
        return df

    loaders: dict[str, Callable[[SparkSession], DataFrame]] = {}
    if state_feed_root:
        loaders["tracker"] = lambda s: load_state_feed(need(read_state_feed(s, state_feed_root), "state feed"))
    if weekly_feed_root:
        loaders["nndss"] = lambda s: load_weekly_feed(need(read_weekly_feed(s, weekly_feed_root), "weekly feed"))
    facts, report = load_all(spark, loaders, strict=strict)
    with session_conf(spark, LOAD_CONF):
        written = write_facts(facts, f"{path.rstrip('/')}/facts")
        rollup.refresh(written, f"{path.rstrip('/')}/rollup")
    merged = rollup.merged(rollup.read(spark, f"{path.rstrip('/')}/rollup"), priority or dims.DEFAULT_PRIORITY)
    register_views(written, merged)
    return written, merged, report
