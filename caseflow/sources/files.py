"""CSV feed sources.

Layouts (as the feeds deliver them):

* per-state feed: ``<root>/data/states/<STATE>/<YYYYMMDD-HHMMSS>_<STATE>_<who>.csv``;
  the newest file of each state directory (by file name) is the state's data;
* weekly feed: ``<root>/NNDSS_Weekly_Data_<date>*.csv``; the newest upload is read, a
  file or a folder of part files, each with the header.

Listing uses Spark's ``binaryFile`` source with only the path selected, so
file contents are never read for discovery. Rows are read by Spark's CSV
reader, every column as text; typing happens in the conform step.

Faulty uploads (S7): a row with more fields than its header, or with bytes that
are not UTF-8, makes its whole file unreadable to the feeds' own loader; here the
file is left out, or ends the load, or only such rows are put aside, as ``on_error``
says. Rows with fewer fields are kept, their last columns null. All of them are
told, with their file and raw text, in ``Feed.quarantine``, and counted in
``Feed.report``.
"""

from __future__ import annotations

import csv
import io
import logging
import re
from dataclasses import dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from caseflow.operators.windows import union_files
from caseflow.session import drop_scratch, scratch_path

log = logging.getLogger(__name__)

FILES_SCHEMA = "path string, parent string, file_name string"
WEEKLY_GLOB = "NNDSS_Weekly_Data_*.csv"


def discover_files(spark: SparkSession, root: str, glob: str = "*.csv", recursive: bool = True) -> DataFrame:
    """(path, parent, file_name) of every file under ``root`` matching ``glob``.

    A missing directory or no match gives an empty result, not an error.
    """
    try:
        listed = (spark.read.format("binaryFile")
                  .option("pathGlobFilter", glob)
                  .option("recursiveFileLookup", str(recursive).lower())
                  .load(root)
                  .select("path"))
        listed.schema  # resolves the listing now so a missing root is caught here
    except AnalysisException:
        return spark.createDataFrame([], FILES_SCHEMA)
    parts = F.split(F.col("path"), "/")
    return listed.select("path", F.element_at(parts, -2).alias("parent"),
                         F.element_at(parts, -1).alias("file_name"))


def latest_file_per_group(files: DataFrame, group: str = "parent", order: str = "file_name") -> DataFrame:
    """The newest file of each group, by file-name order (not modification time)."""
    return files.groupBy(group).agg(F.max_by("path", order).alias("path"), F.max(order).alias(order))


def latest_file(files: DataFrame) -> DataFrame:
    """S3: the single newest file by full path (one row, or none)."""
    return files.agg(F.max("path").alias("path")).where(F.col("path").isNotNull())


def weekly_uploads(spark: SparkSession, root: str) -> DataFrame:
    """(path, upload) of the weekly feed's files under ``root``: a file is an upload of its own, a part one of its folder's."""
    root = root.rstrip("/")
    whole = discover_files(spark, root, WEEKLY_GLOB, recursive=False).withColumn("upload", F.col("path"))
    parts = discover_files(spark, f"{root}/{WEEKLY_GLOB}/part-*", "*.csv", recursive=False)
    parts = parts.withColumn("upload", F.regexp_replace("path", "/[^/]*$", ""))
    return whole.unionByName(parts).select("path", "upload")


def _paths(df: DataFrame) -> list[str]:
    # one row per chosen upload (one per state) or part of one: file names only, never data
    return [r["path"] for r in df.select("path").collect()]


#: A header longer than this is none.
HEADER_BYTES = 1 << 20
ON_ERROR = ("skip", "raise", "quarantine")
LONG, SHORT, BYTES, HEADER, UNREADABLE = "more fields than the header", "fewer fields than the header", "not UTF-8", "no header", "unreadable"
_PATH, _RECORD, _FAULT = "_feed_path", "_feed_record", "_feed_fault"


@dataclass
class Feed:
    """What a set of uploads holds: its rows, what is wrong with them, and a row a file."""

    rows: DataFrame | None       # all columns as text
    quarantine: DataFrame        # path, reason, record
    report: DataFrame            # path, status (read, skipped), rows, short_rows, bad_rows


def _plain(path: str) -> str:
    """One spelling of a file's URI, whichever reader gave it."""
    return re.sub(":/+", ":/", unquote(path))


def _header(spark: SparkSession, path: str) -> list[str] | None:
    """Fields of a file's first line that is not blank, from the head of the file alone."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        head = bytearray()
        while len(head) < HEADER_BYTES and b"\n" not in head.lstrip(b"\xef\xbb\xbf \t\r\n"):
            more = bytes(stream.readNBytes(1 << 16))
            if not more:
                break
            head += more
    finally:
        stream.close()
    text = head.decode("utf-8", "replace").lstrip("\ufeff")
    lines = [line for line in csv.reader(io.StringIO(text)) if any(f.strip() for f in line)]
    return lines[0] if lines else None


def _by_header(spark: SparkSession, paths: list[str]) -> tuple[dict[tuple[str, ...], list[str]], dict[str, str]]:
    """Paths by header, and the faults of those without one. One chosen upload a state: their heads are read by the driver."""
    out: dict[tuple[str, ...], list[str]] = {}
    faults: dict[str, str] = {}
    for path in paths:
        try:
            fields = _header(spark, path)
        except Py4JJavaError as exc:
            log.error("%s cannot be opened: %s", path, exc.java_exception)
            faults[path] = UNREADABLE
            continue
        if fields is None:
            faults[path] = HEADER
        else:
            out.setdefault(tuple(fields), []).append(path)
    return out, faults


#: A file of more bytes is read by several tasks where no line break is quoted.
LARGE_FILE = 64 << 20
#: A line whose quoted fields all end on it; quotes within a plain field or beside a quoted one don't count as such.
_CLOSED = r'^(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)(?:,(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+))*+$'


def _one_line_records(spark: SparkSession, paths: list[str]) -> set[str]:
    """Those of ``paths`` that are large and have a record a line, so that they can be split at any line break.

    One pass over the large files as text. A file with another kind of line is read by one
    task: one with a quoted line break, with quotes that a CSV reader has to guess at, of white
    space alone, or with carriage returns elsewhere than at the end of every line.
    """
    jvm = spark._jvm

    large = {}
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        if status.getLen() > LARGE_FILE:
            large[_plain(status.getPath().toString())] = path
    if not large:
        return set()
    lines = spark.read.option("lineSep", "\n").text(list(large.values())).select(F.col("_metadata.file_path").alias(_PATH), "value")
    ended = F.col("value").endswith("\r")
    line = F.when(ended, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    other = line.contains("\r") | line.rlike(r"^[\x00-\x20]+$") | (line.contains('"') & ~line.rlike(_CLOSED))
    told = lines.groupBy(_PATH).agg(F.count(F.lit(1)).alias("n"), F.count_if(ended).alias("ended"), F.count_if(other).alias("other"))
    return {large[_plain(r[_PATH])] for r in told.collect() if not r["other"] and r["ended"] in (0, r["n"])}       # a row a file


def _marked(spark: SparkSession, header: tuple[str, ...], paths: list[str], on_error: str, multi_line: bool) -> DataFrame:
    """Rows of files of one header, with their path, and the fault and raw text of those that do not fit it."""
    text = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
    options = {"quote": '"', "escape": '"'}
    rows = (spark.read.schema(T.StructType([*text.fields, T.StructField(_RECORD, T.StringType(), True)]))
            .options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_RECORD, columnPruning=False, multiLine=multi_line,
                     ignoreCorruptFiles=on_error != "raise", **options)
            .csv(paths).select("*", F.col("_metadata.file_path").alias(_PATH)))
    more = ", ".join(f"c{i} string" for i in range(len(header) + 1))
    longer = F.from_csv(_RECORD, more, {**options, "multiLine": "true"})[f"c{len(header)}"].isNotNull()
    garbled = F.concat_ws("", *[F.col(f"`{c}`") for c in dict.fromkeys(header)]).contains("\ufffd")
    fault = F.when(F.col(_RECORD).isNotNull() & longer, LONG).when(garbled, BYTES).when(F.col(_RECORD).isNotNull(), SHORT)
    return rows.withColumn(_FAULT, fault)


def read_feed(spark: SparkSession, paths: list[str], on_error: str = "skip", multi_line: bool = True, one_upload: bool = False) -> Feed:
    """Read CSV files as all-text columns, union by name across differing headers (D4), faults told.

    ``on_error``: ``skip`` leaves out files with a faulty row or without a header, ``raise``
    ends the load at them, ``quarantine`` keeps such a file's other rows. Rows of few
    fields are kept in any case. The files are parsed once, into a staging table in the
    shared folder that the frames of the result read.

    Quotes inside quoted text are doubled, and quoted text may hold line breaks; no one can
    tell from a file's middle whether a line break is quoted. A large file is therefore
    looked through first, and is split among tasks where none is; one with quoted line breaks
    is read by one task. ``multi_line=False`` is for feeds that are known to have none.

    ``one_upload``: the files are parts of one upload, which ``skip`` leaves out as a whole.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {', '.join(ON_ERROR)}, got {on_error!r}")
    headers, lost = _by_header(spark, paths)
    if lost and on_error == "raise":
        raise ValueError("; ".join(f"{p}: {why}" for p, why in lost.items()))
    told = spark.createDataFrame([(p, why, None) for p, why in lost.items()], "path string, reason string, record string")
    report = [(p, "skipped", 0, 0, 0) for p in lost]
    rows = None
    if headers:
        columns = list(dict.fromkeys(c for h in headers for c in h))
        staged = scratch_path(spark, "feed")
        split = _one_line_records(spark, [p for group in headers.values() for p in group]) if multi_line else set()
        read = [(h, [p for p in group if (p in split) == apart], multi_line and not apart) for h, group in headers.items() for apart in (False, True)]
        union_files([_marked(spark, h, p, on_error, whole) for h, p, whole in read if p]).write.parquet(staged)
        every = spark.read.parquet(staged)
        bad = F.col(_FAULT).isin(LONG, BYTES)
        counts = every.groupBy(_PATH).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(_FAULT) == SHORT).alias("short"),
                                          F.count_if(bad).alias("bad")).collect()       # a row a file
        found = {_plain(r[_PATH]): r for r in counts}
        faulty = [r for r in counts if r["bad"]]
        if faulty and on_error == "raise":
            raise ValueError("; ".join(f"{r[_PATH]}: {r['bad']} rows that do not fit its header" for r in faulty))
        for r in faulty:
            log.error("%s: %d rows do not fit its header; %s", r[_PATH], r["bad"],
                      "they are put aside" if on_error == "quarantine" else "the file is skipped")
        told = told.unionByName(every.where(F.col(_FAULT).isNotNull()).select(
            F.col(_PATH).alias("path"), F.col(_FAULT).alias("reason"), F.coalesce(_RECORD, F.concat_ws(",", *[F.col(f"`{c}`") for c in columns])).alias("record")))
        good = every.where(F.coalesce(~bad, F.lit(True)))
        left_out = one_upload and on_error == "skip" and bool(faulty or lost)
        if left_out:
            good = good.where(F.lit(False))
        elif on_error != "quarantine" and faulty:
            good = good.where(~F.col(_PATH).isin([r[_PATH] for r in faulty]))
        for path in (p for group in headers.values() for p in group):
            r = found.get(_plain(path))
            skipped = left_out or bool(r and r["bad"] and on_error != "quarantine")
            report.append((path, "skipped" if skipped else "read", r["n"] if r else 0, r["short"] if r else 0, r["bad"] if r else 0))
        rows = good.select(*[F.col(f"`{c}`") for c in columns])
    return Feed(rows, told, spark.createDataFrame(report, "path string, status string, rows long, short_rows long, bad_rows long"))


def read_csv_text(spark: SparkSession, paths: list[str], on_error: str = "skip", multi_line: bool = True) -> DataFrame | None:
    """Rows of ``read_feed``; None if no file has a header."""
    return read_feed(spark, paths, on_error, multi_line).rows


def state_feed_paths(spark: SparkSession, root: str) -> list[str]:
    """The newest upload of every state directory under ``<root>/data/states``."""
    files = discover_files(spark, f"{root.rstrip('/')}/data/states", "*.csv", True)
    return sorted(_paths(latest_file_per_group(files)))


def read_state_feed(spark: SparkSession, root: str, on_error: str = "skip", multi_line: bool = True) -> DataFrame | None:
    """Newest file of every state directory under ``<root>/data/states``, unioned by name.

    Returns None when there is no directory or no file (the feed is then absent).
    """
    chosen = state_feed_paths(spark, root)
    if not chosen:
        log.warning("no state feed files under %s", root)
        return None
    return read_csv_text(spark, chosen, on_error, multi_line)


def read_weekly_feed(spark: SparkSession, root: str, on_error: str = "skip", multi_line: bool = True) -> DataFrame | None:
    """The newest ``NNDSS_Weekly_Data_*.csv`` directly under ``root``, file or folder of parts (all columns as text)."""
    files = weekly_uploads(spark, root)
    chosen = _paths(files.join(files.agg(F.max("upload").alias("upload")), "upload"))
    if not chosen:
        log.warning("no weekly feed file under %s", root)
        return None
    return read_feed(spark, sorted(chosen), on_error, multi_line, one_upload=True).rows


def write_state_feed(raw: DataFrame, root: str, stamp: str = "20240101-000000", who: str = "caseflow", state_col: str = "state") -> str:
    """Write uploads of a per-state feed: ``<root>/data/states/<STATE>/<stamp>_<STATE>_<who>.csv``.

    The layout is one file per state upload, so each state's rows are routed to one
    writer, and its file is then moved into the state's directory: a reader sees an upload
    whole or not at all. Rows without a state belong to no upload. The rows carry the state
    as ``reporting_jurisdiction`` (the reader mirrors it back to ``state``). Returns ``root``.
    """
    spark = raw.sparkSession
    draft = scratch_path(spark, "upload")
    out = raw.where(F.col(state_col).isNotNull()).withColumnRenamed(state_col, "reporting_jurisdiction").withColumn("st", F.col("reporting_jurisdiction"))
    out.repartition("st").write.option("header", True).partitionBy("st").csv(draft)
    for path in _paths(discover_files(spark, draft, "*.csv").select("path")):
        state = unquote(path.split("/st=")[-1].split("/")[0])
        _move(spark, path, f"{root.rstrip('/')}/data/states/{state}/{stamp}_{state}_{who}.csv")
    return root


def write_weekly_feed(raw: DataFrame, root: str, date: str) -> str:
    """Write an upload of the weekly feed, the folder ``<root>/NNDSS_Weekly_Data_<date>.csv`` of part files.

    A national feed has no parts like the states of the other one, and one writer would have
    to take all of it: every task writes its rows. The folder is moved into place when it is
    whole; one of the same date is replaced.
    """
    spark = raw.sparkSession
    draft, target = scratch_path(spark, "upload"), f"{root.rstrip('/')}/NNDSS_Weekly_Data_{date}.csv"
    raw.write.option("header", True).csv(draft)
    drop_scratch(spark, [target])
    _move(spark, draft, target)
    return root


def _move(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{source} could not be moved to {target}")
