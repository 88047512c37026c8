"""Session helpers: one place for the configs every caseflow job expects."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Configs the operators rely on. Time zone pins timestamp formatting (period
# truncation itself is zone-free); AQE coalesces small shuffle partitions and
# splits skewed ones at run time. Shuffle partition count is deliberately not
# pinned here: a cluster sets it for its data volume (sized so one partition
# fits an executor's memory, e.g. ~128-256 MB of shuffle data each) and AQE
# coalesces the small aggregates these queries produce; local runs pass it.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never JIT-compiles a method over 8000 bytecode bytes; a fused
    # stage past that runs interpreted (10x slower on the conform projections).
    # At this limit Spark falls back to per-operator codegen for such stages.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


_SHIPPED: set[str] = set()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "caseflow", extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with caseflow's defaults.

    ``master`` and ``shuffle_partitions`` are only set when given, so a
    cluster submit keeps its own values.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master (one machine, as in tests) may go without the setting
    and gets a fresh temporary folder. On a cluster a missing setting is an
    error: a machine-local folder would be invisible to the other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver "
                               f"and all executors share (master {sc.master})")
        named = tempfile.mkdtemp(prefix="caseflow-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


#: Scratch folders named since the process began, in order.
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint directory for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    _SCRATCH.append(f"{base}/caseflow-scratch/{name}-{uuid.uuid4().hex[:12]}")
    return _SCRATCH[-1]


#: Rows and bytes of an Arrow batch for Python functions over whole texts, and Spark's defaults.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("1000", "10000"),
                "spark.sql.execution.arrow.maxBytesPerBatch": ("8388608", "67108864b")}


def text_batches(spark: SparkSession) -> None:
    """Hand texts to Python in small batches, where the session still has the defaults.

    Those are made for short rows: ten thousand documents at a time, held in the JVM's direct
    memory on their way to and from the worker, and in the worker.
    """
    for key, (value, default) in TEXT_BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)


def scratch_made(since: int = 0) -> list[str]:
    """Scratch folders named after the first ``since`` ones."""
    return _SCRATCH[since:]


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once a session.

    Functions that run there import its modules; a cluster whose machines have the
    package installed does without it.
    """
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="caseflow-ship-")      # the driver serves the archive from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(f"{folder}/caseflow", "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(spark.sparkContext.applicationId)


def drop_scratch(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Delete the tables at ``paths``, or every table this session wrote with ``scratch_path``.

    Call it once the results that read those tables have been used.
    """
    jvm = spark.sparkContext._jvm
    everything = [f"{ensure_checkpoint_dir(spark).rstrip('/')}/caseflow-scratch"]
    for path in everything if paths is None else paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# SQL confs the heavy load job wants even in a session someone else configured.
LOAD_CONF = {"spark.sql.codegen.hugeMethodLimit": "8000"}


@contextmanager
def session_conf(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """Set runtime SQL confs for the duration of a block, then restore the caller's values."""
    saved = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
