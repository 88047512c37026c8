"""Tables of whole versions: a folder a version, and a log that names the current one.

A writer fills a folder of its own and then publishes it by renaming one small file
into the log. Until then readers see the version before; a write that fails leaves a
folder that nothing names. Two writers cannot publish the same number: the slower one
fails, and what it wrote is not read.

The log is metadata only: a record tells folders and counts, never data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

LOG = "_log"


class Conflict(RuntimeError):
    """Another writer has published this version number."""


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """(file system, path) as Hadoop knows them, whatever store the path is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def fresh(root: str) -> str:
    """Name of a new folder for the version to be written."""
    return f"v-{uuid.uuid4().hex}"


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Published version numbers, ascending; none where nothing was published."""
    fs, log = _path(spark, f"{root.rstrip('/')}/{LOG}")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())


def record(spark: SparkSession, root: str, number: int) -> dict:
    fs, file = _path(spark, f"{root.rstrip('/')}/{LOG}/{number:020d}.json")
    stream = fs.open(file)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> dict | None:
    """Record of the current version, with its ``number``; None where nothing was published."""
    published = numbers(spark, root)
    return {**record(spark, root, published[-1]), "number": published[-1]} if published else None


def publish(spark: SparkSession, root: str, entry: dict, after: int | None) -> dict:
    """Make ``entry`` the version that follows number ``after`` (None: the first)."""
    number = 0 if after is None else after + 1
    fs, target = _path(spark, f"{root.rstrip('/')}/{LOG}/{number:020d}.json")
    _, draft = _path(spark, f"{root.rstrip('/')}/{LOG}/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise Conflict(f"version {number} of {root} was published by another writer")
    return {**entry, "number": number}


def sweep(spark: SparkSession, root: str, folders: Iterable[str], keep: int) -> None:
    """Forget all but the last ``keep`` versions, and delete folders that neither they nor ``folders`` name.

    Call it only where no other writer is at work: its unpublished folder would go too.
    """
    published = numbers(spark, root)
    kept, gone = published[-keep:], published[:-keep]
    named = set(folders).union(*[record(spark, root, n)["folders"] for n in kept])
    for n in gone:
        fs, file = _path(spark, f"{root.rstrip('/')}/{LOG}/{n:020d}.json")
        fs.delete(file, False)
    fs, top = _path(spark, root)
    for status in fs.listStatus(top):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in named:
            fs.delete(status.getPath(), True)
