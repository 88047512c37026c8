import hashlib
import re

import pytest
from conftest import ODD_ROWS
from pyspark.sql import functions as F

from caseflow.llm import exact_dedup


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        keep = rows[min(members)[3]][0]
        out += [(rows[m[3]][0], keep, len(members), rows[m[3]][0] == keep, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def result(spark, folder, **settings):
    source = f"{folder}/documents.parquet"
    state = exact_dedup.keep_state(spark, source, **settings)
    digest = {k: v for k, v in settings.items() if k == "digest"}
    return sorted((tuple(r) for r in exact_dedup.classify(spark.read.parquet(source), state, **digest).drop("row").collect()), key=str)


def test_odd_rows(spark, stored):
    assert result(spark, stored(ODD_ROWS)) == brute(ODD_ROWS)


@pytest.mark.parametrize("bits", [0, 1])
def test_equal_digests_of_different_texts_are_told_apart(spark, stored, bits):
    weak = lambda norm: F.substring(F.sha2(norm, 256), 1, bits)     # noqa: E731
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(40)]
    assert result(spark, stored(rows), digest=weak) == brute(rows)


def test_state_goes_on_where_it_stopped(spark, tmp_path, make):
    from caseflow.session import scratch_path
    source, state = str(tmp_path / "documents.parquet"), scratch_path(spark, "test-state")
    first, second = [(i, f"t {i % 5}") for i in range(5, 25)], [(i, f"t  {i % 9}") for i in range(9)]
    make(first).repartition(4).write.parquet(source)
    exact_dedup.keep_state(spark, source, bytes_per_batch=1, checkpoint=state)      # a file a batch
    make(second).write.mode("append").parquet(source)
    kept = exact_dedup.keep_state(spark, source, checkpoint=state)
    got = exact_dedup.classify(spark.read.parquet(source), kept).drop("row").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(first + second)
    assert kept.where("locator LIKE 'file:%'").count() == kept.count() == 9


def test_rows_of_one_id_are_told_apart_by_a_row_column(spark, tmp_path, make):
    source = str(tmp_path / "documents.parquet")
    make([(1, "a b"), (1, "ab"), (1, "a b"), (None, ""), (None, None)]).coalesce(1).withColumn(
        "row", F.monotonically_increasing_id()).write.parquet(source)
    got = exact_dedup.classify(spark.read.parquet(source), exact_dedup.keep_state(spark, source, row="row"), row="row")
    assert got.where("kept").count() == 2


def test_empty_table(spark, stored):
    assert result(spark, stored([])) == []


def test_new_texts_are_compared_with_bytes_read_before(spark, tmp_path, make):
    """A weak digest and a run that goes on: the text that stays lies in a file the second run does not read."""
    from caseflow.session import scratch_path
    weak = lambda norm: F.substring(F.sha2(norm, 256), 1, 0)     # noqa: E731
    folder, state = tmp_path / "documents.parquet", scratch_path(spark, "test-state")
    make([(1, "long old text"), (2, "long  old text")]).coalesce(1).write.parquet(str(folder))
    exact_dedup.keep_state(spark, str(folder), checkpoint=state, digest=weak)
    old = spark.read.parquet(str(folder)).inputFiles()
    make([(3, "new"), (4, "ne w")]).coalesce(1).write.mode("append").parquet(str(folder))
    kept = exact_dedup.keep_state(spark, str(folder), checkpoint=state, digest=weak)
    new = spark.read.parquet(*[f for f in spark.read.parquet(str(folder)).inputFiles() if f not in old])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.classify(new, kept, digest=weak).collect()}
    assert got == {3: (4, 2, False), 4: (4, 2, True)}


def test_rows_of_files_are_told_apart_without_a_column(spark, tmp_path, make):
    from caseflow.llm import tables
    source = str(tmp_path / "documents.parquet")
    make([(1, "a b"), (1, "ab"), (1, "a b"), (None, ""), (None, None), (1, "a b")]).repartition(3).write.parquet(source)
    docs = spark.read.parquet(source)
    files = tables.file_numbers(docs)
    rows = tables.number_rows(docs, files, "row")
    assert rows.select("row").distinct().count() == 6 and tables.file_numbers(make([])) is None
    got = exact_dedup.classify(rows, exact_dedup.keep_state(spark, source, row="row", files=files), row="row")
    assert got.where("kept").count() == 2 and got.count() == 6


def test_filters_of_keys_lose_and_add_nothing(spark):
    from caseflow.llm import tables
    rows = spark.range(20000).withColumn("v", F.col("id") * 3)
    for keys in (rows.where("id % 7 = 0"), rows.where("id < 0"), rows, rows.where("id = 5").unionByName(rows.where("id = 5"))):
        ids = {r.id for r in keys.collect()}
        assert {r.id for r in tables.only(rows, keys, "id").collect()} == ids and tables.only(rows, keys, "id").count() == len(ids)
        assert {r.id for r in tables.without(rows, keys, "id").collect()} == set(range(20000)) - ids
