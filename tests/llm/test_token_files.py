import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import ODD_ROWS, SF
from tokenizers import Tokenizer

from caseflow.llm import packing, token_files
from caseflow.session import scratch_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids_of(path, text, end):
    library = Tokenizer.from_file(path)
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def write(docs, partitions=3):
    folder = scratch_path(docs.sparkSession, "test-shards")
    return folder, token_files.write(docs, folder, BYTE, 2, partitions=partitions)


def test_round_trip_of_the_table(spark):
    from caseflow.llm import tables
    docs = tables.read(spark, SF, "documents")
    at = 0
    want = []
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        ids = ids_of(BYTE, r["text"], 2)
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files.op2(spark, SF).collect()) == want


def test_odd_rows(spark, make):
    folder, manifest = write(make(ODD_ROWS))
    rows = token_files.read(folder, manifest).orderBy("start").collect()
    assert sorted((r["doc_id"] or 0, bytes(r["ids"])) for r in rows) == sorted((i or 0, ids_of(BYTE, t, 2).tobytes()) for i, t in ODD_ROWS)
    assert [r["doc_id"] for r in rows] == sorted([i for i, _ in ODD_ROWS], key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]


def test_short_access_and_foreign_dictionary(spark, make):
    folder, manifest = write(make([(i, f"document number {i} " * 40) for i in range(400)]), 2)
    fs, root = token_files.open_folder(folder)
    [name] = [f for f in fs.get_file_info(token_files.pafs.FileSelector(root)) if f.base_name.startswith("dictionary-")]
    dictionary = fs.open_input_file(name.path).read()
    assert dictionary
    row = manifest.orderBy("part").first()
    shard = token_files.ShardReader(fs, f"{root}/{row['shard']}", dictionary)
    k = len(shard) // 2
    assert shard.ids(k).tolist() == ids_of(BYTE, f"document number {shard.doc_ids[k]} " * 40, 2).tolist()
    with pytest.raises(ValueError):
        token_files.ShardReader(fs, f"{root}/{row['shard']}", b"another")


def test_ids_that_do_not_fit_are_refused(tmp_path):
    fs, root = token_files.open_folder(str(tmp_path))
    shard = token_files.ShardWriter(fs, f"{root}/s", b"", 2)
    shard.add(1, np.array([65_535, 0], "<u4"))
    with pytest.raises(ValueError):
        shard.add(2, np.array([65_536], "<u4"))


def test_clashing_columns_and_special_tokens_in_texts(spark, make):
    from pyspark.sql import functions as F
    rows = [(1, "a <|endoftext|> b"), (2, None), (3, "plain")]
    docs = make(rows).withColumns({c: F.lit("clash") for c in ("ids", "start", "n_tokens", "shard", "piece", "length", "members", "task")})
    folder, manifest = write(docs)
    got = {r.doc_id: bytes(r.ids) for r in token_files.read(folder, manifest).collect()}
    assert got == {i: ids_of(BYTE, t, 2).tobytes() for i, t in rows} and len(got[1]) == 4 * 5
    check_packing(packing.pack_documents(docs).collect(), pieces_of(rows))


def test_empty_table(spark, make):
    folder, manifest = write(make([]))
    assert token_files.read(folder, manifest).count() == 0


def check_packing(rows, want):
    got = sorted((tuple(r)[:5] for r in rows), key=str)
    assert got == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(bins)


def pieces_of(rows):
    out = []
    for i, text in rows:
        ids = ids_of(WORD, text, 0)
        out += [(i, k, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    return out


def test_packing_the_table(spark):
    from caseflow.llm import tables
    want = pieces_of([(r["doc_id"], r["text"]) for r in tables.read(spark, SF, "documents").collect()])
    used = check_packing(packing.op6(spark, SF).collect(), want)
    assert used <= -(-sum(w[3] for w in want) // 2048) + 1


def test_packing_odd_rows_and_rounds(spark, make):
    rows = [*ODD_ROWS, *[(100 + i, "some words to pack " * (i % 90 + 1)) for i in range(600)]]
    want = pieces_of(rows)
    docs = make(rows).repartition(12)
    items = packing.pieces(docs, WORD, 0)
    rounds = check_packing(packing.pack(items, fan_in=3).collect(), want)
    local = check_packing(packing.pack(items, fan_in=100, hand_on=0).collect(), want)
    bound = -(-sum(w[3] for w in want) // 2048)
    assert rounds <= local and rounds <= bound + 2
    assert packing.pack_documents(make([])).count() == 0


def test_handing_on_more_gains_nothing(spark):
    """Sequences that are mostly more than half full, a small one in many tasks, hosts of all rooms."""
    import random
    for seed in range(3):
        rng = random.Random(seed)
        sizes = [rng.choice([rng.randint(1030, 2030), rng.randint(1030, 1400), rng.randint(5, 900)]) if k % 7 else rng.randint(1100, 1900)
                 for k in range(900)]
        items = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing.PIECE).repartition(27)
        counts = [packing.pack(items, fan_in=3, hand_on=n).select("sequence_id").distinct().count() for n in (None, 10_000)]
        assert counts[0] <= counts[1]


def test_items_that_fit_nowhere(spark):
    items = spark.range(50).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1500L AS length", "0L AS ids_crc32").repartition(9)
    assert packing.pack(items, fan_in=2).select("sequence_id").distinct().count() == 50
