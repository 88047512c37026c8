import re
import zlib

import corpus_pipeline as C
import numpy as np
import public_tokenizers
from conftest import ODD_ROWS, SF
from test_jaccard_join import brute as components
from test_token_files import check_packing, pieces_of

from caseflow.llm import tables


def staged(spark, docs, sf_dir):
    out = []
    for name, stage in C.STAGES:
        before = docs
        docs = tables.written(stage(spark, docs, sf_dir), f"test-{name}")
        out.append((name, before, docs))
    return {name: (b, a) for name, b, a in out}


def check(spark, docs, sf_dir):
    stages = staged(spark, docs, sf_dir)
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]       # noqa: E731
    for name, (before, after) in stages.items():
        assert after.columns == before.columns or name == "packing"
    before, after = map(rows, stages["language_id"])
    assert set(after) <= set(before) and all(t and any(map(str.isalpha, t)) for _, t in after)
    before, after = map(rows, stages["exact_dedup"])
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")       # noqa: E731
    best = {}
    for i, t in before:
        key = (-len(t or ""), i is None, i or 0)
        if norm(t) not in best or key < best[norm(t)][0]:
            best[norm(t)] = (key, (i, t))
    assert sorted(map(str, after)) == sorted(str(v) for _, v in best.values())
    before, after = map(rows, stages["near_dedup"])
    places = components([(k, t) for k, (_, t) in enumerate(before)])
    assert len(after) == len({c for _, _, c in places})
    group = {k: c for k, _, c in places}
    lowest = {}
    for k, (i, t) in enumerate(before):
        key = (i is None, i or 0)
        lowest[group[k]] = min(lowest.get(group[k], key), key)
    assert sorted((i is None, i or 0) for i, _ in after) == sorted(lowest.values())
    before, after = map(rows, stages["mixing"])
    words = lambda docs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in docs)       # noqa: E731
    assert set(after) <= set(before) and max(map(after.count, set(after))) <= 2
    longest = max(words([d]) for d in before)
    assert abs(words(after) - 1.5 * words(before)) <= longest * 30
    check_packing(stages["packing"][1].collect(), pieces_of(after))


def test_stages_on_the_table(spark):
    check(spark, tables.read(spark, SF, "documents"), SF)


def test_odd_rows(spark, make):
    train = [(100 + i, f"plain english words and a number like {'abcdefghij'[i % 10] * 3}", "en", "x") for i in range(40)]
    docs = make([*[(i, t, "en", "s") for i, t in ODD_ROWS], *train])
    check(spark, docs, SF)


def test_empty_table(spark, make):
    docs = tables.written(make([]), "test-empty")
    for name, stage in C.STAGES:
        docs = tables.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.count() == 0


def test_run(spark):
    out = C.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
