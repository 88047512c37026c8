import random
import zlib

import numpy as np
import pytest
from conftest import ODD_ROWS

from caseflow.llm import tables, toxicity
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("bel", "dor", "fin", "gul", "het", "jas", "kom", "lun")]


def prose(rng, extra=()):
    words = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))] + list(extra)
    rng.shuffle(words)
    return " ".join(words)


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    told = toxicity.op13(spark, sf).where("held_out").join(tables.read(spark, sf, "labels"), "doc_id").collect()
    p = np.array([r.score for r in told])
    y = np.array([r.toxic for r in told])
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in told)
    assert ((p >= 0.5) & (y == 1)).sum() >= 0.85 * (y == 1).sum() and ((p >= 0.5) & (y == 0)).sum() <= 0.01 * (y == 0).sum()
    above = (p[y == 1][:, None] > p[y == 0]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0]).mean()
    assert above >= 0.97


def test_interactions_that_no_sum_of_weights_tells(spark):
    rng = random.Random(2)
    rows = []
    for i in range(2400):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, prose(rng, ["vermin"] * insult + ["groupies"] * group), int(insult and group)))
    machine = toxicity.fit(*labelled(spark, rows))
    for insult, group in ((0, 0), (0, 1), (1, 0), (1, 1)):
        p = [machine.score(prose(rng, ["vermin"] * insult + ["groupies"] * group)) for _ in range(200)]
        assert np.mean([(x >= 0.5) == bool(insult and group) for x in p]) >= 0.99
    # the two alone: each adds less to the margin than both together
    at = [machine.margin(machine.terms(t)) - machine.bias for t in ("vermin", "groupies", "vermin groupies")]
    assert at[2] > at[0] + at[1] + 1


def test_partners_are_found_within_company(spark):
    """A term without association of its own that turns an insult into banter."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        insult, friend = rng.random() < 0.3, rng.random() < 0.5
        toxic = int(insult and not friend) or int(friend and not insult and rng.random() < 0.43)     # friend alone tells nothing
        rows.append((i, prose(rng, ["vermin"] * insult + ["friendship"] * friend), toxic))
    docs, labels = labelled(spark, rows)
    kept = toxicity.fit(docs, labels).place
    assert set(toxicity.buckets("vermin")) | set(toxicity.buckets("friendship")) <= set(kept)


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(0.3, {}, rng.normal(size=9), rng.normal(size=(9, toxicity.FACTORS)))
    terms = [0, 2, 3, 7]
    pairs = sum(m.factors[i] @ m.factors[j] for i in terms for j in terms if i < j)
    assert m.margin(terms) == pytest.approx(0.3 + m.weights[terms].sum() + pairs) and m.margin([]) == pytest.approx(0.3)


def test_screening_counts_as_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, ["scumbag"] * (rng.random() < (0.5 if i % 3 == 0 else 0.1))), int(i % 3 == 0)) for i in range(400)]
    docs, labels = labelled(spark, rows)
    terms = {i: {b for w in set(t.split()) for b in toxicity.buckets(w)} for i, t, _ in rows}
    want = set()
    for b in set().union(*terms.values()):
        table = np.array([[sum((b in terms[i]) == x and y == z for i, _, y in rows) for z in (1, 0)] for x in (True, False)], float)
        expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / 400
        if table[0].sum() >= toxicity.LEAST_ROWS and expected.min() > 0 and ((table - expected) ** 2 / expected).sum() > 5:
            want.add(b)
    found = toxicity.associated(toxicity.hashed(toxicity.sample(docs, labels)), least=5)
    assert set(found) == want and set(toxicity.buckets("scumbag")) <= want


def test_odd_rows_and_nothing_to_learn_from(spark, make, tmp_path):
    docs = make(ODD_ROWS).withColumn("score", F.lit("clash")).withColumn("predicted", F.lit("clash")).withColumn("label", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(4, 1, None), (5, 1, None), (5, 1, 1), (None, 0, 1), (7, 1, 0), (8, 1, 0), (9, 0, 0), (10, 0, 0), (999, 1, 1)]
    for name, kept in (("none", []), ("one", [r for r in rows if r[2] == 0]), ("all", rows)):
        spark.createDataFrame(kept, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        out = toxicity.op13(spark, str(tmp_path)).collect()
        assert len(out) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in out)
        held = {r.doc_id: r.held_out for r in out}
        assert all(held[i] == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 0) for i in held)
        if name == "none":
            assert {round(r.score, 9) for r in out} == {round(1 / 3, 9)} and {r.predicted for r in out} == {0}
        same = {}
        for r, text in ((r, t) for r in out for i, t in ODD_ROWS if i == r.doc_id):
            assert same.setdefault(text, r.score) == r.score


def test_empty_table(spark, make, stored):
    folder = stored([], 1)
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert toxicity.op13(spark, folder).collect() == []


def test_reruns_agree(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, ["scumbag"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(600)]
    docs, labels = labelled(spark, rows)
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(7, "text"), labels)
    assert a.place == b.place and a.bias == b.bias and (a.weights == b.weights).all() and (a.factors == b.factors).all()
