"""Toxicity by a factorization machine over hashed terms (operator 13).

The terms of a text are its distinct lower-case words and their beginnings of 3 to 9
letters, each hashed to one of 2^20 buckets. The machine scores

    bias + sum of w[i] + sum over pairs i < j of <v[i], v[j]>

over the terms present, so that two terms can tell together what neither tells alone
(an insult with a mention of a group), which additive weights miss. The pairs are summed
in linear time: half of |sum of v|^2 less the sum of |v|^2.

Terms are screened first: kept are those associated with the label over all sampled rows
(chi-squared), and those associated with it within the rows that hold such a term, which
are the partners of interactions. Both tables are counted by Spark over all sampled rows.
The machine is then trained by mini-batches with adaptive steps on the kept terms only, a
few numbers a row, in one task: the sample has a bound, ``SAMPLE_DOCS`` rows picked by a
hash of their id.

The model holds at most 2^20 buckets of 1 + FACTORS floats and usually a few thousand;
that is the bound of what is broadcast.

Defined results: null and empty texts, and texts without kept terms, get the score of the
bias alone; without rows to learn from every score is 1/3, and with one class only the
smoothed log odds of that class; of several labels of a doc_id the highest counts, null
labels none; documents that repeat a doc_id are all learnt from; whole texts count,
however long; scores depend on a text alone, so repeated rows are scored alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from caseflow.llm import tables as T

#: Bound of the labelled rows that the machine is fitted on.
SAMPLE_DOCS = 20_000
BUCKETS = 1 << 20
SHORTEST, LONGEST = 3, 9
LEAST_ROWS = 3
#: A term is kept above this chi-squared (one degree of freedom).
ASSOCIATED = 20.0
FACTORS = 8
ROUNDS, BATCH = 12, 128
STEP, FACTOR_STEP, DECAY = 0.1, 0.03, 1e-3
REMEMBERED = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32(doc_id as text) mod 5 is 0 are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def buckets(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    terms = [f"={word}", *(word[:n] for n in range(SHORTEST, min(len(word), LONGEST + 1)))]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms]


@dataclass
class Machine:
    """A fitted machine; ``place`` numbers the kept buckets."""

    bias: float
    place: dict[int, int]
    weights: np.ndarray          # a number a kept term
    factors: np.ndarray          # FACTORS numbers a kept term
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def terms(self, text: str | None) -> list[int]:
        """The kept terms of a text, in order."""
        known, place, found = self.known, self.place, set()
        if len(known) > REMEMBERED:
            known.clear()
        for word in set(_WORD.findall((text or "").lower())):
            at = known.get(word)
            if at is None:
                at = known[word] = tuple(place[b] for b in buckets(word) if b in place)
            if at:
                found.update(at)
        return sorted(found)

    def margin(self, terms: list[int]) -> float:
        v = self.factors[terms]
        together = v.sum(axis=0)
        return float(self.bias + self.weights[terms].sum() + 0.5 * (together @ together - (v * v).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(self.terms(text)), -500, 500))))

    def forget(self) -> None:
        self.known = {}


def train(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors fitted to ``rows`` of term numbers by logistic loss."""
    rng = np.random.default_rng(seed)
    n, positive = len(rows), labels.sum()
    bias = float(np.log((positive + 0.5) / (n - positive + 1)))
    w, v = np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, FACTORS))
    if positive == 0 or positive == n or n_terms == 0:
        return bias, w, v * 0
    seen_bias, seen_w, seen_v = 1e-6, np.full(n_terms, 1e-6), np.full((n_terms, FACTORS), 1e-6)
    sizes = np.array([len(r) for r in rows])
    for _ in range(ROUNDS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            some = order[at:at + BATCH]
            terms = np.concatenate([rows[k] for k in some])
            row = np.repeat(np.arange(len(some)), sizes[some])
            vt = v[terms]
            together = _sums(row, vt, len(some))
            margin = bias + np.bincount(row, w[terms], len(some)) + 0.5 * ((together ** 2).sum(axis=1) - np.bincount(row, (vt ** 2).sum(axis=1), len(some)))
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]
            used, number = np.unique(terms, return_inverse=True)
            slope = np.bincount(number, error[row], len(used)) + DECAY * w[used] * np.bincount(number, minlength=len(used))
            seen_w[used] += slope ** 2
            w[used] -= STEP * slope / np.sqrt(seen_w[used])
            slope = _sums(number, error[row][:, None] * (together[row] - vt), len(used)) + DECAY * v[used]
            seen_v[used] += slope ** 2
            v[used] -= FACTOR_STEP * slope / np.sqrt(seen_v[used])
            seen_bias += error.sum() ** 2
            bias -= STEP * error.sum() / np.sqrt(seen_bias)
    return float(bias), w, v


def _sums(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(group, column, n) for column in values.T], axis=1)


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> DataFrame:
    """text, label of about ``size`` labelled rows of ``docs`` (doc_id, text), picked by a hash of the id."""
    labelled = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("label"))
    slots = 1 << 40
    share = min(slots, slots * size // max(1, labelled.count()) + 1)
    picked = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < share).limit(2 * size)
    # bounded by ``size``: 12 bytes a row
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "label")


def hashed(rows: DataFrame) -> DataFrame:
    """terms array<int>, label of each row of ``rows`` (text, label), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            for at in range(0, len(batch), 256):
                some, terms = batch.slice(at, 256), []
                for text in some.column("text"):
                    words = set(_WORD.findall((text.as_py() or "").lower()))
                    for word in words - known.keys():
                        known[word] = buckets(word)
                    terms.append(sorted(set().union(*[known[w] for w in words])))
                    if len(known) > REMEMBERED:
                        known.clear()
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.int32())), some.column("label").cast(pa.int32())], ["terms", "label"])

    return T.written(rows.mapInArrow(run, "terms array<int>, label int"), "toxicity-terms")


def holding(rows: DataFrame, kept: list[int], only: bool) -> DataFrame:
    """Rows that hold one of the buckets ``kept``, or, with ``only``, all rows reduced to those buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_kept = np.zeros(BUCKETS, bool)
        is_kept[kept] = True
        for batch in batches:
            terms = batch.column("terms")
            sizes = np.diff(terms.offsets.to_numpy())
            flat = terms.flatten().to_numpy()
            hit, row = is_kept[flat], np.repeat(np.arange(len(sizes)), sizes)
            counts = np.bincount(row[hit], minlength=len(sizes))
            if only:
                reduced = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat[hit], pa.int32()))
                yield pa.RecordBatch.from_arrays([reduced, batch.column("label")], ["terms", "label"])
            else:
                yield batch.filter(pa.array(counts > 0))

    return rows.mapInArrow(run, "terms array<int>, label int")


def associated(rows: DataFrame, least: float = ASSOCIATED) -> list[int]:
    """Buckets whose chi-squared with the label over ``rows`` (terms, label) passes ``least``; at most BUCKETS."""
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if positive == 0 or positive == n:
        return []
    counts = rows.select(F.explode("terms").alias("term"), "label").groupBy("term").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").cast("double").alias("k")).where(F.col("n") >= LEAST_ROWS)
    here, toxic = F.col("n"), F.col("k")
    excess = toxic * n - here * positive
    chi = excess * excess * n / (here * (F.lit(float(n)) - here) * float(positive) * float(n - positive))
    return [r.term for r in counts.where((here < n) & (chi > least)).select("term").collect()]


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> Machine:
    """Fit on the labelled rows of ``docs`` (doc_id, text) by ``labels`` (doc_id, toxic)."""
    rows = hashed(sample(docs, labels, size))
    alone = associated(rows)
    company = associated(T.written(holding(rows, alone, only=False), "toxicity-company")) if alone else []
    kept = sorted({*alone, *company})
    place = {b: k for k, b in enumerate(kept)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = sorted((tuple(terms), label) for batch in batches      # whatever the order of the rows, the same machine
                      for terms, label in zip(batch.column("terms").to_pylist(), batch.column("label").to_pylist()))
        if told:
            bias, w, v = train([np.array([place[b] for b in t], np.int64) for t, _ in told], np.array([y for _, y in told], float), len(place))
            yield pa.RecordBatch.from_pylist([{"bias": bias, "weights": w.tobytes(), "factors": v.tobytes()}])

    few = T.written(holding(rows, kept, only=True), "toxicity-sample")
    [told] = few.coalesce(1).mapInArrow(run, "bias double, weights binary, factors binary").collect() or [None]
    if told is None:
        return Machine(float(np.log(0.5)), {}, np.zeros(0), np.zeros((0, FACTORS)))
    return Machine(told.bias, place, np.frombuffer(told.weights), np.frombuffer(told.factors).reshape(-1, FACTORS))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Add score and predicted to ``docs`` (text and any other columns; columns of those names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.drop("score", "predicted")
    names = [*docs.columns, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = np.array([shared.value.score(t.as_py()) for t in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told), pa.array((told >= 0.5).astype(np.int32))], names)
        shared.value.forget()       # workers live on; what a task remembered must not

    added = [T_.StructField("score", T_.DoubleType()), T_.StructField("predicted", T_.IntegerType())]
    return docs.mapInArrow(run, T_.StructType([*docs.schema.fields, *added]))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of those that are not held out."""
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = T.read(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = F.col("doc_id")
    machine = fit(docs, labels.where(~held_out(out)))
    return score(docs, machine).select("doc_id", held_out(out).alias("held_out"), "score", "predicted")
