"""Quality rules with risk-controlled cutoffs (operator 4).

Each rule turns a document into a number, larger being worse. Labelled documents decide
where the rules may cut, for every stratum on its own:

1. One half of them, by a hash of the id, proposes: starting from no cutoff, the rule and
   cutoff of a fixed grid that tell most bad documents from good ones are added, again and
   again. Each step of this path rejects all that the one before rejects.
2. The other half, the holdout, certifies: along the path, an exact binomial test rejects
   "the combined rules lose more than ``risk`` of the good documents", or does not. The
   path goes on only from step to step that pass, so all of them are tested at one level
   (fixed-sequence testing), and the level is shared among the strata (Bonferroni).

With confidence 1 - ``delta`` no stratum loses more than ``risk`` of its good documents.
Where the holdout has too few of them to pass the first step, or no step tells bad
documents from good, only the base rules reject.

Defined results: null and empty texts have no words and fail the base rules; a null
stratum is a stratum of its own; labels without a document, null labels and
documents without labels take no part in the choice; without labels only the base
rules reject; of equal gains the first rule and its laxest cutoff are taken; a score equal
to a cutoff is kept; repeated rows are judged one by one, and whole texts, however long;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import tables as T
from caseflow.llm.words import U64, Words, mix, slices

RISK, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: What rejecting a good document costs, against the gain of rejecting a bad one.
GOOD_COST = 20.0
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_ends")

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(range(65, 91))] = 1                 # A-Z
_KIND[list(range(97, 123))] = 2                # a-z
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?"]] = True

#: Scores as SQL over COUNTS; the larger, the worse.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(n_letters, 1)",
    "long_words": "word_chars / greatest(n_words, 1)",
    "short_words": "-word_chars / greatest(n_words, 1)",
    "ends": "n_ends / greatest(n_words, 1)",
}
GRID = {name: tuple(round(x, 6) for x in np.linspace(0.01, 1.0, 50)) for name in ("symbols", "dup_lines", "repeats", "upper", "ends")}
GRID["long_words"] = tuple(round(x, 6) for x in np.linspace(5.0, 15.0, 41))
GRID["short_words"] = tuple(round(x, 6) for x in np.linspace(-5.0, -1.0, 41))


def _per_row(rows: int, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(at, weights, minlength=rows).astype(np.int64)


def count_slice(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text of a slice."""
    w = Words(data, offsets)
    lengths = np.diff(offsets)
    row_of = np.repeat(np.arange(w.rows), lengths)
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=inside[1:])       # bytes that begin a character
    chars = _per_row(w.rows, w.row, (inside[w.ends] - inside[w.starts]).astype(float))
    # lines: runs between line feeds, within a row
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    line_row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], offsets[line_row + 1])
    worded = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, line_row = starts[worded], ends[worded], line_row[worded]
    lines = _per_row(w.rows, line_row)
    keys = np.unique(w.range_hashes(starts, ends) ^ mix(line_row.astype(np.uint64)), return_index=True)[1]
    # five-word windows found twice or more in a row: mark all their words
    at, h = w.windows(w.hashes())
    _, back, times = np.unique(h ^ mix(w.row[at].astype(np.uint64) + U64(1)), return_inverse=True, return_counts=True)
    again = at[times[back] > 1]
    mark = np.zeros(len(w.starts) + 6, dtype=np.int64)
    np.add.at(mark, again, 1)
    np.add.at(mark, again + 5, -1)
    covered = np.cumsum(mark)[:len(w.starts)] > 0
    kind = _KIND[data]
    return [w.counts.astype(np.int64), chars, _per_row(w.rows, row_of[_SYMBOL[data]]), lines - _per_row(w.rows, line_row[keys]),
            _per_row(w.rows, w.row[covered]), lines, _per_row(w.rows, row_of[kind > 0]), _per_row(w.rows, row_of[kind == 1]),
            _per_row(w.rows, row_of[_END[data]])]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and COUNTS of ``docs`` (doc_id, text, stratum)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text")):
                counts = [pa.array(c) for c in count_slice(data, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i).cast(pa.int64()), batch.column("stratum").slice(i, j - i).cast(pa.string()),
                     *counts], ["doc_id", "stratum", *COUNTS])

    ddl = "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS)
    out = docs.select("doc_id", "text", "stratum").mapInArrow(count, ddl)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", base)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws with chance p, summed exactly from its terms' logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
            for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


#: A cutoff that rejects nothing.
NONE = 1 << 20


def rejected(steps: np.ndarray, config: np.ndarray) -> np.ndarray:
    """Which rows of ``steps`` (a column a rule: cutoffs below the score) have one beyond the cutoffs at ``config``."""
    return (steps > config).any(axis=1)


def propose(steps: np.ndarray, good: np.ndarray, bad: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Path of ever stricter cutoffs: numbers of ``good`` and ``bad`` documents per row of ``steps``, grid sizes by rule."""
    config, path = np.full(len(sizes), NONE), []
    n, m = max(1, good.sum()), max(1, bad.sum())
    while True:
        left = ~rejected(steps, config)
        best, chosen = 0.0, None
        for rule, size in enumerate(sizes):
            for i in reversed(range(min(size, config[rule]))):        # laxest first
                more = left & (steps[:, rule] > i)
                gain = bad[more].sum() / m - GOOD_COST * good[more].sum() / n
                if gain > best:
                    best, chosen = gain, (rule, i)
        if chosen is None:
            return path
        config = config.copy()
        config[chosen[0]] = chosen[1]
        path.append(config)


def certify(steps: np.ndarray, good: np.ndarray, path: list[np.ndarray], risk: float, delta: float) -> np.ndarray | None:
    """The last of the configurations that the holdout's ``good`` documents let pass, one after the other."""
    n, passed = int(good.sum()), None
    for config in path:
        k = int(good[rejected(steps, config)].sum())
        if n == 0 or k > risk * n or binomial_cdf(k, n, risk) > delta:
            break
        passed = config
    return passed


def steps_below(grid: tuple[float, ...], score: Column) -> Column:
    """How many cutoffs of a grid lie below a score."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in grid]), lambda c: c < score))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum and a cutoff column for each rule, null where the rule rejects nothing."""
    judged = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
    held = measured.where("NOT base_failed").join(judged, F.col("doc_id") == F.col("_id"))
    names = list(RULES)
    steps = [steps_below(GRID[name], F.expr(RULES[name])).alias(name) for name in names]
    # labelled documents of equal steps are one row: no more than there are combinations of steps
    counts = held.select("stratum", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("proposes"), "quality", *steps) \
        .groupBy("stratum", "proposes", *names).agg(
            F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad"))
    strata = max(1, measured.select("stratum").distinct().count())
    sizes = [len(GRID[name]) for name in names]

    def pick(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["proposes", *names])
        first, second = frame[frame["proposes"]], frame[~frame["proposes"]]
        path = propose(first[names].to_numpy(), first["good"].to_numpy(), first["bad"].to_numpy(), sizes)
        config = certify(second[names].to_numpy(), second["good"].to_numpy(), path, risk, delta / strata)
        cuts = [np.nan if config is None or config[r] == NONE else GRID[name][config[r]] for r, name in enumerate(names)]
        return pd.DataFrame({"stratum": [key[0]], **{name: [cut] for name, cut in zip(names, cuts)}})

    picked = counts.groupBy("stratum").applyInPandas(pick, "stratum string, " + ", ".join(f"{name} double" for name in names))
    return picked.select("stratum", *[F.nullif(F.col(name), F.lit(float("nan"))).alias(name) for name in names])


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``kept`` and ``failed_rules`` to measured documents."""
    cuts = cuts.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_cut_{r}") for r in RULES])
    both = measured.join(cuts, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(F.expr(score) > F.col(f"_cut_{name}"), F.lit(name)) for name, score in RULES.items()]))
    return both.withColumn("failed_rules", F.array_join(failed, ",")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed_rules") == "")).drop("_stratum", *[f"_cut_{r}" for r in RULES])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document, with cutoffs per language chosen on the labelled documents."""
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("stratum"))
    measured = T.written(measure(docs), "quality-counts")
    cuts = T.written(cutoffs(measured, T.read(spark, sf_dir, "labels")), "quality-cutoffs")
    return judge(measured, cuts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                        "base_failed", "kept", "failed_rules")
