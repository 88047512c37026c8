"""Language identification by words first, then ever shorter character n-grams (operator 5).

A word that the model knows scores its log frequency in each language. An unseen word
falls back to the longest character n-grams of it that are known, scoring their mean log
frequency, and if not even one of its characters is known it tells nothing. A text's
scores are the sums over all its words; the score reported is the share of the best
language after normalising, so it lies between 0 and 1.

Frequencies are drawn towards those of all languages together, by PRIOR tokens: what a
language has not seen has a floor that is the same for all, and a language learnt from a
few words (a stray label) scores other words no better than their average language.

The model is fitted on a sample of labelled rows (``SAMPLE_DOCS`` a language, picked by a
hash of the id) of the ``MAX_LANGUAGES`` commonest labels, and keeps the ``TABLE_ROWS``
commonest words of each language and as many n-grams of each length, so its size has a
bound and it is broadcast.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so
is everything if no row can be learnt from; equal scores go to the language that sorts
first; a text of unknown characters only scores alike for all languages; repeated rows
are predicted one by one; whole texts count, however long; an empty table gives no rows;
other columns are kept, but for lang_pred and score, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from caseflow.llm import tables as T

SAMPLE_DOCS = 1500
MAX_LANGUAGES = 200
TABLE_ROWS = 10_000
LONGEST = 4
#: Tokens of the common frequencies that each language's own are mixed with.
PRIOR = 2000.0
REMEMBERED = 100_000
#: Texts whose new words are scored together.
AT_ONCE = 64
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: ASCII letters in lower case, all else a space.
_ASCII = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalpha() else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    """Words of a text in lower case; without a pattern where it is plain ASCII."""
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    return _WORD.findall(text.lower())


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32(doc_id as text) mod 3 is 1 are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS) -> DataFrame:
    """About ``docs_per_language`` rows of each language of ``labelled`` (doc_id, text, lang), by hash of the id.

    The shares are literals of the filter (a row a language), so no text is shuffled.
    """
    slots = 1 << 40
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    taken = F.lit(False)
    for r in counts:
        share = min(slots, docs_per_language * slots // r["count"] + 1)
        taken = taken | ((F.col("lang") == r["lang"]) & (F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < share))
    return labelled.where(taken)


@dataclass
class Model:
    """Log frequencies by language: of words (table 0) and of n-grams of padded words by their length."""

    languages: list[str]
    tables: list[dict[str, int]]                        # row in ``logs`` of each word or n-gram
    logs: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))      # a row for each number in ``known``

    def _rows(self, word: str) -> list[int]:
        """Rows in ``logs`` whose mean scores a word."""
        row = self.tables[0].get(word)
        if row is not None:
            return [row]
        for n in range(LONGEST, 0, -1):
            padded, get = f"_{word}_" if n > 1 else word, self.tables[n].get
            hits = [v for i in range(len(padded) - n + 1) if (v := get(padded[i:i + n])) is not None]
            if hits:
                return hits
        return []

    def word(self, word: str) -> np.ndarray:
        rows = self._rows(word)
        return self.logs[rows].mean(axis=0) if rows else np.zeros(len(self.languages))

    def forget(self) -> None:
        """Drop the scores of the words met so far."""
        self.known, self.scores = {}, np.zeros((0, 0))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; words that are new to the texts are scored together."""
        found = [words_of(t or "") for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(found)
        if len(self.known) > REMEMBERED:
            self.forget()
        self._remember({w for words in found for w in words if w not in self.known})
        return [self._best(words) for words in found]

    def _best(self, words: list[str]) -> tuple[str, float]:
        told = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        told = told[told >= 0]
        if len(told) == 0:
            return UNKNOWN, 0.0
        total = self.scores.take(told, axis=0).sum(axis=0)
        best = int(np.argmax(total))
        return self.languages[best], float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum())

    def _remember(self, words: Iterable[str]) -> None:
        """Score words not met before, those of equally many rows at once; -1 stands for one that holds other characters than letters."""
        known, alike = self.known, {}
        for word in words:
            at = known[word] = len(known) if word.isalpha() else -1
            if at >= 0:
                rows = self._rows(word)
                places, hits = alike.setdefault(len(rows), ([], []))
                places.append(at)
                hits.append(rows)
        if len(known) > len(self.scores):
            more = np.zeros((max(1024, 2 * len(known)), len(self.languages)))
            more[:len(self.scores)] = self.scores.reshape(-1, len(self.languages))
            self.scores = more
        for n, (places, hits) in alike.items():
            self.scores[places] = self.logs[np.array(hits)].mean(axis=1) if n else 0.0


def fit(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS, table_rows: int = TABLE_ROWS) -> Model:
    """Fit on ``labelled`` (doc_id, text, lang), null languages and texts left out."""
    rows = sample(labelled.where("lang IS NOT NULL AND text IS NOT NULL"), docs_per_language)
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    words = T.written(rows.select("lang", word).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "langid-words")
    languages = [r.lang for r in words.select("lang").distinct().orderBy("lang").collect()]
    tables: list[dict[str, int]] = []
    logs: list[np.ndarray] = [np.zeros((0, len(languages)))]
    for n in range(LONGEST + 1):
        counts = words if n == 0 else words.select("lang", "n", F.explode(_grams("word", n)).alias("word"))
        if n:
            counts = T.written(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), f"langid-grams-{n}")
        table, of = _frequencies(counts, languages, table_rows)
        first = sum(map(len, logs))
        tables.append({key: first + i for i, key in enumerate(table)})
        logs.append(of)
    return Model(languages, tables, np.concatenate(logs).astype(np.float32))


def _grams(word: str, n: int) -> Column:
    """n-grams of a word with an edge mark on both sides, of single characters without."""
    edge = "_" if n > 1 else ""
    padded = f"concat('{edge}', {word}, '{edge}')"
    return F.expr(f"CASE WHEN length({padded}) >= {n} THEN transform(sequence(1, length({padded}) + 1 - {n}), i -> substring({padded}, i, {n})) END")


def _frequencies(counts: DataFrame, languages: list[str], table_rows: int) -> tuple[list[str], np.ndarray]:
    """The commonest keys of each language of ``counts`` (lang, word, n), and their log frequencies in all of them.

    At most table_rows keys a language are collected.
    """
    if not languages:
        return [], np.zeros((0, 0))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    commonest = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    kept = counts.withColumn("_place", F.row_number().over(commonest)).where(F.col("_place") <= table_rows).select("word").distinct()
    sums = [F.sum(F.when(F.col("lang") == lang, F.col("n"))).alias(f"_{i}") for i, lang in enumerate(languages)]
    rows = counts.join(kept, "word", "left_semi").groupBy("word").agg(*sums).orderBy("word").collect()
    own = np.array([[r[f"_{i}"] or 0 for i in range(len(languages))] for r in rows], dtype=float).reshape(-1, len(languages))
    size = np.array([totals.get(lang, 0) for lang in languages], dtype=float)
    common = own.sum(axis=1, keepdims=True) / max(1.0, size.sum())
    return [r.word for r in rows], np.log((own + PRIOR * common) / (size + PRIOR))


def label(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred and score to ``docs`` (text and any other columns; columns of those names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    names = [*docs.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            found = [f for i in range(0, len(text), AT_ONCE) for f in shared.value.predict_all(text.slice(i, AT_ONCE).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], names)
        shared.value.forget()       # workers live on; what a task remembered must not

    schema = T_.StructType([*docs.schema.fields, T_.StructField("lang_pred", T_.StringType()), T_.StructField("score", T_.DoubleType())])
    return docs.mapInArrow(T.released(run), schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = T.read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return label(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
