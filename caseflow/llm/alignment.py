"""Aligning the tokens of two tokenizers over the same text (operator 12).

A byte-level BPE (A) and a piece model (B) both spell space+text. All A and B tokens are
intervals of bytes: sorted by start (lexsort) with the running maximum of their ends
(maximum.accumulate), a group ends where a start reaches that maximum, that is where a
token of A and one of B end together. Within the groups, every A-B pair of overlapping
intervals is a link.

Neither tokenizer has a token that goes on over a single blank or line break, nor does a
cut there change what stands on either side, so texts are cut there and each distinct
segment of a block of documents is encoded and aligned once. Tests hold the result
against encoding whole texts.

How often a pair of ids is linked in the corpus comes from three steps:

1. Tasks cut their documents into blocks of bounded size. A block gives a row a document
   (the numbers of its segments), a row a distinct pair of ids with its links in the
   block, and one row that tells which pairs each segment links.
2. Spark sums the pairs over the blocks, finds the most frequent count of each B id and
   joins both back to the pairs of each block. No pair has more rows than there are blocks.
3. Each block meets its pairs' counts and sums them over its segments and documents.

No table of pairs is broadcast or held whole anywhere.

Defined results: null and empty texts, and texts that either tokenizer spells otherwise
(B takes U+2581 for a blank), have no tokens and no links, zeros and an empty digest;
special-token strings are plain text; rows are aligned one by one, whatever their
doc_ids, null and repeated ones too, and repeated rows count again in the corpus; pairs
of equal count are all the best of their B id; long texts are aligned whole, in a block
of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import tables as T
from caseflow.llm.encode import _byte_alphabet

#: Characters of text after which a block, or a step within it, ends.
BLOCK_CHARS = 12 << 20
STEP_CHARS = 1 << 20
PAIR_ROWS = 1 << 16
#: A segment starts with a blank or line break after another character than white space.
_SEGMENT = re.compile(r"[ \n]\s*+(?:\S++(?:[^\S \n]\s*+)?)*+")
ALIGNED = ("block long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "segments binary, place int, a int, b int, n long")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
DOCUMENT, SEGMENTS, PAIR = 0, 1, 2


class ByteTokens:
    """A byte-level BPE of the ``tokenizers`` library: ids of segments and bytes of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark runs a task a core
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"]
        if spec["normalizer"] is not None or cut["type"] != "ByteLevel" or cut.get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level BPE, whose words start with their blank")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        spelled = {code: byte for byte, code in _byte_alphabet().items()}
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.spelling = [b""] * (max(self.library.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            self.spelling[i] = bytes(spelled[ord(c)] for c in token)

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(s) for s in self.spelling])

    def encode(self, segments: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(segments, add_special_tokens=False)]


class PieceTokens:
    """A piece model of the ``sentencepiece`` library, which puts a blank before a text."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path} has pieces that go on over a blank or a line break")
        self.spelling = [bytes.fromhex(p[3:5]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(s) for s in self.spelling])

    def encode(self, segments: Sequence[str]) -> list[list[int]]:
        # after the blank put before and the line break, a segment stands as it does within a text
        return [ids[2:] for ids in self.library.encode([f"\n{s}" for s in segments], num_threads=1)]


@cache
def tokenizers_of(a: str, b: str) -> tuple[ByteTokens, PieceTokens]:
    """One pair a worker."""
    return ByteTokens(a), PieceTokens(b)


def cut(text: str) -> list[str]:
    """Segments of space+text; those of a blank and a word are named by the word alone."""
    if " ".join(text.split()) == text.replace("\n", " "):       # words with one blank or line break between them
        return text.replace("\n", " \n").split(" ")
    return [s[1:] if s[0] == " " and len(s) > 1 and not s[1].isspace() else s for s in _SEGMENT.findall(" " + text)]


def segment(name: str) -> str:
    return name if name[0] in " \n" else f" {name}"


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Number of the group of each interval: a group breaks where a start reaches all ends before it."""
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.append(False, starts[order][1:] >= reach[:-1]))
    return group


def overlaps(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping pairs (i, j) of two sorted tilings, and how many each i has."""
    low = np.searchsorted(ends_b, starts_a, "right")
    n = np.searchsorted(starts_b, ends_a, "left") - low
    i = np.repeat(np.arange(len(n)), n)
    return i, np.repeat(low, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n), n


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype("<u4").tobytes(), 1) if len(numbers) else b""


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed) if packed else b"", "<u4")


class Block:
    """The distinct segments of a bounded number of documents, numbered as they appear."""

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self.a, self.b = a, b
        self.known: dict[str, int] = {}
        self.groups: list[str | None] = []        # the segment's groups as text; None if it is spelled otherwise
        self.tallies: list[np.ndarray] = []       # per segment: A tokens, B tokens, groups, links
        self.pairs: list[np.ndarray] = []         # a << 32 | b of all links, segment by segment
        self.chars = 0
        self.counted = np.zeros(0, np.int64)      # per segment, its occurrences

    def learn(self, names: Sequence[str]) -> None:
        """Encode and align new segments, laid end to end on one axis of bytes."""
        ids_a, ids_b = (t.encode([segment(n) for n in names]) for t in (self.a, self.b))
        right = np.zeros(len(names), bool)
        for k, (name, x, y) in enumerate(zip(names, ids_a, ids_b)):
            raw = segment(name).encode()
            right[k] = b"".join([self.a.spelling[i] for i in x]) == raw == b"".join([self.b.spelling[i] for i in y])
        for name in names:
            self.known[name] = len(self.known)
        tallies = np.zeros((len(names), 4), np.int64)
        groups: list[str | None] = [None] * len(names)
        good = np.flatnonzero(right)
        if len(good):
            n_a, n_b = (np.array([len(ids[k]) for k in good]) for ids in (ids_a, ids_b))
            flat_a, flat_b = (np.array([i for k in good for i in ids[k]]) for ids in (ids_a, ids_b))
            ends_a, ends_b = np.cumsum(self.a.lengths[flat_a]), np.cumsum(self.b.lengths[flat_b])
            starts_a, starts_b = ends_a - self.a.lengths[flat_a], ends_b - self.b.lengths[flat_b]
            starts = np.append(starts_a, starts_b)
            side = np.repeat([0, 1], [len(flat_a), len(flat_b)])
            group = coalesce(starts, np.append(ends_a, ends_b), side)
            i, j, n = overlaps(starts_a, ends_a, starts_b, ends_b)
            self.pairs.append(flat_a[i] << 32 | flat_b[j])
            first_a = np.cumsum(n_a) - n_a
            n_groups = np.diff(np.append(group[first_a], group.max() + 1))
            tallies[good] = np.stack([n_a, n_b, n_groups, np.add.reduceat(n, first_a)], axis=1)

            # as text: by group, A before B, each followed by what separates it from the next
            order = np.lexsort((starts, side, group))
            ids, sides, numbers = np.append(flat_a, flat_b)[order], side[order], group[order]
            sep = np.where(np.diff(numbers) > 0, 2, np.diff(sides) != 0)
            parts = [f"{x}{',|;'[s]}" for x, s in zip(ids.tolist(), np.append(sep, 0).tolist())]
            ends = np.cumsum(n_a + n_b).tolist()
            for k, begin, end in zip(good.tolist(), [0, *ends], ends):
                groups[k] = "".join(parts[begin:end])[:-1]
        self.groups += groups
        self.tallies.append(tallies)

    def documents(self, texts: Sequence[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, segments) of each text."""
        names = [cut(t) if t else [] for t in texts]
        new = dict.fromkeys(n for doc in names for n in doc if n not in self.known)
        if new:
            self.learn(list(new))
        self.tallies = [np.concatenate([np.zeros((0, 4), np.int64), *self.tallies])]
        self.counted = np.append(self.counted, np.zeros(len(self.known) - len(self.counted), np.int64))
        [tallies] = self.tallies
        out, met = [], [np.zeros(0, "<u4")]
        for doc in names:
            at = [self.known[n] for n in doc]
            groups = [self.groups[k] for k in at]
            if not at or None in groups:
                out.append((0, 0, 0, 0, "", b""))
                continue
            met.append(np.array(at, "<u4"))
            out.append((*tallies[met[-1]].sum(axis=0).tolist(), hashlib.sha256(";".join(groups).encode()).hexdigest(), _packed(met[-1])))
        self.counted += np.bincount(np.concatenate(met), minlength=len(self.counted))
        self.chars += sum(len(t or "") for t in texts)
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, the links of each, and the segments' pairs: places among the distinct ones and numbers of them."""
        flat = np.concatenate([np.zeros(0, np.int64), *self.pairs])
        n = np.concatenate([np.zeros((0, 4), np.int64), *self.tallies])[:, 3]
        pairs, places = np.unique(flat, return_inverse=True)
        counts = np.bincount(places, np.repeat(self.counted, n), len(pairs)).astype(np.int64)
        return pairs, counts, places.astype("<u4"), n.astype("<u4")


def _rows(**columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    types = {"groups_sha256": pa.string(), "segments": pa.binary(), "kind": pa.int32(), "place": pa.int32(), "a": pa.int32(), "b": pa.int32()}
    size = len(next(v for v in columns.values() if not isinstance(v, int)))
    arrays = []
    for name in names:
        value, kind = columns.get(name), types.get(name, pa.int64())
        value = pa.nulls(size, kind) if value is None else pa.array(np.full(size, value) if isinstance(value, int) else value, kind)
        arrays.append(value)
    return pa.RecordBatch.from_arrays(arrays, names)


def align(docs: DataFrame, a: str, b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Step 1: the blocks of ``docs`` (doc_id, text) under the tokenizer files ``a`` and ``b``, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizers_of(a, b)
        first, block, number = TaskContext.get().partitionId() << 32, None, 0

        def close() -> Iterator[pa.RecordBatch]:
            pairs, counts, places, n = block.links()
            # segments that only texts without tokens have link nothing
            linked = np.flatnonzero(counts)
            for k in range(0, len(linked), PAIR_ROWS):
                some = linked[k:k + PAIR_ROWS]
                yield _rows(block=first + number, kind=PAIR, place=some, a=pairs[some] >> 32, b=pairs[some] & 0xFFFFFFFF, n=counts[some])
            yield _rows(block=first + number, kind=SEGMENTS, segments=[_packed(np.append(n, places))], n=np.array([len(n)]))

        for batch in batches:
            ids, texts = batch.column("doc_id").cast(pa.int64()), batch.column("text")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
            at = 0
            while at < len(texts):
                before = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + STEP_CHARS, "right")))
                if block is None:
                    block = Block(*tokens)
                told = block.documents(texts[at:to].to_pylist())
                n_a, n_b, n_groups, n_links, digests, segments = zip(*told)
                yield _rows(block=first + number, kind=DOCUMENT, doc_id=ids[at:to], n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links,
                            groups_sha256=digests, segments=segments)
                at = to
                if block.chars >= block_chars:
                    yield from close()
                    block, number = None, number + 1
        if block is not None:
            yield from close()

    return T.written(docs.select("doc_id", "text").mapInArrow(run, ALIGNED), "alignment-blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Step 2: a, b, count (links in the corpus), best (no other pair of this B id has more)."""
    counts = T.written(blocks.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("count")), "alignment-pairs")
    top = counts.groupBy(F.col("b").alias("_b")).agg(F.max("count").alias("_top"))
    return counts.join(top, F.col("b") == F.col("_b")).select("a", "b", "count", (F.col("count") == F.col("_top")).alias("best"))


def scored(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Step 3: a row per document, with the corpus-wide counts of its links."""
    pairs = blocks.where(F.col("kind") == PAIR).select("block", "place", "a", "b")
    told = pairs.join(counts, ["a", "b"]).select(F.col("block").alias("of_block"), "place", "count", "best")

    def finish(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        is_document = np.array(rows.column("kind")) == DOCUMENT
        documents = rows.filter(pa.array(is_document))
        [whole], [n_segments] = (rows.filter(pa.array(~is_document)).column(c).to_pylist() for c in ("segments", "n"))
        whole = _unpacked(whole)
        n, places = whole[:n_segments].astype(np.int64), whole[n_segments:]
        ends = np.cumsum(n)
        of_segment = []
        for column in ("best", "count"):
            value = np.zeros(int(places.max(initial=0)) + 1, np.int64)
            value[np.array(pairs.column("place"))] = np.array(pairs.column(column)).astype(np.int64)
            total = np.append(0, np.cumsum(value[places]))
            of_segment.append(total[ends] - total[ends - n])
        numbers = [_unpacked(s) for s in documents.column("segments").to_pylist()]
        sums = [pa.array([int(v[x].sum()) for x in numbers], pa.int64()) for v in of_segment]
        names = [c.split()[0] for c in RESULT.split(", ")]
        told = {"n_best": sums[0], "count_sum": sums[1]}
        return pa.table([told[c] if c in told else documents.column(c) for c in names], names)

    return (blocks.where(F.col("kind") != PAIR).drop("place", "a", "b").groupBy("block")
            .cogroup(told.groupBy("of_block")).applyInArrow(finish, RESULT))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document of the table under byte_bpe_50k (A) and piece_bpe_32k (B)."""
    import public_tokenizers
    docs = T.read(spark, sf_dir, "documents")
    blocks = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return scored(blocks, pair_counts(blocks))
