"""Hierarchical best-fit packing of token pieces into sequences (operator 6).

Documents are cut into pieces of at most ``capacity`` tokens. Every partition packs
its own pieces, longest first, each into the fullest open sequence that still has
room. Nearly full sequences are final and written at once; underfull ones go on as
items, with their contents, to a merge round in which one task takes the leftovers of
``FAN_IN`` tasks, and so on until one task remains. A sequence holds at most
``capacity`` pieces, so what an item carries is bounded.

Which underfull sequences go on: two that are more than half full never merge, and a
task leaves at most one that is half full or less, or else those two would have met. So a
round over FAN_IN tasks moves at most FAN_IN small sequences, and takes at most as many
hosts; a host that is emptier serves wherever a fuller one does. Of a task's others the
FAN_IN emptiest for each round to come, and FAN_IN more for hosts used up elsewhere,
are therefore all that any later round can use. They go on; the rest can gain nothing
and is final. The last task gets a bounded number of items whatever the input.

Defined results: null or empty text is one piece holding the end id alone; whole texts
are cut, however long; of sequences with equal room the one that got it last is taken;
repeated rows are packed as often as they come; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import tables as T
from caseflow.llm.encode import encoder
from caseflow.llm.token_files import encode_ids

CAPACITY = 2048
NEARLY_FULL = 8         # free tokens of a sequence that is final at once
FAN_IN = 16
BATCH = 1000            # sequences written at a time
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])
BIN = pa.schema([("sequence_id", pa.int64()), ("task", pa.int32()), ("fill", pa.int64()), ("final", pa.bool_()),
                 ("members", pa.list_(MEMBER))])
BIN_DDL = ("sequence_id long, task int, fill long, final boolean, "
           "members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>")


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every whole text of ``docs`` (doc_id, text)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode_ids(tokenizer, text.as_py(), end_id)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    for name, value in zip(rows, (doc_id, k, at, len(part), zlib.crc32(part.astype("<u4").tobytes()))):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, MEMBER.field(k).type) for k, v in rows.items()], list(rows))
        encoder(tokenizer).known.clear()        # the worker lives on, in other stages too

    return docs.select("doc_id", "text").mapInArrow(T.released(cut), PIECE)


class Contents:
    """Columns of the pieces that a task holds, by row number."""

    def __init__(self) -> None:
        self.size = 0
        self.columns = {f.name: np.zeros(1024, f.type.to_pandas_dtype()) for f in MEMBER}
        self.named = np.zeros(1024, bool)       # whether doc_id is not null

    def extend(self, columns: dict[str, pa.Array]) -> range:
        """Row numbers of the pieces added."""
        first, self.size = self.size, self.size + len(columns["doc_id"])
        while len(self.named) < self.size:
            self.named = np.append(self.named, np.zeros_like(self.named))
            self.columns = {k: np.append(v, np.zeros_like(v)) for k, v in self.columns.items()}
        for k, v in self.columns.items():
            v[first:self.size] = columns[k].fill_null(0).to_numpy(zero_copy_only=False)
        self.named[first:self.size] = columns["doc_id"].is_valid().to_numpy(zero_copy_only=False)
        return range(first, self.size)

    def members(self, sequences: list[list[int]]) -> pa.Array:
        """The pieces of each sequence."""
        rows = np.array([r for s in sequences for r in s], np.int64)
        arrays = [pa.array(v[rows], mask=~self.named[rows] if k == "doc_id" else None) for k, v in self.columns.items()]
        flat = pa.StructArray.from_arrays(arrays, fields=list(MEMBER))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(s) for s in sequences])), pa.int32()), flat)


class BestFit:
    """Open sequences by free room; a bit of ``rooms`` stands for each room that some sequence has."""

    def __init__(self, capacity: int, nearly_full: int):
        self.capacity, self.nearly_full, self.rooms = capacity, nearly_full, 0
        self.open: list[list[list[int]]] = [[] for _ in range(capacity + 1)]     # contents, by room

    def add(self, length: int, members: list[int]) -> list[int] | None:
        """Put an item into the fullest sequence with room for it; return the sequence once it is nearly full."""
        fitting = self.rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            inside = self.open[room].pop()
            if not self.open[room]:
                self.rooms &= ~(1 << room)
            inside.extend(members)
        else:
            room, inside = self.capacity, members
        room -= length
        if room <= self.nearly_full:
            return inside
        self.open[room].append(inside)
        self.rooms |= 1 << room
        return None

    def rest(self) -> Iterator[list[int]]:
        """Contents of the open sequences, the emptiest first."""
        for room in range(self.capacity, 0, -1):
            yield from self.open[room]


def _pack_task(batches: Iterator[pa.RecordBatch], number: int, last: bool, capacity: int, fan_in: int,
               hand_on: int) -> Iterator[pa.RecordBatch]:
    """Pack one task's items, longest first; rows of BIN. ``task`` tells which task of the next round takes a row."""
    here = TaskContext.get().partitionId()
    fit, held, done, task = BestFit(capacity, NEARLY_FULL), Contents(), 0, here if number == 0 else None

    def told(sequences: list[list[int]], final: bool) -> pa.RecordBatch:
        nonlocal done
        ids = (number << 56) | (here << 32) | np.arange(done + 1, done + 1 + len(sequences))
        done += len(sequences)
        fill = [int(held.columns["length"][s].sum()) for s in sequences]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([(task or 0) // fan_in] * len(sequences), pa.int32()), pa.array(fill, pa.int64()),
            pa.array([final] * len(sequences), pa.bool_()), held.members(sequences)], schema=BIN)

    def parts(sequences: list[list[int]], final: bool) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(sequences), BATCH):
            yield told(sequences[k:k + BATCH], final)

    full: list[list[int]] = []
    for batch in batches:
        if number:
            tasks = batch.column("task").to_pylist()
            task = min([*tasks, *([] if task is None else [task])])
            inside = batch.column("members")
            rows = held.extend(dict(zip([f.name for f in MEMBER], inside.flatten().flatten())))
            ends = np.append(0, np.cumsum(inside.value_lengths().to_numpy())) + rows.start
            items = zip(batch.column("fill").to_pylist(), (list(range(a, b)) for a, b in zip(ends.tolist(), ends[1:].tolist())))
        else:
            rows = held.extend({f.name: batch.column(f.name) for f in MEMBER})
            items = zip(batch.column("length").to_pylist(), ([r] for r in rows))
        for length, members in items:
            ended = fit.add(length, members)
            if ended:
                full.append(ended)
        if len(full) >= BATCH:
            yield from parts(full, True)
            full = []
    yield from parts(full, True)
    rest = list(fit.rest())
    going = 0 if last else hand_on
    yield from parts(rest[:going], False)
    yield from parts(rest[going:], True)


def pack(items: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN, hand_on: int | None = None) -> DataFrame:
    """Add sequence_id and offset to ``items`` (columns of PIECE, lengths up to ``capacity``).

    ``hand_on`` is how many underfull sequences of a task go on; by default all that later rounds can use.
    """
    todo, by, number, last, finals = T.written(items, "pack-pieces"), F.desc("length"), 0, False, []
    tasks = todo.rdd.getNumPartitions()
    while True:
        rounds = 0
        while fan_in ** rounds < tasks:
            rounds += 1
        going = fan_in * (rounds + 1) if hand_on is None else hand_on
        packed = T.written(todo.sortWithinPartitions(by).mapInArrow(
            lambda b, n=number, end=last, k=going: _pack_task(b, n, end, capacity, fan_in, k), BIN_DDL), f"pack-round-{number}")
        finals.append(packed.where("final"))
        todo = packed.where("not final")
        highest = todo.agg(F.max("task")).first()[0]
        if highest is None:
            break
        tasks = highest + 1
        todo, by, number, last = todo.repartition(tasks, "task"), F.desc("fill"), number + 1, highest == 0
    out = finals[0]
    for more in finals[1:]:
        out = out.unionByName(more)
    # offsets: running sum of the lengths of the members before
    lengths = F.transform("members", lambda m: m["length"])
    offsets = F.aggregate(lengths, F.expr("cast(array(0) as array<bigint>)"),
                          lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return out.select("sequence_id", F.explode(F.arrays_zip("members", F.slice(offsets, 1, F.size("members")).alias("offset"))).alias("m")) \
        .select("m.members.*", "sequence_id", "m.offset")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, end id 0."""
    return pack_documents(T.read(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers
    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0))
