"""Token ids in binary shard files with a shared zstandard dictionary (operator 2).

A shard is one file:

    magic, version, id width in bytes, SHA-256 of the dictionary
    one zstandard frame a document (its ids, little-endian, end id included)
    per document: doc_id, whether it has one, number of ids; frame offsets
    number of documents, place of the three arrays, magic

Any document is read with two short reads: the index at the end of the shard, then
its frame. The dictionary is trained once on the serialised ids of a bounded sample
and lies beside the shards as ``dictionary-<hash>``; a reader refuses a shard whose
hash is another.

Spark sorts the documents by range of ``doc_id``; each task writes shards under
names of its own and returns a manifest row for each. Only the manifest rows that
Spark commits count, so a task that is run again leaves at most an unread file.

Defined results: null text is empty and holds the end id alone; whole texts are encoded,
however long; documents with the same ``doc_id`` follow one another in the order of their
text's hash; null ids come first; ids that do not fit the width end the job; an empty
table gives an empty manifest and no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm import tables as T
from caseflow.llm.encode import encoder
from caseflow.session import scratch_path

MAGIC = b"CFTOKENS"
HEADER = struct.Struct("<8sBB32s")
FOOTER = struct.Struct("<QQ8s")
SHARD_BYTES = 64 << 20
#: Bounds of what the dictionary is trained on: documents, and bytes of ids of each.
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
MANIFEST = "shard string, part int, roll int, docs long, tokens long"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder all machines share (a local path, or a URI such as hdfs://...)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + re.sub("^file:/*", "", uri)
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; documents are added in order."""

    def __init__(self, fs: pafs.FileSystem, path: str, dictionary: bytes, width: int):
        self.out = fs.open_output_stream(path)
        self.width, self.at, self.tokens = width, HEADER.size, 0
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
        self.out.write(HEADER.pack(MAGIC, 1, width, hashlib.sha256(dictionary).digest()))
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.offsets = [self.at]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.zstd.compress(_narrow(ids, self.width).tobytes())
        self.out.write(frame)
        self.at += len(frame)
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.offsets.append(self.at)
        self.tokens += len(ids)

    def close(self) -> None:
        self.out.write(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes())
        self.out.write(np.array([x is not None for x in self.doc_ids], "u1").tobytes())
        self.out.write(np.array(self.counts, "<u8").tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(FOOTER.pack(len(self.doc_ids), self.at, MAGIC))
        self.out.close()


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, fs: pafs.FileSystem, path: str, dictionary: bytes):
        self.file = fs.open_input_file(path)
        magic, version, self.width, digest = HEADER.unpack(self._at(0, HEADER.size))
        if magic != MAGIC or version != 1:
            raise ValueError(f"{path} is no token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary ({digest.hex()})")
        size = self.file.size()
        n, index, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not complete")
        raw = self._at(index, size - FOOTER.size - index)
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.named = np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
        self.counts = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 17 * n).astype(np.int64)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdDecompressor(dict_data=trained)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document, read on its own."""
        frame = self._at(self.offsets[i], self.offsets[i + 1] - self.offsets[i])
        raw = self.zstd.decompress(frame, max_output_size=int(self.counts[i]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


def _narrow(ids: np.ndarray, width: int) -> np.ndarray:
    """``ids`` in ``width`` bytes each; an id that does not fit is an error."""
    if len(ids) and int(ids.max()) >> (8 * width):
        raise ValueError(f"token id {ids.max()} does not fit into {width} bytes")
    return ids.astype(f"<u{width}")


def encode_ids(path: str, text: str | None, end_id: int) -> np.ndarray:
    return np.append(np.frombuffer(encoder(path)(text or ""), "<u4"), np.uint32(end_id))


def train_dictionary(docs: DataFrame, path: str, end_id: int, width: int) -> bytes:
    """Dictionary trained on the ids of about SAMPLE_DOCS documents, picked by a hash of their id.

    The sample is at most 2 * SAMPLE_DOCS documents and SAMPLE_BYTES of ids of each; a
    corpus too small or too uniform to train on gives the empty dictionary.
    """
    slots = 1 << 40
    share = min(slots, slots * SAMPLE_DOCS // max(1, docs.count()) + 1)
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < share).select("doc_id", "text").limit(2 * SAMPLE_DOCS)

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [_narrow(encode_ids(path, t, end_id), width).tobytes()[:SAMPLE_BYTES]
                   for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "ids"])

    rows = picked.mapInArrow(serialise, "doc_id long, ids binary").collect()
    samples = [bytes(r.ids) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.ids))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards in ascending doc_id order; return the manifest."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer, end_id, width)
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary-{hashlib.sha256(dictionary).hexdigest()}") as f:
        f.write(dictionary)

    def write_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        part, roll, shard, rows = TaskContext.get().partitionId(), 0, None, []

        def end():
            shard.close()
            rows.append((name, part, roll, len(shard.counts), shard.tokens))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if shard is None:
                    name = f"{part:06d}-{roll:04d}-{uuid.uuid4().hex}"
                    shard = ShardWriter(fs, f"{root}/{name}", dictionary, width)
                shard.add(doc_id, encode_ids(tokenizer, text.as_py(), end_id))
                if shard.at >= SHARD_BYTES:
                    end()
                    shard, roll = None, roll + 1
        if shard is not None:
            end()
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "part", "roll", "docs", "tokens"), r)) for r in rows],
                                         pa.schema([("shard", pa.string()), ("part", pa.int32()), ("roll", pa.int32()),
                                                    ("docs", pa.int64()), ("tokens", pa.int64())]))

    keys = ["doc_id", F.xxhash64("text")]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return T.written(ordered.mapInArrow(write_shards, MANIFEST), "token-manifest")


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of every document, read back from the shards of ``manifest``."""
    before = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))

    def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        [found] = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("dictionary-")]
        with fs.open_input_file(found) as f:
            dictionary = f.read()
        for batch in batches:
            for name, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist()):
                shard = ShardReader(fs, f"{root}/{name}", dictionary)
                begins = start + np.append(0, np.cumsum(shard.counts)[:-1])
                for i in range(0, len(shard), 512):
                    some = range(i, min(i + 512, len(shard)))
                    ids = [shard.ids(k).astype("<u4").tobytes() for k in some]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard.doc_ids[some.start:some.stop], mask=~shard.named[some.start:some.stop]),
                        pa.array(begins[some.start:some.stop], pa.int64()),
                        pa.array(shard.counts[some.start:some.stop]),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                shard.close()

    # one shard a task: their number follows the data
    return starts.repartitionByRange(max(1, manifest.count()), "start").mapInArrow(
        read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token shards with end id 2, and return what the files hold."""
    import public_tokenizers
    folder = scratch_path(spark, "token-shards")
    manifest = write(T.read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read(folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
