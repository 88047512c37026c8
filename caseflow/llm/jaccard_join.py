"""N-gram Jaccard join by parity sketches (operator 7).

A document's set is its distinct five-word shingles, as 64-bit hashes. Documents with
equal sets form one class, and the join works on classes.

Sketch: for a size band, shingles are dealt to ``pieces`` words by their hash, and each
XORs its hash into its word. A shingle that only one of two sets has changes one word,
so the number of words in which two sketches differ is at most the symmetric
difference. Sets of sizes a and b at or above the threshold t differ in at most
(1 - t) / (1 + t) * (a + b) shingles; with more pieces than that, some words agree
(pigeonhole). Ordered by how many classes hold a word, rarest first, two such sketches
even share one of their first ``differences + 1`` words, so only those are joined; a
word that one class alone holds leads nowhere but uses up a place. Bands are powers of
two: a set takes part in the band of its size and, where its smaller partners can lie
there, in the band below, so any two partners meet in the band of the smaller.

Words are counted in one shuffle of packed arrays: a task sends a word it has met often
once, with a count, and keeps the other holders aside for a skew-safe join, so a word
that a third of the corpus holds is no burden to one task.

Candidates are not all pairs of a word's holders: holders are compared with one leader
first, the holder with the fewest words of its own, and the links give components; this
is done twice. Of the pairs of holders whose components still differ, those go on
whose bit sketches (a bit a shingle, XORed in) differ in no more bits than linked sets
may differ in shingles. No link between components is lost. Every candidate pair is
verified on the whole sets.

Defined results: null texts and texts without words have the empty set, size 0, and
link with nothing, so each is its own component; texts of fewer than five words have
one shingle; documents of equal sets are linked; rows that share a ``doc_id`` are linked
only by their texts; a null ``doc_id`` has the component of its class, null if there is
no id in it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm import tables as T
from caseflow.llm.words import U64, Words, mix, slices

SHINGLE = 5
NUMERATOR, DENOMINATOR = 80, 100
NO_ID = -(1 << 63)              # stands for a null doc_id in packed arrays
FLUSH = 1 << 18                 # words a task packs at once
#: Bits of the fixed-size filter of classes whose sets are needed.
FILTER_BITS = 1 << 22
LEADER_ROUNDS = 2
SKETCH_LONGS = 8                # 512 bits
_EMPTY = U64(1 << 63)           # marks the word of a piece without shingles


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order."""
    for _, _, data, offsets in slices(texts):
        w = Words(data, offsets)
        h = w.hashes(lower=True)
        at, shingles = w.windows(h, n)
        first = np.searchsorted(at, w.first)
        for r in range(w.rows):
            count = w.counts[r]
            if count >= n:
                yield np.unique(shingles[first[r]:first[r + 1]])
            elif count:
                yield mix(Words.chain(h, w.first[r:r + 1], int(count)) + U64(count))
            else:
                yield np.zeros(0, np.uint64)


def class_key(hashes: np.ndarray) -> int:
    """64-bit key of a set, whatever the order of its members."""
    return int(mix(np.array([mix(hashes).sum(dtype=np.uint64) + U64(len(hashes))], np.uint64))[0].astype(np.int64))


def bit_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity sketch of a set: every member flips one of the bits, so two sketches differ in no more bits than the sets in members."""
    odd = np.bincount((mix(hashes ^ U64(0x5851F42D4C957F2D)) >> U64(55)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def most_differences(a: int, b: int) -> int:
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (DENOMINATOR - NUMERATOR) * (a + b) // (DENOMINATOR + NUMERATOR)


def bands(n: int) -> list[tuple[int, int]]:
    """(band, largest symmetric difference to a partner met there) of a set of n shingles."""
    own = n.bit_length() - 1
    out = [(own, most_differences(n, n * DENOMINATOR // NUMERATOR))]
    if -(-n * NUMERATOR // DENOMINATOR) < 1 << own:
        out.append((own - 1, most_differences(n, (1 << own) - 1)))
    return out


def pieces(band: int) -> int:
    """Words of a sketch in a band: a tenth more than the most differences there, and plenty for small sets."""
    top = 2 << band
    return max(-(-11 * (most_differences(top, top * DENOMINATOR // NUMERATOR) + 1) // 10), min(2 * top, 64))


def sketch(hashes: np.ndarray, band: int, differences: int) -> np.ndarray:
    """Words of one set in a band, each mixed with its place; the lowest bit tells even bands from odd ones.

    Empty pieces come last in the order of words; as many as may be needed are given, marked.
    """
    m = pieces(band)
    place = ((hashes >> U64(32)) * U64(m)) >> U64(32)          # ascending, as the hashes are
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    words = np.bitwise_xor.reduceat(mix(hashes), starts)
    seat = U64(band << 48) + place[starts]
    out = mix(words ^ mix(seat)) & ~_EMPTY
    if len(out) <= differences:
        free = np.setdiff1d(np.arange(m, dtype=np.uint64), place[starts])
        free = np.sort(mix(free + U64(band << 48)))[:differences + 1 - len(out)] | _EMPTY
        out = np.concatenate([out, free])
    return (out & ~U64(1)) | U64(band & 1)


PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
PACKED_DDL = "bucket int, kind string, a binary, b binary, c binary, d binary"
FOUND_DDL = "kind string, a long, b long, c long, d long"


def _packed(kind: str, key: np.ndarray, arrays: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows of PACKED: the arrays split by the bucket of ``key`` (uint64)."""
    bucket = ((key >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
    columns = [pa.array(used, pa.int32()), pa.array([kind] * len(used))]
    for x in [*arrays, *[None] * (4 - len(arrays))]:
        raw = None if x is None else x[order].astype(np.int64)
        columns.append(pa.array([b"" if raw is None else raw[cuts[k]:cuts[k + 1]].tobytes() for k in used], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, schema=PACKED)


def _pack_words(words: list[np.ndarray], owners: list[int], buckets: int) -> Iterator[pa.RecordBatch]:
    """Words and the classes that hold them; of a word met repeatedly, one holder with the count, the others aside."""
    sig = np.concatenate(words)
    did = np.repeat(np.array(owners, np.int64), [len(w) for w in words])
    order = np.argsort(sig, kind="stable")
    sig, did = sig[order], did[order]
    head = np.append(True, sig[1:] != sig[:-1])
    times = np.diff(np.append(np.flatnonzero(head), len(sig)))
    spread = lambda s: mix(s)       # noqa: E731  bits of a word other than its marks decide its bucket
    yield _packed("word", spread(sig[head]), [sig[head], did[head], times], buckets)
    if not head.all():
        yield _packed("held", spread(did[~head].astype(np.uint64)), [sig[~head], did[~head]], buckets)


def _sketches(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        words, owners, size = [], [], 0
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
            rows = np.zeros((len(ids), 4), np.int64)
            for i, hashes in enumerate(shingle_sets(batch.column("text"))):
                n, did = len(hashes), class_key(hashes) if len(hashes) else 0
                given = [0, 0]
                for k, (band, differences) in enumerate(bands(n) if n else []):
                    sig = sketch(hashes, band, differences)
                    given[k] = len(sig)
                    if did not in seen:
                        words.append(sig)
                        owners.append(did)
                        size += len(sig)
                seen.add(did)
                rows[i] = ids[i], did, n, given[0] << 32 | given[1]
                if size >= FLUSH:
                    yield from _pack_words(words, owners, buckets)
                    words, owners, size = [], [], 0
            if len(rows):
                # spread by place, so that repeated ids do not meet
                yield _packed("doc", mix(mix(rows[:, 0].astype(np.uint64)) + np.arange(len(rows), dtype=np.uint64)), list(rows.T), buckets)
        if words:
            yield from _pack_words(words, owners, buckets)

    return docs.select("doc_id", "text").mapInArrow(T.released(run), PACKED_DDL)


def _count_words(table: pa.Table) -> pa.Table:
    """One bucket: documents and set-aside holders as they are, and the words held by two classes or more."""
    def column(kind: str, name: str) -> np.ndarray:
        rows = table.filter(pc.equal(table["kind"], kind))
        return np.frombuffer(b"".join(rows[name].to_pylist()), np.int64)

    out = [(k, [column(k, c) for c in names]) for k, names in (("doc", "abcd"), ("held", "ab"))]
    sig, did, times = (column("word", c) for c in "abc")
    order = np.lexsort((did, sig))
    sig, did, times = sig[order], did[order], times[order]
    if len(sig):
        # the same class from several tasks is one holder
        first = np.append(True, (sig[1:] != sig[:-1]) | (did[1:] != did[:-1]))
        head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        held = np.add.reduceat(np.where(first, times, times - 1), head)
        run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(sig))))
        keep = first & (held[run] > 1)
        out.append(("word", [sig[keep], did[keep], held[run][keep]]))
    columns = {"kind": np.concatenate([np.full(len(x[0]), k, dtype=object) for k, x in out])}
    for i, name in enumerate("abcd"):
        columns[name] = np.concatenate([x[i] if i < len(x) else np.zeros(len(x[0]), np.int64) for _, x in out])
    return pa.table({"kind": pa.array(columns["kind"], pa.string()), **{c: pa.array(columns[c]) for c in "abcd"}})


def _join_words(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, did, n, alone) to be joined on sig: the rarest words of each class's sketches, as many as can differ and one.

    ``alone`` is how many words of its sketch no other class holds.
    """
    words = found.where("kind = 'word'").select(F.col("a").alias("sig"), F.col("b").alias("did"), F.col("c").alias("held"))
    aside = found.where("kind = 'held'").select(F.col("a").alias("sig"), F.col("b").alias("did")).join(
        words.groupBy("sig").agg(F.max("held").alias("held")), "sig")
    rows = words.unionByName(aside).dropDuplicates(["sig", "did"])
    own = F.length(F.bin("n")) - 1
    partner = F.floor(F.col("n") * DENOMINATOR / NUMERATOR)
    gap, both = DENOMINATOR - NUMERATOR, DENOMINATOR + NUMERATOR
    is_own = F.col("sig").bitwiseAND(F.lit(1)) == own % 2
    differences = F.floor(F.when(is_own, gap * (F.col("n") + partner)).otherwise(
        gap * (F.col("n") + F.expr("shiftleft(1L, length(bin(n)) - 1)") - 1)) / both)
    given = F.when(is_own, F.col("given0")).otherwise(F.col("given1"))
    per = Window.partitionBy("did", "is_own")
    rows = (rows.join(classes.select("did", "n", "given0", "given1"), "did").withColumn("is_own", is_own)
            .withColumn("rank", F.row_number().over(per.orderBy((F.col("sig") < 0).cast("int"), "held", "sig")))
            .withColumn("shared", F.count(F.lit(1)).over(per)))
    # words that no other class holds are the rarest and use up places
    return rows.where(F.col("rank") <= differences + 1 - (given - F.col("shared"))).select(
        "sig", "did", "n", (given - F.col("shared")).alias("alone"))


def _filter_of(dids: DataFrame) -> np.ndarray:
    """Bit set of FILTER_BITS by the top bits of the keys: of a fixed size, whatever the number of keys."""
    top = F.shiftrightunsigned("did", 64 - 22)
    rows = dids.groupBy(F.shiftright(top, 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(did, 42) & 31 as int))")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in rows:
        out[r["word"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def sets_of(docs: DataFrame, dids: DataFrame) -> DataFrame:
    """did, hashes, bits of the classes ``dids``, from the whole texts; the filter spares the others' shuffle."""
    wanted = docs.sparkSession.sparkContext.broadcast(_filter_of(dids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, sets, bits = [], [], []
            for hashes in shingle_sets(batch.column("text")):
                did = class_key(hashes) if len(hashes) else 0
                if len(hashes) and did not in seen and wanted.value[(did & (1 << 64) - 1) >> 42]:
                    seen.add(did)
                    keys.append(did)
                    sets.append(hashes.astype(np.int64))
                    bits.append(bit_sketch(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64())),
                                              pa.array(bits, pa.list_(pa.int64()))], ["did", "hashes", "bits"])

    found = docs.select("text").mapInArrow(T.released(run), "did long, hashes array<long>, bits array<long>")
    return found.join(dids, "did", "left_semi").groupBy("did").agg(F.first("hashes").alias("hashes"), F.first("bits").alias("bits"))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets reach the threshold, with their intersection and union."""
    one = sets.select(F.col("did").alias("a"), F.col("hashes").alias("set_a"))
    two = sets.select(F.col("did").alias("b"), F.col("hashes").alias("set_b"))
    sized = pairs.join(one, "a").join(two, "b").select(
        "a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return sized.select("a", "b", "both", (F.col("sum") - F.col("both")).alias("either")).where(
        F.col("both") * DENOMINATOR >= F.col("either") * NUMERATOR)


def components(links: DataFrame) -> DataFrame:
    """did, comp of every end of ``links`` (a, b): comp is the smallest did that links lead to.

    Labels fall to the smallest of the neighbours' and are then followed one step
    further, so that their reach doubles; each round is a written table.
    """
    both = T.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "join-edges")
    labels = T.written(both.groupBy(F.col("a").alias("did")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "join-labels")
    while True:
        near = both.join(labels.select(F.col("did").alias("b"), "comp"), "b").groupBy(F.col("a").alias("did")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "did").select("did", F.least("comp", "near").alias("next"), "comp")
        far = labels.select(F.col("did").alias("next"), F.col("comp").alias("far"))
        stepped = T.written(lower.join(far, "next", "left").select(
            "did", F.least("next", F.coalesce("far", "next")).alias("comp"), F.col("comp").alias("old")), "join-labels")
        labels = stepped.select("did", "comp")
        if stepped.where("comp <> old").isEmpty():
            return labels


def _size_fits(n: Column, other: Column) -> Column:
    return F.least(n, other) * DENOMINATOR >= F.greatest(n, other) * NUMERATOR


def _bits_fit(n: Column, other: Column, bits: str, other_bits: str) -> Column:
    """Whether two bit sketches differ in no more bits than linked sets of these sizes may differ in shingles."""
    apart = sum((F.bit_count(F.col(f"{bits}{i}").bitwiseXOR(F.col(f"{other_bits}{i}"))) for i in range(SKETCH_LONGS)), F.lit(0))
    return apart * (DENOMINATOR + NUMERATOR) <= (n + other) * (DENOMINATOR - NUMERATOR)


def links_between(words: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, components) of classes that share one of ``words`` (sig, did, n, alone)."""
    spark = words.sparkSession
    links = spark.createDataFrame([], "a long, b long, both int, either int")
    tested = spark.createDataFrame([], "a long, b long")
    comps = spark.createDataFrame([], "did long, comp long")
    for turn in range(LEADER_ROUNDS + 1):
        held = words.join(comps, "did", "left").withColumn("comp", F.coalesce("comp", "did"))
        rank = F.col("alone") if turn == 0 else F.xxhash64("did")
        apart = held.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
                                        F.min(F.struct(rank.alias("by"), "did", "comp", "n")).alias("leader")) \
            .where("low <> high").drop("low", "high")
        held = T.written(held.join(apart, "sig"), "join-held")
        if held.isEmpty():
            break
        if turn < LEADER_ROUNDS:
            pairs = held.select("did", "comp", "n", F.col("leader.did").alias("did2"), F.col("leader.comp").alias("comp2"),
                                F.col("leader.n").alias("n2")).where("comp <> comp2").where(_size_fits(F.col("n"), F.col("n2")))
        else:
            bits = sets.select("did", *[F.col("bits")[i].alias(f"w{i}") for i in range(SKETCH_LONGS)])
            one = held.select("sig", "did", "comp", "n").join(bits, "did")
            two = one.select("sig", *[F.col(c).alias(f"{c}2") for c in ("did", "comp", "n")], *[F.col(f"w{i}").alias(f"v{i}") for i in range(SKETCH_LONGS)])
            pairs = one.join(two, (one["sig"] == two["sig"]) & (F.col("did") < F.col("did2")) & (F.col("comp") != F.col("comp2"))
                             & _size_fits(F.col("n"), F.col("n2")) & _bits_fit(F.col("n"), F.col("n2"), "w", "v"))
        pairs = pairs.select(F.least("did", "did2").alias("a"), F.greatest("did", "did2").alias("b")).distinct()
        pairs = T.written(pairs.join(tested, ["a", "b"], "left_anti"), "join-pairs")
        found = T.written(verify(pairs, sets), "join-links")
        tested = tested.unionByName(pairs)
        if not found.isEmpty():
            links = links.unionByName(found)
            comps = components(links)
    return links, comps


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, n_shingles, component_id, n_links of each row, and the verified links of classes.

    Links are between class keys (``did`` of the first frame); those within a
    component that its leaders already hold together are not listed.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = T.written(_sketches(docs, buckets).groupBy("bucket").applyInArrow(_count_words, FOUND_DDL), "join-found")
    rows = found.where("kind = 'doc'").select(
        F.nullif(F.col("a"), F.lit(NO_ID)).alias("doc_id"), F.col("b").alias("did"), F.col("c").alias("n"), F.col("d").alias("given"))
    classes = rows.where("n > 0").groupBy("did").agg(
        F.max("n").alias("n"), F.min("doc_id").alias("first_id"), F.max(F.shiftright("given", 32)).alias("given0"),
        F.max(F.col("given").bitwiseAND(F.lit((1 << 32) - 1))).alias("given1"))
    classes = T.written(classes, "join-classes")
    words = _join_words(found, classes)
    met = words.groupBy("sig").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("sig")
    words = T.written(words.join(met, "sig", "left_semi"), "join-words")
    sets = T.written(sets_of(docs, words.select("did").distinct()), "join-sets")
    links, comps = links_between(words, sets)
    lowest = comps.join(classes.select("did", "first_id"), "did").groupBy("comp").agg(F.min("first_id").alias("component_id"))
    placed = comps.join(lowest, "comp").select("did", "component_id")
    placed = classes.select("did", "first_id").join(placed, "did", "left").select(
        "did", F.coalesce("component_id", "first_id").alias("component_id"))
    linked = rows.where("n > 0").join(placed, "did").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "did")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("did"))
    return linked.unionByName(empty), links


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard similarity 0.8 or more of five-word shingles."""
    documents, _ = join(T.read(spark, sf_dir, "documents"))
    return documents.select("doc_id", "n_shingles", "component_id")
