"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 8).

Targets are shared out by weight and stop at a number of epochs of a source;
the excess goes to the others by weight (water filling, solved in closed form
over the table of sources). A source whose target is ``e`` epochs and a rest
takes every document ``e`` times, and then whole documents in the order of their
exponential key, -ln(u) / quality, until the rest of the token budget is met.

The prefix sum within a source is never one sorted run: keys fall into bins whose
number follows the number of documents, bin totals are summed up to the bin in
which the budget ends, and only that bin's documents are put in order.

Defined results: a quality that is null or not positive counts as 1e-9; null text has size 0 and is never sampled beyond complete epochs
(which add 0 words); null sources are one source, the last; rows with the same
``doc_id`` share one random number and are ordered by size; an empty table gives
no rows; a table of empty texts has targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm import tables as T

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
DOCS_PER_BIN = 4096


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from the id alone: 52 bits of md5, so reruns and retries agree."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def text_quality(col: str = "text") -> Column:
    """Quality weight of a text, 0.1 to 1: one less the share of the symbols ``#*$%&|<>`` in it, tenfold."""
    text = T.text_or_empty(col)
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - symbols * F.lit(10.0) / F.greatest(F.length(text), F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: one row per source of ``sizes`` (source, size).

    With level L, sources get min(cap, weight * L) where cap = max_epochs * size and
    the sum is ``share`` of all sizes. Sources in order of cap / weight fill up
    first, so L follows from running sums over that order. The windows run over the
    table of sources, one row each.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_nr") % len(weights) + 1).cast("int"))
    per = (per.withColumn("_nr", F.row_number().over(by_name) - 1).withColumn("weight", cycle)
           .withColumn("cap", F.col("source_size") * float(max_epochs)))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "_nr")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    per = per.withColumn("_level", level)
    # the first source in filling order that does not reach its cap sets the level
    per = per.withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.struct(
        (F.col("cap") / F.col("weight")).alias("at"), F.col("_nr").alias("nr"), F.col("_level").alias("level")))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: str = "size", quality: str = "quality", seed: str = "mix",
        docs_per_bin: int = DOCS_PER_BIN, carry: tuple[str, ...] = (), **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, drawn, taken for ``docs`` (doc_id, source, size, quality).

    Columns named in ``carry`` come along.
    """
    weight = F.greatest(F.coalesce(F.col(quality), F.lit(0.0)), F.lit(1e-9))
    rows = T.written(docs.select(
        "doc_id", "source", *carry, F.col(size).alias("size"), weight.alias("quality"),
        (-F.log(uniform(F.col("doc_id"), seed)) / weight).alias("key")), "mix-sizes")
    spread = rows.groupBy(F.col("source").alias("_source")).agg(
        F.min("quality").alias("least"), F.sum("quality").alias("total"))
    share = targets(rows, **settings).join(spread, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    share = T.written(share.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("bins", F.ceil(F.col("total") / F.col("least") / docs_per_bin).cast("long")), "mix-targets")
    # bins of equal width in 1 - exp(-least * key): the density of keys is greatest at 0, total / least
    # documents a unit there, so with that many bins none is expected to hold more than docs_per_bin
    keyed = rows.join(share, rows["source"].eqNullSafe(share["source"])).drop(share["source"]).withColumn(
        "bin", F.floor((F.lit(1.0) - F.exp(-F.col("key") * F.col("least"))) * F.col("bins")).cast("long"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = keyed.groupBy("source", "bin", "rest").agg(F.sum("size").alias("words")) \
        .withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    ends = bins.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))) \
        .select("source", F.col("bin").alias("end_bin"), "before")
    ends = T.written(ends, "mix-ends")
    marked = keyed.join(ends, keyed["source"].eqNullSafe(ends["source"]), "left").drop(ends["source"])
    last = marked.where(F.col("bin") == F.col("end_bin"))
    order = Window.partitionBy("source").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("after", F.col("before") + F.sum("size").over(order))
    # the document in which the budget ends is taken if that comes nearer to the budget than leaving it
    miss = F.col("rest") - (F.col("after") - F.col("size"))
    drawn = (F.col("after") <= F.col("rest")) | ((miss > 0) & (F.col("after") - F.col("rest") < miss))
    first = marked.where(F.col("end_bin").isNull() | (F.col("bin") != F.col("end_bin")))
    # without a bin in which the budget ends, it is 0 or the whole source
    whole = F.when(F.col("end_bin").isNull(), F.col("rest") > 0).otherwise(F.col("bin") < F.col("end_bin"))
    out = ("doc_id", "source", *carry, "size", "source_size", "target", "epochs")
    done = first.select(*out, whole.alias("drawn")).unionByName(last.select(*out, drawn.alias("drawn")))
    return done.withColumn("taken", F.col("size") * (F.col("epochs") + F.col("drawn").cast("long")))


def measured(docs: DataFrame, *carry: str) -> DataFrame:
    """Sizes and qualities of documents."""
    return docs.select("doc_id", "source", *carry, T.n_words().alias("size"), text_quality().alias("quality"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: words taken of each."""
    return mix(measured(T.read(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    greatest(0.1::DOUBLE, 1.0::DOUBLE - (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))
      * 10.0::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS quality,
    (('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / quality AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % 3 + 1]::DOUBLE AS weight FROM k GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lv
      FROM c WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT lv FROM l WHERE lv * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1) * weight, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size, k.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS after
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN rest > 0 AND (after <= rest OR (rest - (after - size) > 0 AND after - rest < rest - (after - size))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r"""
