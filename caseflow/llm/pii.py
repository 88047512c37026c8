"""PII spans: patterns propose, checksums confirm, nearby words adjust the score (operator 9).

All column expressions, no Python on the executors. ``split`` and
``regexp_extract_all`` with one pattern cut a text into the parts around the
matches and the matches themselves, so running sums of their lengths give the
spans in code points. The sums run within chunks of matches and over the chunks, and
contexts are read from pieces of the text, so a text of many megabytes with a match
every few characters takes little more than linear time.

A kind that the base does not ask for counts only from ``LEAST_SCORE`` on: a secret
needs letters and digits mixed in it, and a word that calls it one before it or near it.

Defined results: null and empty texts have no spans; whole texts are searched, however
long; spans of different kinds may overlap, and those of one kind never do; every row
keeps its own result, so repeated rows and ids do no harm; an empty table gives no rows;
other columns are passed through untouched, but for ``pii_spans``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import tables as T

SPAN_TYPE = "array<struct<kind:string,start:int,end:int,match:string,score:double>>"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data: its pattern, what a text must hold for it, and its context words."""

    name: str
    pattern: str
    hint: str                   # a cheap pattern; a text without it is not searched
    context: tuple[str, ...]
    base_score: float
    least_score: float = 0.0    # a span below it is not told


# The patterns never back-track over long runs: quantifiers are possessive where what
# follows cannot match inside the run, and a match starts at the head of its run or
# where the match before it ended (\G), as a plain leftmost search would find it.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "@", ("mail", "contact", "write"), 0.9),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", ("ip", "host", "server", "address"), 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]", ("card", "visa", "credit", "payment"), 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", ("phone", "tel", "call", "fax"), 0.6),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [0-9]{1,3})?)(?![A-Za-z0-9_])",
         "[A-Z]{2}[0-9]{2}",
         ("iban", "account", "bank"), 0.8),
    Kind("secret", r"(?<![A-Za-z0-9/+_-])[A-Za-z0-9/+_-]{20,200}+(?![A-Za-z0-9/+_-])", "[A-Za-z0-9/+_-]{20}",
         ("token", "secret", "passw", "api_key", "apikey", "api key", "credential", "private key"), 0.75, 0.8),
)
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.1
#: Matches whose starts are summed at a time, and characters of a piece of the text.
CHUNK, PIECE = 256, 512


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check (from the right, every second digit doubled)."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def mod97(s: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97-10 (first four characters moved to the end)."""
    moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97) \
        .when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The check a proposed match must pass."""
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(match, r"\."), lambda p: F.when(F.length(plain(p)) <= 3, plain(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        s = F.translate(match, " ", "")
        return F.when(F.length(s).between(15, 34), mod97(s)).otherwise(False)
    if kind == "secret":
        return match.rlike("[0-9].*[0-9].*[0-9]") & match.rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]")
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def _before(sizes: Column) -> Column:
    """Sum of the elements before each one."""
    grow = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))

    def add(acc: Column, size: Column) -> Column:
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    def chunked(s: Column) -> Column:
        n = F.size(s)
        chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda k: F.aggregate(
            F.sequence(k * CHUNK, F.least((k + 1) * CHUNK, n) - 1), grow, lambda acc, i: add(acc, F.get(s, i))))
        return _let(chunks, lambda c: _let(F.aggregate(c, grow, lambda acc, x: add(acc, x["at"]))["starts"], lambda bases: F.flatten(
            F.transform(c, lambda x, k: F.transform(x["starts"], lambda v: v + F.get(bases, k))))))

    return _let(sizes, chunked)


def spans_of(kind: Kind, text: Column) -> Column:
    """Confirmed spans of one kind, in order: array of (kind, start, end, match, score)."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    parts = F.split(text, kind.pattern, -1)
    none = F.expr(f"cast(array() as {SPAN_TYPE})")

    def located(x: Column) -> Column:
        sizes = F.transform(x["parts"], lambda p, i: F.length(p) + F.coalesce(F.length(F.get(x["matches"], i)), F.lit(0)))
        return _let(_before(sizes), lambda before: F.filter(
            F.transform(x["matches"], lambda m, i: F.struct(
                (F.get(before, i) + F.length(F.get(x["parts"], i))).alias("start"), m.alias("match"))),
            lambda s: confirmed(kind.name, s["match"])))

    def window(pieces: Column, start: Column, size: int) -> Column:
        """``size`` characters from ``start``, of two neighbouring pieces."""
        k = F.floor(start / PIECE).cast("int")
        return F.substring(F.concat(F.get(pieces, k), F.coalesce(F.get(pieces, k + 1), F.lit(""))), start - k * PIECE + 1, F.lit(size))

    def scored(found: Column, pieces: Column) -> Column:
        near = "|".join(kind.context)

        def score(s: Column) -> Column:
            end = s["start"] + F.length(s["match"])
            ahead = F.substring(window(pieces, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), CONTEXT_CHARS),
                                F.lit(1), F.least(s["start"], F.lit(CONTEXT_CHARS)))
            around = F.lower(F.concat(ahead, F.lit(" "), F.coalesce(window(pieces, end, CONTEXT_CHARS), F.lit(""))))
            return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), end.alias("end"), s["match"].alias("match"),
                            (F.lit(kind.base_score) + F.when(around.rlike(near), CONTEXT_BONUS).otherwise(0.0)).alias("score"))

        return F.filter(F.transform(found, score), lambda s: s["score"] >= kind.least_score)

    found = _let(F.struct(parts.alias("parts"), matches.alias("matches")), located)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    told = _let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(_let(pieces, lambda p: scored(f, p)).cast(SPAN_TYPE)))
    return F.when(text.rlike(kind.hint), told).otherwise(none).cast(SPAN_TYPE)


def detect(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, min_score: float = 0.0) -> DataFrame:
    """Add ``pii_spans``: all confirmed spans scoring ``min_score`` or more, by kind as listed, then start."""
    body = T.text_or_empty(text)
    every = reduce(lambda a, b: F.concat(a, b), [spans_of(k, body) for k in kinds])
    if min_score > 0:
        every = F.filter(every, lambda s: s["score"] >= min_score)
    return docs.withColumn("pii_spans", every)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span of ``pii_spans`` by its kind in brackets; a span overlapping an earlier one goes with it."""
    ordered = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                                       s["kind"].alias("kind"))))
    body = T.text_or_empty(text)
    out = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("s")),
        lambda acc, x: F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["s"].alias("s")))
        .otherwise(F.struct(x["end"].alias("at"), F.concat(
            acc["s"], F.substring(body, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]")).alias("s"))))
    return docs.withColumn(text, F.concat(out["s"], F.substring(body, out["at"] + 1, F.lit(2**31 - 1))))


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text of documents: counts, span lists, and the spans' scores in percent."""
    found = detect(T.read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii_spans")
    # spans are read several times below; a generator keeps Spark from inlining the search into each use
    found = found.select("doc_id", F.explode(F.array("pii_spans")).alias("pii_spans"))
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("pii_spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_listing(base), 256).alias("base_sha256"),
                        _listing(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"), scores.alias("scores"))


def _sql_kind(name: str, pattern: str, ok: str) -> str:
    """DuckDB: confirmed spans of one kind as a list of ('kind:start:end', score in percent)."""
    [kind] = [k for k in KINDS if k.name == name]
    near = "|".join(kind.context)
    context = (f"lower(substr(t, greatest(x.s - {CONTEXT_CHARS}, 0) + 1, least(x.s, {CONTEXT_CHARS})) || ' ' || "
               f"substr(t, x.s + length(x.m) + 1, {CONTEXT_CHARS}))")
    base = round(kind.base_score * 100)
    return f"""
      list_filter(list_transform(list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
          'm': regexp_extract_all(t, '{pattern}')[i],
          's': list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda p: length(p)))::BIGINT
             + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i - 1], lambda p: length(p))), 0)::BIGINT}}),
        lambda x: {ok}), lambda x: {{'span': '{name}:' || x.s || ':' || (x.s + length(x.m)),
                                     'score': CASE WHEN regexp_matches({context}, '{near}') THEN {base + round(CONTEXT_BONUS * 100)} ELSE {base} END}}),
        lambda x: x.score >= {round(kind.least_score * 100)})"""


_DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k:
    CASE WHEN (length({_DIGITS}) - k) % 2 = 0 THEN substr({_DIGITS}, k, 1)::INT
         WHEN substr({_DIGITS}, k, 1)::INT > 4 THEN substr({_DIGITS}, k, 1)::INT * 2 - 9
         ELSE substr({_DIGITS}, k, 1)::INT * 2 END)) % 10 = 0"""
_COMPACT = "replace(x.m, ' ', '')"
_MOD97 = f"""list_reduce(list_prepend(0, list_transform(string_split(substr({_COMPACT}, 5) || substr({_COMPACT}, 1, 4), ''), lambda c:
    CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
    lambda a, b: CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b) % 97 END) = 1"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id,
   {_sql_kind('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')} AS email,
   {_sql_kind('ip', '[0-9]+(?:[.][0-9]+){3}', "len(list_filter(string_split(x.m, '.'), lambda p: TRY_CAST(p AS HUGEINT) IS NULL OR TRY_CAST(p AS HUGEINT) > 255)) = 0")} AS ip,
   {_sql_kind('card', '[0-9](?:[ -]?[0-9])+', f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END")} AS card,
   {_sql_kind('phone', '[+][0-9][ ().0-9-]+[0-9]', f"length({_DIGITS}) BETWEEN 9 AND 15")} AS phone,
   {_sql_kind('iban', '\\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [0-9]{1,3})?)\\b', f"CASE WHEN length({_COMPACT}) BETWEEN 15 AND 34 THEN {_MOD97} ELSE false END")} AS iban,
   {_sql_kind('secret', '[A-Za-z0-9/+_-]{20,}', "length(x.m) <= 200 AND regexp_matches(x.m, '[0-9].*[0-9].*[0-9]') AND regexp_matches(x.m, '[A-Za-z].*[A-Za-z].*[A-Za-z]')")} AS secret
 FROM d),
a AS (SELECT *, email || ip || card || phone AS base, email || ip || card || phone || iban || secret AS every FROM f)
SELECT doc_id, len(email)::BIGINT AS n_email, len(ip)::BIGINT AS n_ip, len(card)::BIGINT AS n_card, len(phone)::BIGINT AS n_phone,
       sha256(array_to_string(list_transform(base, lambda x: x.span), ',')) AS base_sha256,
       array_to_string(list_transform(every, lambda x: x.span), ',') AS spans, len(every)::BIGINT AS n_spans,
       array_to_string(list_transform(every, lambda x: x.score::VARCHAR), ',') AS scores
FROM a"""
