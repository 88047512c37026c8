"""Scalar column expressions.

Every function takes and returns a ``Column`` built from Spark's own SQL
functions, so it stays inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Python's str.isspace() also treats the four ASCII separators \x1c-\x1f as
# whitespace; Java's Unicode White_Space class does not, so they are listed.
_PY_SPACE = r"\s\x1c-\x1f"
# The same characters one by one: Java's Unicode White_Space class and the four separators.
_SPACES = [chr(i) for i in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                            0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
# Lower-case ASCII words, single blanks, underscores or hyphens between them: a slug but for those.
_WORDS = r"^[a-z0-9]+(?:[ _-][a-z0-9]+)*\z"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: ColumnOrName) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace (``trim`` only drops spaces).

    The regex runs only where the first or the last character is one.
    """
    c = _c(c)
    edge = F.substring(c, 1, 1).isin(_SPACES) | F.substring(c, -1, 1).isin(_SPACES)
    return F.when(edge, F.regexp_replace(c, rf"(?U)^[{_PY_SPACE}]+|[{_PY_SPACE}]+$", "")).otherwise(c)


def slug(c: ColumnOrName) -> Column:
    """X1 slugify: lower, drop punctuation, whitespace/underscores -> '-', collapse, trim '-'.

    Empty result -> null. Letters and digits are matched by Unicode class so
    accented names keep their letters. Plain words need only their blanks and
    underscores replaced; one ASCII regex tells them from the rest.
    """
    low = F.lower(_c(c))
    words = F.replace(F.replace(low, F.lit(" "), F.lit("-")), F.lit("_"), F.lit("-"))
    s = F.regexp_replace(low, rf"(?U)[^\p{{L}}\p{{N}}_{_PY_SPACE}-]", "")
    # whitespace/underscore runs -> '-' and then '-' runs -> '-' is the same as
    # turning every run of [whitespace _ -] into one '-': one regex pass, not two
    s = F.regexp_replace(s, rf"(?U)[{_PY_SPACE}_-]+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    return F.nullif(F.when(low.rlike(_WORDS), words).otherwise(s), F.lit(""))


NOT_ASCII = "[^\\x00-\\x7F]"


def url_slug(c: ColumnOrName, normalize: bool = True) -> Column:
    """X2 URL slug: NFC, lower, drop apostrophes, runs of [^a-z0-9] -> '-', trim '-'.

    Spark SQL has no Unicode normaliser, so NFC runs in an Arrow-batched,
    vectorised pandas UDF (``Series.str.normalize``); every other step is a
    native expression. Spark ships every row of a batch to the UDF, so pass
    ``normalize=False`` for values known to be composed, as ASCII ones are
    (``conform.add_url_slugs`` parts the rows of a table by that).
    """
    col = _c(c)
    if normalize:
        from caseflow.functions._nfc import nfc
        col = F.when(col.rlike(NOT_ASCII), nfc(col)).otherwise(col)
    s = F.regexp_replace(F.lower(col), "'", "")
    s = F.regexp_replace(s, "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.regexp_replace(s, "-+", "-")


def truncate_period(ts: ColumnOrName, granularity: str = "month", strict: bool = False) -> Column:
    """X3 DATE_TRUNC to 'month' or 'week' (Monday); other values fall back to month.

    Truncates the calendar date (``trunc``) and returns timestamp_ntz, so the
    result never depends on the session time zone (``date_trunc`` would go
    through a zoned timestamp).
    """
    g = check_granularity(granularity, strict)
    return F.trunc(F.to_date(_c(ts)), g).cast("timestamp_ntz")


def check_granularity(granularity: str, strict: bool = False) -> str:
    if granularity in ("month", "week"):
        return granularity
    if strict:
        raise ValueError(f"granularity must be 'month' or 'week', got {granularity!r}")
    return "month"


def iso_date(ts: ColumnOrName) -> Column:
    """X4 ``strftime('%Y-%m-%d')``; null stays null."""
    return F.date_format(_c(ts), "yyyy-MM-dd")


def days_before(ts: ColumnOrName, days: int) -> Column:
    """X5 ``ts - INTERVAL n DAYS``."""
    return _c(ts) - F.expr(f"INTERVAL {int(days)} DAYS")


def title_from_slug(c: ColumnOrName) -> Column:
    """X6 ``s.replace('-', ' ').title()``.

    ``initcap`` only capitalises after spaces; Python's title() starts a new
    word after any non-letter (``h1n1`` -> ``H1N1``), so each letter run is
    capitalised on its own.
    """
    spaced = F.regexp_replace(_c(c), "-", " ")
    parts = F.regexp_extract_all(spaced, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def contains_ci(c: ColumnOrName, needle: str) -> Column:
    """X7 ``LOWER(c) LIKE '%needle%'``."""
    return F.lower(_c(c)).like(f"%{needle.lower()}%")


def source_rank(c: ColumnOrName, priority: Iterable[str]) -> Column:
    """X8 CASE rank by an ordered source list; unlisted sources rank after all listed ones."""
    order = list(priority)
    expr = None
    for i, name in enumerate(order, start=1):
        expr = F.when(_c(c) == name, F.lit(i)) if expr is None else expr.when(_c(c) == name, F.lit(i))
    return F.lit(len(order) + 1) if expr is None else expr.otherwise(F.lit(len(order) + 1))


def map_lookup(c: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """Literal map lookup (null when absent); the map is a constant folded into the plan."""
    return F.try_element_at(_create_map(mapping), _c(c))


def map_upper(c: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """X9 ``upper(c)`` then map; null when absent."""
    return F.try_element_at(_create_map(mapping), F.upper(_c(c)))


def _create_map(mapping: Mapping[str, str]) -> Column:
    flat = []
    for k, v in mapping.items():
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def round_half_even(c: ColumnOrName, digits: int = 2) -> Column:
    """X10 Python ``round(x, n)``: the double's exact value to the nearest n-digit decimal, ties to even.

    ``bround`` rounds the double's shortest decimal text instead, which makes ties
    of values that only print like one. Here x * 2 * 10**n is held against the odd
    integer of the nearest tie without error: x is split into two halves of 26 bits
    (Dekker), whose products with so small a factor are exact. For |x| below about
    2**50 / 10**n.
    """
    scale = float(10 ** digits)
    x = F.abs(_c(c).cast("double"))
    big = x * F.lit(134217729.0)                       # 2**27 + 1
    high = big - (big - x)
    low = x - high
    floor = F.floor(x * F.lit(scale)).cast("double")
    over = (high * F.lit(2 * scale) - (floor * 2.0 + 1.0)) + low * F.lit(2 * scale)
    up = (over > 0) | ((over == 0) & (F.pmod(floor, F.lit(2.0)) == 1.0))
    return F.signum(_c(c)) * (floor + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)


def percent_of(part: ColumnOrName, total: ColumnOrName) -> Column:
    """X11 ``part / total * 100`` if total > 0 else 0.0 (never divides by zero under ANSI)."""
    return F.when(_c(total) > 0, _c(part).cast("double") / _c(total) * F.lit(100.0)).otherwise(F.lit(0.0))


def zfill(c: ColumnOrName, width: int = 2) -> Column:
    """X12 ``str.zfill``: left-pad with zeros, never truncate."""
    return F.when(F.length(_c(c)) < width, F.lpad(_c(c), width, "0")).otherwise(_c(c))


def quantile_bin(c: ColumnOrName, breaks: Column) -> Column:
    """X13 bisect-right of ``c`` in a sorted array of thresholds -> 0..len(breaks).

    Null (no data) and zero values give a null bin.
    """
    hits = F.aggregate(breaks, F.lit(0), lambda acc, t: acc + F.when(_c(c) >= t, 1).otherwise(0))
    return F.when(_c(c).isNull() | (_c(c) <= 0), F.lit(None).cast("long")).otherwise(hits.cast("long"))


def zero_if_null(c: ColumnOrName) -> Column:
    """X15 ``int(x) if x else 0``."""
    return F.coalesce(_c(c), F.lit(0)).cast("long")


def non_blank(c: ColumnOrName) -> Column:
    """F7 predicate: not null and not the empty string."""
    return _c(c).isNotNull() & (_c(c) != "")


def interleave_bits(a: ColumnOrName, b: ColumnOrName, bits: int) -> Column:
    """Z-order key: the lowest ``bits`` bits (31 at most) of two integers in turn, ``a`` ahead of ``b``."""
    return F.shiftleft(_spread_bits(a, bits), 1).bitwiseOR(_spread_bits(b, bits))


def _spread_bits(c: ColumnOrName, bits: int) -> Column:
    """The lowest ``bits`` bits with a zero ahead of each: halves, quarters and so on are moved apart."""
    out = _c(c).cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        if shift < bits:
            out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return out
