"""Scalar expressions built from ``pyspark.sql.functions`` only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a run of the characters that Java's regex class \s stands for.
JAVA_SPACE_RUN = r"[ \t\n\x0B\f\r]+"
# Fixed value: a character that Java does not count as whitespace (Unicode-aware).
NONBLANK_PATTERN = r"[^\p{javaWhitespace}]"
# Fixed value: optional scheme, optional "www.", then the host.
URL_HOST_PATTERN = r"^(?:https?://)?(?:www\.)?([A-Za-z0-9._%+-]+)/?.*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _java_split(text: Column, pattern: str) -> Column:
    """Java's ``split``: a leading empty item stays, trailing empty items go.

    ``pattern`` must match a whole run of trailing separators at once, so at most one
    empty item ends the parts, or two make up the parts of a text of separators alone.
    """

    def without_trailing(parts: Column) -> Column:
        n = F.size(parts)
        alone = (n == 2) & (F.get(parts, F.lit(0)) == "")
        ends_empty = (text != "") & (F.element_at(parts, -1) == "")
        kept = F.when(alone, F.lit(0)).otherwise(n - F.lit(1))
        return F.when(ends_empty, F.slice(parts, F.lit(1), kept)).otherwise(parts)

    # The lambda names the parts, so a long text is split once and not per mention.
    return F.get(F.transform(F.array(F.split(text, pattern)), without_trailing), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Whitespace tokens of a text; ``''`` has one empty token, blanks alone have none."""
    return _java_split(_col(text), JAVA_SPACE_RUN)


def comma_fields(line: Column | str) -> Column:
    """Comma-separated fields of a line without its trailing empty fields."""
    return _java_split(_col(line), ",+$|,")


def is_nonblank(text: Column | str) -> Column:
    """True for text with a character other than whitespace; false for null."""
    text = _col(text)
    return text.isNotNull() & text.rlike(NONBLANK_PATTERN)


def nonblank_items(items: Column | str) -> Column:
    """The array without its null and blank items, order kept."""
    return F.filter(_col(items), is_nonblank)


def first_nonblank(items: Column | str) -> Column:
    return F.get(nonblank_items(items), F.lit(0))


def wide_key(text: Column | str) -> Column:
    """A 64-bit key of an identifier; null for null.

    Of a hundred million identifiers, two share a key with a chance of 1 in 3,700. For keys
    that never collide, take the text itself: every graph operator takes texts as well.
    """
    text = _col(text)
    return F.when(text.isNotNull(), F.xxhash64(text))


def java_hash(text: Column | str) -> Column:
    """The 32-bit string hash of the JVM, widened to BIGINT; null for null.

    It calls the JVM's own method, several times faster than folding over the characters
    with a lambda. 32 bits collide, so that strangers become one: use it only where ids
    must equal those of a JVM job, and ``wide_key`` or the text itself elsewhere. Catalyst
    takes the call for nondeterministic and pushes no filter below it: filter first.
    """
    text = _col(text)
    hashed = F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), text)
    return F.when(text.isNotNull(), hashed.cast("bigint"))


def url_host(url: Column | str) -> Column:
    """Host part of a URL without ``www.``; ``'none'`` where the pattern does not match."""
    host = F.regexp_extract(_col(url), URL_HOST_PATTERN, 1)
    return F.when(host == "", F.lit("none")).otherwise(host)


def contains_literal(items: Column | str, literal: str) -> Column:
    """Array membership by equality: the literal is never read as a pattern."""
    return F.array_contains(_col(items), F.lit(literal))


def compare_to_range(x: Column | str, start: Column | str, end: Column | str) -> Column:
    """-1 below the range, 0 inside (both ends belong to it), 1 above."""
    x = _col(x)
    return F.when(x < _col(start), F.lit(-1)).when(x > _col(end), F.lit(1)).otherwise(F.lit(0))


def within_seconds(first: Column | str, second: Column | str, seconds: int = 600) -> Column:
    """True when ``second`` comes at most so many seconds after ``first``.

    There is no lower limit: a second time before the first one passes too.
    """
    return (_col(second) - _col(first)) <= F.make_dt_interval(secs=F.lit(seconds))


def count_at_most(sorted_points: Column, point: Column, longest: int) -> Column:
    """How many items of an ascending array are <= ``point``, by binary search.

    ``longest`` is an upper bound of the array's length.
    """
    steps = [2**k for k in reversed(range(max(1, longest).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda found, s: F.when(
            F.get(sorted_points, found + s - F.lit(1)) <= point, found + s
        ).otherwise(found),
    )
