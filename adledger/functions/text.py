"""Text primitives shared by all extraction rules."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column
from pyspark.sql import functions as F

# sentinels around a scanned match; removed from the input before scanning
_START, _GROUPS, _SEP, _END = "\x01", "\x02", "\x04", "\x03"


def squash(text: Column) -> Column:
    """Collapse every run of (Unicode) white space to one blank and trim."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it as often as ``body`` likes."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null when nothing (or nothing but '') matched."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def digits(text: Column) -> Column:
    """All digits of ``text`` as an integer, null when there are none or too many."""
    return F.regexp_replace(text, r"\D", "").try_cast("int")


def within(value: Column, bounds: tuple[int, int]) -> Column:
    return let(value, lambda v: F.when(v.between(*bounds), v))


def case(branches: list[tuple[Column, str]]) -> Column:
    """First branch whose condition holds, else null."""
    head, *rest = branches
    out = F.when(head[0], F.lit(head[1]))
    for condition, value in rest:
        out = out.when(condition, F.lit(value))
    return out


def join_present(*parts: Column) -> Column:
    """Join the non-empty parts with one blank."""
    return F.concat_ws(" ", *[blank_to_null(p) for p in parts])


def scan(text: Column, pattern: str, *, groups: int, left: int, right: int, shortest: int) -> Column:
    """Every match of ``pattern`` in order, with its groups and its surroundings.

    Gives ``array<struct<g1, .., left, right>>``: ``left`` holds up to that many
    characters before the match, ``right`` after it. Matches are marked with
    sentinels and split apart, so the work is linear in the text. ``shortest`` is
    the least length of a match; it bounds how many neighbouring pieces a context
    can span.
    """
    # a plain search for each mark; translating would look up every character
    clean = reduce(lambda t, mark: F.replace(t, F.lit(mark), F.lit(" ")), (_START, _GROUPS, _END, _SEP), text)
    captured = _SEP.join(f"${g}" for g in range(1, groups + 1))
    marked = F.regexp_replace(clean, pattern, f"{_START}$0{_GROUPS}{captured}{_END}")
    span_left = ceil(left / shortest) + 1
    span_right = ceil(right / shortest) + 1
    copies = f"{_GROUPS}[^{_END}]*{_END}"

    def original(parts: Column) -> Column:
        # without the group copies the text between the marks is whole again
        return F.regexp_replace(F.array_join(parts, ""), copies, "")

    def contexts(pieces: Column, piece: Column, index: Column) -> list[Column]:
        begin = F.greatest(index - span_left, F.lit(0))
        found = []
        if left:
            before = original(F.slice(pieces, begin + 1, index - begin))
            found.append(F.right(before, F.lit(left)).alias("left"))
        if right:
            after = F.concat(
                F.substring_index(piece, _END, -1),
                original(F.slice(pieces, index + 2, F.lit(span_right))),
            )
            found.append(F.substring(after, 1, right).alias("right"))
        return found

    def matches(pieces: Column) -> Column:
        def one(piece: Column, index: Column) -> Column:
            values = F.substring_index(F.substring_index(piece, _END, 1), _GROUPS, -1)
            fields = [
                F.substring_index(F.substring_index(values, _SEP, g + 1), _SEP, -1)
                .alias(f"g{g + 1}")
                for g in range(groups)
            ]
            return F.struct(*fields, *contexts(pieces, piece, index))

        # piece 0 precedes the first match
        return F.slice(
            F.transform(pieces, one), F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))
        )

    return let(F.split(marked, _START), matches)
