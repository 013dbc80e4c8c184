"""Sequence similarity and its exact native bounds.

The ratio is ``2 * M / (len(a) + len(b))`` where M counts the characters in the
matching blocks found by longest-match recursion. It has no built-in form, so
the score itself is an Arrow UDF; everything that decides which pairs reach it
is a native expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPS = 1e-9


def sequence_ratio():
    """Arrow UDF ``(left, right) -> double``; the left argument comes first.

    Built inside a function so that it ships to the workers by value. Pairs are
    visited in order of the right text, because the matcher indexes that side.

    Marked non-deterministic on purpose: a filter on a deterministic score of
    two grouping columns is pushed below the aggregates and into the join, and
    the function would then run once per join row and not once per pair.
    """

    @F.pandas_udf("double")
    def score(left, right):
        from difflib import SequenceMatcher

        import numpy as np
        import pandas as pd

        a, b = left.to_numpy(object), right.to_numpy(object)
        out = np.full(len(a), np.nan)
        matcher, current = SequenceMatcher(None, "", ""), None
        usable = [i for i in range(len(a)) if a[i] is not None and b[i] is not None]
        for i in sorted(usable, key=lambda j: b[j]):
            if b[i] != current:
                current = b[i]
                matcher.set_seq2(current)
            matcher.set_seq1(a[i])
            out[i] = matcher.ratio()
        return pd.Series(out).where(~np.isnan(out), None)

    return score.asNondeterministic()


#: From this length of the right text on the matcher leaves frequent characters out.
FREQUENT_FROM = 200


def settled_ratio(left: Column, right: Column) -> Column:
    """The ratio where it needs no matching, else NULL: texts that are equal, contain one another or share no character."""
    a, b = F.length(left), F.length(right)
    inside = F.contains(left, right) | F.contains(right, left)
    closed = F.when((a == 0) & (b == 0), 1.0).when(inside, 2.0 * F.least(a, b) / (a + b)).when(bag_bound(left, right) == 0, 0.0)
    return F.when(b < FREQUENT_FROM, closed)


def min_length(length: Column, threshold: float) -> Column:
    """Shortest text that can reach ``threshold`` against one of ``length``."""
    return F.ceil(length * F.lit(threshold / (2 - threshold)) - F.lit(_EPS)).cast("int")


def max_length(length: Column, threshold: float) -> Column:
    return F.floor(length * F.lit((2 - threshold) / threshold) + F.lit(_EPS)).cast("int")


def max_edits(length: Column, threshold: float) -> Column:
    """Most insertions plus deletions any partner at ``threshold`` can need."""
    return F.floor(length * F.lit(2 * (1 - threshold) / threshold) + F.lit(_EPS)).cast("int")


def pair_edits(left_len: Column, right_len: Column, threshold: float) -> Column:
    """Most insertions plus deletions of one pair at ``threshold``."""
    return F.floor((left_len + right_len) * F.lit(1 - threshold) + F.lit(_EPS)).cast("int")


def piece_width(length: Column, threshold: float) -> Column:
    """Width of the pieces a text is cut into.

    With ``max_edits + 1`` disjoint pieces of this width at least one survives
    unchanged in every partner that reaches the threshold (pigeonhole).
    """
    return F.floor(length / (max_edits(length, threshold) + 1)).cast("int")


def pieces(text: Column, threshold: float) -> Column:
    """Disjoint pieces covering the text, as many as its width allows."""
    width = piece_width(F.length(text), threshold)
    count = F.floor(F.length(text) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1),
                       lambda i: F.substring(text, i * width + 1, width))


def grams_for_partners(text: Column, threshold: float) -> Column:
    """Substrings a partner's surviving piece can equal, each with its place (from 0)."""
    size = F.length(text)
    lengths = F.sequence(F.greatest(min_length(size, threshold), F.lit(1)),
                         max_length(size, threshold))
    widths = F.array_distinct(F.transform(lengths, lambda n: piece_width(n, threshold)))
    widths = F.filter(widths, lambda w: w <= size)
    return F.flatten(F.transform(
        widths,
        lambda w: F.transform(F.sequence(F.lit(0), size - w),
                              lambda i: F.struct(F.substring(text, i + 1, w).alias("piece"), i.alias("place")))))


def unharmed(shift: Column, left_len: Column, right_len: Column, threshold: float) -> Column:
    """Whether a piece of the left text may stand unharmed ``shift`` places on in the right text.

    A piece moves by the insertions less the deletions before it; those behind it make up the rest of the difference
    in length. Together they are no more than the pair's edits.
    """
    return F.abs(shift) + F.abs(right_len - left_len - shift) <= pair_edits(left_len, right_len, threshold)


def outermost(nth: Column, shift: Column, rest: Column, edits: Column) -> Column:
    """Whether a piece may be the first unharmed one from an end, with ``nth`` pieces between it and that end.

    Go through the pieces from the end and stop at the first up to whose far side there are at most ``nth`` edits. There
    is one, as there are more pieces than edits. Before it there are exactly ``nth`` edits and in it none, so it is
    moved against that end by at most ``nth``, and by an odd number if ``nth`` is odd; against the other end by no
    more than the edits that are left.
    """
    return (F.abs(shift) <= nth) & (F.pmod(shift + nth, F.lit(2)) == 0) & (F.abs(rest) <= edits - nth)


def char_bag(text: Column) -> Column:
    """Characters labelled by occurrence, so set intersection counts multisets.

    The sorted characters are bound once by a one-element outer transform; named
    directly inside the inner lambda they would be sorted again per character.
    """
    ordered = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.get(F.transform(F.array(ordered), lambda chars: F.transform(
        chars, lambda c, i: F.concat(
            c, (i.cast("long") - F.array_position(chars, c)).cast("string")))), F.lit(0))


def bag_bound(left: Column, right: Column) -> Column:
    """Upper bound of the ratio from the common character multiset."""
    common = F.size(F.array_intersect(char_bag(left), char_bag(right)))
    return F.lit(2.0) * common / (F.length(left) + F.length(right))
