"""Price parsing; each variant keeps the failure behaviour of the job it serves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def price_digits(text: Column) -> Column:
    """(a) keep digits and dots only."""
    return F.regexp_replace(text, r"[^\d.]", "").try_cast("double")


def price_symbols(text: Column) -> Column:
    """(b) strip currency signs and commas, then the whole rest must be a number.

    The dollar sign goes first, so a ``CA$`` prefix leaves letters and gives NULL.
    """
    bare = F.trim(F.regexp_replace(text, r"[$€,]", ""))
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def price_first_number(text: Column, default: float | None = 0.0) -> Column:
    """(c) the first number of the text, else ``default``."""
    number = F.regexp_extract(F.regexp_replace(text, r"[$€,]", ""), r"(\d+\.?\d*)", 1)
    parsed = F.rtrim(number, F.lit(".")).try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


def price_feed_text(text: Column) -> Column:
    """(d) two-decimal text for the feed; anything unusable is ``0.00``."""
    bare = F.regexp_replace(text, r"[$£€¥\s,]", "")
    value = bare.try_cast("double")
    return F.when(value.isNull(), F.lit("0.00")).otherwise(F.format_string("%.2f", value))


def price_from_block(text: Column, low: float | None = None, high: float | None = None) -> Column:
    """First price in a block of lines, as a number.

    A ``$n`` in a line under 30 characters wins; otherwise the first line that
    is nothing but a number of two to four digits inside [20, 9999]. With
    ``low`` and ``high`` only ``$n`` lines inside that range count.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    dollar = r"\$\s*(\d+\.?\d*)"

    def marked_value(line):
        return _number(F.regexp_extract(line, dollar, 1))

    marked = F.transform(
        F.filter(lines, lambda s: (F.length(s) < 30) & s.rlike(dollar)), marked_value)
    if low is not None:
        return F.get(F.filter(marked, lambda v: v.between(low, high)), F.lit(0))
    bare = F.transform(
        F.filter(lines, lambda s: s.rlike(r"^\$?\d{2,4}\.?\d{0,2}$")),
        lambda s: _number(F.regexp_extract(s, r"(\d+\.?\d*)", 1)))
    bare = F.filter(bare, lambda v: v.between(20, 9999))
    return F.coalesce(F.get(marked, F.lit(0)), F.get(bare, F.lit(0)))


def _number(text: Column) -> Column:
    return F.rtrim(text, F.lit(".")).try_cast("double")
