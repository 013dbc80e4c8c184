"""Key tables and skew helpers shared by the join operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shuffled(df: DataFrame) -> DataFrame:
    """A side of joins that is shuffled and sorted, whatever size the optimizer expects it to have.

    Sizes are expected from compressed files and column types: a key table of a million urls, a table of exploded pieces
    or staged titles count a few megabytes and take hundreds in the driver and each executor when broadcast.
    """
    return df.hint("merge")


def spread_nulls(key: Column, by: Column) -> Column:
    """Replace NULL keys by values that match nothing, one per value of ``by``.

    A left join sends every NULL key to the same task; rows without a code or
    title would pile up there.
    """
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(by).cast("string")))


def smallest_per_key(table: DataFrame, keys: dict[str, Column], value: str, name: str) -> DataFrame:
    """One row per key with the smallest ``value``: the deterministic tie-break.

    A plain aggregate, so hot keys shrink to one row per map task before the
    shuffle. The table is never broadcast.
    """
    keyed = table.select(*[c.alias(k) for k, c in keys.items()], F.col(value).alias(name))
    for k in keys:
        keyed = keyed.filter(F.col(k).isNotNull())
    return shuffled(keyed.groupBy(*keys).agg(F.min(name).alias(name)))


def smallest_of_levels(levels: dict[str, tuple[DataFrame, dict[str, Column], str]]) -> DataFrame:
    """:func:`smallest_per_key` of several levels that look the same key up, as one table.

    ``levels`` has (table, keys, value) by the name of the level's column. A key that any of them has is one row, so
    the listings meet all levels in one join.
    """
    every = None
    for name, (table, keys, value) in levels.items():
        values = [F.when(F.lit(other == name), F.col(value)).alias(other) for other in levels]
        rows = table.select(*[c.alias(k) for k, c in keys.items()], *values)
        for k in keys:
            rows = rows.filter(F.col(k).isNotNull())
        every = rows if every is None else every.unionByName(rows)
    return shuffled(every.groupBy(*keys).agg(*[F.min(name).alias(name) for name in levels]))


def first_of(*pairs) -> Column:
    """First non-null of (test, value) pairs, in order."""
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def spread_for_compute(df: DataFrame, *keys: str) -> DataFrame:
    """Full shuffle width ahead of a stage whose cost is computing, not bytes.

    Adaptive execution merges partitions by size; exploding titles into pieces
    or scoring pairs multiplies the work per byte, so an explicit number of
    partitions keeps every core busy. Rows must already be distinct on ``keys``.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read as values and do not recompute.

    A column used in many places is otherwise copied into each of them, and a
    parsed page would be parsed once per field. A generator over a one-element
    array is not merged with its neighbours.
    """
    values = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(values)))
