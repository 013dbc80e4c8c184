"""Connected groups of a link table in logarithmic rounds.

Alternating stars: a node's larger neighbours move to its smallest neighbour, then its other neighbours do. A chain
of n links is a star after about log2(n) rounds. A round is two aggregates and joins, written to the shared folder;
no node's neighbours are ever gathered, a node only learns the smallest of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.session import staged


def _to_smallest(links: DataFrame, larger: bool) -> DataFrame:
    u, v = F.col("a").alias("u"), F.col("b").alias("v")
    if larger:
        ends = links.select(u, v).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = ends.join(least, "u")
    if larger:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected(links: DataFrame) -> tuple[DataFrame, int]:
    """(id, group) of every id of ``links`` (a, b), the group being its smallest id, and the rounds it took."""
    now = staged(links.select("a", "b").filter("a <> b").distinct(), "group-links")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
    seen, rounds = state(now), 0
    while seen[0]:
        now = staged(_to_smallest(_to_smallest(now, True), False), "group-links")
        rounds += 1
        before, seen = seen, state(now)
        if before == seen:
            break
    members = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("group"))
    return members.unionByName(members.select(F.col("group").alias("id"), "group").distinct()), rounds
