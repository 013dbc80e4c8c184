"""Connected components of a link table by alternating large and small stars.

Every round is a few aggregates and joins over the links, written to the shared folder. No node's neighbours are
gathered: a node only learns their minimum, which is combined before the shuffle, and joins split hot nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import staged, staged_few


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links of a node's larger (or not larger) neighbours moved to its smallest neighbour."""
    if large:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = sides.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, label: str = "components", rows: int | None = None) -> DataFrame:
    """(id, component) of every id of ``links`` (a, b); the component is its smallest id. ``rows``: about how many links, if known."""
    links = links.select("a", "b").where("a <> b").distinct()
    now = staged(links, label) if rows is None else staged_few(links, label, rows)
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
    seen = mark(now)
    while seen[0]:
        now = staged_few(_star(_star(now, True), False), label, seen[0])  # a round never has more links than nodes and links before
        before, seen = seen, mark(now)
        if seen == before:
            break
    found = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
