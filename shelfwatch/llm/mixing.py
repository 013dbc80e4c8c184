"""Mixing overlapping sources to target weights by a min-cost flow.

A document may belong to several sources. Spark sums tokens by membership pattern (the set of sources), a small flow
problem on the driver routes each pattern's tokens to the sources' quotas, and Spark then selects documents in a
seeded order until each pattern's share is used up. The k-th use of a pattern's tokens costs k - 1, so nothing is
repeated while something unused could serve ("convex repetition costs"), and at most ``max_epochs`` uses exist.

The driver sees one row per pattern (an error beyond ``max_patterns``), never documents. Selection is exact: every
document gets its place on the pattern's line of tokens from sums of 4096 hash ranges and a window inside one range,
so a pattern that holds a third of all rows is spread over thousands of window groups. A use counts as taken when the
middle of the document lies inside the share, which keeps the total within half a document of the quota.

Null texts have size 0; a null source is a source of its own, ordered last. Repeated rows are documents of their own.
An empty table gives an empty result; sources without tokens get target 0.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.llm.common import WORD, blank_null, staged

MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the seeded hash that name its range.
RANGE_DIGITS = 3


def capped_targets(sizes: dict[str | None, int], weights: dict[str | None, float], cap: float = MAX_EPOCHS) -> dict[str | None, float]:
    """Shares of all tokens by weight, none above ``cap`` times its source; the excess is shared again by weight."""
    total, free, out = sum(sizes.values()), list(sizes), {}
    while free:
        left = total - sum(cap * sizes[s] for s in out)
        whole = sum(weights[s] for s in free)
        share = {s: weights[s] * left / whole if whole else 0.0 for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**out, **share}
        out.update({s: float(cap * sizes[s]) for s in over})
        free = [s for s in free if s not in over]
    return out


def route(patterns: list[tuple[tuple, int]], quotas: dict, max_epochs: int = MAX_EPOCHS) -> list[dict]:
    """Tokens of each pattern for each source, of a flow that fills as much as it can at the least repetition cost.

    Successive shortest paths: source node, patterns (one arc per use, cost 0, 1, ...), quotas, sink.
    """
    names = list(quotas)
    sink, size = 1 + len(patterns) + len(names), 2 + len(patterns) + len(names)
    arcs: list[list] = []  # to, room, cost; the arc back is at index ^ 1
    leaving: list[list[int]] = [[] for _ in range(size)]

    def arc(a: int, b: int, room: int, cost: int) -> int:
        leaving[a].append(len(arcs))
        arcs.append([b, room, cost])
        leaving[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    place = {s: 1 + len(patterns) + j for j, s in enumerate(names)}
    links: list[dict] = []
    for i, (members, tokens) in enumerate(patterns):
        for use in range(max_epochs):
            arc(0, 1 + i, tokens, use)
        links.append({s: arc(1 + i, place[s], tokens * max_epochs, 0) for s in members if s in place})
    for s in names:
        arc(place[s], sink, quotas[s], 0)
    while True:
        far, via, queue, waiting = [None] * size, [-1] * size, deque([0]), [False] * size
        far[0] = 0
        while queue:
            a = queue.popleft()
            waiting[a] = False
            for k in leaving[a]:
                b, room, cost = arcs[k]
                if room > 0 and (far[b] is None or far[a] + cost < far[b]):
                    far[b], via[b] = far[a] + cost, k
                    if not waiting[b]:
                        waiting[b] = True
                        queue.append(b)
        if far[sink] is None:
            break
        path, node = [], sink
        while node:
            path.append(via[node])
            node = arcs[via[node] ^ 1][0]
        step = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= step
            arcs[k ^ 1][1] += step
    return [{s: arcs[k ^ 1][1] for s, k in link.items()} for link in links]


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size in words, and the membership array ``sources`` of one source each."""
    return docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(blank_null(text_col), F.lit(WORD)).cast("long").alias("size"),
                       F.array(source_col).alias("sources"))


def drawn(doc_id: Column, seed: str) -> Column:
    """Where a document stands in the seeded order."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(members: DataFrame, quotas_of, *, max_epochs: int = MAX_EPOCHS, seed: str = SEED, max_patterns: int = 100_000) -> DataFrame:
    """How often each document is used for each source.

    ``members``: doc_id, size, sources (array of strings). ``quotas_of(patterns)`` gets the (members, tokens) list
    and returns tokens wanted by source. Result: doc_id, size, sources, for_source, copies, taken; every document has
    at least one row, with copies 0 and null for_source if it is not used.
    """
    spark: SparkSession = members.sparkSession
    name = lambda x: F.when(x.isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), x))
    rows = members.withColumn("pattern", F.array_join(F.array_sort(F.array_distinct(F.transform("sources", name))), "\x00"))
    rows = staged(rows.withColumn("draw", drawn(F.col("doc_id"), seed)).withColumn("lot", F.substring("draw", 1, RANGE_DIGITS)), "mix-sizes")
    lots = staged(rows.groupBy("pattern", "lot").agg(F.sum("size").alias("lot_size")), "mix-lots")
    found = lots.groupBy("pattern").agg(F.sum("lot_size").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    read = lambda p: tuple(None if x == "n" else x[1:] for x in p.split("\x00")) if p else ()
    found = sorted((r.pattern, r.n or 0) for r in found)
    patterns = [(read(p), n) for p, n in found]
    flows = route(patterns, quotas_of(patterns), max_epochs)
    shares = []  # half-open stretches of each pattern's line of tokens, one per source
    for (p, n), flow in zip(found, flows, strict=True):
        at = 0
        for s, tokens in flow.items():
            if tokens:
                shares.append((p, n, s, at, at + tokens))
                at += tokens
    kinds = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("whole", T.LongType()), T.StructField("for_source", T.StringType()),
                          T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    shares_df = spark.createDataFrame(shares, kinds)
    before = Window.partitionBy("pattern").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = lots.select("pattern", "lot", F.coalesce(F.sum("lot_size").over(before), F.lit(0)).alias("lot_at"))
    inside = Window.partitionBy("pattern", "lot").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["pattern", "lot"])
    middle = 2 * (F.col("lot_at") + F.col("at")) + F.col("size")  # twice the middle of the document
    uses = lambda end: F.greatest(F.lit(0), F.ceil((2 * F.col(end) - middle) / (2 * F.col("whole"))))
    joined = placed.join(shares_df, "pattern", "left")
    copies = F.when((F.col("whole") > 0) & (F.col("size") > 0), uses("to") - uses("from")).otherwise(0).cast("long")
    return joined.select("doc_id", "size", "sources", "pattern", "for_source", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "draw")


def by_rank(sources: list[str | None]) -> dict[str | None, int]:
    """Weights 1, 2, 3, repeating, of sources by code point, null last."""
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: 1 + i % 3 for i, s in enumerate(order)}


def mix_by_weight(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=by_rank,
                  max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken of documents with one source each."""
    plan: dict = {}

    def quotas(patterns):
        sizes = {p[0]: n for p, n in patterns}
        targets = capped_targets(sizes, weights(list(sizes)), max_epochs)
        plan.update({s: (sizes[s], targets[s]) for s in sizes})
        return {s: int(targets[s] + 0.5) for s in sizes}

    used = mix(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col), quotas, max_epochs=max_epochs, seed=seed)
    used = used.withColumn("source", F.col("sources")[0])
    kinds = T.StructType([T.StructField("name", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    totals = docs.sparkSession.createDataFrame([(s, n, float(t)) for s, (n, t) in plan.items()], kinds)
    return used.join(totals, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "size", "source", "source_size", "target", "copies", "taken", "draw")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns, as often as it takes them.

    In the seeded order of a source the number of uses falls once, by one: the place of that step is a row per source,
    so whole documents are filtered and repeated where they are read.
    """
    used = mix_by_weight(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed).where("size > 0")
    steps = staged(used.groupBy("source").agg(F.max("copies").alias("most"), F.max(F.struct("copies", "draw")).alias("at")), "mix-steps")
    kinds = T.StructType([T.StructField("_source", docs.schema[source_col].dataType), T.StructField("_most", T.LongType()), T.StructField("_upto", T.StringType())])
    few = docs.sparkSession.createDataFrame([(r.source, r.most, r["at"].draw) for r in steps.collect()], kinds)
    draw = drawn(F.col(id_col), seed)
    rows = docs.join(few, F.col(source_col).eqNullSafe(F.col("_source"))).where(blank_null(text_col).rlike(WORD))
    uses = F.when(draw <= F.col("_upto"), F.col("_most")).otherwise(F.greatest(F.lit(0), F.col("_most") - 1)).cast("int")
    return rows.withColumn("_use", F.explode(F.array_repeat(F.lit(0), uses))).select(*(F.col(f"`{c}`") for c in docs.columns))
