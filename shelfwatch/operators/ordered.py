"""Order-dependent operators that do not put one key into one task.

A plain window over a key sends all its rows to one task. Here a key is cut
into chunks that follow the order; windows run inside a chunk, and one summary
row per chunk carries what must cross from one chunk to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwatch.session import staged


def chunk_of(seq: Column, width: int = 1_000_000) -> Column:
    """Chunk of an integer order column, by its start; exact for long integers."""
    return (seq - F.pmod(seq, F.lit(width))).cast("long")


def _same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, nulls being equal; the right one's copies are dropped."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    test = None
    for c in on:
        one = left[c].eqNullSafe(other[f"_r_{c}"])
        test = one if test is None else test & one
    joined = left.join(other, test, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{c}" for c in on])


def sums_before(chunks: DataFrame, keys: list[str], order: list[str], size: str, fan: int = 1000) -> DataFrame:
    """Adds ``_before`` and ``total``: the sum of ``size`` over earlier rows of the key, and over all.

    A tree of sums: rows are numbered into blocks of about ``fan`` by the ranges of their order, blocks are summed, and
    the sums before a block come from a window over the blocks alone. ``chunks`` has one row per key and order; its
    last order column is an integer, and of chunk starts.
    """
    *lead, last = order
    spread = F.max(last) - F.min(last)
    reach = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.min(last).alias("_low"), spread.alias("_span"))
    rows = _same(chunks, reach, keys)
    width = F.greatest(F.lit(1), F.ceil((F.col("_span") + 1) / F.greatest(F.lit(1), F.ceil(F.col("_rows") / fan))))
    rows = rows.withColumn("_block", F.floor((F.col(last) - F.col("_low")) / width)).drop("_rows", "_low", "_span")
    by_block = [*lead, "_block"]
    blocks = rows.groupBy(*keys, *by_block).agg(F.sum(size).alias("_block_sum"))
    over = W.partitionBy(*keys).orderBy(*by_block).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_blocks_before", F.coalesce(F.sum("_block_sum").over(over), F.lit(0))).drop("_block_sum")
    totals = chunks.groupBy(*keys).agg(F.sum(size).alias("total"))
    inside = W.partitionBy(*keys, *by_block).orderBy(last).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    rows = _same(_same(rows, blocks, [*keys, *by_block]), totals, keys)
    return rows.withColumn("_before", F.col("_blocks_before") + F.col("_inside")).drop("_block", "_blocks_before", "_inside")


def with_previous(df: DataFrame, keys: list[str], chunk: list[str], order: list[str],
                  value: str, name: str) -> DataFrame:
    """Adds ``name``: the ``value`` of the row before, in ``order`` within ``keys``.

    ``chunk`` columns must be non-decreasing along ``order``. The value before a chunk comes as a row of its own ahead
    of the chunk's rows, so that these are shuffled once and not joined.
    """
    inside = W.partitionBy(*keys, *chunk).orderBy("_own", *order)
    last = df.groupBy(*keys, *chunk).agg(
        F.max(F.struct(*order, F.col(value).alias("_v"))).alias("_m"))
    across = W.partitionBy(*keys).orderBy(*chunk)
    before = last.select(*keys, *chunk, F.lag(F.col("_m._v")).over(across).alias("_v"), F.lit(0).alias("_own"))
    rows = df.withColumns({"_v": F.col(value), "_own": F.lit(1)}).unionByName(before, allowMissingColumns=True)
    return rows.withColumn(name, F.lag("_v").over(inside)).filter("_own = 1").drop("_v", "_own")


def with_position(df: DataFrame, keys: list[str], chunk: list[str], order: list[str]) -> DataFrame:
    """Adds 0-based ``position`` and ``total`` within ``keys`` along ``order``."""
    inside = W.partitionBy(*keys, *chunk).orderBy(*order)
    sizes = sums_before(df.groupBy(*keys, *chunk).agg(F.count(F.lit(1)).alias("_n")), keys, chunk, "_n").drop("_n")
    return (_same(df.withColumn("_rn", F.row_number().over(inside)), sizes, [*keys, *chunk])
            .withColumn("position", F.col("_before") + F.col("_rn") - 1).drop("_rn", "_before"))


def price_history(snapshots: DataFrame, seq: str, width: int = 1_000_000, heavy_rows: int = 100_000) -> DataFrame:
    """Price per listing and date with the previous price and the change.

    Listings are counted first (combined before the shuffle). Those of up to ``heavy_rows`` rows fit a window of their
    own, one exchange in all; only larger ones are cut into chunks. Rows without a url are a listing, null dates and
    null ``seq`` come first; both ways give the same rows.
    """
    heavy = (snapshots.groupBy("catalog_url").agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") > heavy_rows).select("catalog_url"))
    own = W.partitionBy("catalog_url").orderBy("discovered_date", seq)
    light = _same(snapshots, heavy, ["catalog_url"], "left_anti").withColumn("previous_price", F.lag("price").over(own))
    rows = _same(snapshots, heavy, ["catalog_url"], "left_semi").withColumn("_chunk", chunk_of(F.col(seq), width))
    out = with_previous(rows, ["catalog_url"], ["discovered_date", "_chunk"],
                        ["discovered_date", "_chunk", seq], "price", "previous_price").drop("_chunk")
    return light.unionByName(out).withColumn("price_change", F.col("price") - F.col("previous_price"))


def latest_per_url(snapshots: DataFrame, seq: str) -> DataFrame:
    """The newest snapshot row of every listing, by aggregate and not by window."""
    rest = [c for c in snapshots.columns if c not in ("catalog_url", "discovered_date", seq)]
    return (snapshots.groupBy("catalog_url")
            .agg(F.max(F.struct("discovered_date", seq, *rest)).alias("m"))
            .select("catalog_url", "m.*"))


def checkpoint_marks(batch: DataFrame, seq: str, every: int = 5,
                     width: int = 1_000_000) -> DataFrame:
    """Rows at which a batch would save its progress: first, every n-th, last."""
    rows = batch.withColumn("_chunk", chunk_of(F.col(seq), width))
    out = with_position(rows, ["batch_id"], ["_chunk"], ["_chunk", seq]).drop("_chunk")
    return out.withColumn("save", (F.col("position") % every == 0)
                          | (F.col("position") == F.col("total") - 1))


def top_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per key. The rank filter is applied on the map side too."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def recent_attempts(attempts: DataFrame, n: int = 50) -> DataFrame:
    return top_per_key(attempts, ["retailer", "page_type"],
                       [F.desc("attempted_at"), F.desc("seq")], n)


def spaced(points: DataFrame, key: str, at: str, span: int, light_rows: int = 1000) -> DataFrame:
    """Adds ``kept``: of each key's points in order, the first and then each that lies ``span`` or more after the last kept.

    ``points`` are distinct (key, integer at). Keys of up to ``light_rows`` points are folded as one array each. For
    larger ones every point is linked to the first point ``span`` or more after it, which lies at the same offset of the
    next block of ``span`` or later, or else opens a later block; so the search stays inside (key, block), and only block
    starts meet by key. The links are then doubled: a round keeps what the links of twice the length reach, and chains of
    n kept points take about log2(n) rounds, each written to the shared folder.
    """
    points = staged(points.select(key, at), "points")
    counted = points.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    many = counted.filter(F.col("_n") > light_rows).select(key)
    heavy = not many.isEmpty()
    few = _same(points, many, [key], "left_anti") if heavy else points
    light = few.filter(F.col(at).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(at)).alias("_all"))
    none = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("kept"))

    def fold(acc, x):
        return F.when(acc["last"].isNull() | (x - acc["last"] >= span), F.struct(x.alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    def flagged(kept):
        mark = lambda xs, k: F.transform(xs, lambda x: F.struct(x.alias(at), F.lit(k).alias("kept")))
        return F.concat(mark(kept, True), mark(F.array_except("_all", kept), False))

    # The folded array is bound by an outer transform, as it is used twice.
    folded = F.get(F.transform(F.array(F.aggregate("_all", none, fold, lambda acc: acc["kept"])), flagged), F.lit(0))
    out = light.select(key, F.inline(folded)).unionByName(few.filter(F.col(at).isNull()).withColumn("kept", F.lit(False)))
    if not heavy:
        return out
    large = _same(points, many, [key], "left_semi")
    kept = _reached(large, key, at, span).withColumn("kept", F.lit(True))
    return out.unionByName(_same(large, kept, [key, at], "left").withColumn("kept", F.coalesce("kept", F.lit(False))))


def _reached(points: DataFrame, key: str, at: str, span: int) -> DataFrame:
    block = F.expr(f"(`{at}` - pmod(`{at}`, {span}L)) div {span}L")
    data = points.withColumn("_block", block).withColumns({"_from": F.lit(None).cast("bigint"), "_pos": F.col(at)})
    asks = data.withColumns({"_block": F.col("_block") + 1, "_from": F.col(at), "_pos": F.col(at) + span})
    own = F.when(F.col("_from").isNull(), F.col("_pos"))
    onward = W.partitionBy(key, "_block").orderBy("_pos").rangeBetween(W.currentRow, W.unboundedFollowing)
    found = data.unionByName(asks).withColumn("_to", F.min(own).over(onward)).filter(F.col("_from").isNotNull())
    starts = data.unionByName(asks).groupBy(key, "_block").agg(F.min(own).alias("_first"))
    later = W.partitionBy(key).orderBy("_block").rowsBetween(1, W.unboundedFollowing)
    starts = starts.withColumn("_later", F.min("_first").over(later)).drop("_first")
    links = _same(found, starts, [key, "_block"]).select(key, F.col("_from").alias(at), F.coalesce("_to", "_later").alias("_to"))
    links = staged(links.filter(F.col("_to").isNotNull()), "links")
    kept = staged(points.groupBy(key).agg(F.min(at).alias(at)), "kept")
    while True:
        more = staged(_same(kept, links, [key, at]).select(key, F.col("_to").alias(at)), "kept")
        if more.isEmpty():
            return kept
        kept = staged(kept.unionByName(more), "kept")
        onto = links.select(key, F.col(at).alias("_to"), F.col("_to").alias("_next"))
        links = staged(_same(links, onto, [key, "_to"]).select(key, at, F.col("_next").alias("_to")), "links")
