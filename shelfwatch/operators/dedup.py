"""Keep-first deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions import urls as U
from shelfwatch.functions.text import title_key
from shelfwatch.operators.groups import connected
from shelfwatch.operators.keyed import shuffled
from shelfwatch.session import staged

#: Rows of a connected group that one pass of a task goes through.
GROUP_ROWS = 200_000


def first_per_key(rows: DataFrame, key: Column, seq: str, within: list[str] | None = None) -> DataFrame:
    """First row by ``seq`` per key, found by aggregate so that hot keys shrink early."""
    keys = [*(within or []), "_key"]
    rest = [c for c in rows.columns if c not in (within or []) and c != seq]
    return (rows.withColumn("_key", key).groupBy(*keys)
            .agg(F.min(F.struct(seq, *rest)).alias("m"))
            .select(*(within or []), F.col(f"m.{seq}").alias(seq),
                    *[F.col(f"m.{c}").alias(c) for c in rest]))


def unique_urls(rows: DataFrame, seq: str, url: str = "url") -> DataFrame:
    return first_per_key(rows, U.url_key_v3(F.col(url)), seq)


def unique_products(rows: DataFrame, seq: str, url: str = "url") -> DataFrame:
    return first_per_key(rows, U.product_identifier(F.col(url)), seq)


def unique_in_page(rows: DataFrame, seq: str, page: str = "page_id", url: str = "url") -> DataFrame:
    return first_per_key(rows, F.col(url), seq, [page])


def identity_keys() -> Column:
    """All keys a listing can be recognised by, in one namespace.

    The normalized url, the product code and ``title:price``; a code may equal
    another row's url or title text, and then they do collide.
    """
    price = F.col("price")
    price_text = F.when(price == F.floor(price), F.concat(
        F.floor(price).cast("string"), F.lit(".0"))).otherwise(price.cast("string"))
    titled = (F.coalesce("title", F.lit("")) != "") & (F.coalesce(price, F.lit(0.0)) != 0)
    return F.array_distinct(F.array_compact(F.array(
        F.when(F.coalesce("url", F.lit("")) != "", U.url_key_v2(F.col("url"))),
        F.nullif("product_code", F.lit("")),
        F.when(titled, F.concat(title_key(F.col("title")), F.lit(":"), price_text)))))


def greedy_dedup(rows: DataFrame, seq: str, max_rounds: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Keep a row unless an earlier *kept* row shares any of its keys.

    Same result as going through the rows in ``seq`` order (unique integers). Keys that only one row has decide
    nothing. Rounds over all open rows come first: each keeps the rows that are smallest on all their keys and drops
    those that share a key with one. They go on while a round decides half of the open rows, so they shrink as fast.
    What is left, chains of partial duplicates, falls into connected groups, found in logarithmic rounds; what happens
    in one group does not touch another. Groups of up to ``group_rows`` rows are gone through in order, many of them in
    one task and each held only while it lasts. Only larger groups are decided in rounds however little one decides
    (see :func:`_in_rounds`).
    """
    rows = staged(rows, "dedup-rows")
    number = F.col(seq).cast("long").alias(seq)
    lines, own = rows.filter(F.col(seq).isNotNull()), identity_keys()
    if not lines.groupBy(number).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        # Rows of one number are one row with the keys of them all; the place of a key must be its alone.
        lines = staged(lines.groupBy(number).agg(F.array_distinct(F.flatten(F.collect_list(own))).alias("keys")), "dedup-keys")
        own = F.col("keys")
    dropped, slow, n = [], False, rows.count()
    while True:
        met = staged(_met(lines.select(number, F.posexplode(own).alias("place", "key")), seq), "dedup-met")
        if n <= group_rows:
            dropped.append(_in_order(_lines(met, seq).withColumn("group", F.lit(0)), seq))
            break
        if slow:
            dropped.append(_by_groups(_lines(met, seq), seq, max_rounds, group_rows))
            break
        decided = staged(_decided(met, seq), "dedup-round")
        dropped.append(decided.filter("hit").select(seq))
        lines, own = decided.filter("NOT hit").select(seq, "keys"), F.col("keys")
        before, n = n, lines.count()
        slow = n * 2 > before
    every = dropped[0]
    for some in dropped[1:]:
        every = every.unionByName(some)
    return rows.join(shuffled(every), seq, "left_anti")


def _met(keyed: DataFrame, seq: str) -> DataFrame:
    """(seq, first, at) of the keys of (seq, place, key) that several rows share.

    From here on a key is the smallest row that has it and its place there, two numbers instead of a text.
    """
    shared = keyed.groupBy("key").agg(F.min(seq).alias("first"), F.min_by("place", seq).alias("at"), F.count(F.lit(1)).alias("n"))
    return keyed.select(seq, "key").join(shuffled(shared.filter("n > 1").drop("n")), "key").select(seq, "first", "at")


def _lines(met: DataFrame, seq: str) -> DataFrame:
    """(seq, keys), one line a row. Plain rows are shuffled, as partly collected arrays take more bytes."""
    return met.repartition(seq).groupBy(seq).agg(F.collect_list(F.struct("first", "at")).alias("keys"))


def _decided(met: DataFrame, seq: str) -> DataFrame:
    """(seq, hit, keys) of the rows that are not smallest on all their keys; hit: shares a key with one that is.

    The rows that are get no line, they are kept. A key is theirs only as its smallest row, so a key is taken if its
    smallest row is smallest throughout. Rows that are hit need their keys no more.
    """
    later = staged(met.filter(F.col("first") < F.col(seq)).select(F.col(seq).alias("first")).distinct(), "dedup-later")
    flagged = met.join(shuffled(later.withColumn("open", F.lit(True))), "first", "left").filter(F.col("open") | (F.col("first") < F.col(seq)))
    ends = flagged.select(seq, *[F.when(F.col("open"), F.col(c)).alias(c) for c in ("first", "at")]).repartition(seq)
    keys = F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "at")))
    return ends.groupBy(seq).agg(F.bool_or(F.col("first").isNull()).alias("hit"), keys.alias("keys")) \
        .select(seq, "hit", F.when(~F.col("hit"), F.col("keys")).alias("keys"))


def _in_order(lines: DataFrame, seq: str) -> DataFrame:
    """Numbers of the rows of (seq, keys, group) that are dropped when each group is gone through in order."""
    texts = F.transform("keys", lambda k: F.concat_ws(":", k["first"], k["at"]))
    return staged(lines.select("group", seq, texts.alias("keys")).repartition("group").sortWithinPartitions("group", seq)
                  .mapInArrow(_gone_through(seq), f"{seq} long"), "dedup-dropped")


def _by_groups(lines: DataFrame, seq: str, max_rounds: int | None, group_rows: int) -> DataFrame:
    """Numbers of the dropped rows of (seq, keys), by connected groups."""
    links = lines.select(F.col(seq).alias("a"), F.explode("keys.first").alias("b"))
    found, _ = connected(links)
    found = staged(found.select(F.col("id").alias(seq), "group"), "dedup-groups")
    large = found.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows).select("group")
    grouped = lines.join(shuffled(found), seq)
    dropped = _in_order(grouped.join(shuffled(large), "group", "left_anti"), seq)
    rest = staged(grouped.join(shuffled(large), "group", "left_semi").select(seq, F.explode("keys").alias("key")), "dedup-large")
    kept = _in_rounds(rest, seq, max_rounds)
    return dropped.unionByName(staged(rest.select(seq).distinct().join(shuffled(kept), seq, "left_anti"), "dedup-dropped"))


def _gone_through(seq: str):
    """Rows (group, seq, keys) in order to the numbers of those that an earlier kept row shares a key with."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen = None, set()
        for batch in batches:
            gone = []
            for g, n, keys in zip(*(batch[c].to_pylist() for c in ("group", seq, "keys"))):
                if g != group:
                    group, seen = g, set()
                if seen.isdisjoint(keys):
                    seen.update(keys)
                else:
                    gone.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], [seq])

    return work


def _in_rounds(open_rows: DataFrame, seq: str, max_rounds: int | None = None) -> DataFrame:
    """Kept rows of (seq, key): every round keeps the rows that are smallest on all their keys.

    Undecided rows that share a key with a kept row are dropped, the rest goes on. No pair of rows is formed: keys
    carry one minimum and one flag, both from aggregates. Each round is written to the shared folder and read back.
    """
    kept, rounds = open_rows.select(F.col(seq).cast("long").alias(seq)).filter("false"), 0
    while not open_rows.isEmpty():
        first = open_rows.groupBy("key").agg(F.min(seq).alias("_min"))
        marked = open_rows.join(first, "key")
        winners = (marked.groupBy(seq).agg(F.min(
            (F.col(seq) == F.col("_min")).cast("int")).alias("_all"))
            .filter("_all = 1").select(seq))
        # A key's minimum wins or not as one row, so its flag needs no row-to-row join.
        taken = first.join(winners.withColumnRenamed(seq, "_min"), "_min", "left_semi") \
            .select("key")
        hit = open_rows.join(taken, "key", "left_semi").select(seq).distinct()
        winners = staged(winners, "dedup-kept")
        open_rows = staged(open_rows.join(hit, seq, "left_anti"), "dedup-open")
        kept = kept.unionByName(winners)
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError("round limit reached before every row was decided")
    return kept
