"""Tables in buckets: same rows as the whole-table operators, few files rewritten, old versions readable."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import changes
from shelfwatch.sources.buckets import BucketTable, PageStore

def now():
    return F.lit("2025-01-02 00:00:00").cast("timestamp_ntz")


def products(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("https://r"), F.col("id") % 7, F.lit(".com/"), "id").alias("url"), F.lit("r").alias("retailer"),
        F.concat(F.lit("t"), "id").alias("title"), F.col("id").cast("double").alias("price"),
        now().alias("first_seen"), now().alias("last_updated"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("group", [None, "parse_url(url, 'HOST')"])
def test_a_small_change_rewrites_few_buckets(spark, tmp_path, group):
    table = BucketTable.create(products(spark, 20_000), str(tmp_path / "t"), ["url"], 256, group)
    before, first = rows(table.read()), table.manifest(0)
    assert rows(products(spark, 20_000)) == before
    some = products(spark, 20_000).sample(0.0005, seed=3).withColumn("price", F.col("price") + 1).select("url", "retailer", "title", "price")
    some = some.unionByName(spark.createDataFrame([("new", "s", None, 3.0)], "url string, retailer string, title string, price double")).coalesce(1)
    merge = lambda old, new: changes.upsert_products(old, new, now())
    assert table.upsert(some, merge) == 1
    assert rows(table.read()) == rows(merge(products(spark, 20_000), some))
    second = table.manifest(1)
    assert sum(second[b] != first.get(b) for b in second) <= some.count() <= 0.1 * 256
    assert rows(BucketTable(spark, str(tmp_path / "t")).read(0)) == before


def test_changes_by_host_touch_the_buckets_of_the_host(spark, tmp_path):
    table = BucketTable.create(products(spark, 2000), str(tmp_path / "t"), ["url"], 64, "parse_url(url, 'HOST')", spread=8)
    assert len(table.touched(products(spark, 2000).filter("url like 'https://r3.%'"))) == 8


def test_deletes_null_keys_empty_tables_and_repeated_tries(spark, tmp_path):
    schema = "k string, v int"
    table = BucketTable.create(spark.createDataFrame([], schema), str(tmp_path / "t"), ["k"], 4)
    assert rows(table.read()) == []
    put = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("v").cast("int").alias("v"))
    one = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], schema)
    for _ in range(2):  # the second try of a batch replaces the first
        assert table.upsert(one, put, at=0) == 1
        assert rows(table.read()) == rows(one)
    assert table.upsert(spark.createDataFrame([], schema), put) == 1
    assert table.upsert(spark.createDataFrame([], schema), put, at=1) == 2
    gone = lambda old, new: old.filter(F.col("k").isNotNull())
    table.upsert(spark.createDataFrame([(None, 0)], schema), gone)
    assert rows(table.read()) == [("a", 1), ("b", 3)]
    assert rows(table.read(1)) == rows(one)


def test_any_sequence_of_upserts_equals_the_whole_table_form(spark, tmp_path):
    schema = "catalog_url string, retailer string, title string, price double, discovered_date date"
    pick = random.Random(5)
    whole = spark.createDataFrame([(f"u{i}", "r", "t", 1.0, dt.date(2024, 1, 1)) for i in range(30)], schema)
    table = BucketTable.create(whole, str(tmp_path / "t"), ["catalog_url", "retailer"], 16)
    held = whole
    for step in range(3):
        urls = pick.sample(range(40), 4)
        new = spark.createDataFrame([(f"u{i}", "r", pick.choice([None, "x"]), pick.choice([None, 2.0 + step])) for i in urls],
                                    "catalog_url string, retailer string, title string, price double")
        merge = lambda old, new: changes.upsert_listings(old, new, now())
        table.upsert(new, merge)
        held = spark.createDataFrame(merge(held, new).collect(), schema)
        assert rows(table.read()) == rows(held)


def test_pages_move_only_for_changed_urls(spark, tmp_path):
    schema = "url string, retailer string, html string, cached_at timestamp_ntz"
    day = lambda d: dt.datetime(2025, 1, d)
    store = PageStore(spark, str(tmp_path / "s"), 8)
    store.put(spark.createDataFrame([(f"u{i}", "r", "x" * 50, day(2)) for i in range(20)] + [(None, "r", "lost", day(2))], schema))
    store.put(spark.createDataFrame([("u1", "r", "newer", day(3)), ("u1", "r", "newer", day(3)), ("u2", "r", "older", day(1)),
                                     ("u3", "r", "same time", day(2)), ("u4", "r", None, day(4)), ("u9", "r", "undated", None)], schema))
    got = {r.url: r for r in store.pages().collect()}
    assert len(got) == 20 and [got[u].html for u in ("u1", "u2", "u3", "u4", "u9")] == ["newer", "x" * 50, "same time", None, "x" * 50]
    bodies = spark.read.parquet(str(tmp_path / "s" / "bodies"))
    assert {r.batch: r["count"] for r in bodies.groupBy("batch").count().collect()} == {1: 20, 2: 3}
    reads = spark.createDataFrame([("u1", dt.datetime(2025, 1, 3, 5)), ("u1", dt.datetime(2025, 1, 3, 6)), ("u2", day(5)), ("?", day(3))],
                                  "url string, read_at timestamp_ntz")
    PageStore.open(spark, str(tmp_path / "s")).count_accesses(reads)
    got = {r.url: r for r in store.pages().collect()}
    assert (got["u1"].accessed_count, got["u1"].last_accessed) == (3, dt.datetime(2025, 1, 3, 6))
    assert got["u2"].accessed_count == 1 and spark.read.parquet(str(tmp_path / "s" / "bodies")).count() == 23


def test_staged_folders_go_when_their_block_ends(spark, tmp_path):
    import os

    from shelfwatch.session import scratch_root, staged, staging

    root = scratch_root(spark)
    kept = staged(spark.range(3), "kept-outside")
    with staging(spark):
        inside = staged(spark.range(5), "dropped-inside")
        inside.write.parquet(str(tmp_path / "result"))
    names = os.listdir(root)
    assert not any(n.startswith("dropped-inside") for n in names)
    assert kept.count() == 3 and spark.read.parquet(str(tmp_path / "result")).count() == 5
    with pytest.raises(ValueError):
        with staging(spark):
            staged(spark.range(2), "dropped-failing")
            raise ValueError
    assert not any(n.startswith("dropped") for n in os.listdir(root))
