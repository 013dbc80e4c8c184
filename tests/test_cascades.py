"""Cascades read their listings once, let linked rows go and look each key up in one join, with the links of a plain loop."""

import random

import pytest
from pyspark.sql import functions as F
from test_larger_tables import LISTING, PRODUCT, few, plan

from shelfwatch.operators import fuzzy, linking


def counted(spark, df):
    """``df`` and the number of its rows that were worked out so far."""
    seen = spark.sparkContext.accumulator(0)

    def title(text):
        seen.add(1)
        return text

    return df.withColumn("title", F.udf(title, "string").asNondeterministic()("title")), seen


@pytest.mark.parametrize("cascade", [
    linking.link_listings, linking.backfill_links,
    lambda x, p: linking.backfill_links(x, p, fuzzy_level=False),
    lambda x, p: linking.classify_listings(x, p, p.withColumnRenamed("url", "catalog_url"))])
def test_listings_are_worked_out_once(spark, cascade):
    listings, products = few(spark)
    rows, seen = counted(spark, listings)
    assert cascade(rows, products).count() == 4
    cascade(rows, products).collect()
    assert seen.value == 8


def test_history_is_worked_out_once(spark):
    listings, products = few(spark)
    history, seen = counted(spark, listings)
    linking.classify_listings(listings, products, history).collect()
    assert seen.value == 4


def test_learned_patterns_are_worked_out_once_and_shuffle_no_listings(spark):
    listings, products = few(spark)
    calls = spark.sparkContext.accumulator(0)

    def score(x):
        calls.add(1)
        return x

    policy = spark.createDataFrame([("r", 0.2, "exact_url", True)], "retailer string, url_stability_score double, best_dedup_method string, image_urls_consistent boolean") \
        .withColumn("url_stability_score", F.udf(score, "double").asNondeterministic()("url_stability_score"))
    got = linking.link_listings(listings, products, policy).collect()
    assert calls.value == 1 and {r.link_method for r in got} <= {"fuzzy_title_price", "image_url_match", None}


def tables(spark, seed):
    rng = random.Random(seed)

    def url():
        return rng.choice([None, "", *(f"https://s.com/{x}{end}" for x in "ab" for end in ("", "/", "?p=1", "?p=2", "/?p=3", "?p=4#x"))])

    def row(n):
        return (rng.choice(["r1", "r2", "r3", "r4", None]), url(), f"{n}", 0.0, rng.choice([None, "", "AB-1", "AB-2", "AB-3"]), None)

    listings, products = [row(i) for i in range(120)], [row(i) for i in range(25)]
    listings.append(("r1", "https://s.com/other", "120", 0.0, "AB-9", None))
    products.append(("r1", "https://s.com/code", "25", 0.0, "AB-9", None))
    return listings, products, spark.createDataFrame(listings, LISTING), spark.createDataFrame(products, PRODUCT)


def normal(url):
    return url.split("?")[0].rstrip("/")


@pytest.mark.parametrize("seed", [1, 2])
def test_first_and_last_url_decide_like_every_url(spark, seed):
    listings, products, left, right = tables(spark, seed)

    def links(row):
        of = [p for p in products if p[0] == row[0] and row[0] is not None and p[1] is not None]
        for method, same in (("exact_url", lambda p: p[1] == row[1]), ("normalized_url", lambda p: row[1] is not None and normal(p[1]) == normal(row[1])),
                             ("product_code", lambda p: row[4] and p[4] == row[4])):
            hits = [p[1] for p in of if same(p)]
            if hits:
                return method, min(hits)
        return None, None

    want = sorted((x[2], *links(x)) for x in listings)
    assert {w[1] for w in want} == {"exact_url", "normalized_url", "product_code", None}
    for out in (linking.link_listings(left, right), linking.backfill_links(left, right), linking.backfill_links(left, right, fuzzy_level=False)):
        assert sorted(map(tuple, out.select("title", "link_method", "linked_product_url").collect())) == want


@pytest.mark.parametrize("seed", [4, 5])
def test_first_and_last_retailer_decide_like_every_retailer(spark, seed):
    listings, products, left, right = tables(spark, seed)
    products, right = products[:4], right.limit(4)
    history = [(r, u, t, p, None, None) for r, u, t, p, _, _ in tables(spark, seed + 10)[1]]
    seen = {(r, u) for r, u, *_ in history if r is not None and u is not None}
    own = {p[1] for p in products}
    out = linking.classify_listings(left, right, spark.createDataFrame(history, LISTING))
    got = {r.title: (r.match_method, r.matched_url) for r in out.collect()}
    for r, u, t, *_ in listings:
        known = u is not None and (u in own or (r, u) in seen)
        assert (got[t] == ("exact_url", u)) == known, (r, u, got[t])


def test_one_join_a_key(spark):
    """Products and history are met by url, by normalized url, by code and by title and price: four joins, two of them to the folder."""
    listings, products = few(spark)
    kept = linking.classify_listings(listings.drop("image_urls"), products.drop("image_urls"), listings, use_fuzzy=False)
    assert plan(kept).count("SortMergeJoin") == 2


@pytest.mark.parametrize("band", [fuzzy.AbsoluteBand(1.0), fuzzy.AbsoluteBand(10.0), fuzzy.RelativeBand(0.10)])
def test_a_band_lies_in_two_buckets(spark, band):
    """Both prices meet in a bucket whenever the band holds them; a price is multiplied by two at most."""
    rng = random.Random(8)
    prices = [rng.choice([1, 2, 3.99, 20, 99.99, 100, 1e6]) * rng.choice([1, 1, 0.9, 1.1, 1 / 1.1, 1 / 0.9]) + rng.choice([0, 0, 1, 10, 9.999999999, 0.5]) for _ in range(300)]
    df = spark.createDataFrame([(float(p),) for p in prices], "p double").distinct()
    left = df.select(F.col("p").alias("lp"), fuzzy._near_buckets(band, F.col("p")).alias("bucket"))
    right = df.select(F.col("p").alias("rp"), band.bucket(F.col("p")).alias("bucket"))
    held = band.holds(F.col("lp"), F.col("rp"))
    met = left.join(right, "bucket").filter(held).select("lp", "rp")
    every = df.select(F.col("p").alias("lp")).join(df.select(F.col("p").alias("rp")), held)
    assert met.count() == met.distinct().count() == every.count() > df.count()
    assert left.groupBy("lp").count().agg(F.max("count")).first()[0] <= 2


def test_columns_without_a_type_pass_through(spark):
    listings, products = few(spark)
    rows = listings.withColumn("note", F.lit(None))
    out = linking.link_listings(rows, products)
    assert out.columns == [*rows.columns, "linked_product_url", "link_confidence", "link_method"]
    assert out.filter("note IS NULL AND linked_product_url IS NOT NULL").count() == 4
