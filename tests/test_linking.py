"""Blocked joins against brute force, cascade order and policy."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions.similarity import sequence_ratio
from shelfwatch.operators import fuzzy, linking

WORDS = ["red", "blue", "linen", "maxi", "midi", "dress", "wrap", "top", "long", "puff", "a-line"]


def titles(rng, n):
    out = []
    for _ in range(n):
        base = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5)))
        chars = list(base)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(chars) + 1)
            if rng.random() < 0.5 and chars:
                chars.pop(min(i, len(chars) - 1))
            else:
                chars.insert(i, rng.choice("abcxyz "))
        out.append("".join(chars) or "x")
    return out


def tables(spark, seed):
    rng = random.Random(seed)
    listings = [("r%d" % (i % 2), t, float(rng.choice([20, 20.5, 21, 49.99, 50.98, 55])))
                for i, t in enumerate(titles(rng, 120))]
    products = [("r%d" % (i % 2), t, float(rng.choice([20, 20.99, 21, 50, 54.9, 49.99])),
                 f"u{i:03d}") for i, t in enumerate(titles(rng, 150))]
    return (listings, products,
            spark.createDataFrame(listings, "retailer string, title string, price double"),
            spark.createDataFrame(products, "retailer string, title string, price double, url string"))


def brute(listings, products, threshold, in_band):
    best = {}
    for r, t, p in set(listings):
        lt = t.lower().strip()
        if not lt:
            continue
        for pr, pt, pp, url in products:
            if pr == r and in_band(p, pp) and pt.strip():
                ratio = SequenceMatcher(None, lt, pt.lower().strip()).ratio()
                if ratio > threshold:
                    key = (r, lt, p)
                    if key not in best or (-ratio, url) < best[key]:
                        best[key] = (-ratio, url)
    return {k: (u, -r) for k, (r, u) in best.items()}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("band,threshold,test", [
    (fuzzy.AbsoluteBand(1.0), 0.90, lambda a, b: abs(a - b) < 1.0),
    (fuzzy.RelativeBand(0.10), 0.85, lambda a, b: abs(a - b) / a < 0.10),
])
def test_blocking_loses_no_match(spark, seed, band, threshold, test):
    listings, products, left, right = tables(spark, seed)
    got = {(r.retailer, r.lt, r.lp): (r.url, r.ratio)
           for r in fuzzy.best_fuzzy(left, right, band, threshold).collect()}
    assert got == brute(listings, products, threshold, test)


def test_pairs_of_one_table(spark):
    rng = random.Random(5)
    rows = [("r", t, float(rng.choice([10, 10.4, 11, 30]))) for t in titles(rng, 90)]
    df = spark.createDataFrame(rows, "retailer string, title string, price double")
    got = {(r.lt, r.lp, r.rt, r.rp) for r in fuzzy.title_price_pairs(df).collect()}
    values = sorted({(t.lower().strip(), p) for _, t, p in rows if t.strip()})
    want = {(*a, *b) for i, a in enumerate(values) for b in values[i + 1:]
            if abs(a[1] - b[1]) < 1.0 and SequenceMatcher(None, a[0], b[0]).ratio() >= 0.90}
    assert got == want


def test_ratio_takes_the_left_text_first(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("a", None), ("x" * 250, "x" * 201 + "y")]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    got = [r.s for r in df.select(sequence_ratio()("a", "b").alias("s")).collect()]
    assert got[3] is None
    assert got[:3] + got[4:] == [SequenceMatcher(None, a, b).ratio() for a, b in pairs if b is not None]


def test_codes_inside_urls(spark):
    rng = random.Random(1)
    urls = ["https://s.com/" + "".join(rng.choice("AB12-/") for _ in range(14)) for _ in range(60)]
    codes = ["".join(rng.choice("AB12-") for _ in range(n)) for n in (1, 2, 3, 4, 5, 7, 8, 9) for _ in range(8)]
    codes += [u[-9:] for u in urls[:6]] + [u[10:19] for u in urls[6:12]]
    p = spark.createDataFrame([("r", u) for u in urls], "retailer string, url string")
    c = spark.createDataFrame([("r", x) for x in codes], "retailer string, code string")
    got = {r.code: r.url for r in linking.codes_in_urls(c, p).collect()}
    assert got == {x: min(u for u in urls if x in u) for x in codes if any(x in u for u in urls)}


PRODUCTS = [
    ("https://r.com/a/", "r", "Linen Dress", 50.0, "C1", ["i1", "i2"]),
    ("https://r.com/b?x=1", "r", "Wool Coat", 90.0, "C2", ["i3"]),
    ("https://r.com/c", "r", "Silk Top Blue", 30.0, None, ["i4", "i5"]),
]
LISTINGS = [
    (1, "https://r.com/a/", "other", 1.0, None, []),
    (2, "https://r.com/b", "other", 1.0, None, []),
    (3, "https://r.com/zz", "other", 1.0, "C1", []),
    (4, "https://r.com/q", "Silk Top Blues", 30.99, None, []),
    (5, "https://r.com/q2", "nothing alike", 55.0, None, ["i1", "zz"]),
    (6, "https://r.com/q3", "nothing alike", 55.0, None, ["i1", "y", "z"]),
    (7, "https://r.com/q4", None, None, None, None),
]


def cascade_tables(spark):
    p = spark.createDataFrame(PRODUCTS, "url string, retailer string, title string, price double, "
                                        "product_code string, image_urls array<string>")
    x = spark.createDataFrame(LISTINGS, "id int, catalog_url string, title string, price double, "
                                        "product_code string, image_urls array<string>")
    return x.withColumn("retailer", F.lit("r")), p


def test_cascade_takes_the_first_level(spark):
    x, p = cascade_tables(spark)
    got = {r.id: (r.link_method, r.linked_product_url, r.link_confidence)
           for r in linking.link_listings(x, p).collect()}
    ratio = SequenceMatcher(None, "silk top blues", "silk top blue").ratio()
    assert got[1] == ("exact_url", "https://r.com/a/", 1.0)
    assert got[2] == ("normalized_url", "https://r.com/b?x=1", 0.95)
    assert got[3] == ("product_code", "https://r.com/a/", 0.90)
    assert got[4][:2] == ("fuzzy_title_price", "https://r.com/c")
    assert got[4][2] == pytest.approx(0.85 + (ratio - 0.9) * 0.5)
    assert got[5][0] == "image_url_match" and got[5][2] == pytest.approx(0.65 + 0.5 * 0.15)
    assert got[6][0] is None and got[7][0] is None


def test_unstable_retailer_skips_the_key_levels(spark):
    x, p = cascade_tables(spark)
    policy = spark.createDataFrame([("r", 0.49, "exact_url", True)], "retailer string, "
                                   "url_stability_score double, best_dedup_method string, image_urls_consistent boolean")
    got = {r.id: (r.link_method, r.link_confidence) for r in linking.link_listings(x, p, policy).collect()}
    assert got[1][0] is None and got[3][0] is None and got[4][0] == "fuzzy_title_price"
    assert got[5][1] == pytest.approx(0.75 + 0.5 * 0.20)


def test_backfill_leaves_linked_rows_alone(spark):
    x, p = cascade_tables(spark)
    done = x.withColumn("linked_product_url", F.when(F.col("id") == 1, F.lit("kept")))
    ids = {r.id for r in linking.backfill_links(done, p).collect()}
    assert ids == {2, 3, 4, 5, 6, 7}


def test_classification(spark):
    x, p = cascade_tables(spark)
    history = spark.createDataFrame([("r", "https://r.com/q3", "t", 1.0)],
                                    "retailer string, catalog_url string, title string, price double")
    got = {r.id: (r.status, r.match_method) for r in linking.classify_listings(x, p, history).collect()}
    assert got[1] == ("confirmed_existing", "exact_url")
    assert got[4] == ("suspected_duplicate", "fuzzy_title")
    assert got[5] == ("suspected_duplicate", "image_url")
    assert got[6] == ("confirmed_existing", "exact_url")
    assert got[7] == ("confirmed_new", "none")


def test_hot_values_do_not_multiply(spark):
    """A third of all rows are copies of one listing: the joins see one value."""
    n = 30000
    x = spark.range(n).select(
        F.col("id"), F.lit("r").alias("retailer"), F.concat(F.lit("https://r.com/n/"), "id").alias("catalog_url"),
        F.when(F.col("id") % 3 == 0, "hot dress maxi").otherwise(F.concat(F.lit("item number "), F.col("id"))).alias("title"),
        F.lit(50.0).alias("price"), F.lit(None).cast("string").alias("product_code"))
    p = spark.range(n).select(
        F.lit("r").alias("retailer"), F.concat(F.lit("https://r.com/p/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("url"),
        F.when(F.col("id") % 3 == 0, "hot dress maxis").otherwise(F.concat(F.lit("thing no "), F.col("id"))).alias("title"),
        F.lit(50.5).alias("price"), F.lit(None).cast("string").alias("product_code"))
    out = linking.backfill_links(x, p).groupBy("link_method").count().collect()
    assert {r.link_method: r["count"] for r in out} == {"fuzzy_title_price": n // 3, None: n - n // 3}


@pytest.mark.parametrize("seed", range(3))
def test_image_overlap_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    pool = [f"i{k}" for k in range(25)]

    def images():
        return rng.sample(pool, rng.randint(0, 5)) + rng.choice([[], ["chart"], ["chart", "chart"]])

    listings = [(i, "r", float(rng.choice([10, 15, 24.99, 40])), images()) for i in range(60)]
    products = [(f"u{i:03d}", "r", float(rng.choice([10, 20, 25, 34.9, 50])), images()) for i in range(80)]
    x = spark.createDataFrame(listings, "id int, retailer string, price double, image_urls array<string>").withColumn(
        "catalog_url", F.col("id").cast("string"))
    p = spark.createDataFrame(products, "url string, retailer string, price double, image_urls array<string>")
    got = {r.id: r.linked_product_url for r in linking.match_image_overlap(x, p).collect()}
    want = {}
    for i, _, price, mine in listings:
        hits = [(-len(set(mine) & set(theirs)) / len(set(mine)), u) for u, _, pp, theirs in products
                if mine and abs(price - pp) < 10 and len(set(mine) & set(theirs)) * 2 >= len(set(mine))]
        want[i] = min(hits)[1] if hits else None
    assert got == want
