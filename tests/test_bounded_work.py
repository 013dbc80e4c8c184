"""Work that must stay small: rounds, window sizes, scores and candidates, counted on hard cases."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from test_dedup import SCHEMA, loop

from shelfwatch.operators import dedup, fuzzy, groups, linking, ordered, quality


def test_long_chain_takes_few_rounds(spark):
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("https://s.com/"), F.floor((F.col("id") + 1) / 2).cast("string")).alias("url"),
                                 F.lit(None).cast("string").alias("title"), F.lit(None).cast("double").alias("price"), F.concat(F.lit("c"), F.floor(F.col("id") / 2).cast("string")).alias("product_code"))
    assert {r.seq for r in dedup.greedy_dedup(rows, "seq").collect()} == set(range(0, n, 2))
    found, rounds = groups.connected(rows.select(F.col("seq").alias("a"), (F.col("seq") + 1).alias("b")))
    assert rounds <= 20 and {r.group for r in found.select("group").distinct().collect()} == {0}


@pytest.mark.parametrize("group_rows", [1, 6, 200_000])
def test_large_and_small_groups_are_decided_alike(spark, group_rows):
    rng = random.Random(11)
    rows = [(i, rng.choice([None, f"https://s.com/{rng.randint(0, 60)}"]), rng.choice([None, f"T{rng.randint(0, 50)}"]), rng.choice([None, 5.0, 7.5]),
             rng.choice([None, f"c{rng.randint(0, 60)}"])) for i in range(150)]
    got = dedup.greedy_dedup(spark.createDataFrame(rows, SCHEMA), "seq", group_rows=group_rows)
    assert {r.seq for r in got.collect()} == loop(rows)


def test_history_is_the_same_below_and_above_the_limit(spark):
    """Null urls, dates and numbers included."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["2024-01-01", "2024-01-02", None]), i if rng.random() > 0.02 else None, float(rng.randint(1, 9))) for i in range(300)]
    seen, unique = set(), []
    for r in rows:  # one row without a number for each url and date, so that the order is defined
        if r[2] is not None or (r[0], r[1]) not in seen:
            unique.append(r)
            seen |= {(r[0], r[1])} if r[2] is None else set()
    df = spark.createDataFrame(unique, "catalog_url string, discovered_date string, seq long, price double").withColumn("discovered_date", F.to_date("discovered_date"))
    got = [sorted(map(repr, ordered.price_history(df, "seq", width=7, heavy_rows=n).collect())) for n in (1, 100, 100_000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(unique)


def test_sums_before_in_blocks_of_root_n(spark):
    """One key with all rows: sums are exact and no window partition is large."""
    n, fan = 10_000, 100
    df = spark.range(n).select(F.lit(None).cast("string").alias("k"), (F.col("id") * 50).alias("at"), (F.col("id") % 7).alias("size"))
    got = {r["at"]: (r["_before"], r["total"]) for r in ordered.sums_before(df, ["k"], ["at"], "size", fan).collect()}
    total, want = sum(i % 7 for i in range(n)), {}
    before = 0
    for i in range(n):
        want[i * 50] = (before, total)
        before += i % 7
    assert got == want
    spans = df.withColumn("block", F.floor(F.col("at") / ((n * 50) // (n // fan)))).groupBy("block").count()
    assert spans.agg(F.max("count")).first()[0] <= fan + 1


def test_ratios_equal_the_matcher(spark):
    rng = random.Random(4)
    texts = ["", "a", "ab", "abc", "red dress", "red dresses", "dress", "xyz", "été", "aaaa", "long " * 50, "long " * 39]
    texts += ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 14))) for _ in range(20)]
    pairs = [(a, b) for a in texts for b in texts]
    got = {(r.lt, r.rt): r.ratio for r in fuzzy.ratios(spark.createDataFrame(pairs, "lt string, rt string").distinct()).collect()}
    assert got == {(a, b): SequenceMatcher(None, a, b).ratio() for a, b in pairs}


def test_best_links_of_a_large_page(spark):
    """A page of 5000 links: each title's best link is found, and few pairs are scored."""
    rng = random.Random(9)
    words = ["red", "blue", "silk", "midi", "maxi", "dress", "skirt", "linen", "wrap", "belted", "pleated", "floral"]
    slugs = sorted({"-".join(rng.choices(words, k=4)) + f"-{i}" for i in range(5000)})
    titles = sorted({" ".join(rng.choices(words, k=4)) for _ in range(12)})
    links = spark.createDataFrame([(1, s) for s in slugs], "page_id long, slug string")
    scored = quality.slug_scores(spark.createDataFrame([(1, t) for t in titles], "page_id long, low string"), links, 0.5).collect()
    best = {}
    for r in scored:
        best[r.low] = max(best.get(r.low, 0), r.similarity)
    assert best == {t: max(SequenceMatcher(None, t, s).ratio() for s in slugs) for t in titles}
    assert len(scored) <= len(titles) * len(slugs) / 4, len(scored)


def test_fuzzy_candidates_stay_near_the_true_pairs(spark):
    """On the listings: at most 20 candidates for a true pair. On titles all of like wording: a small part of all pairs."""
    import catalog_queries.everything  # noqa: F401
    from catalog_queries.base import Views

    v = Views(spark, "/root/testdata/sf0.01")
    for band, threshold in ((fuzzy.AbsoluteBand(1.0), 0.90), (fuzzy.RelativeBand(0.10), 0.85)):
        found = fuzzy.candidate_title_pairs(fuzzy._listing_values(v.b_snapshots), fuzzy._product_values(v.b_products), band, threshold).collect()
        true = [r for r in found if SequenceMatcher(None, r.lt, r.rt).ratio() >= threshold]
        assert len(true) <= len(found) <= max(20, 20 * len(true))
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("al", "be", "co", "du", "en", "fo", "gr", "ha") for b in ("mond", "rylic", "ntral", "nder", "llow", "pper", "rtic", "zure")]
    base = [" ".join(rng.sample(words, 5)) for _ in range(300)]
    left = spark.createDataFrame([("r", t, 10.0) for t in base], "retailer string, lt string, lp double")
    right = spark.createDataFrame([("r", t + rng.choice(["s", "", " x"]), 10.0, "u") for t in base], "retailer string, rt string, rp double, url string")
    found = {(r.lt, r.rt) for r in fuzzy.candidate_title_pairs(left, right, fuzzy.AbsoluteBand(1.0), 0.9).collect()}
    true = {(a.lt, b.rt) for a in left.collect() for b in right.collect() if a.lt != b.rt and SequenceMatcher(None, a.lt, b.rt).ratio() >= 0.9}
    assert true <= found and len(found) <= len(base) ** 2 / 12


def test_codes_are_looked_up_by_their_rarest_piece(spark):
    """All urls share the pieces of the shop's name; codes that hold them still meet only the urls with their own part."""
    n = 3000
    products = spark.range(n).select(F.lit("r").alias("retailer"), F.concat(F.lit("https://shop-products.com/p/shop-products-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("url"))
    codes = [("r", f"shop-products-{i:06d}") for i in range(0, 200)] + [("r", "products"), ("r", "shop-products-x"), ("r", "0012"), ("r", "99"), ("r", None), ("r", "")]
    got = {r.code: r.url for r in linking.codes_in_urls(spark.createDataFrame(codes, "retailer string, code string"), products).collect()}
    urls = [f"https://shop-products.com/p/shop-products-{i:06d}" for i in range(n)]
    want = {c: min(u for u in urls if c in u) for _, c in codes if c and any(c in u for u in urls)}
    assert got == want
