"""What failed on larger tables: broadcasts by a compressed size, work per url of a file, Python calls per key."""

import datetime as dt
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from shelfwatch.operators import fuzzy, linking, quality
from shelfwatch.sources import files
from shelfwatch.streaming import jobs

LISTING = "retailer string, catalog_url string, title string, price double, product_code string, image_urls array<string>"
PRODUCT = "retailer string, url string, title string, price double, product_code string, image_urls array<string>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def few(spark):
    listings = [("r", f"u{i}?p=1", f"red dress {i}", 10.0 + i, f"AB-10{i}", [f"i{i}", "s"]) for i in range(4)]
    products = [("r", f"u{i}", f"red dress {i}s", 10.5 + i, f"AB-10{i}", [f"i{i}", "s"]) for i in range(3)]
    return spark.createDataFrame(listings, LISTING), spark.createDataFrame(products, PRODUCT)


def test_linking_broadcasts_no_table(spark):
    listings, products = few(spark)
    for df in (linking.link_listings(listings, products), linking.backfill_links(listings, products),
               linking.classify_listings(listings, products, listings), linking.price_changes(listings, products, F.lit(0)),
               linking.match_code_or_url(listings, products), linking.match_image_overlap(listings, products),
               linking.match_title_near_price(listings, products), fuzzy.title_price_pairs(products)):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
    got = linking.backfill_links(listings, products).select("catalog_url", "linked_product_url", "link_method").collect()
    assert sorted(map(tuple, got)) == [(f"u{i}?p=1", f"u{i}" if i < 3 else None, "normalized_url" if i < 3 else None) for i in range(4)]


def test_title_level_takes_the_chain_once(spark):
    listings, products = few(spark)
    assert plan(linking.backfill_links(listings, products, fuzzy_level=False)).count("SortMergeJoin") == 5


def test_batch_fields_are_read_before_urls_are_taken_apart(spark):
    texts = [("a/b1.json", '{"urls": ["x", "y"], "modesty_level": "modest"}'), ("b2.json", '["z"]'), ("b3.json", "no json")]
    df = files.parse_batches(spark.createDataFrame(texts, "file_name string, value string"))
    assert "parse_json" not in plan(df).split("Generate posexplode")[0]
    assert sorted(map(tuple, df.select("batch_id", "modesty_level", "position", "url").collect())) == [
        ("b1", "modest", 0, "x"), ("b1", "modest", 1, "y"), ("b2", None, 0, "z")]


def test_remaining_urls_of_a_checkpoint_in_one_pass(spark):
    rng = random.Random(3)

    def urls(unknown):
        return None if rng.random() < 0.1 else [None if rng.random() < unknown else rng.choice("abcdef") for _ in range(rng.randint(0, 9))]

    rows = [(f"b{i % 40}", urls(0.1), urls(0.03), 1, 1, 0) for i in range(200)]
    df = spark.createDataFrame(rows, "batch_id string, all_urls array<string>, processed_urls array<string>, total_urls int, successful_count int, failed_count int")
    out = files.checkpoint_statistics(df)
    assert "array_contains" not in plan(out)

    def left(every, done):
        if every is None:
            return None
        return 0 if done is None or None in done else sum(u is not None and u not in done for u in every)

    key = repr
    assert sorted(((r.batch_id, r.remaining) for r in out.collect()), key=key) == sorted(((r[0], left(r[1], r[2])) for r in rows), key=key)


def test_kept_sights_without_python(spark):
    hour = dt.timedelta(hours=1)
    start = dt.datetime(2024, 1, 1)
    rng = random.Random(5)
    rows = [(f"https://x/{rng.randrange(4)}", start + rng.randrange(200) * hour, i) for i in range(150)]
    rows += [("https://x/0", None, 900), ("https://x/0", None, 901), rows[0], rows[1]]
    batch = spark.createDataFrame(rows, "url string, at timestamp, n int")
    out = jobs.kept_sights("at")(batch)
    assert "InPandas" not in plan(out)
    want = {}
    for url in {r[0] for r in rows}:
        last = None
        for at in sorted({r[1] for r in rows if r[0] == url and r[1]}):
            if last is None or at - last >= 24 * hour:
                want[url, at], last = 1, at
    want["https://x/0", None] = 1
    got = {}
    for r in out.filter("kept").collect():
        got[r.url, r.at] = got.get((r.url, r.at), 0) + 1
    assert got == want and out.count() == len(rows)


def test_price_alerts_hold_prices_by_bucket(spark, tmp_path):
    schema = "catalog_url string, seen_at timestamp, seq bigint, price double"
    rng = random.Random(7)
    start, last, want = dt.datetime(2024, 1, 1), {}, []
    for k in range(2):
        rows = [(rng.choice(["a", "b", "c", "d", None]), start + dt.timedelta(days=k, minutes=rng.randrange(600)), k * 100 + i,
                 float(rng.choice([0, 5, 5.005, 7, 9]))) for i in range(60)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        alerts = jobs.price_alerts(live, buckets=2)
        assert "bucket" in alerts._jdf.queryExecution().analyzed().toString()
        (alerts.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True)
         .start(str(tmp_path / "out")).awaitTermination())
        for url, at, seq, price in sorted(rows, key=lambda r: r[1:3]):
            if price:
                if url in last and abs(price - last[url]) >= 0.01:
                    want.append((url, seq, last[url], price))
                last[url] = price
    got = spark.read.parquet(str(tmp_path / "out")).select("catalog_url", "seq", "old_price", "new_price").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_many_prices_of_one_title(spark):
    """The smallest url in the band is found, and a listing meets cells of a title and not each of its prices."""
    rng = random.Random(13)
    nan, inf = float("nan"), float("inf")
    products = sorted({("r", rng.choice(["red dress", "red dresses"]), round(rng.uniform(5, 300), 2), f"u{rng.randrange(10**6):06d}") for _ in range(3000)})
    products += [("r", "red dress", p, "a") for p in (nan, inf, 0.0, -5.0, None)] + [("s", "red dress", 50.0, "b"), (None, "red dress", 50.0, "c")]
    prices = [round(rng.uniform(4, 320), 2) for _ in range(60)] + [nan, None, 0.0, 50.0, 45.0, 55.0, 1e9, 0.005]
    listings = [("r", t, p) for p in prices for t in ("Red dress ", "red dresses", "red dressed", "else")]
    left = spark.createDataFrame(listings, "retailer string, title string, price double")
    right = spark.createDataFrame(products, "retailer string, title string, price double, url string")
    by_title = {}
    for r, t, p, u in products:
        if r == "r" and p and p > 0:
            by_title.setdefault(t, []).append((p, u))
    ratio = {(a, b): SequenceMatcher(None, a, b).ratio() for a in ("red dress", "red dresses", "red dressed", "else") for b in by_title}
    for band, threshold, holds in ((fuzzy.RelativeBand(0.10), 0.85, lambda a, b: abs(a - b) / a < 0.10), (fuzzy.AbsoluteBand(1.0), 0.90, lambda a, b: abs(b - a) < 1.0)):
        want = {}
        for _, t, p in listings:
            low = t.strip().lower()
            best = min(((-ratio[low, b], u) for b, rows in by_title.items() if ratio[low, b] > threshold for q, u in rows if p and holds(p, q)), default=None)
            if best:
                want[low, p] = (best[1], -best[0])
        got = {(r.lt, r.lp): (r.url, r.ratio) for r in fuzzy.best_fuzzy(left, right, band, threshold).collect()}
        assert got == want and len(want) > 100
    values = fuzzy._listing_values(left).withColumn("rt", F.col("lt")).filter("lp between 20 and 200")
    near = values.withColumn("bucket", fuzzy._near_buckets(fuzzy.RelativeBand(0.10), F.col("lp")))
    urls = fuzzy.smallest_in_band(near, fuzzy._product_values(right), fuzzy.RelativeBand(0.10))
    assert urls.count() <= 16 * values.count()


def test_texts_of_a_page_are_shuffled_once(spark, monkeypatch):
    """Links are found as by the plain loop; texts go to their page once and without the bags of their characters."""
    plans, kept = {}, quality.staged
    monkeypatch.setattr(quality, "staged", lambda df, label: plans.setdefault(label, plan(df)) and kept(df, label))
    rng = random.Random(11)
    words = ["red", "blue", "silk", "midi", "dress", "skirt"]
    links = [(p, i, f"https://s.com/{'-'.join(rng.choices(words, k=3))}", rng.choice(["a b", None, ""]), "$5") for p in range(6) for i in range(5)]
    rows = [(p, i, rng.choice([str.upper, str.lower])(" ".join(rng.choices(words, k=3))), float(i % 2)) for p in range(7) for i in range(4)]
    rows += [rows[0], (1, None, None, None), (None, 0, "red silk dress", 1.0), (2, 9, "", 1.0)]
    out = quality.reconcile_by_slug(spark.createDataFrame(links, "page_id long, position int, url string, dom_title string, dom_price string"),
                                    spark.createDataFrame(rows, "page_id long, position int, title string, price double")).collect()
    want, taken = [], set()
    for p, _, title, price in set(rows):
        scores = [(-SequenceMatcher(None, (title or "").lower(), u.split("/")[-1]).ratio(), i, u) for q, i, u, *_ in links if q == p and title]
        if scores and min(scores)[0] < -0.5:
            want.append((p, min(scores)[2], title, price, -min(scores)[0]))
            taken.add((p, min(scores)[2]))
    left = sorted((p, u) for p, _, u, *_ in links if (p, u) not in taken)
    assert sorted(r[:5] for r in map(tuple, out) if r[4] is not None) == sorted(want)
    assert sorted(r[:2] for r in map(tuple, out) if r[4] is None) == left
    assert plans["slug-bounds"].count("Exchange hashpartitioning(") == 2
