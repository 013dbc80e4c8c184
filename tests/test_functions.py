"""Golden cases of the column expressions."""

import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions import images as I
from shelfwatch.functions import prices as P
from shelfwatch.functions import text as X
from shelfwatch.functions import urls as U
from shelfwatch.operators import learning


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first().o


URLS = ["https://Shop.com/A/b/?x=1#f", "HTTP://user@h.com:80/p;v=1?q", "https://h.com", "https://h.com/a;b/c;d",
        "https://h.com/p#frag", "https://h.com/a//"]


@pytest.mark.parametrize("url", URLS)
def test_url_keys(spark, url):
    p = urlparse(url)
    v2 = f"{p.scheme}://{p.netloc}{p.path}"
    assert one(spark, url, U.url_key_v1) == url.split("?")[0].rstrip("/")
    assert one(spark, url, U.url_key_v2) == v2
    assert one(spark, url, U.url_key_v3) == v2.rstrip("/").lower()
    assert one(spark, url, U.product_identifier) == p.netloc + p.path


@pytest.mark.parametrize("text,want", [("$1,299.00", 1299.0), ("CA$120", None), ("€95", 95.0), ("free", None), ("", None)])
def test_price_symbols(spark, text, want):
    assert one(spark, text, P.price_symbols) == want


def test_other_prices(spark):
    assert one(spark, "now 12. off", P.price_first_number) == 12.0
    assert one(spark, "none", P.price_first_number) == 0.0
    assert one(spark, "CA$ 1,20.5", P.price_digits) == 120.5
    assert one(spark, None, P.price_feed_text) == "0.00"
    assert one(spark, "x\n$ 19.5 now\n20", P.price_from_block) == 19.5
    assert one(spark, "$3 a\n$16", lambda c: P.price_from_block(c, 15, 2000)) == 16.0


@pytest.mark.parametrize("text", ["o'neill a-line 3d", "FREE PEOPLE", "x1y", ""])
def test_title_case_is_per_letter_run(spark, text):
    assert one(spark, text, X.title_case) == text.title()


def test_lists_and_types(spark):
    assert one(spark, "XS-XL", X.parse_sizes) == ["XS", "S", "M", "L", "XL"]
    assert one(spark, "6-8", X.parse_sizes) == ["6-8"]
    assert one(spark, None, X.parse_sizes) == []
    assert one(spark, "Maxi Dress ", X.clothing_type) == "dress"
    assert one(spark, "rain-hat", X.store_type) == "Rain-Hat"


def test_replies(spark):
    as_text = lambda kind: lambda c: F.to_json(X.reply_json(c, kind))
    assert one(spark, "```json\n{\"a\":1}\n```", as_text("object")) == '{"a":1}'
    assert one(spark, "[1]", as_text("object")) is None
    assert one(spark, "[1]", as_text("array")) == "[1]"
    assert one(spark, "no json", as_text("array")) is None


def test_image_upgrade(spark):
    def up(url, retailer):
        return one(spark, url, lambda c: I.upgraded(c, F.lit(retailer)))

    assert up("https://a.com/x_330_430.JPG", "anthropologie") == "https://a.com/x_1094_1405.JPG"
    assert up("https://a.scene7.com/x", "anthropologie").endswith("?wid=1200&hei=1500&fmt=jpeg&qlt=85")
    assert up("https://a.com/$product$/x?wid=5", "anthropologie") == "https://a.com/$zoom$/x?wid=1200"
    assert up("https://c.com/n/ct/1_V2.jpg", "revolve") == "https://c.com/n/uv/1_V2.jpg"
    assert up("https://c.com/a_thumb.png?w=20", "zara") == "https://c.com/a_full.png?w=1200"


def fold(rows):
    state = {}
    for retailer, seq, method, ok, conf, changed in sorted(rows, key=lambda r: r[1]):
        if retailer not in state:
            state[retailer] = [1, int(changed), method, conf]
            continue
        s = state[retailer]
        s[0] += 1
        s[1] += int(changed)
        if ok and conf > s[3]:
            s[2], s[3] = method, conf
    return {k: tuple(v) for k, v in state.items()}


@pytest.mark.parametrize("seed", range(5))
def test_closed_form_of_the_attempt_fold(spark, seed):
    rng = random.Random(seed)
    data = [(f"r{rng.randint(0, 5)}", i, rng.choice("abc"), rng.random() < 0.6, rng.choice([0.1, 0.5, 0.5, 0.9]),
             rng.random() < 0.3) for i in range(60)]
    schema = "retailer string, seq bigint, method string, success boolean, confidence double, url_changed boolean"
    df = spark.createDataFrame(data, schema)

    def flat(x):
        return {r.retailer: (r.sample_size, r.url_changes_detected, r.best_dedup_method, r.dedup_confidence_threshold)
                for r in x.collect()}

    assert flat(learning.fold_linking_attempts(df)) == fold(data)
    half = learning.fold_linking_attempts(df.filter("seq < 30"))
    assert flat(learning.fold_linking_attempts(df.filter("seq >= 30"), half)) == fold(data)


def test_cached_calls(spark):
    rows = [(1, False), (2, True), (3, False), (4, True)]
    df = spark.createDataFrame(rows, "seq bigint, success boolean").select(
        "*", F.lit("p").alias("prompt"), F.lit("2024-01-01").cast("timestamp_ntz").alias("attempted_at"))
    tracked = learning.track_calls(df)
    assert {r.seq: r.response_cached for r in tracked.collect()} == {1: False, 2: False, 3: True, 4: True}
    assert learning.cache_usage(tracked).first().usage_count == 3
