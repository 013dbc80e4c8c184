"""Nothing is cut: rows and texts beyond every former limit count, and scratch space is never a guess."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwatch import session
from shelfwatch.functions import text as X
from shelfwatch.operators import changes, extraction, linking, ordered, quality
from shelfwatch.plans import monitor
from shelfwatch.sources import sinks


def test_a_large_blocked_page_is_blocked(spark):
    html = "<html>" + "x" * 600_000 + " Access Denied </html>"
    row = quality.page_validity(spark.createDataFrame([(html, "revolve")], "html string, retailer string")).first()
    assert (row.error, row.valid) == ("blocked: access denied", False)


def test_a_late_source_line_is_seen(spark):
    rows = spark.createDataFrame([("y" * 2000 + " URL Source: https://www.other.com/home ", "https://a.com/p/1")], "content string, url string")
    assert rows.select(quality.homepage_redirect(F.col("content"), F.col("url"))).first()[0]


def test_listings_beyond_the_hundredth_are_kept(spark):
    links = "".join(f'<a href="/shop/p{i}">item {i}</a>' for i in range(230))
    pages = spark.createDataFrame([(1, "site", links)], "page_id long, retailer string, html string")
    assert extraction.listing_links(pages).count() == 230
    assert extraction.listing_links(pages, limit=100).count() == 100
    tiles = "".join(f'<li class="plp__product js"><a href="https://www.r.com/a/dp/C{i}/?p=1">x</a><img alt="some title {i}">$100.00</li>' for i in range(170))
    assert extraction.listing_tiles(spark.createDataFrame([(1, "revolve", tiles)], pages.schema)).count() == 170


def test_a_long_description_is_compared_to_its_end(spark):
    schema = "url string, price double, original_price double, sale_status string, stock_status string, title string, description string, image_urls array<string>"
    old = ("u", 1.0, None, "s", "i", "t", "d" * 600 + "a", ["x"])
    new = (*old[:6], "d" * 600 + "b", ["x"])
    both = spark.createDataFrame([(old, new)], f"old struct<{schema.replace(' ', ':').replace(',:', ',')}>, new struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    assert both.select(changes.changed_fields("old", "new").alias("c")).first().c == ["description"]


def test_sections_and_sizes(spark):
    row = spark.range(1).select(extraction.product_section(F.lit("# A\nnow $5")).alias("s"), X.parse_sizes(F.lit(" 2-4 ")).alias("z")).first()
    assert row.s == "# A\n\nPrice: $5\n\n" and row.z == ["2-4"]


def test_positions_are_matched_by_order(spark):
    first = spark.createDataFrame([(1, p, f"https://a.com/{p}", f"t{p}", "$5.00") for p in (0, 1)], "page_id long, position int, url string, dom_title string, dom_price string")
    second = spark.createDataFrame([(1, p + 1, f"t{p}", 5.0) for p in (0, 1)], "page_id long, position int, title string, price double")
    got = quality.reconcile_by_position(first, second).collect()
    assert sorted((r.position, r.title) for r in got) == [(0, "t0"), (1, "t1")]


LISTING = "seq long, catalog_url string, retailer string, title string, price double, product_code string, clothing_type string"


def test_a_code_only_the_history_knows(spark):
    now = spark.createDataFrame([(1, "https://r.com/new/9", "r", "new name", 7.0, "ZX-77", None)], LISTING)
    seen = spark.createDataFrame([(0, "https://r.com/old/1", "r", "old name", 5.0, "ZX-77", None)], LISTING)
    products = spark.createDataFrame([("https://r.com/q", "r", "other", 1.0, "AA-1")], "url string, retailer string, title string, price double, product_code string")
    row = linking.classify_listings(now, products, seen).first()
    assert (row.status, row.match_method, row.confidence, row.matched_url) == ("confirmed_existing", "product_code", 0.95, "https://r.com/old/1")


def test_routes_and_priorities(spark):
    found = spark.createDataFrame([(1, "u1", "mango", "coat", "confirmed_new", None), (2, "u2", "mango", "dress", "confirmed_new", None), (3, "u3", "hm", "coat", "suspected_duplicate", "m"),
                                   (4, "u4", "hm", "coat", "confirmed_existing", "m")],
                                  "seq long, catalog_url string, retailer string, clothing_type string, status string, matched_url string")
    items, drafts = monitor.new_items(found, "seq")
    assert {(r.product_url, r.review_type, r.priority) for r in items.collect()} == {("u2", "modesty", "normal"), ("u3", "duplication", "low")}
    assert [r.catalog_url for r in drafts.collect()] == ["u1"]


def test_partitioned_rows_are_written_whole_and_once(spark, tmp_path):
    rows = spark.range(5000).select("id", F.lit("big").alias("retailer"), F.lit(dt.date(2025, 1, 1)).alias("day"))
    sinks.append_partitioned(rows, str(tmp_path / "t"), ["retailer", "day"])
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == list(range(5000))


def test_a_cluster_must_name_the_shared_folder():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        session.scratch_root(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:///scratch/"
    assert session.scratch_root(Session()) == "hdfs:///scratch"


def test_price_history_of_heavy_and_light_listings_agrees(spark):
    rows = [(i, f"u{i % 3}", dt.date(2025, 1, 1 + (i * 7) % 20), float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, catalog_url string, discovered_date date, price double")
    light, heavy, mixed = (ordered.price_history(df, "seq", 10, n) for n in (10**9, 0, 66))
    assert set(light.collect()) == set(heavy.select(light.columns).collect()) == set(mixed.select(light.columns).collect())
