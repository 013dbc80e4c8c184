"""Upserts, merges and the queue on small frames."""

import datetime as dt

from pyspark.sql import functions as F

from shelfwatch.operators import changes, ordered, review

AS_OF = dt.datetime(2025, 1, 2)


def now():
    return F.lit("2025-01-02 00:00:00").cast("timestamp_ntz")


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


STORED = "url string, retailer string, title string, price double, shopify_status string, images_uploaded int, " \
         "assessment_status string, first_seen timestamp_ntz, last_updated timestamp_ntz"


def test_upsert_folds_a_batch_in_order(spark):
    old = dt.datetime(2024, 1, 1)
    have = spark.createDataFrame([("a", "r", "old", 1.0, "published", 1, "assessed", old, old)], STORED)
    batch = spark.createDataFrame([
        (1, "a", "other", "first", 5.0), (2, "a", "other", None, 6.0), (3, "b", "s", "new", None)],
        "seq bigint, url string, retailer string, title string, price double")
    got = rows(changes.upsert_products(have, batch, now(), seq="seq"), "url")
    assert (got["a"]["title"], got["a"]["price"], got["a"]["retailer"]) == ("first", 6.0, "r")
    assert (got["a"]["first_seen"], got["a"]["last_updated"]) == (old, AS_OF)
    assert got["a"]["shopify_status"] == "not_uploaded"
    assert got["b"]["retailer"] == "s" and got["b"]["first_seen"] == AS_OF
    kept = rows(changes.upsert_products(have, batch, now(), "seq", defaults_on_insert_only=True), "url")
    assert kept["a"]["shopify_status"] == "published" and kept["b"]["shopify_status"] == "not_uploaded"


def test_listing_price_is_overwritten_even_with_null(spark):
    s = "catalog_url string, retailer string, title string, price double, discovered_date date"
    have = spark.createDataFrame([("u", "r", "t", 9.0, dt.date(2024, 1, 1))], s)
    new = spark.createDataFrame([("u", "r", None, None)], "catalog_url string, retailer string, title string, price double")
    got = rows(changes.upsert_listings(have, new, now()), "catalog_url")["u"]
    assert got["title"] == "t" and got["price"] is None and got["discovered_date"] == dt.date(2024, 1, 1)


def test_merge_of_remote_reviews_step_by_step(spark):
    s = "url string, lifecycle_stage string, assessed_at timestamp_ntz, modesty_status string, shopify_status string, last_updated timestamp_ntz"
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    local = spark.createDataFrame([
        ("pending", "pending_assessment", None, None, "draft", t1), ("none", None, None, None, "draft", t1),
        ("newer", "assessed_approved", t2, "modest", "published", t1),
        ("older", "assessed_approved", t1, "modest", "published", t1)], s)
    remote = spark.createDataFrame([
        ("pending", "assessed_approved", t1, "modest", "published", t2), ("none", "assessed_rejected", t1, "not_modest", "draft", t2),
        ("newer", "assessed_rejected", t1, "not_modest", "draft", t2), ("older", "assessed_rejected", t2, "not_modest", "draft", t2),
        ("unknown", "assessed_approved", t2, "modest", "published", t2), ("pending", "pending_assessment", t2, None, None, t2)], s)
    once = changes.merge_remote_reviews(local, remote)
    got = rows(once, "url")
    assert {u for u, r in got.items() if r["was_merged"]} == {"pending", "none", "older"}
    assert got["newer"]["lifecycle_stage"] == "assessed_approved" and "unknown" not in got
    again = rows(changes.merge_remote_reviews(once.drop("was_merged"), remote), "url")
    assert not any(r["was_merged"] for r in again.values())


def test_changed_fields_edges(spark):
    s = "url string, price double, original_price double, sale_status string, stock_status string, title string, description string, image_urls array<string>"
    base = ("u", 10.0, None, "a", "b", "Dress", "x", ["1", "2"])
    old = spark.createDataFrame([base], s).select("url", F.struct("*").alias("old"))

    def diff(**kw):
        names = [p.split()[0] for p in s.split(", ")]
        row = dict(zip(names, base), **kw)
        new = spark.createDataFrame([tuple(row[n] for n in names)], s).select("url", F.struct("*").alias("new"))
        return old.join(new, "url").select(changes.changed_fields("old", "new").alias("c")).first().c

    assert diff(price=10.01, title=" dress\n", image_urls=["2", "1", "2"], original_price=0.0) == []
    assert diff(price=10.02) == ["price"] and diff(price=None) == ["price"]
    assert diff(sale_status=None) == ["sale_status"] and diff(image_urls=[]) == ["images"]
    assert diff(description="x" * 501) == ["description"]


def test_queue_insert_ignores_known_and_repeated_items(spark):
    q = spark.createDataFrame([("u1", "modesty")], "product_url string, review_type string")
    new = spark.createDataFrame([(1, "u1", "modesty", "low"), (2, "u2", "modesty", "high"), (3, "u2", "modesty", "low"),
                                 (4, "u2", "duplication", "low"), (5, None, "modesty", "low")],
                                "seq bigint, product_url string, review_type string, priority string")
    got = {(r.product_url, r.review_type, r.priority) for r in review.add_to_queue(q, new, now(), "seq").collect()}
    assert got == {("u2", "modesty", "high"), ("u2", "duplication", "low")}


def test_skipped_rows_keep_their_decision(spark):
    q = spark.createDataFrame([(1, "u", "pending", None, None, None, None), (2, "v", "pending", None, None, None, None)],
                              "id bigint, product_url string, status string, review_decision string, reviewer_notes string, reviewed_at timestamp_ntz, reviewed_by string")
    r = spark.createDataFrame([(1, "modest", "n", "w"), (2, None, "later", "w")],
                              "id bigint, review_decision string, reviewer_notes string, reviewed_by string")
    got = rows(review.mark_reviewed(q, r, now()), "id")
    assert (got[1]["status"], got[1]["reviewed_by"]) == ("reviewed", "w")
    assert (got[2]["status"], got[2]["review_decision"], got[2]["reviewed_by"]) == ("skipped", None, None)


def test_chunked_lag_equals_plain_order(spark):
    data = [(k, i, float((i * 7 + k) % 11)) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(data, "k int, seq bigint, v double").withColumn("c", ordered.chunk_of(F.col("seq"), 6))
    got = {(r.k, r.seq): r.prev for r in ordered.with_previous(df, ["k"], ["c"], ["c", "seq"], "v", "prev").collect()}
    value = {(k, i): v for k, i, v in data}
    assert got == {(k, i): value.get((k, i - 1)) for k, i, _ in data}
    pos = ordered.with_position(df, ["k"], ["c"], ["c", "seq"]).collect()
    assert all(r.position == r.seq and r.total == 40 for r in pos)
