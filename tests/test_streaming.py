"""Streams: restart from the checkpoint, late rows, same answer as the batch form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import learning
from shelfwatch.streaming import jobs, running

PRICES = "catalog_url string, seen_at timestamp, seq bigint, price double"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_alerts_go_on_after_a_restart_and_ignore_late_rows(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    t = lambda h: F.lit(f"2025-01-01 {h:02d}:00:00").cast("timestamp")

    def rows(*items):
        df = None
        for i, (u, h, p) in enumerate(items):
            r = spark.range(1).select(F.lit(u).alias("catalog_url"), t(h).alias("seen_at"), F.lit(i).cast("long").alias("seq"),
                                      F.lit(float(p)).alias("price"))
            df = r if df is None else df.unionByName(r)
        df.coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(PRICES).parquet(src)
        return {(r.catalog_url, r.old_price, r.new_price)
                for r in running.append_available(jobs.price_alerts(stream), out, chk).collect()}

    rows(("a", 1, 10), ("a", 3, 12), ("b", 1, 5))
    assert run() == {("a", 10.0, 12.0)}
    rows(("a", 2, 99), ("b", 2, 5.005), ("c", 1, 1))
    assert run() == {("a", 10.0, 12.0)}
    rows(("a", 4, 11), ("b", 5, 6))
    assert run() == {("a", 10.0, 12.0), ("a", 12.0, 11.0), ("b", 5.005, 6.0)}


def test_retailer_state_equals_the_batch_fold(spark, tmp_path):
    schema = "retailer string, seq bigint, method string, success boolean, confidence double, url_changed boolean"
    data = [(f"r{i % 3}", i, "abc"[i % 3 - i % 2], i % 4 != 0, (i * 37 % 100) / 100, i % 5 == 0) for i in range(90)]
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    for lo in (0, 30, 60):
        put(spark, src, data[lo:lo + 30], schema)
        stream = spark.readStream.schema(schema).parquet(src)
        got = running.update_available(stream, out, chk, apply=jobs.retailer_state(), mode="append")
    last = got.groupBy("retailer").agg(F.max(F.struct("sample_size", "url_changes_detected", "best_dedup_method", "dedup_confidence_threshold")).alias("m"))
    want = learning.fold_linking_attempts(spark.createDataFrame(data, schema))
    assert {(r.retailer, *r.m) for r in last.collect()} == {
        (r.retailer, r.sample_size, r.url_changes_detected, r.best_dedup_method, r.dedup_confidence_threshold) for r in want.collect()}


def test_window_rates_of_stream_and_batch_agree(spark, tmp_path):
    schema = "retailer string, success boolean, attempted_at timestamp"
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    df = spark.range(200).select(F.lit("r").alias("retailer"), (F.col("id") % 3 > 0).alias("success"),
                                 (F.lit("2025-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id") * 7)).alias("attempted_at"))
    df.write.parquet(src)
    stream = jobs.success_rates(spark.readStream.schema(schema).parquet(src), "attempted_at", "1 hour")
    got = running.latest_updates(running.update_available(stream, out, chk), ["retailer", "window_start", "window_end"])
    want = jobs.success_rates(spark.read.parquet(src), "attempted_at", "1 hour")
    assert set(got.select(want.columns).collect()) == set(want.collect())


SIGHTS = [("https://s.com/a?x=1", 0), ("https://s.com/a", 5), ("https://s.com/A/", 23), ("https://s.com/a?y", 24), ("https://s.com/a", 47),
          ("https://s.com/b", 1), ("https://s.com/a", 3000), ("https://s.com/b", 25), ("https://s.com/b", 26)]


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_repeats_are_dropped_for_a_day_whatever_the_batches(spark, tmp_path, parts):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    rows = sorted(SIGHTS, key=lambda r: r[1])
    size = -(-len(rows) // parts)
    for lo in range(0, len(rows), size):
        some = [(u, dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)) for u, h in rows[lo:lo + size]]
        put(spark, src, some, "url string, seen_at timestamp")
        stream = jobs.suppress_repeats(spark.readStream.schema("url string, seen_at timestamp").parquet(src), "seen_at")
        got = running.append_available(stream, out, chk)
    hours = sorted((r.url_key[-1], round((r.seen_at - dt.datetime(2025, 1, 1)).total_seconds() / 3600)) for r in got.collect())
    assert hours == [("a", 0), ("a", 24), ("a", 3000), ("b", 1), ("b", 25)]


@pytest.mark.parametrize("parts", [1, 4])
def test_kept_sights_do_not_depend_on_the_order_of_files(spark, tmp_path, parts):
    schema = "url string, seen_at timestamp"
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    rows = [("https://s.com/a", h) for h in (120, 20, 3000, 40, 0, 24, None, 121, 47, None)]  # not in event order
    for k in range(parts):
        put(spark, src, [(u, None if h is None else dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)) for u, h in rows[k::parts]], schema)
        stream = spark.readStream.schema(schema).parquet(src)
        got = running.update_available(stream, out, chk, apply=jobs.kept_sights("seen_at"), mode="append")
    newest = got.agg(F.max("batch_id")).first()[0]
    times = [r.seen_at for r in got.filter((F.col("batch_id") == newest) & F.col("kept")).collect()]
    assert times.count(None) == 1
    assert sorted(round((t - dt.datetime(2025, 1, 1)).total_seconds() / 3600) for t in times if t) == [0, 24, 120, 3000]


def test_a_late_file_is_not_lost(spark, tmp_path):
    schema = "url string, seen_at timestamp"
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    for days in ([5, None], [1, None], [1, 5]):
        put(spark, src, [("https://s.com/a", d and dt.datetime(2025, 1, d)) for d in days], schema)
        got = running.append_available(jobs.suppress_repeats(spark.readStream.schema(schema).parquet(src), "seen_at"), out, chk)
    assert sorted(str(r.seen_at) for r in got.collect()) == ["2025-01-01 00:00:00", "2025-01-05 00:00:00", "None"]


@pytest.mark.parametrize("parts", [1, 2])
def test_an_item_is_queued_once_whatever_the_batches(spark, tmp_path, parts):
    schema = "seq bigint, catalog_url string, retailer string, title string, price double, product_code string"
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    rows = [(1, "https://a.com/new/1", "r", "one thing", 5.0, None), (2, "https://a.com/new/1", "r", "one thing", 5.0, None)]
    products = spark.createDataFrame([("https://a.com/old", "r", "something else", 9.0, None)], "url string, retailer string, title string, price double, product_code string")
    queue = spark.createDataFrame([], "product_url string, review_type string")
    for lo in range(0, 2, 2 // parts):
        put(spark, src, rows[lo:lo + 2 // parts], schema)
        apply = jobs.classify_and_queue(products, queue, F.lit("2025-01-01").cast("timestamp"), "seq")
        got = running.update_available(spark.readStream.schema(schema).parquet(src), out, chk, apply=apply, mode="append")
    assert [(r.product_url, r.review_type, r.priority) for r in got.collect()] == [("https://a.com/new/1", "modesty", "normal")]


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_sessions_do_not_depend_on_the_batches(spark, tmp_path, parts):
    schema = "reviewed_by string, reviewed_at timestamp"
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    start = dt.datetime(2025, 1, 1)
    rows = [(f"r{i % 2}", start + dt.timedelta(minutes=(i * i * 7) % 900)) for i in range(60)]  # not in event order
    for k in range(parts):
        put(spark, src, rows[k::parts], schema)
        stream = spark.readStream.schema(schema).parquet(src)
        got = running.update_available(stream, out, chk, apply=jobs.merged_sessions("reviewed_at"), mode="append")
    newest = got.agg(F.max("batch_id")).first()[0]
    want = jobs.review_sessions(spark.createDataFrame(rows, schema), "reviewed_at")
    assert set(got.filter(F.col("batch_id") == newest).select(want.columns).collect()) == set(want.collect())
