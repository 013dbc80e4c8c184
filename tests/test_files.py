"""Readers and writers on temporary folders."""

import json

from pyspark.sql import functions as F

from shelfwatch.operators.changes import snapshot_rows
from shelfwatch.sources import files, sinks


def test_batch_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"urls": ["u1", "u2"], "modesty_level": "modest"}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(["u3"]))
    got = {(r.batch_id, r.position, r.url, r.modesty_level) for r in files.read_batches(spark, str(tmp_path)).collect()}
    assert got == {("a", 0, "u1", "modest"), ("a", 1, "u2", "modest"), ("b", 0, "u3", None)}


def test_url_lists(spark, tmp_path):
    (tmp_path / "list").write_text(" https://a\n\nhttps://b")
    assert {r.url for r in files.read_url_lists(spark, str(tmp_path)).collect()} == {"https://a", "https://b"}


def test_failure_reports(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({
        "batch_id": "b", "workflow": "w", "total_failed": 1,
        "failures": [{"url": "u", "reason": "r", "certainty": "uncertain", "has_price": True}]}))
    (tmp_path / "y.json").write_text(json.dumps({"batch_id": "c", "workflow": "w", "total_failed": 0, "failures": []}))
    got = {(r.batch_id, r.url, r.has_price) for r in files.read_failures(spark, str(tmp_path)).collect()}
    assert got == {("b", "u", True), ("c", None, None)}


def test_checkpoints(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({
        "batch_id": "b", "total_urls": 3, "all_urls": ["x", "y", "x"], "processed_urls": ["y"],
        "successful_count": 1, "failed_count": 0}))
    rows = files.read_checkpoints(spark, str(tmp_path))
    assert sorted((r.position, r.url) for r in files.checkpoint_remaining(rows).collect()) == [(0, "x"), (2, "x")]
    assert files.checkpoint_statistics(rows).first().remaining == 2


def test_retailers_and_phrases(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"retailers": {"x": {
        "display_name": "X", "catalog_urls": {"tops": "u"}, "pagination": {"type": "offset", "items_per_page": 90},
        "stock_status_mappings": {"few left": "low in stock"}}}}))
    r = files.read_retailers(spark, str(tmp_path)).first()
    assert (r.retailer, r.catalog_urls["tops"], r.items_per_page) == ("x", "u", 90)
    text = spark.read.text(str(tmp_path), wholetext=True)
    assert files.parse_stock_phrases(text).first() == ("x", "few left", "low in stock")


def test_listing_records(spark, tmp_path):
    (tmp_path / "t.txt").write_text(
        "PRODUCT | URL=https://s.com/d/AB-1?x=a=b | TITLE=Dress | PRICE=$1,050 | IMAGE=i\n"
        "note\nPRODUCT | URL=https://s.com/e | PRICE=3\nPRODUCT | url=u | TITLE=T | ORIGINAL_PRICE=$9\n")
    got = {r.title: r for r in files.read_listing_records(spark, str(tmp_path)).collect()}
    assert got["Dress"].url == "https://s.com/d/AB-1?x=a=b" and got["Dress"].product_code == "AB-1"
    assert got["Dress"].price == 1050.0 and got["Dress"].image_urls == ["i"] and got["Dress"].sale_status == "regular"
    assert got["T"].sale_status == "on_sale" and len(got) == 2


def test_snapshot_append_is_partitioned_and_prunable(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = spark.range(20).select(
        F.concat(F.lit("u"), "id").alias("catalog_url"), F.when(F.col("id") < 5, "a").otherwise("b").alias("retailer"),
        F.lit("t").alias("title"), F.lit(1.0).alias("price"), F.lit(None).cast("string").alias("product_code"),
        F.array().cast("array<string>").alias("image_urls"))
    out = snapshot_rows(rows, F.lit("tops"), F.lit("2025-01-01 10:00:00").cast("timestamp_ntz"))
    sinks.append_snapshot(out, path)
    sinks.append_snapshot(out, path)
    back = spark.read.parquet(path)
    assert back.count() == 40 and back.filter("retailer = 'a'").count() == 10
    plan = back.filter("retailer = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(retailer" in plan


def test_failures_are_written_row_by_row(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = spark.createDataFrame([("w", "b", "u1"), ("w", "b", "u2"), ("w", "c", "u3")], "workflow string, batch_id string, url string")
    sinks.write_failures(rows, path)
    assert spark.read.json(f"{path}/records").count() == 3
    assert {(r.batch_id, r.total_failed) for r in spark.read.json(f"{path}/headers").collect()} == {("b", 2), ("c", 1)}
