"""Readers of batch, list, report, checkpoint and configuration files, and of page stores.

Each reader is a parser over a DataFrame of text rows with a thin ``read_``
function in front, so that the same parsing runs over text from anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch import schemas
from shelfwatch.functions.prices import price_symbols
from shelfwatch.functions.urls import product_code

# Retailers whose listing has numbered pages.
PAGINATED_RETAILERS = ["anthropologie", "urban_outfitters", "nordstrom", "abercrombie"]

PATTERN_STRUCT = """map<string, struct<display_name: string, catalog_urls: map<string, string>,
  pagination: struct<type: string, items_per_page: int>,
  deduplication_strategy: struct<primary: string, threshold: double, reason: string>,
  product_code_extraction: struct<pattern: string, reliability: string, note: string>>>"""
STOCK_STRUCT = "map<string, struct<stock_status_mappings: map<string, string>>>"
SELECTOR_STRUCT = """map<string, map<string, struct<selector: string, confidence: double,
  success_count: int, failure_count: int, last_success: string, status: string>>>"""


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(name, "/", -1), r"\.[^.]*$", "")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_name").alias("file_name"))


def parse_batches(files: DataFrame) -> DataFrame:
    """Url rows of batch files: an object with ``urls``, or a bare list.

    A file's fields are read before its urls are taken apart; beside the generator they would be read out of the whole
    text once per url.
    """
    v = F.try_parse_json("value")

    def get(path, kind="string"):
        return F.try_variant_get(v, path, kind)

    urls = F.coalesce(get("$.urls", "array<string>"), get("$", "array<string>"))
    fields = ["batch_id", "modesty_level", "retailer", "product_type"]
    read = files.select(
        _stem(F.col("file_name")).alias("batch_id"), get("$.modesty_level").alias("modesty_level"),
        get("$.retailer").alias("retailer"), get("$.product_type").alias("product_type"), urls.alias("urls"))
    return read.select(*fields, F.posexplode("urls").alias("position", "url"))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return parse_batches(_whole(spark, path))


def parse_url_lists(lines: DataFrame) -> DataFrame:
    """One url per line; blank lines do not count."""
    return lines.select("file_name", F.trim("value").alias("url")).filter(F.col("url") != "")


def read_url_lists(spark: SparkSession, path: str) -> DataFrame:
    return parse_url_lists(spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("file_name")))


def flatten_failures(reports: DataFrame) -> DataFrame:
    """One row per failure record with its report header; empty reports keep one row."""
    header = ["batch_id", "workflow", "retailer", "category", "modesty_level", "run_date",
              "total_failed"]
    rows = reports.withColumnRenamed("product_type", "batch_product_type") \
        .select(*header, "batch_product_type", F.explode_outer("failures").alias("f"))
    return rows.select(*header, "batch_product_type", "f.*")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    return flatten_failures(spark.read.schema(schemas.FAILURE_REPORT).json(path, multiLine=True))


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHECKPOINT).json(path, multiLine=True)


def checkpoint_remaining(checkpoints: DataFrame) -> DataFrame:
    """Urls of each batch not processed yet, in order, duplicates kept."""
    every = checkpoints.select("batch_id", F.posexplode("all_urls").alias("position", "url"))
    done = checkpoints.select("batch_id", F.explode("processed_urls").alias("url")).distinct()
    return every.join(done, ["batch_id", "url"], "left_anti")


def checkpoint_statistics(checkpoints: DataFrame) -> DataFrame:
    """Counts of each checkpoint; ``remaining`` are its urls not processed yet, duplicates counted.

    Both lists are sorted together, a processed url before its copies in the whole list, and gone through once. Nothing
    counts as remaining beside an unknown processed url, nor does an unknown url.
    """
    def marked(urls, rank):
        known = F.filter(urls, lambda u: u.isNotNull())
        return F.transform(known, lambda u: F.struct(u.alias("u"), F.lit(rank).alias("rank")))

    both = F.sort_array(F.concat(marked("processed_urls", 0), marked("all_urls", 1)))
    start = F.struct(F.lit(None).cast("string").alias("done"), F.lit(0).alias("n"))

    def step(seen, x):
        left = seen["n"] + (~x["u"].eqNullSafe(seen["done"])).cast("int")
        return F.when(x["rank"] == 0, F.struct(x["u"].alias("done"), seen["n"].alias("n"))).otherwise(
            F.struct(seen["done"].alias("done"), left.alias("n")))

    unknown = F.col("processed_urls").isNull() | F.exists("processed_urls", lambda u: u.isNull())
    left = F.when(unknown & (F.size("all_urls") >= 0), F.lit(0)).when(
        F.size("all_urls") >= 0, F.aggregate(both, start, step, lambda seen: seen["n"])).otherwise(F.size("all_urls"))
    return checkpoints.select("batch_id", "total_urls", F.size("processed_urls").alias("processed"),
                              F.col("successful_count").alias("successful"),
                              F.col("failed_count").alias("failed"), left.alias("remaining"))


def parse_retailers(files: DataFrame) -> DataFrame:
    """Retailer dimension from a configuration with a ``retailers`` object."""
    config = F.from_json(F.get_json_object("value", "$.retailers"), PATTERN_STRUCT)
    rows = files.select(F.explode(config).alias("retailer", "c"))
    return rows.select(
        "retailer", "c.display_name", "c.catalog_urls",
        F.col("c.pagination.type").alias("pagination_type"),
        F.col("c.pagination.items_per_page").alias("items_per_page"),
        F.col("c.deduplication_strategy.primary").alias("dedup_primary"),
        F.col("c.deduplication_strategy.threshold").alias("dedup_threshold"),
        F.col("c.product_code_extraction.pattern").alias("code_pattern"))


def read_retailers(spark: SparkSession, path: str) -> DataFrame:
    return parse_retailers(_whole(spark, path))


def parse_stock_phrases(files: DataFrame) -> DataFrame:
    """(retailer, phrase, stock_status) rows of the stock phrase maps."""
    config = F.from_json(F.get_json_object("value", "$.retailers"), STOCK_STRUCT)
    rows = files.select(F.explode(config).alias("retailer", "c"))
    return rows.select("retailer", F.explode("c.stock_status_mappings").alias("phrase",
                                                                              "stock_status"))


def parse_selectors(files: DataFrame) -> DataFrame:
    """Learned selectors of an export as rows per (retailer, element)."""
    m = F.from_json(F.get_json_object("value", "$.learned_selectors"), SELECTOR_STRUCT)
    outer = files.select(F.explode(m).alias("retailer", "elements"))
    return outer.select("retailer", F.explode("elements").alias("element", "e")) \
        .select("retailer", "element", "e.*")


def read_selectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_selectors(_whole(spark, path))


def parse_listing_records(lines: DataFrame) -> DataFrame:
    """Rows of ``PRODUCT | KEY=value | ...`` lines that have a URL and a TITLE."""
    line = F.trim("value")
    body = F.expr("substring(trim(value), 10)")
    parts = F.filter(F.transform(F.split(body, r"\|"), lambda p: F.trim(p)),
                     lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(parts, lambda p: F.struct(
        F.upper(F.trim(F.substring_index(p, "=", 1))).alias("k"),
        F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v")))

    def last(key):
        hits = F.filter("_pairs", lambda x: x["k"] == key)
        return F.try_element_at(F.transform(hits, lambda x: x["v"]), F.lit(-1))

    rows = (lines.filter(line.startswith("PRODUCT |")).withColumn("_pairs", pairs)
            .withColumns({"url": last("URL"), "title": last("TITLE"), "_p": last("PRICE"),
                          "_o": last("ORIGINAL_PRICE"), "_i": last("IMAGE")}))
    original = price_symbols(F.col("_o"))
    keep = [c for c in lines.columns if c != "value"]
    return rows.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")) \
        .select(*keep, "url", product_code(F.col("url"), F.lit("")).alias("product_code"), "title",
                price_symbols(F.col("_p")).alias("price"), original.alias("original_price"),
                F.when(F.nullif("_i", F.lit("")).isNotNull(), F.array("_i")).alias("image_urls"),
                F.when(original.isNotNull(), "on_sale").otherwise("regular").alias("sale_status"),
                F.lit("in_stock").alias("availability"))


def read_listing_records(spark: SparkSession, path: str) -> DataFrame:
    return parse_listing_records(spark.read.text(path))


def page_plan(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Urls to scan per request: pages 1 and 2 where the retailer is paginated, else page 1.

    ``pages`` is the (retailer, category, page, url) dimension.
    """
    depth = F.when(F.lower("retailer").isin(PAGINATED_RETAILERS), 2).otherwise(1)
    asked = requests.select(F.lower("retailer").alias("retailer"),
                            F.lower("category").alias("category"), depth.alias("depth"))
    return (asked.join(pages, ["retailer", "category"]).filter(F.col("page") <= F.col("depth"))
            .select("retailer", "category", "page", "url"))
