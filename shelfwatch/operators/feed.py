"""Store feed rows, tags and metafields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions import prices as P
from shelfwatch.functions import text as X
from shelfwatch.functions.urls import product_code
from shelfwatch.operators.changes import publish_status

# System tag, pending tags, stock levels.
SYSTEM_TAG = "Auto-Scraped"
PENDING_TAGS = ["not-assessed", "pending-modesty-review"]
STOCK_LEVELS = {"in_stock": 100, "low_stock": 5, "out_of_stock": 0}
RAW_STOCK_LEVELS = {"in stock": 100, "low in stock": 5, "out of stock": 0}


def _words(c: Column) -> Column:
    return X.title_case(F.replace(c, F.lit("_"), F.lit(" ")))


def tags(decision: Column, retailer: Column, product_type: Column, sale: Column, brand: Column,
         stock: Column, raw: bool = False) -> Column:
    """Tag array: decision, retailer, system tag, type, then sale, brand and stock."""
    on_sale = (sale == "on sale") if raw else (X.canonical_sale(sale) == "on_sale")
    has_brand = (F.coalesce(brand, F.lit("")) != "") & (F.lower(brand) != F.lower(retailer))
    return F.array_compact(F.array(
        _words(decision), _words(retailer), F.lit(SYSTEM_TAG), X.singular_tag(product_type),
        F.when(on_sale, F.lit("On Sale")), F.when(has_brand, X.title_case(brand)),
        F.nullif(stock, F.lit(""))))


def sku(code: Column, retailer: Column, title: Column, as_of: Column) -> Column:
    words = F.slice(F.filter(F.split(F.coalesce(title, F.lit("PRODUCT")), r"\s+"),
                             lambda w: w != ""), 1, 2)
    suffix = F.substring(F.unix_timestamp(as_of.cast("timestamp")).cast("string"), -6, 6)
    made = F.concat_ws("-", F.upper(F.substring(retailer, 1, 3)),
                       F.substring(F.upper(F.array_join(words, "")), 1, 6), suffix)
    return F.coalesce(F.nullif(code, F.lit("")), made)


def inventory(stock: Column, raw: bool = False) -> Column:
    """Quantity from the stock text; anything unknown counts as well stocked."""
    key = F.coalesce(stock, F.lit("in stock" if raw else "in_stock"))
    key = key if raw else X.canonical_stock(key)
    out = None
    for name, level in (RAW_STOCK_LEVELS if raw else STOCK_LEVELS).items():
        out = F.when(key == name, level) if out is None else out.when(key == name, level)
    return out.otherwise(100)


def product_feed(products: DataFrame, as_of: Column, published: bool = True,
                 raw: bool = False) -> DataFrame:
    """One feed row per product. ``raw`` takes status texts literally."""
    decision = F.coalesce("modesty_status", F.lit("pending_review"))
    ptype = X.store_type(F.col("clothing_type"))
    sale = F.col("sale_status")
    on_sale = (sale == "on sale") if raw else (X.canonical_sale(sale) == "on_sale")
    base = tags(decision, F.col("retailer"), ptype, sale, F.col("brand"), F.col("stock_status"),
                raw)
    waiting = F.lit(not published)
    extra = F.when(waiting, F.lit("Awaiting Assessment")).when(
        decision == "pending_review", F.lit("not-assessed"))
    return products.select(
        "url", F.coalesce("title", F.lit("Untitled Product")).alias("title"),
        X.description_html(F.col("description")).alias("body_html"),
        F.coalesce("brand", "retailer").alias("vendor"), ptype.alias("product_type"),
        F.when(waiting | (decision == "pending_review"), "draft")
        .otherwise(publish_status(decision)).alias("status"),
        F.array_join(F.array_compact(F.concat(base, F.array(extra))), ", ").alias("tags"),
        P.price_feed_text(F.col("price").cast("string")).alias("price"),
        F.when(on_sale & (F.coalesce("original_price", F.lit(0.0)) != 0),
               P.price_feed_text(F.col("original_price").cast("string")))
        .alias("compare_at_price"),
        sku(F.col("product_code"), F.col("retailer"), F.col("title"), as_of).alias("sku"),
        inventory(F.col("stock_status"), raw).alias("inventory_quantity"))


def feed_json(feed: DataFrame) -> DataFrame:
    """Feed rows as the JSON text a store import takes; missing values are written as nulls, images follow later."""
    variant = F.struct(
        F.lit("Default").alias("option1"), "price", "compare_at_price", "sku",
        "inventory_quantity", F.lit("shopify").alias("inventory_management"),
        F.lit("deny").alias("inventory_policy"), F.lit("manual").alias("fulfillment_service"),
        F.lit(True).alias("requires_shipping"), F.lit(True).alias("taxable"),
        F.lit(0.5).alias("weight"), F.lit("kg").alias("weight_unit"))
    option = F.struct(F.lit("Title").alias("name"), F.lit(1).alias("position"), F.array(F.lit("Default")).alias("values"))
    product = F.struct(
        "title", "body_html", "vendor", "product_type", "status", "tags", F.array(variant).alias("variants"),
        F.array(option).alias("options"), F.array().cast("array<string>").alias("images"))
    return feed.select("url", F.to_json(F.struct(product.alias("product")), {"ignoreNullFields": "false"}).alias("value"))


def metafields(products: DataFrame, as_of: Column) -> DataFrame:
    """Thirteen (namespace, key, value, type) rows per product."""
    have = set(products.columns)

    def text(name, default):
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in have \
            else F.lit(default)

    single = "single_line_text_field"
    rows = [
        ("custom", "stock_status", text("stock_status", "in stock"), single),
        ("inventory", "source_urls", F.to_json(F.array("url")), "json"),
        ("custom", "last_updated", F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "date_time"),
        ("custom", "product_id", F.to_json(F.array_compact(F.array(F.coalesce(
            "product_code", product_code(F.col("url"), F.col("retailer")))))), "json"),
        ("custom", "modesty_level", text("modesty_status", "pending_review"), single),
        ("custom", "retailer_source", F.col("retailer"), single),
        ("custom", "scraping_method_used", text("method_used", "openmanus"), single),
        ("custom", "sale_status", text("sale_status", "not on sale"), single),
        ("custom", "original_price", text("original_price", ""), single),
        ("clothing", "neckline", text("neckline", "unknown"), single),
        ("clothing", "sleeve_length", text("sleeve_length", "unknown"), single),
        ("clothing", "visual_analysis_confidence", text("visual_analysis_confidence", ""), single),
        ("clothing", "visual_analysis_source", text("visual_analysis_source", ""), single),
    ]
    entries = F.array(*[F.struct(F.lit(n).alias("namespace"), F.lit(k).alias("key"),
                                 v.alias("value"), F.lit(t).alias("type")) for n, k, v, t in rows])
    return products.select("url", F.explode(entries).alias("m")).select("url", "m.*")


def edit_tags(feed: DataFrame, decisions: DataFrame, key: str = "url") -> DataFrame:
    """Apply decisions to feed rows: pending tags go, the decision tag comes once."""
    d = decisions.select(key, F.col("review_decision").alias("_d"))
    current = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: F.trim(t)),
                       lambda t: t != "")
    kept = F.filter(current, lambda t: ~t.isin(PENDING_TAGS))
    edited = F.array_join(F.when(F.array_contains(kept, F.col("_d")), kept).otherwise(
        F.concat(kept, F.array("_d"))), ", ")
    hit = F.col("_d").isNotNull()
    new = {"tags": F.when(hit, edited).otherwise(F.col("tags")),
           "status": F.when(hit, publish_status(F.col("_d"))).otherwise(F.col("status"))}
    return feed.join(d, key, "left").select(*[
        new[c].alias(c) if c in new else F.col(c) for c in feed.columns])
