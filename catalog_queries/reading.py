"""Extraction from pages and parsing of file texts.

Pages with structured data, state objects, images and tiles are rendered by
Spark from the product tables, so that every row has a known right answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries.base import BINDINGS, as_of, query
from catalog_queries.linking import with_images
from shelfwatch.functions import text as X
from shelfwatch.functions import urls as U
from shelfwatch.operators import extraction, feed, quality
from shelfwatch.session import scratch_path
from shelfwatch.sources import files, sinks
from shelfwatch.sources.buckets import PageStore


def page(v, kind):
    """Rendered product pages of one kind; ``page_id`` is the product number."""
    p = with_images(v.b_products_full.select("*", F.col("p_partkey").alias("page_id")))
    if kind == "ld":
        offer = F.struct(F.when(F.col("page_id") % 2 == 0, "AggregateOffer").otherwise("Offer").alias("@type"),
                         F.when(F.col("page_id") % 2 == 0, F.col("price")).alias("lowPrice"),
                         F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("USD "), F.col("price").cast("string"))).alias("price"),
                         F.lit("USD").alias("priceCurrency"),
                         F.when(F.col("stock_status") == "out_of_stock", "https://schema.org/OutOfStock")
                         .otherwise("https://schema.org/InStock").alias("availability"))
        product = F.struct(F.lit("Product").alias("@type"), F.col("title").alias("name"), "description",
                           F.struct(F.col("brand").alias("name")).alias("brand"),
                           F.col("product_code").alias("sku"), F.col("image_urls").alias("image"),
                           F.array(offer).alias("offers"))
        body = F.when(F.col("page_id") % 3 == 0, F.to_json(F.array(product))).otherwise(F.to_json(product))
        script = F.concat(F.lit('<script type="application/ld+json">{"@type":"Organization"}</script><script type="application/ld+json">'), body, F.lit("</script>"))
    elif kind == "state":
        inner = F.struct(F.col("title").alias("name"), "description",
                         F.struct(F.col("price").alias("current")).alias("price"),
                         (F.col("stock_status") == "in_stock").alias("inStock"),
                         F.transform("image_urls", lambda u: F.struct(u.alias("url"))).alias("images"),
                         F.col("product_code").alias("id"))
        wrapped = F.struct(F.struct(F.struct(inner.alias("product")).alias("pageProps")).alias("props"))
        script = F.when(F.col("page_id") % 2 == 0, F.concat(
            F.lit("<script>window.__INITIAL_STATE__ = "), F.to_json(F.struct(inner.alias("product"))), F.lit(";</script>"))) \
            .otherwise(F.concat(F.lit("<script>__NEXT_DATA__ = "), F.to_json(wrapped), F.lit(";</script>")))
    else:
        imgs = F.concat_ws("", F.transform("image_urls", lambda u: F.concat(F.lit('<img class="product-image" data-src="'), u, F.lit('">'))))
        script = F.concat(F.lit('<div><h1 class="x">'), F.col("title"), F.lit('</h1><span class="price">$'),
                          F.format_number("price", 2), F.lit('</span><img src="/static/logo.svg">'), imgs, F.lit("</div>"))
    name = F.when(F.col("page_id") % 2 == 0, "urban_outfitters").otherwise("aritzia") if kind == "state" else F.lit("revolve")
    return p.select("page_id", "url", name.alias("retailer"), F.concat(
        F.lit("<html><body>"), script, F.lit("</body></html>")).alias("html"))


def shown(df, *more):
    return df.select("page_id", "title", F.round("price", 2).alias("price"), "stock_status",
                     F.coalesce(F.array_join("image_urls", ","), F.lit("")).alias("images"), *more)


KNOWN = "SELECT p_partkey AS page_id, title, round(price, 2) AS price, {stock} AS stock_status, image_csv AS images{more} FROM b_products_full"


@query("E1_json_ld_products", KNOWN.format(
    stock="CASE WHEN stock_status = 'out_of_stock' THEN 'out_of_stock' ELSE 'in_stock' END",
    more=", brand, product_code AS product_id"))
def json_ld(v):
    return shown(extraction.json_ld_products(page(v, "ld")), "brand", "product_id")


@query("E2_state_products", KNOWN.format(
    stock="CASE WHEN stock_status = 'in_stock' THEN 'in_stock' ELSE 'out_of_stock' END",
    more=", product_code AS product_id"))
def state(v):
    return shown(extraction.state_products(page(v, "state")), "product_id")


@query("E3_rule_fields", """
SELECT p_partkey AS page_id, title, '$' || format('{:,.2f}', price) AS price, NULL::VARCHAR AS description, NULL::VARCHAR AS stock_text FROM b_products_full""")
def rules(v):
    return extraction.rule_fields(page(v, "plain"))


@query("E3_rule_titles_of_pages", """
SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '') AS title FROM pages""")
def page_titles(v):
    rows = v.pages.withColumn("retailer", F.lit("other"))
    return extraction.rule_fields(rows).select("page_id", "title")


@query("E4_listing_links", """
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>.*?</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>(.*?)</a>', 1)) AS t, generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>.*?</a>', 1), 1) AS pos FROM pages)
SELECT page_id, (pos - 1)::BIGINT AS position, CASE WHEN starts_with(href, '/') THEN concat('https://www.site.com', href) ELSE href END AS url, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS title
FROM a WHERE contains(href, '/') AND (starts_with(href, '/') OR starts_with(href, 'http'))""")
def links(v):
    rows = v.pages.withColumn("retailer", F.lit("site"))
    return extraction.listing_links(rows).withColumn("position", F.col("position").cast("long"))


@query("T6_hundred_per_page", """
SELECT l_orderkey AS page_id, least(count(*), 100) AS kept FROM lineitem GROUP BY ALL""")
def hundred(v):
    from shelfwatch.operators.ordered import top_per_key

    rows = v.lineitem.select(F.col("l_orderkey").alias("page_id"), "l_partkey", "l_suppkey", "l_linenumber")
    return top_per_key(rows, ["page_id"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 100) \
        .groupBy("page_id").agg(F.count(F.lit(1)).alias("kept"))


@query("E5_page_images", "SELECT p_partkey AS page_id, image_csv AS images FROM b_products_full")
def images(v):
    return extraction.page_images(page(v, "plain")).select(
        "page_id", F.array_join("image_urls", ",").alias("images"))


@query("E6_products_with_fallback", """
SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 2 AND title NOT LIKE '%item%' THEN title ELSE title END AS title,
  CASE WHEN image_csv = '' AND p_partkey % 5 = 0 THEN 'reply' WHEN p_partkey % 3 = 0 THEN 'embedded' WHEN p_partkey % 3 = 1 THEN 'embedded' ELSE 'rules' END AS method,
  image_csv <> '' OR p_partkey % 5 = 0 AS valid FROM b_products_full""")
def fallback(v):
    m = F.col("page_id") % 3
    mixed = page(v, "ld").filter(m == 0).unionByName(page(v, "state").filter(m == 1)) \
        .unionByName(page(v, "plain").filter(m == 2))
    replies = v.b_products_full.filter("p_partkey % 5 = 0").select(
        F.col("p_partkey").alias("page_id"), "title", "price", "description",
        F.array(F.lit("https://i.example.com/r.jpg")).alias("image_urls"), "stock_status", "brand",
        F.col("product_code").alias("product_id"))
    return extraction.products_with_fallback(mixed, replies).select("page_id", "title", "method", "valid")


@query("E7_listings_with_fallback", """
WITH a AS (SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>', 1)) AS n FROM pages)
SELECT page_id, CASE WHEN n >= 10 THEN 'rules' ELSE 'reply' END AS method, CASE WHEN n >= 10 THEN n ELSE 1 END AS rows FROM a""")
def listing_fallback(v):
    rows = v.pages.withColumn("retailer", F.lit("site"))
    replies = v.pages.select("page_id", F.lit(0).alias("position"), "url", F.lit("reply").alias("title"))
    return extraction.listings_with_fallback(rows, replies).groupBy("page_id", "method").agg(
        F.count(F.lit(1)).alias("rows"))


@query("E9_product_section", """
WITH c AS (SELECT p_partkey, title, printf('%.2f', price) AS pr, concat('https://lp2.hm.com/hmgoepprod?set=', p_partkey, '-', repeat('x', 60)) AS i FROM b_products_full)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('# ', title, chr(10), chr(10), 'Price: $', pr, chr(10), chr(10), 'Images:', chr(10), i, 'a', chr(10), i, 'b', chr(10), chr(10)) ELSE concat('# ', title, chr(10), chr(10), 'Price: $', pr, chr(10), chr(10)) END AS section FROM c""")
def section(v):
    i = F.concat(F.lit("https://lp2.hm.com/hmgoepprod?set="), F.col("p_partkey"), F.lit("-"), F.repeat(F.lit("x"), 60))
    few = F.concat(F.lit("intro\n# "), F.col("title"), F.lit("\nnow $"), F.format_string("%.2f", "price"))
    full = F.concat(few, F.lit(" ![a]("), i, F.lit("a) and ("), i, F.lit("b) $1.00"))
    return v.b_products_full.select("p_partkey", extraction.product_section(
        F.when(F.col("p_partkey") % 2 == 0, full).otherwise(few)).alias("section"))


def tile_pages(v):
    """Listing pages of twenty products each, one repeated, some without title or price."""
    p = v.b_products_full.select("*", F.floor(F.col("p_partkey") / 20).alias("page_id"))
    n = F.col("p_partkey") % 20
    title = F.when(n % 7 == 0, F.lit("")).otherwise(F.col("title"))
    cost = F.when(n % 5 == 0, F.lit("$3")).otherwise(F.concat(F.lit("$1 was $"), (n + 100).cast("string")))
    tile = F.concat(F.lit('<li class="plp__product js"><a href="https://www.r.com/a/dp/'), F.col("product_code"),
                    F.lit('/?p=1">x</a><img alt="'), title, F.lit('">'), cost, F.lit("</li>"))
    return (p.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), tile.alias("t")))).alias("t"))
            .select("page_id", F.lit("revolve").alias("retailer"), F.concat(
                F.lit("<ul>"), F.concat_ws("", F.transform("t", lambda x: x["t"])), F.get("t", F.lit(0))["t"], F.lit("</ul>")).alias("html")))


@query("E10_listing_tiles", """
SELECT p_partkey // 20 AS page_id, concat('https://www.r.com/a/dp/', product_code, '/') AS url, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey)::INT AS position,
  CASE WHEN p_partkey % 20 % 7 <> 0 AND length(title) > 5 THEN title END AS title, CASE WHEN p_partkey % 20 % 5 <> 0 THEN (p_partkey % 20 + 100)::DOUBLE END AS price FROM b_products_full""")
def tiles(v):
    return extraction.listing_tiles(tile_pages(v))


@query("E10_tile_coverage", """
SELECT p_partkey // 20 AS page_id, count(*) AS tiles, count(*) FILTER (p_partkey % 20 % 7 <> 0 AND length(title) > 5) AS with_titles, count(*) FILTER (p_partkey % 20 % 5 <> 0) AS with_prices FROM b_products_full GROUP BY ALL""")
def coverage(v):
    return extraction.tile_coverage(extraction.listing_tiles(tile_pages(v)))


@query("X24_absolute_urls", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://cdn.example.com/', page_id) WHEN 1 THEN concat('https://www.site.com/p/', page_id) WHEN 2 THEN url END AS link FROM pages""")
def absolute(v):
    k, m = F.col("page_id").cast("string"), F.col("page_id") % 4
    link = (F.when(m == 0, F.concat(F.lit("//cdn.example.com/"), k)).when(m == 1, F.concat(F.lit("/p/"), k))
            .when(m == 2, F.col("url")).otherwise(F.lit("mailto:x")))
    return v.pages.select("page_id", U.absolute_url(link, F.lit("https://www.site.com/")).alias("link"))


@query("X25_reply_json", """
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS title, p_partkey % 3 = 2 AS is_list FROM part""")
def reply(v):
    body = F.to_json(F.struct(F.col("p_name").alias("title")))
    m = F.col("p_partkey") % 3
    text = (F.when(m == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(m == 1, F.concat(F.lit("  "), body, F.lit("\n"))).otherwise(F.concat(F.lit("["), body, F.lit("]"))))
    return v.part.select("p_partkey", F.try_variant_get(X.reply_json(text, "object"), "$.title", "string").alias("title"),
                         X.reply_json(text, "array").isNotNull().alias("is_list"))


# --- files ------------------------------------------------------------------------------------

def numbered_batches(v):
    """Batch file texts: every brand's product urls as an object or a bare list."""
    per = v.b_products.groupBy("retailer").agg(F.sort_array(F.collect_list("url")).alias("urls"))
    odd = F.length("retailer") % 2 == 1
    return per.select(F.concat(F.col("retailer"), F.lit(".json")).alias("file_name"), F.when(
        odd, F.to_json(F.struct("urls", F.lit("modest").alias("modesty_level"), "retailer")))
        .otherwise(F.to_json("urls")).alias("value"))


@query("S1_parse_batches", """
SELECT retailer AS batch_id, CASE WHEN length(retailer) % 2 = 1 THEN 'modest' END AS modesty_level, (row_number() OVER (PARTITION BY retailer ORDER BY url) - 1)::INT AS position, url FROM b_products""")
def batches(v):
    return files.parse_batches(numbered_batches(v)).select("batch_id", "modesty_level", "position", "url")


@query("S1_read_batch_files", "SELECT url, CASE WHEN length(retailer) % 2 = 1 THEN 'modest' END AS modesty_level FROM b_products")
def batch_files(v):
    path = scratch_path(v.spark, "batches")
    numbered_batches(v).write.partitionBy("file_name").text(path)
    return files.read_batches(v.spark, path).select("url", "modesty_level")


@query("S2_url_lists", "SELECT 'all' AS file_name, url FROM b_products")
def url_lists(v):
    lines = v.b_products.select(F.lit("all").alias("file_name"), F.explode(F.array(
        F.concat(F.lit("  "), "url", F.lit(" ")), F.lit(" "))).alias("value"))
    return files.parse_url_lists(lines)


@query("S3_flatten_failures", """
SELECT retailer AS batch_id, 'updater' AS workflow, (count(*) OVER (PARTITION BY retailer))::INT AS total_failed, url, error AS reason FROM b_extracts WHERE NOT success""")
def failure_files(v):
    path = scratch_path(v.spark, "failures")
    rows = v.b_extracts.filter("NOT success").select(
        F.lit("updater").alias("workflow"), F.col("retailer").alias("batch_id"), "url", F.col("error").alias("reason"))
    sinks.write_failures(rows, path)
    records = v.spark.read.schema("workflow string, batch_id string, url string, reason string").json(f"{path}/records")
    heads = v.spark.read.schema("workflow string, batch_id string, total_failed int").json(f"{path}/headers")
    return records.join(heads, ["workflow", "batch_id"]).select("batch_id", "workflow", "total_failed", "url", "reason")


@query("S3_report_files", """
SELECT retailer, 'updater' AS workflow, url, error AS reason, 'extraction' AS stage, true AS complete FROM b_extracts WHERE NOT success""")
def report_files(v):
    """Reports of some 500 failures, one JSON document a file, read back and flattened."""
    failed = v.b_extracts.filter("NOT success")
    parts = 1 + failed.count() // 500
    record = F.struct("url", F.col("error").alias("reason"), F.lit("extraction").alias("stage"))
    reports = failed.groupBy("retailer", F.pmod(F.xxhash64("url"), F.lit(parts)).alias("part")).agg(
        F.collect_list(record).alias("failures"), F.count(F.lit(1)).alias("total_failed"))
    report = F.struct(F.concat_ws("-", "retailer", "part").alias("batch_id"), F.lit("updater").alias("workflow"),
                      "retailer", "total_failed", "failures")
    path = scratch_path(v.spark, "reports")
    reports.select("retailer", "part", F.to_json(report).alias("value")).write.partitionBy("retailer", "part").text(path)
    rows = files.read_failures(v.spark, f"{path}/*/*")
    found = rows.groupBy("batch_id").agg(F.count("url").alias("found"))
    return rows.join(found, "batch_id").select("retailer", "workflow", "url", "reason", "stage",
                                               (F.col("total_failed") == F.col("found")).alias("complete"))


@query("K1_failure_headers", "SELECT 'updater' AS workflow, retailer AS batch_id, count(*) AS total_failed FROM b_extracts WHERE NOT success GROUP BY ALL")
def failure_headers(v):
    return sinks.failure_headers(v.b_extracts.filter("NOT success").select(
        F.lit("updater").alias("workflow"), F.col("retailer").alias("batch_id"), "url"))


def checkpoint_rows(v):
    done = F.filter("all_urls", lambda u: F.length(u) % 2 == 0)
    return (v.b_products.groupBy(F.col("retailer").alias("batch_id"))
            .agg(F.sort_array(F.collect_list("url")).alias("all_urls"))
            .withColumns({"processed_urls": done, "total_urls": F.size("all_urls"),
                          "successful_count": F.size(done), "failed_count": F.lit(0)}))


@query("S4_checkpoint_remaining", """
SELECT retailer AS batch_id, url FROM b_products WHERE length(url) % 2 = 1""")
def checkpoint_left(v):
    return files.checkpoint_remaining(checkpoint_rows(v)).select("batch_id", "url")


@query("S4_checkpoint_statistics", """
SELECT retailer AS batch_id, count(*) AS total_urls, count(*) FILTER (length(url) % 2 = 0) AS processed, count(*) FILTER (length(url) % 2 = 0) AS successful, 0 AS failed, count(*) FILTER (length(url) % 2 = 1) AS remaining FROM b_products GROUP BY ALL""")
def checkpoint_stats(v):
    return files.checkpoint_statistics(checkpoint_rows(v))


@query("S5_scan_pages", "SELECT page_id, url, length(html) AS chars, sha256(url) AS url_hash FROM pages")
def scan_pages(v):
    return v.pages.select("page_id", "url", F.length("html").alias("chars"), U.url_hash(F.col("url")).alias("url_hash"))


@query("S6_retailer_dimension", """
SELECT retailer, count(*) AS products, 'numbered' AS pagination_type, 0.85::DOUBLE AS dedup_threshold FROM b_products GROUP BY ALL""")
def dimension(v):
    one = F.struct(F.struct(F.lit("numbered").alias("type")).alias("pagination"),
                   F.struct(F.lit(0.85).alias("threshold")).alias("deduplication_strategy"))
    texts = v.b_products.select("retailer").distinct().select(F.to_json(F.struct(
        F.create_map("retailer", one).alias("retailers"))).alias("value"))
    dim = files.parse_retailers(texts).select("retailer", "pagination_type", "dedup_threshold")
    return v.b_products.join(dim, "retailer").groupBy("retailer", "pagination_type", "dedup_threshold").agg(
        F.count(F.lit(1)).alias("products"))


@query("S8_listing_records", """
SELECT p_partkey, url, string_split(rtrim(url, '/'), '/')[-1] AS product_code, title, CASE WHEN p_partkey % 4 <> 0 THEN price END AS price, CASE WHEN p_partkey % 3 = 0 THEN 99.5 END::DOUBLE AS original_price,
  CASE WHEN p_partkey % 3 = 0 THEN 'on_sale' ELSE 'regular' END AS sale_status FROM b_products WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0""")
def records(v):
    k = F.col("p_partkey")
    line = F.concat(F.when(k % 7 == 0, F.lit("NOTE | ")).otherwise(F.lit(" PRODUCT | ")), F.lit("URL="), "url",
                    F.when(k % 11 != 0, F.concat(F.lit(" | title = "), "title")).otherwise(""),
                    F.when(k % 4 != 0, F.concat(F.lit(" | PRICE=$"), F.col("price").cast("string"))).otherwise(" | PRICE=none"),
                    F.when(k % 3 == 0, F.lit(" | ORIGINAL_PRICE=$99.50")).otherwise(""), F.lit(" | junk"))
    return files.parse_listing_records(v.b_products.select("p_partkey", line.alias("value"))).select(
        "p_partkey", "url", "product_code", "title", "price", "original_price", "sale_status")


@query("S9_learned_selectors", """
SELECT retailer, 'link' AS element, concat('a.', retailer) AS selector, count(*)::INT AS success_count FROM b_products GROUP BY ALL""")
def selectors(v):
    entry = F.struct(F.concat(F.lit("a."), "retailer").alias("selector"), F.col("n").alias("success_count"))
    texts = v.b_products.groupBy("retailer").agg(F.count(F.lit(1)).alias("n")).select(F.to_json(F.struct(
        F.create_map("retailer", F.create_map(F.lit("link"), entry)).alias("learned_selectors"))).alias("value"))
    return files.parse_selectors(texts).select("retailer", "element", "selector", "success_count")


@query("S11_page_plan", """
WITH r AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'nordstrom' WHEN 1 THEN 'revolve' ELSE 'abercrombie' END AS retailer, CASE p_size % 2 WHEN 0 THEN 'dresses' ELSE 'tops' END AS category FROM part), n AS (SELECT unnest([1, 2]) AS page)
SELECT retailer, category, page, concat('https://', retailer, '/', category, '/', page) AS url FROM r, n WHERE page = 1 OR retailer <> 'revolve'""")
def plan(v):
    r = v.part.select(F.when(F.col("p_size") % 3 == 0, "nordstrom").when(F.col("p_size") % 3 == 1, "revolve")
                      .otherwise("abercrombie").alias("retailer"),
                      F.when(F.col("p_size") % 2 == 0, "dresses").otherwise("tops").alias("category")).distinct()
    dim = r.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("page")).withColumn(
        "url", F.concat(F.lit("https://"), "retailer", F.lit("/"), "category", F.lit("/"), F.col("page")))
    return files.page_plan(r.withColumn("retailer", F.upper("retailer")), dim)


@query("K9_export_batch", "SELECT url, retailer FROM b_products_full WHERE sale_status = 'on_sale'")
def export(v):
    from shelfwatch.operators.review import smart_batch

    path = scratch_path(v.spark, "batch")
    sinks.export_batch(smart_batch(v.b_products_full, "on_sale", as_of()), path)
    return v.spark.read.schema("url string, retailer string").json(path)


@query("K14_page_store", """
WITH s AS (SELECT url, page_id, html, page_id % 9 + 2 AS accessed_count, TIMESTAMP '2001-11-01' AS cached_at FROM pages), n AS (SELECT url, page_id, concat('x', html) AS html, 1::BIGINT AS accessed_count, TIMESTAMP '2001-11-30' AS cached_at FROM pages WHERE page_id % 3 = 0)
SELECT sha256(url) AS url_hash, md5(html) AS page_hash, accessed_count, cached_at FROM (SELECT * FROM s UNION ALL SELECT * FROM n) QUALIFY row_number() OVER (PARTITION BY url ORDER BY cached_at DESC, accessed_count) = 1""")
def store(v):
    old = v.pages.select(U.url_hash(F.col("url")).alias("url_hash"), "url", F.lit("r").alias("retailer"), "html",
                         as_of("2001-11-01 00:00:00").alias("cached_at"),
                         (F.col("page_id") % 9 + 2).alias("accessed_count"), as_of("2001-11-01 00:00:00").alias("last_accessed"))
    new = v.pages.filter("page_id % 3 = 0").select("url", F.lit("r").alias("retailer"), F.concat(F.lit("x"), "html").alias("html"),
                                                   as_of("2001-11-30 00:00:00").alias("cached_at"))
    return sinks.store_pages(old, new).select("url_hash", F.md5("html").alias("page_hash"), "accessed_count", "cached_at")


@query("K14_page_accesses", """
WITH s AS (SELECT url, page_id, html, TIMESTAMP '2001-11-29 12:00:00' AS cached_at FROM pages), n AS (SELECT url, page_id, concat('x', html) AS html, TIMESTAMP '2001-11-30' AS cached_at FROM pages WHERE page_id % 3 = 0),
p AS (SELECT * FROM (SELECT * FROM s UNION ALL SELECT * FROM n) QUALIFY row_number() OVER (PARTITION BY url ORDER BY cached_at DESC) = 1),
r AS (SELECT url, count(*) AS n FROM pages WHERE page_id % 2 = 0 GROUP BY url)
SELECT sha256(url) AS url_hash, md5(html) AS page_hash, (CASE WHEN cached_at > TIMESTAMP '2001-11-29 18:00:00' THEN coalesce(n, 0) ELSE 0 END + 1)::BIGINT AS accessed_count,
  CASE WHEN cached_at > TIMESTAMP '2001-11-29 18:00:00' AND n IS NOT NULL THEN TIMESTAMP '2001-11-30 18:00:00' ELSE cached_at END AS last_accessed
FROM p LEFT JOIN r USING (url)""")
def page_accesses(v):
    def pages(html, at, which="true"):
        return v.pages.filter(which).select("url", F.lit("r").alias("retailer"), html.alias("html"), as_of(at).alias("cached_at"))

    kept = PageStore(v.spark, scratch_path(v.spark, "pages"), 64)
    kept.put(pages(F.col("html"), "2001-11-29 12:00:00"))
    kept.put(pages(F.concat(F.lit("x"), "html"), "2001-11-30 00:00:00", "page_id % 3 = 0"))
    kept.count_accesses(v.pages.filter("page_id % 2 = 0").select("url", as_of("2001-11-30 18:00:00").alias("read_at")))
    return kept.pages().select("url_hash", F.md5("html").alias("page_hash"), "accessed_count", "last_accessed")


@query("K15_append_attempts", "SELECT CAST(attempted_at AS DATE) AS log_date, count(*) AS n FROM b_attempts GROUP BY ALL")
def logs(v):
    path = scratch_path(v.spark, "attempts")
    half = v.b_attempts.filter("seq % 2 = 0")
    sinks.append_log(half, path)
    sinks.append_log(v.b_attempts.filter("seq % 2 = 1"), path)
    return v.spark.read.parquet(path).groupBy(F.col("log_date").cast("date").alias("log_date")).agg(F.count(F.lit(1)).alias("n"))
