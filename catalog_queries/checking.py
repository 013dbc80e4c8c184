"""Page, product and crawl quality; keep-first deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries.base import BINDINGS, query
from catalog_queries.linking import with_images
from shelfwatch.functions import prices as P
from shelfwatch.functions import text as X
from shelfwatch.functions import urls as U
from shelfwatch.operators import dedup, fuzzy, linking, quality
from shelfwatch.session import staged


def sql_any(text, phrases):
    return "(" + " OR ".join("contains({}, '{}')".format(text, p.replace("'", "''"))
                             for p in phrases) + ")"


def sql_errors(*pairs):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + ")"


# Listings whose fields are damaged in many ways; fields come from the data.
BINDINGS["b_rough"] = """
SELECT seq, retailer, catalog_url AS url,
  CASE l_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN 'Shop now' WHEN 3 THEN 'sale' WHEN 4 THEN concat('Product ', CAST(l_orderkey AS STRING)) WHEN 5 THEN 'Extracted by us' WHEN 6 THEN '' ELSE title END AS title,
  CASE l_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 WHEN 3 THEN 20000.0 ELSE price END AS price,
  CASE l_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'https://i.example.com/a.jpg' ELSE concat('https://i.example.com/a', CAST(l_linenumber AS STRING), '.jpg,https://i.example.com/b.jpg') END AS image_csv,
  product_code, l_orderkey % 4 AS kind
FROM b_snapshots
"""

NO_TITLE, NO_PRICE = "coalesce(title, '') = ''", "coalesce(price, 0) = 0"
N_IMG = "CASE WHEN image_csv = '' THEN 0 ELSE len(string_split(image_csv, ',')) END"


def rough(v):
    return with_images(v.b_rough)


@query("F6a_strict_errors", f"""
SELECT seq, {sql_errors((NO_TITLE, 'missing_title'), (NO_PRICE, 'missing_price'), (sql_any('lower(title)', quality.GENERIC_TITLES), 'generic_title'),
  ('price < 1 OR price > 10000', 'unreasonable_price'), (f'{N_IMG} < 1', 'insufficient_images'))} AS errors FROM b_rough""")
def strict(v):
    return rough(v).select("seq", F.array_join(quality.errors_strict(), ",").alias("errors"))


@query("F6b_rigorous_errors", f"""
SELECT seq, {sql_errors((NO_TITLE, 'missing_title'), (NO_PRICE, 'missing_price'), (f'{N_IMG} = 0', 'missing_images'),
  (f'NOT ({NO_TITLE}) AND (length(title) < 5 OR length(title) > 200)', 'title_length'), (sql_any('lower(title)', quality.PLACEHOLDER_TITLES), 'placeholder_title'),
  (f'{N_IMG} = 0', 'no_images'), (f'{N_IMG} = 1', 'few_images'))} AS errors FROM b_rough""")
def rigorous(v):
    return rough(v).select("seq", F.array_join(quality.errors_rigorous(), ",").alias("errors"))


@query("F6c_passes_minimum", f"""
SELECT seq, NOT ({NO_TITLE}) AND NOT ({NO_PRICE}) AND {N_IMG} >= 1 AS passes FROM b_rough""")
def minimum(v):
    return rough(v).select("seq", quality.passes_minimum().alias("passes"))


@query("F8_ad_filter", f"""
SELECT seq, {sql_errors(("NOT contains(url, '/dp/')", 'url_path'), (sql_any("lower(coalesce(title, ''))", quality.AD_PHRASES), 'ad_phrase'),
  ("length(coalesce(title, '')) < 10 AND " + sql_any("lower(coalesce(title, ''))", quality.AD_WORDS), 'short_generic_title'), (NO_PRICE, 'missing_price'))} AS reasons FROM b_rough""")
def ads(v):
    return v.b_rough.select("seq", F.array_join(quality.ad_reasons("/dp/"), ",").alias("reasons"))


@query("F4_page_validity", f"""
WITH p AS (SELECT page_id, html, CASE WHEN page_id % 2 = 0 THEN 'revolve' ELSE 'hm' END AS retailer FROM pages),
e AS (SELECT *, CASE WHEN length(html) < 1000 THEN 'too_short' ELSE {"CASE " + " ".join(f"WHEN contains(lower(html), '{p}') THEN 'blocked: {p}'" for p in quality.BLOCK_PHRASES) + " END"} END AS error FROM p)
SELECT page_id, error, error IS NULL AS valid, CASE WHEN error IS NULL AND NOT CASE retailer WHEN 'revolve' THEN {sql_any('lower(html)', quality.PAGE_INDICATORS['revolve'])} ELSE {sql_any('lower(html)', quality.PAGE_INDICATORS['hm'])} END THEN 'missing_retailer_indicators' END AS warning FROM e""")
def validity(v):
    rows = v.pages.withColumn("retailer", F.when(F.col("page_id") % 2 == 0, "revolve").otherwise("hm"))
    return quality.page_validity(rows).select("page_id", "error", "valid", "warning")


BINDINGS["b_replies"] = """
SELECT page_id, url, concat(CASE page_id % 5 WHEN 0 THEN 'Title: Browse | all ' WHEN 1 THEN 'Title: x ' ELSE 'Title: y ' END, 'URL Source: ',
  CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN concat(replace(url, 'https://', 'https://www.'), '/?a=1') ELSE 'https://www.other.example.com/home' END, ' ', html) AS content FROM pages
"""
BARE = "rtrim(regexp_replace(regexp_replace({}, 'https?://(www\\.)?', ''), '\\?.*', ''), '/')"


@query("F5_homepage_redirect", f"""
WITH s AS (SELECT *, regexp_extract(content, 'URL Source:\\s*(https?://[^\\s\\n]+)', 1) AS src FROM b_replies),
k AS (SELECT *, {BARE.format('src')} AS got, {BARE.format('url')} AS asked FROM s)
SELECT page_id, {sql_any('content', quality.HOMEPAGE_PHRASES)} OR (src <> '' AND NOT contains(got, asked) AND NOT contains(asked, got)) AS redirected FROM k""")
def redirects(v):
    return v.b_replies.select("page_id", quality.homepage_redirect(
        F.col("content"), F.col("url")).alias("redirected"))


@query("F26_listing_window", """
WITH m AS (SELECT page_id, html, list_min(list_filter([nullif(instr(html, 'product-card'), 0), nullif(instr(html, 'ProductCard'), 0), nullif(instr(html, 'product-item'), 0), nullif(instr(html, 'data-product'), 0), nullif(instr(html, 'class="product'), 0)], lambda x: x IS NOT NULL)) AS a FROM pages)
SELECT page_id, md5(CASE WHEN length(html) > 40000 THEN substr(html, CASE WHEN a > 1 THEN greatest(a - 500, 1) ELSE 1 END, 40000) ELSE html END) AS window_hash,
  length(html) // 4 AS tokens, length(html) // 4 > 15000 AS too_large FROM m""")
def window(v):
    return quality.size_gate(v.pages).select(
        "page_id", F.md5(quality.listing_window(F.col("html"), 40000)).alias("window_hash"),
        "tokens", "too_large")


@query("X22_truncation", """
SELECT doc_id, length(text) // 4 AS tokens, md5(CASE WHEN length(text) <= 400 THEN text ELSE concat(text[1:400], chr(10), chr(10), '[HTML TRUNCATED]') END) AS cut_hash FROM documents""")
def truncation(v):
    t = F.col("text")
    return v.documents.select("doc_id", X.token_estimate(t).alias("tokens"),
                              F.md5(quality.truncated(t, 100)).alias("cut_hash"))


@query("F9_assessment_route", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND coalesce(t, 'other') NOT IN ('dress', 'top', 'dress_top') THEN 'draft' ELSE 'assessment' END AS route
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'dress' WHEN 1 THEN 'bottom' WHEN 2 THEN 'dress_top' END AS t FROM part)""")
def route(v):
    rows = v.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "Mango")
                         .otherwise("asos").alias("r"),
                         F.when(F.col("p_size") % 4 == 0, "dress")
                         .when(F.col("p_size") % 4 == 1, "bottom")
                         .when(F.col("p_size") % 4 == 2, "dress_top").alias("t"))
    return rows.select("p_partkey", quality.assessment_route(F.col("r"), F.col("t")).alias("route"))


TYPES = " ".join("WHEN {{0}} IN ({}) THEN '{}'".format(", ".join(repr(k) for k in ks), t)
                 for t, ks in X.CLOTHING_TYPES.items())
BINDINGS["b_typed"] = """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'mango' ELSE 'asos' END AS retailer,
  CASE p_size % 6 WHEN 0 THEN 'Dresses ' WHEN 1 THEN 'tunic' WHEN 2 THEN 'JEANS' WHEN 3 THEN 'Blazer' WHEN 4 THEN 'hat' ELSE NULL END AS clothing_type,
  CASE p_size % 5 WHEN 0 THEN 'tops' WHEN 1 THEN 'dress tops' WHEN 2 THEN NULL ELSE 'dresses' END AS category FROM part
"""


@query("F11_clothing_type", f"""
SELECT p_partkey, CASE {TYPES.format("lower(trim(coalesce(CASE WHEN retailer = 'mango' THEN clothing_type ELSE category END, '')))")} ELSE 'other' END AS clothing_type,
  CASE WHEN retailer = 'mango' THEN 'extraction' ELSE 'category_override' END AS clothing_type_source FROM b_typed""")
def typed(v):
    return quality.with_clothing_type(v.b_typed).select(
        "p_partkey", "clothing_type", "clothing_type_source")


STORE = " ".join("WHEN {{0}} IN ({}) THEN '{}'".format(", ".join(repr(k) for k in ks), t)
                 for t, ks in X.STORE_TYPES.items())


@query("X15_type_maps", f"""
SELECT p_partkey, CASE {TYPES.format("lower(trim(coalesce(clothing_type, '')))")} ELSE 'other' END AS canonical,
  CASE WHEN clothing_type IS NULL THEN 'Clothing' {STORE.format('lower(trim(clothing_type))')} ELSE concat(upper(clothing_type[1]), lower(clothing_type[2:])) END AS store_type FROM b_typed""")
def type_maps(v):
    t = F.col("clothing_type")
    return v.b_typed.select("p_partkey", F.coalesce(X.clothing_type(t), F.lit("other"))
                            .alias("canonical"), X.store_type(t).alias("store_type"))


@query("J17_lookup_joins", """
SELECT retailer, count(*) AS n, count(DISTINCT clothing_type) AS types FROM b_typed GROUP BY ALL""")
def lookups(v):
    dims = v.b_typed.select("clothing_type").distinct().withColumn(
        "canonical", X.clothing_type(F.col("clothing_type")))
    return (v.b_typed.join(dims, "clothing_type", "left").groupBy("retailer")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("clothing_type").alias("types")))


HOSTS = " ".join(f"WHEN contains(lower(u), '{t}') THEN '{n}'" for t, n in U.RETAILER_HOSTS)
BINDINGS["b_mixed_urls"] = """
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://www.REVOLVE.com/x/dp/AB-12/?q=1' WHEN 1 THEN 'https://www2.hm.com/en/productpage.0123.html' WHEN 2 THEN 'https://www.nordstrom.com/s/a/123' WHEN 3 THEN 'https://shop.mango.com/us/p/A1.html' WHEN 4 THEN 'https://www.urbanoutfitters.com/shop/a-dress' WHEN 5 THEN url ELSE concat('http://user@h.example.com:8080/a/', CAST(page_id AS STRING), ';v=2?x=1#f') END AS u FROM pages
"""


@query("F15_retailer_and_route", f"""
WITH r AS (SELECT page_id, CASE {HOSTS} ELSE 'unknown' END AS retailer FROM b_mixed_urls)
SELECT page_id, retailer, CASE WHEN retailer IN ('nordstrom', 'anthropologie', 'abercrombie', 'hm', 'aritzia', 'urban_outfitters') THEN 'commercial' WHEN retailer IN ('revolve', 'asos', 'mango', 'hm', 'uniqlo') THEN 'markdown' ELSE 'default' END AS route FROM r""")
def routed(v):
    r = U.retailer_from_url(F.col("u"))
    return v.b_mixed_urls.select("page_id", r.alias("retailer"),
                                 quality.extraction_route(r).alias("route"))


V2 = "concat(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)), '://', regexp_replace(regexp_replace(regexp_replace(u, '[?#].*$', ''), ';[^/]*$', ''), '^[A-Za-z]+://', ''))"


@query("X1_url_keys", f"""
SELECT page_id, rtrim(split_part(u, '?', 1), '/') AS v1, {V2} AS v2, lower(rtrim({V2}, '/')) AS v3, {BARE.format('u')} AS v4, sha256(u) AS hash FROM b_mixed_urls""")
def url_keys(v):
    u = F.col("u")
    return v.b_mixed_urls.select(
        "page_id", U.url_key_v1(u).alias("v1"), U.url_key_v2(u).alias("v2"),
        U.url_key_v3(u).alias("v3"), U.url_key_v4(u).alias("v4"), U.url_hash(u).alias("hash"))


LAST = "split_part(split_part(string_split(rtrim({0}, '/'), '/')[-1], '?', 1), '#', 1)"


@query("X2_product_codes", f"""
WITH r AS (SELECT page_id, u, CASE {HOSTS} ELSE 'unknown' END AS retailer FROM b_mixed_urls)
SELECT page_id, coalesce(nullif(CASE retailer WHEN 'revolve' THEN regexp_extract(u, '/dp/([A-Z0-9\\-]+)/?', 1) WHEN 'hm' THEN regexp_extract(u, '\\.([0-9]+)\\.html', 1)
  WHEN 'nordstrom' THEN regexp_extract(u, '-(\\d+)\\.html', 1) WHEN 'mango' THEN regexp_extract(u, '/([A-Z0-9\\-]+)\\.html', 1) WHEN 'urban_outfitters' THEN regexp_extract(u, '/([A-Za-z0-9\\-]+)/?$', 1) ELSE '' END, ''), {LAST.format('u')}) AS code FROM r""")
def codes(v):
    u = F.col("u")
    return v.b_mixed_urls.select("page_id", U.product_code(u, U.retailer_from_url(u)).alias("code"))


@query("X2b_code_sets", f"""
WITH r AS (SELECT page_id, u, CASE {HOSTS} ELSE 'unknown' END AS retailer FROM b_mixed_urls),
l AS (SELECT *, split_part(string_split(rtrim(u, '/'), '/')[-1], '?', 1) AS seg FROM r)
SELECT page_id, coalesce(nullif(CASE retailer WHEN 'revolve' THEN regexp_extract(u, '/dp/([A-Z0-9\\-]+)/?', 1) WHEN 'nordstrom' THEN regexp_extract(u, '/s/[^/]+/(\\d+)', 1) WHEN 'urban_outfitters' THEN regexp_extract(u, '/([A-Za-z0-9\\-]+)/?$', 1) ELSE '' END, ''), seg) AS listing,
  CASE WHEN retailer = 'revolve' THEN nullif(regexp_extract(u, '(?i)/dp/([A-Z0-9\\-]+)/?', 1), '') END AS monitor FROM l""")
def code_sets(v):
    u = F.col("u")
    r = U.retailer_from_url(u)
    return v.b_mixed_urls.select("page_id", U.product_code(u, r, "listing").alias("listing"),
                                 U.product_code(u, r, "monitor").alias("monitor"))


@query("X2c_code_from_image", """
WITH i AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat('https://c.example.com/-/AF', p_partkey, '-WD_1.jpg') ELSE concat('https://c.example.com/', p_partkey, '_alt.x.png') END AS u FROM part)
SELECT p_partkey, split_part(split_part(regexp_replace(string_split(u, '/')[-1], '\\.[^.]*$', ''), '-', 1), '_', 1) AS code FROM i""")
def image_codes(v):
    k = F.col("p_partkey").cast("string")
    u = F.when(F.col("p_size") % 2 == 0, F.concat(
        F.lit("https://c.example.com/-/AF"), k, F.lit("-WD_1.jpg"))).otherwise(
        F.concat(F.lit("https://c.example.com/"), k, F.lit("_alt.x.png")))
    return v.part.select("p_partkey", U.code_from_image(u).alias("code"))


@query("X3_product_identifier", f"""
SELECT page_id, CASE WHEN contains(lower(u), 'revolve.com') AND regexp_matches(u, '(?i)/dp/([A-Z0-9\\-]+)/?') THEN concat('revolve:', regexp_extract(u, '(?i)/dp/([A-Z0-9\\-]+)/?', 1))
  ELSE regexp_replace(regexp_replace(regexp_replace(u, '[?#].*$', ''), ';[^/]*$', ''), '^[A-Za-z]+://', '') END AS identifier FROM b_mixed_urls""")
def identifiers(v):
    return v.b_mixed_urls.select("page_id", U.product_identifier(F.col("u")).alias("identifier"))


@query("X4_prices", """
SELECT l_orderkey, l_linenumber, TRY_CAST(regexp_replace(t, '[^\\d.]', '', 'g') AS DOUBLE) AS digits, TRY_CAST(trim(regexp_replace(t, '[$€,]', '', 'g')) AS DOUBLE) AS symbols,
  coalesce(TRY_CAST(regexp_extract(regexp_replace(t, '[$€,]', '', 'g'), '(\\d+\\.?\\d*)', 1) AS DOUBLE), 0.0) AS first_number,
  coalesce(printf('%.2f', TRY_CAST(regexp_replace(t, '[$£€¥\\s,]', '', 'g') AS DOUBLE)), '0.00') AS feed_text
FROM (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 6 WHEN 0 THEN concat('CA$', CAST(CAST(l_quantity AS INT) AS STRING)) WHEN 1 THEN '$1,299.00' WHEN 2 THEN concat('€', CAST(CAST(l_quantity AS INT) AS STRING), '.50') WHEN 3 THEN 'call us' WHEN 4 THEN concat('from ', CAST(CAST(l_quantity AS INT) AS STRING), ' to 99') ELSE '' END AS t FROM lineitem)""")
def parsed(v):
    q = F.col("l_quantity").cast("int").cast("string")
    t = (F.when(F.col("l_orderkey") % 6 == 0, F.concat(F.lit("CA$"), q))
         .when(F.col("l_orderkey") % 6 == 1, F.lit("$1,299.00"))
         .when(F.col("l_orderkey") % 6 == 2, F.concat(F.lit("€"), q, F.lit(".50")))
         .when(F.col("l_orderkey") % 6 == 3, F.lit("call us"))
         .when(F.col("l_orderkey") % 6 == 4, F.concat(F.lit("from "), q, F.lit(" to 99")))
         .otherwise(F.lit("")))
    return v.lineitem.select("l_orderkey", "l_linenumber", P.price_digits(t).alias("digits"),
                             P.price_symbols(t).alias("symbols"),
                             P.price_first_number(t).alias("first_number"),
                             P.price_feed_text(t).alias("feed_text"))


@query("X5_price_from_block", """
WITH t AS (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) % 3000 AS STRING) AS n, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN CAST(n AS DOUBLE) WHEN 1 THEN CASE WHEN length(n) BETWEEN 2 AND 4 AND CAST(n AS DOUBLE) BETWEEN 20 AND 9999 THEN CAST(n AS DOUBLE) END END AS price,
  CASE WHEN k = 0 AND CAST(n AS DOUBLE) BETWEEN 15 AND 2000 THEN CAST(n AS DOUBLE) END AS ranged FROM t""")
def blocks(v):
    n = (F.col("o_totalprice").cast("long") % 3000).cast("string")
    k = F.col("o_orderkey") % 4
    t = (F.when(k == 0, F.concat(F.lit("Linen dress\n 7 colours\n$ "), n, F.lit(" now\n55")))
         .when(k == 1, F.concat(F.lit("Linen dress\n  "), n, F.lit("\nnew")))
         .when(k == 2, F.concat(F.lit("a very long line of advertising with $"), n, F.lit(" in it")))
         .otherwise(F.lit("nothing")))
    return v.orders.select("o_orderkey", P.price_from_block(t).alias("price"),
                           P.price_from_block(t, 15.0, 2000.0).alias("ranged"))


@query("X6_clean_title", """
SELECT l_orderkey, l_linenumber, trim(regexp_replace(replace(regexp_replace(t, '(?i)\\b(NEW|SALE|EXCLUSIVE|LIMITED)\\b', '', 'g'), 'REVOLVE', ''), '\\s+', ' ', 'g')) AS title
FROM (SELECT l_orderkey, l_linenumber, concat('New  ', title, ' REVOLVE SALE!  renew') AS t FROM b_snapshots)""")
def titles(v):
    t = F.concat(F.lit("New  "), F.col("title"), F.lit(" REVOLVE SALE!  renew"))
    return v.b_snapshots.select("l_orderkey", "l_linenumber",
                                X.clean_title(t, F.lit("revolve")).alias("title"))


@query("F18_stock_status", f"""
SELECT doc_id, CASE WHEN {sql_any('lower(text)', quality.DELISTED_PHRASES)} THEN 'no_longer_available' WHEN {sql_any('lower(text)', quality.IN_STOCK_PHRASES)} THEN 'in_stock'
  WHEN {sql_any('lower(text)', quality.OUT_OF_STOCK_PHRASES)} THEN 'out_of_stock' WHEN {sql_any('lower(source)', quality.GONE_PAGE_PHRASES)} AND NOT n_chars > 100 THEN 'no_longer_available'
  WHEN quality = 1 THEN 'in_stock' ELSE 'unknown' END AS stock_status FROM b_docs""")
def stock(v):
    return v.b_docs.select("doc_id", quality.stock_status(
        F.col("text"), F.col("source"), F.col("n_chars") > 100,
        F.coalesce(F.col("quality") == 1, F.lit(False))).alias("stock_status"))


@query("F23_modesty_class", f"""
SELECT doc_id, CASE WHEN {sql_any('lower(text)', X.NOT_MODEST_WORDS)} THEN 'not_modest' WHEN {sql_any('lower(text)', X.MODEST_WORDS)} THEN 'modest' ELSE 'moderately_modest' END AS modesty FROM documents""")
def modesty(v):
    return v.documents.select("doc_id", X.modesty_keyword_class(
        F.lit(None).cast("string"), F.col("text")).alias("modesty"))


@query("F27_missing_images", f"""
SELECT url, CASE WHEN kind > 0 THEN 'field present but empty' ELSE 'no image fields' END AS reason, 'image_extraction' AS stage, CASE WHEN kind > 0 THEN 'known_error' ELSE 'uncertain' END AS certainty,
  NOT ({NO_PRICE}) AS has_price, NOT ({NO_TITLE}) AS has_title FROM b_rough WHERE image_csv = ''""")
def no_images(v):
    rows = rough(v).withColumn("images", F.lit(None).cast("array<string>")).withColumn(
        "image_urls", F.when((F.size("image_urls") > 0) | (F.col("kind") > 0), F.col("image_urls")))
    return quality.missing_image_failures(rows)


@query("F10_unify_fields", """
SELECT seq, coalesce(nullif(CASE WHEN kind > 1 THEN url ELSE '' END, ''), 'https://alt.example.com/') AS catalog_url, image_csv AS images FROM b_rough""")
def unify(v):
    rows = rough(v).select("seq", F.when(F.col("kind") > 1, F.col("url")).otherwise("").alias("url"),
                           F.lit("https://alt.example.com/").alias("catalog_url"),
                           F.array().cast("array<string>").alias("images"), "image_urls")
    out = linking.unify_fields(rows)
    return out.select("seq", "catalog_url", F.coalesce(F.array_join("image_urls", ","), F.lit(""))
                      .alias("images"))


LOW = "CASE lower(retailer) WHEN 'revolve' THEN 40 ELSE 20 END"


@query("A29_crawl_quality", """
WITH s AS (SELECT retailer, kind, count(*) AS n, count(*) FILTER (coalesce(title, '') <> '' AND regexp_matches(lower(trim(title)), '\\[url only|unknown product|product \\d+|^\\s*$|^n/a$|^none$|^null$')) AS fake,
  count(*) FILTER (coalesce(title, '') = '') AS mt, count(*) FILTER (coalesce(title, '') <> '' AND price IS NULL) AS mp, count(*) FILTER (coalesce(title, '') <> '' AND price <= 0) AS ip FROM b_rough WHERE kind < 3 GROUP BY ALL),
l AS (SELECT retailer, l_orderkey % 4 AS kind, count(*) AS links FROM b_snapshots GROUP BY ALL),
j AS (SELECT l.retailer, l.kind, links, coalesce(n, 0) AS n, coalesce(fake, 0) AS fake, coalesce(mt, 0) AS mt, coalesce(mp, 0) AS mp, coalesce(ip, 0) AS ip FROM l LEFT JOIN s USING (retailer, kind))
SELECT retailer, kind, n AS rows, links, round(n / links, 6) AS extraction_ratio, concat_ws(',', CASE WHEN fake > 0 THEN 'fake_titles' END, CASE WHEN n < 20 AND links > 20 THEN 'below_minimum' END) AS errors,
  concat_ws(',', CASE WHEN links > 20 AND n / links < 0.3 THEN 'low_extraction_ratio' END, CASE WHEN mt > n * 0.1 THEN 'missing_titles' END, CASE WHEN mp > n * 0.1 THEN 'missing_prices' END, CASE WHEN ip > 0 THEN 'invalid_prices' END) AS warnings,
  fake = 0 AND NOT (n < 20 AND links > 20) AS valid FROM j""")
def crawl(v):
    links = v.b_snapshots.withColumn("kind", F.col("l_orderkey") % 4)
    out = quality.crawl_quality(v.b_rough.filter("kind < 3"), links, ["retailer", "kind"])
    return out.select("retailer", "kind", "rows", "links",
                      F.round("extraction_ratio", 6).alias("extraction_ratio"),
                      F.array_join("errors", ",").alias("errors"),
                      F.array_join("warnings", ",").alias("warnings"), "valid")


@query("A30_catalog_validation", """
SELECT retailer, count(*) AS rows, count(*) FILTER (coalesce(url, '') = '') AS missing_urls, count(url) - count(DISTINCT url) AS duplicate_urls, count(*) >= 10 AND count(*) FILTER (coalesce(url, '') = '') = 0 AS valid
FROM (SELECT retailer, CASE WHEN seq % 50 = 1 AND retailer <> 'brand11' THEN NULL ELSE url END AS url FROM b_rough) GROUP BY ALL""")
def catalogs(v):
    rows = v.b_rough.select("retailer", F.when(
        ~((F.col("seq") % 50 == 1) & (F.col("retailer") != "brand11")), F.col("url")).alias("url"))
    return quality.catalog_validation(rows, "retailer")


@query("A31_acceptance", f"""
WITH a AS (SELECT retailer, count(*) AS total, count(*) FILTER (coalesce(url, '') <> '') AS with_urls, count(*) FILTER (length(title) > 5) AS with_titles, count(*) FILTER (price > 0) AS with_prices FROM b_rough GROUP BY ALL)
SELECT *, total >= {LOW} AND with_titles >= total * 0.8 AND with_prices >= total * 0.8 AS meets_expectations FROM a""")
def accepted(v):
    return quality.acceptance(v.b_rough)


@query("A31b_completeness", f"""
WITH c AS (SELECT retailer, kind > 0 AS success, coalesce(length(title) > 5, false) AND coalesce(price > 0, false) AND {N_IMG} > 0 AS complete FROM b_rough)
SELECT retailer, count(*) FILTER (complete AND success) AS passed, count(*) FILTER (success AND NOT complete) AS partial, count(*) FILTER (NOT success) AS failed FROM c GROUP BY ALL""")
def complete(v):
    return quality.completeness_totals(rough(v).withColumn("success", F.col("kind") > 0), "retailer")


# --- reconciling two extractions ------------------------------------------------------------

def two_extractions(v):
    """Two readings of each order's lines as one page's tiles."""
    s = (v.b_snapshots.groupBy("l_orderkey", "l_linenumber")
         .agg(F.min(F.struct("seq", "catalog_url", "title", "price")).alias("m"))
         .select("l_orderkey", "l_linenumber", "m.*"))
    s = staged(s, "extractions")  # both readings, and some of them twice, come from these rows
    first = s.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("position"),
                     F.col("catalog_url").alias("url"), F.col("title").alias("dom_title"),
                     F.concat(F.lit("$"), F.round("price", 2).cast("string")).alias("dom_price"))
    second = s.select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("position"),
        F.when(F.col("l_orderkey") % 5 == 0, F.lit("another thing"))
        .when(F.col("l_orderkey") % 5 == 1, F.concat("title", F.lit(" dress")))
        .otherwise(F.col("title")).alias("title"),
        (F.round("price", 2) + F.when(F.col("l_orderkey") % 3 == 0, 7.0)
         .when(F.col("l_orderkey") % 3 == 1, 1.5).otherwise(0.0)).alias("price"))
    return first, second


@query("J15_reconcile_by_position")
def by_position(v):
    return quality.reconcile_by_position(*two_extractions(v))


@query("A32_reconciliation_statistics")
def reconciliation(v):
    return quality.reconciliation_statistics(quality.reconcile_by_position(*two_extractions(v)))


@query("J15b_reconcile_by_slug")
def by_slug(v):
    first, second = two_extractions(v)
    slugs = first.withColumn("url", F.concat(F.lit("https://www.example.com/"), F.replace(
        "dom_title", F.lit(" "), F.lit("-"))))
    # Each page has one link more than the second reading has rows, so the readings differ in length.
    more = slugs.groupBy("page_id").agg(F.max("position").alias("last")).select(
        "page_id", (F.col("last") + 1).alias("position"), F.lit("https://www.example.com/gift-card").alias("url"),
        F.lit("gift card").alias("dom_title"), F.lit("$25").alias("dom_price"))
    return quality.reconcile_by_slug(slugs.unionByName(more), second)


@query("J16b_title_cross_check")
def cross_check(v):
    rows = v.b_extracts.select("url", "title").join(
        v.b_products_full.select("url", F.col("title").alias("known")), "url")
    return quality.title_cross_check(rows, "title", "known")


@query("X20_sequence_ratio")
def ratios(v):
    """Every part and supplier that were ever ordered together."""
    rows = v.lineitem.select("l_partkey", "l_suppkey").distinct()
    rows = rows.join(v.part, F.col("l_partkey") == F.col("p_partkey")).join(
        v.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = rows.select(F.lower("p_name").alias("lt"), F.lower("s_name").alias("rt")).distinct().select(
        "lt", "rt")
    return fuzzy.ratios(pairs).filter("ratio > 0")


@query("X19_confidences", """
SELECT l_orderkey, l_linenumber, round(0.85 + (l_discount * 10 - 0.90) * 0.5, 6) AS fuzzy_confidence FROM lineitem""")
def confidences(v):
    return v.lineitem.select("l_orderkey", "l_linenumber", F.round(
        fuzzy.link_confidence(F.col("l_discount") * 10), 6).alias("fuzzy_confidence"))


@query("X21_age", """
SELECT id, epoch(TIMESTAMP '2001-12-01' - added_at) / 86400.0 AS age_days FROM b_queue""")
def ages(v):
    from catalog_queries.base import as_of
    from shelfwatch.operators.review import age_days

    return v.b_queue.select("id", age_days(F.col("added_at"), as_of()).alias("age_days"))


# --- keep-first deduplication --------------------------------------------------------------------

@query("D1_greedy_dedup")
def greedy(v):
    return dedup.greedy_dedup(v.b_rough.select("seq", "retailer", "url", "title", "price",
                                               "product_code"), "seq")


FIRST = "SELECT {cols} FROM (SELECT seq, l_orderkey AS page_id, catalog_url AS url FROM b_snapshots) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY seq) = 1"
BARE_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z]+://', '')"


def urls(v):
    return v.b_snapshots.select("seq", F.col("l_orderkey").alias("page_id"),
                                F.col("catalog_url").alias("url"))


@query("D2_unique_urls", FIRST.format(
    cols="seq, url", key="lower(rtrim(regexp_replace(url, '[?#].*$', ''), '/'))"))
def unique_urls(v):
    return dedup.unique_urls(urls(v).select("seq", "url"), "seq")


@query("D3_unique_products", FIRST.format(cols="seq, url", key=BARE_PATH))
def unique_products(v):
    return dedup.unique_products(urls(v).select("seq", "url"), "seq")


@query("D4_unique_in_page", FIRST.format(cols="seq, page_id, url", key="page_id, url"))
def unique_in_page(v):
    return dedup.unique_in_page(urls(v), "seq")


@query("X1b_url_key_v2", f"SELECT page_id, {V2} AS url_key FROM b_mixed_urls")
def key_v2(v):
    return v.b_mixed_urls.select("page_id", U.url_key_v2(F.col("u")).alias("url_key"))


@query("X1c_url_key_v3", f"SELECT page_id, lower(rtrim({V2}, '/')) AS url_key FROM b_mixed_urls")
def key_v3(v):
    return v.b_mixed_urls.select("page_id", U.url_key_v3(F.col("u")).alias("url_key"))


@query("X1d_url_key_v4", f"SELECT page_id, {BARE.format('u')} AS url_key FROM b_mixed_urls")
def key_v4(v):
    return v.b_mixed_urls.select("page_id", U.url_key_v4(F.col("u")).alias("url_key"))


@query("X11_url_hash", "SELECT l_orderkey, l_linenumber, sha256(catalog_url) AS url_hash FROM b_snapshots")
def hashes(v):
    return v.b_snapshots.select("l_orderkey", "l_linenumber",
                                U.url_hash(F.col("catalog_url")).alias("url_hash"))


@query("U5_matched_and_remainder", """
SELECT s.seq, s.catalog_url, p.url AS linked_product_url FROM b_snapshots s LEFT JOIN b_products p ON s.retailer = p.retailer AND s.catalog_url = p.url""")
def matched_and_rest(v):
    rows = v.b_snapshots.select("seq", "retailer", "catalog_url")
    matched = linking.match_exact_url(rows, v.b_products).filter("linked_product_url IS NOT NULL")
    rest = rows.withColumnRenamed("catalog_url", "url")
    rest = linking.remaining_urls(rest, v.b_products).withColumnRenamed("url", "catalog_url")
    return linking.with_remainder(matched, rest).select("seq", "catalog_url", "linked_product_url")
