"""Match levels, cascades, price changes and anti joins over the bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries.base import AS_OF, as_of, query
from shelfwatch.operators import fuzzy, linking, patterns

KEY = ["l_orderkey", "l_linenumber"]
LINKED = [*KEY, "linked_product_url", "link_confidence"]
# What cascades read of a listing; they write rows to the shared folder with all columns they are given.
READ = ["retailer", "catalog_url", "title", "price", "product_code"]

V1 = "rtrim(split_part({}, '?', 1), '/')"
KNOWN = "SELECT retailer, {key}, min(url) AS u FROM b_products GROUP BY ALL"


def with_images(df):
    return df.withColumn("image_urls", F.filter(
        F.split("image_csv", ","), lambda x: x != "")).drop("image_csv")


@query("J1_exact_url", """
SELECT s.l_orderkey, s.l_linenumber, k.u AS linked_product_url,
  CASE WHEN k.u IS NOT NULL THEN 1.0::DOUBLE END AS link_confidence
FROM b_snapshots s LEFT JOIN (SELECT retailer, url, min(url) AS u FROM b_products GROUP BY ALL) k
  ON s.retailer = k.retailer AND s.catalog_url = k.url""")
def exact_url(v):
    return linking.match_exact_url(v.b_snapshots, v.b_products).select(*LINKED)


@query("J2_normalized_url", f"""
SELECT s.l_orderkey, s.l_linenumber, k.u AS linked_product_url,
  CASE WHEN k.u IS NOT NULL THEN 0.95::DOUBLE END AS link_confidence
FROM b_snapshots s LEFT JOIN (SELECT retailer, {V1.format('url')} AS n, min(url) AS u FROM b_products GROUP BY ALL) k
  ON s.retailer = k.retailer AND {V1.format('s.catalog_url')} = k.n""")
def normalized_url(v):
    return linking.match_normalized_url(v.b_snapshots, v.b_products).select(*LINKED)


@query("J3_product_code", """
SELECT s.l_orderkey, s.l_linenumber, k.u AS linked_product_url,
  CASE WHEN k.u IS NOT NULL THEN 0.9::DOUBLE END AS link_confidence
FROM b_snapshots s LEFT JOIN (SELECT retailer, product_code, min(url) AS u FROM b_products GROUP BY ALL) k
  ON s.retailer = k.retailer AND s.product_code = k.product_code""")
def product_code(v):
    return linking.match_product_code(v.b_snapshots, v.b_products).select(*LINKED)


@query("J3b_code_in_url", """
WITH codes AS (SELECT DISTINCT retailer, substr(product_code, 2) AS code FROM b_snapshots WHERE product_code IS NOT NULL)
SELECT c.retailer, c.code, min(p.url) AS url
FROM codes c JOIN b_products p ON p.retailer = c.retailer AND contains(p.url, c.code) GROUP BY ALL""")
def code_in_url(v):
    codes = v.b_snapshots.filter("product_code IS NOT NULL").select(
        "retailer", F.expr("substr(product_code, 2)").alias("code"))
    return linking.codes_in_urls(codes, v.b_products)


@query("J4_title_price", """
SELECT s.l_orderkey, s.l_linenumber, k.u AS linked_product_url,
  CASE WHEN k.u IS NOT NULL THEN 1.0::DOUBLE END AS link_confidence
FROM b_snapshots s LEFT JOIN (SELECT retailer, lower(trim(title)) AS t, price, min(url) AS u FROM b_products WHERE price <> 0 GROUP BY ALL) k
  ON s.retailer = k.retailer AND lower(trim(s.title)) = k.t AND s.price = k.price""")
def title_price(v):
    return linking.match_title_price(v.b_snapshots, v.b_products).select(*LINKED)


@query("J4b_title_near_price", """
WITH d AS (SELECT DISTINCT retailer, title, price FROM b_snapshots WHERE title <> '' AND price <> 0),
k AS (SELECT d.retailer, d.title, d.price, min(p.url) AS u FROM d JOIN b_products p
  ON p.retailer = d.retailer AND p.title = d.title AND abs(p.price - d.price) < 1.0 GROUP BY ALL)
SELECT s.l_orderkey, s.l_linenumber, k.u AS linked_product_url,
  CASE WHEN k.u IS NOT NULL THEN 0.95::DOUBLE END AS link_confidence
FROM b_snapshots s LEFT JOIN k ON s.retailer = k.retailer AND s.title = k.title AND s.price = k.price""")
def title_near_price(v):
    return linking.match_title_near_price(v.b_snapshots, v.b_products).select(*LINKED)


@query("J5_fuzzy_links")
def fuzzy_links(v):
    return fuzzy.fuzzy_links(v.b_snapshots, v.b_products)


@query("J6_fuzzy_suspects")
def fuzzy_suspects(v):
    return fuzzy.fuzzy_suspects(v.b_snapshots, v.b_products)


@query("J7_first_image", """
WITH k AS (SELECT retailer, i, min(url) AS u FROM (SELECT retailer, url, unnest(string_split(image_csv, ',')) AS i FROM b_products_full) WHERE i <> '' GROUP BY ALL)
SELECT s.l_orderkey, s.l_linenumber, k.u AS linked_product_url,
  CASE WHEN k.u IS NOT NULL THEN 0.9::DOUBLE END AS link_confidence
FROM b_listings s LEFT JOIN k ON s.retailer = k.retailer AND string_split(s.image_csv, ',')[1] = k.i""")
def first_image(v):
    return linking.match_first_image(
        with_images(v.b_listings), with_images(v.b_products_full)).select(*LINKED)


@query("J8_image_overlap", """
WITH l AS (SELECT DISTINCT retailer, price, image_csv FROM b_listings WHERE image_csv <> ''),
li AS (SELECT l.*, unnest(string_split(image_csv, ',')) AS i FROM l),
pi AS (SELECT retailer, url, price, unnest(string_split(image_csv, ',')) AS i FROM b_products_full WHERE image_csv <> ''),
o AS (SELECT li.retailer, li.price, li.image_csv, pi.url, count(*) / 2.0 AS r FROM li JOIN pi
  ON li.retailer = pi.retailer AND li.i = pi.i AND abs(li.price - pi.price) < 10.0 GROUP BY ALL),
b AS (SELECT retailer, price, image_csv, min({'n': -r, 'u': url}) AS m FROM o WHERE r >= 0.5 GROUP BY ALL)
SELECT s.l_orderkey, s.l_linenumber, b.m.u AS linked_product_url,
  round(0.65 + (-b.m.n) * 0.15, 6)::DOUBLE AS link_confidence
FROM b_listings s LEFT JOIN b ON s.retailer = b.retailer AND s.price = b.price AND s.image_csv = b.image_csv""")
def image_overlap(v):
    return linking.match_image_overlap(
        with_images(v.b_listings), with_images(v.b_products_full)).select(
        *LINKED[:3], F.round("link_confidence", 6).alias("link_confidence"))


@query("J9_link_cascade")
def link_cascade(v):
    rows = with_images(v.b_listings).select(*KEY, *READ, "image_urls")
    return linking.link_listings(rows, with_images(v.b_products_full)).select(*LINKED, "link_method")


CASCADE_SQL = f"""
WITH e AS (SELECT retailer, url AS k, min(url) AS u FROM b_products GROUP BY ALL),
n AS (SELECT retailer, {V1.format('url')} AS k, min(url) AS u FROM b_products GROUP BY ALL),
c AS (SELECT retailer, product_code AS k, min(url) AS u FROM b_products GROUP BY ALL),
d AS (SELECT DISTINCT retailer, title, price FROM b_snapshots WHERE price <> 0),
t AS (SELECT d.retailer, d.title, d.price, min(p.url) AS u FROM d JOIN b_products p ON p.retailer = d.retailer AND p.title = d.title AND abs(p.price - d.price) < 1.0 GROUP BY ALL),
j AS (SELECT s.*, e.u AS eu, n.u AS nu, c.u AS cu, t.u AS tu FROM b_snapshots s
  LEFT JOIN e ON s.retailer = e.retailer AND s.catalog_url = e.k
  LEFT JOIN n ON s.retailer = n.retailer AND {V1.format('s.catalog_url')} = n.k
  LEFT JOIN c ON s.retailer = c.retailer AND s.product_code = c.k
  LEFT JOIN t ON s.retailer = t.retailer AND s.title = t.title AND s.price = t.price)
"""


@query("J9b_key_levels_summary", CASCADE_SQL + """
SELECT retailer, CASE WHEN eu IS NOT NULL THEN 'exact_url' WHEN nu IS NOT NULL THEN 'normalized_url'
  WHEN cu IS NOT NULL THEN 'product_code' WHEN tu IS NOT NULL THEN 'exact_title_price' END AS link_method,
  count(*) AS n, count(DISTINCT coalesce(eu, nu, cu, tu)) AS products
FROM j WHERE coalesce(eu, nu, cu, tu) IS NOT NULL GROUP BY ALL""")
def backfill_key_levels(v):
    links = all_links(v)
    return (links.filter(F.col("link_method") != "fuzzy_title_price")
            .groupBy("retailer", "link_method")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.countDistinct("linked_product_url").alias("products")))


@query("J9b_backfill_links")
def backfill(v):
    return linking.backfill_links(v.b_snapshots.select(*KEY, *READ), v.b_products).select(*LINKED, "link_method")


CLASSIFY_SQL = f"""
WITH m AS (SELECT * FROM b_snapshots WHERE scan_type = 'monitor'),
h AS (SELECT * FROM b_snapshots WHERE scan_type = 'baseline'),
e AS (SELECT url AS k, min(url) AS u FROM b_products GROUP BY ALL),
he AS (SELECT DISTINCT retailer, catalog_url AS k FROM h),
n AS (SELECT retailer, {V1.format('url')} AS k, min(url) AS u FROM b_products GROUP BY ALL),
c AS (SELECT retailer, product_code AS k, min(url) AS u FROM b_products GROUP BY ALL),
t AS (SELECT retailer, lower(trim(title)) AS k, price, min(url) AS u FROM b_products WHERE price <> 0 GROUP BY ALL),
hc AS (SELECT retailer, product_code AS k, min(catalog_url) AS u FROM h GROUP BY ALL),
ht AS (SELECT retailer, lower(trim(title)) AS k, price, min(catalog_url) AS u FROM h WHERE price <> 0 GROUP BY ALL),
j AS (SELECT m.*, e.u AS eu, he.k AS hu, n.u AS nu, coalesce(c.u, hc.u) AS cu, t.u AS tu, ht.u AS htu FROM m
  LEFT JOIN e ON m.catalog_url = e.k
  LEFT JOIN he ON m.retailer = he.retailer AND m.catalog_url = he.k
  LEFT JOIN n ON m.retailer = n.retailer AND {V1.format('m.catalog_url')} = n.k
  LEFT JOIN c ON m.retailer = c.retailer AND m.product_code = c.k
  LEFT JOIN hc ON m.retailer = hc.retailer AND m.product_code = hc.k
  LEFT JOIN t ON m.retailer = t.retailer AND lower(trim(m.title)) = t.k AND m.price = t.price
  LEFT JOIN ht ON m.retailer = ht.retailer AND lower(trim(m.title)) = ht.k AND m.price = ht.price)
SELECT l_orderkey, l_linenumber,
  CASE WHEN coalesce(eu, hu, nu, cu, tu, htu) IS NOT NULL THEN 'confirmed_existing' ELSE 'confirmed_new' END AS status,
  CASE WHEN coalesce(eu, hu) IS NOT NULL THEN 'exact_url' WHEN nu IS NOT NULL THEN 'normalized_url'
    WHEN cu IS NOT NULL THEN 'product_code' WHEN coalesce(tu, htu) IS NOT NULL THEN 'title_price' ELSE 'none' END AS match_method,
  CASE WHEN coalesce(eu, hu) IS NOT NULL THEN 1.0 WHEN nu IS NOT NULL THEN 0.95
    WHEN cu IS NOT NULL THEN 0.95 WHEN coalesce(tu, htu) IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence,
  coalesce(eu, hu, nu, cu, tu, htu) AS matched_url
FROM j"""
CLASS = [*KEY, "status", "match_method", "confidence", "matched_url"]


def split_scans(v):
    return (v.b_snapshots.filter("scan_type = 'monitor'"),
            v.b_snapshots.filter("scan_type = 'baseline'"))


@query("J10_classify_by_keys", CLASSIFY_SQL)
def classify_by_keys(v):
    now, history = split_scans(v)
    return linking.classify_listings(now.select(*KEY, *READ), v.b_products, history, use_fuzzy=False).select(*CLASS)


@query("J10_classify")
def classify(v):
    now, history = split_scans(v)
    return linking.classify_listings(now.select(*KEY, *READ), v.b_products, history).select(*CLASS)


PRICE_SQL = f"""
WITH e AS (SELECT retailer, url AS k, min({{'u': url, 'p': price}}) AS m FROM b_products GROUP BY ALL),
n AS (SELECT retailer, {V1.format('url')} AS k, min({{'u': url, 'p': price}}) AS m FROM b_products GROUP BY ALL),
j AS (SELECT s.*, coalesce(e.m, n.m) AS m FROM b_snapshots s
  LEFT JOIN e ON s.retailer = e.retailer AND s.catalog_url = e.k
  LEFT JOIN n ON s.retailer = n.retailer AND {V1.format('s.catalog_url')} = n.k WHERE s.price <> 0)
SELECT l_orderkey, l_linenumber, m.u AS product_url, retailer,
  CASE WHEN abs(price - m.p) > 50 THEN 'high' ELSE 'normal' END AS priority,
  'price_change_detected_in_catalog' AS reason, price AS catalog_price, m.p AS products_price,
  price - m.p AS price_difference, {AS_OF} AS detected_at
FROM j WHERE m.p <> 0 AND abs(price - m.p) >= 0.01"""
CHANGE = [*KEY, "product_url", "retailer", "priority", "reason", "catalog_price",
          "products_price", "price_difference", "detected_at"]


@query("J11_price_changes", PRICE_SQL)
def price_changes(v):
    return linking.price_changes(v.b_snapshots, v.b_products, as_of()).select(*CHANGE)


@query("J12_unseen_listings", """
SELECT s.l_orderkey, s.l_linenumber, s.catalog_url AS url FROM b_snapshots s
WHERE NOT EXISTS (SELECT 1 FROM b_products p WHERE p.url = s.catalog_url)""")
def unseen(v):
    rows = v.b_snapshots.select(*KEY, F.col("catalog_url").alias("url"))
    return linking.remaining_urls(rows, v.b_products).select(*KEY, "url")


@query("U2_remaining_urls", """
SELECT s.l_orderkey, s.l_linenumber, s.catalog_url AS url FROM b_snapshots s
WHERE s.catalog_url NOT IN (SELECT catalog_url FROM b_snapshots WHERE scan_type = 'baseline')""")
def remaining(v):
    rows = v.b_snapshots.select(*KEY, F.col("catalog_url").alias("url"))
    done = v.b_snapshots.filter("scan_type = 'baseline'").select(F.col("catalog_url").alias("url"))
    return linking.remaining_urls(rows, done).select(*KEY, "url")


LINKS_SQL = CASCADE_SQL + """, links AS (SELECT *, coalesce(eu, nu, cu, tu) AS u,
  CASE WHEN eu IS NOT NULL THEN 'exact_url' WHEN nu IS NOT NULL THEN 'normalized_url'
    WHEN cu IS NOT NULL THEN 'product_code' WHEN tu IS NOT NULL THEN 'exact_title_price' END AS link_method,
  CASE WHEN eu IS NOT NULL THEN 1.0 WHEN nu IS NOT NULL THEN 0.95 WHEN cu IS NOT NULL THEN 0.9
    WHEN tu IS NOT NULL THEN 0.95 END AS conf FROM j)
"""


def all_links(v):
    return linking.backfill_links(v.b_snapshots.select(*READ), v.b_products)


def key_links(v):
    """Links of the key levels only, so that plain SQL can check what is built on them."""
    return linking.backfill_links(v.b_snapshots.select(*READ), v.b_products, fuzzy_level=False)


@query("A1_linking_statistics")
def linking_statistics(v):
    return patterns.linking_statistics(all_links(v))


@query("A2_retailer_patterns")
def retailer_patterns(v):
    return patterns.retailer_patterns(all_links(v))


@query("A20_linking_summary")
def linking_summary(v):
    return patterns.linking_summary(all_links(v))


@query("A1_linking_statistics_by_keys", LINKS_SQL + """
SELECT retailer, count(*) AS total, count(u) AS linked, count(*) FILTER (conf >= 0.95) AS high_confidence,
  count(*) FILTER (conf >= 0.85 AND conf < 0.95) AS medium_confidence, count(*) - count(u) AS unlinked,
  count(*) FILTER (link_method = 'exact_url') AS by_exact_url,
  count(*) FILTER (link_method = 'normalized_url') AS by_normalized_url,
  count(*) FILTER (link_method = 'product_code') AS by_product_code,
  count(*) FILTER (link_method = 'exact_title_price') AS by_exact_title_price,
  count(*) FILTER (link_method = 'fuzzy_title_price') AS by_fuzzy_title_price
FROM links GROUP BY ROLLUP (retailer)""")
def linking_statistics_by_keys(v):
    return patterns.linking_statistics(key_links(v))


@query("A2_retailer_patterns_by_keys", LINKS_SQL + """,
a AS (SELECT retailer, count(*) AS total, count(u) AS linked, count(*) FILTER (u IS NOT NULL AND u <> catalog_url) AS changes,
  sum(conf::DECIMAL(18,6))::DOUBLE AS s FROM links GROUP BY retailer),
mm AS (SELECT retailer, link_method, count(*) AS k FROM links WHERE u IS NOT NULL GROUP BY ALL),
best AS (SELECT retailer, max({'k': k, 'm': link_method}).m AS best_dedup_method FROM mm GROUP BY retailer)
SELECT a.retailer, round(1.0 - changes / linked, 6) AS url_stability_score, linked AS sample_size,
  round(1.0 - changes / linked, 6) > 0.80 AS path_stable, best_dedup_method,
  round(s / linked, 6) AS dedup_confidence_threshold, changes AS url_changes_detected
FROM a JOIN best USING (retailer) WHERE linked > 0""")
def retailer_patterns_by_keys(v):
    out = patterns.retailer_patterns(key_links(v))
    return out.select("retailer", F.round("url_stability_score", 6).alias("url_stability_score"),
                      "sample_size", "path_stable", "best_dedup_method",
                      F.round("dedup_confidence_threshold", 6).alias("dedup_confidence_threshold"),
                      "url_changes_detected")


@query("A20_linking_summary_by_keys", LINKS_SQL + """
SELECT link_method, count(*) AS n, (sum(conf::DECIMAL(18,6)) / count(*))::DECIMAL(18,3)::DOUBLE AS mean_confidence
FROM links WHERE u IS NOT NULL GROUP BY link_method""")
def linking_summary_by_keys(v):
    return patterns.linking_summary(key_links(v))


@query("D6_title_price_pairs")
def pairs(v):
    return fuzzy.title_price_pairs(v.b_products)


# Patterns as a retailer's own history gives them: the pages of even brands keep their urls, those of odd ones move.
STABLE = "CAST(regexp_extract(retailer, '([0-9]+)$', 1) AS INT) % 2 = 0"
POLICY_SQL = CASCADE_SQL + f""", learned AS (SELECT retailer, 1.0 - count(*) FILTER (coalesce(eu, nu, cu, tu) <> catalog_url) / count(*)::DOUBLE AS stability
  FROM j WHERE coalesce(eu, nu, cu, tu) IS NOT NULL AND (NOT ({STABLE}) OR coalesce(eu, nu, cu, tu) = catalog_url) GROUP BY retailer),
gated AS (SELECT j.*, coalesce(stability < 0.5, false) AS fuzzy_only FROM j LEFT JOIN learned l ON j.retailer = l.retailer)
"""


def learned_patterns(v):
    stays = ~F.expr(STABLE) | (F.col("linked_product_url") == F.col("catalog_url"))
    return patterns.retailer_patterns(key_links(v).filter(stays))


@query("J9_policy_key_levels", POLICY_SQL + """
SELECT retailer, CASE WHEN eu IS NOT NULL THEN 'exact_url' WHEN nu IS NOT NULL THEN 'normalized_url' ELSE 'product_code' END AS link_method,
  count(*) AS n, count(DISTINCT coalesce(eu, nu, cu)) AS products
FROM gated WHERE NOT fuzzy_only AND coalesce(eu, nu, cu) IS NOT NULL GROUP BY ALL""")
def policy_key_levels(v):
    """The cascade under learned patterns: retailers whose urls move have no link by url or code."""
    links = linking.link_listings(v.b_snapshots.select(*READ), v.b_products, learned_patterns(v))
    return (links.filter(F.col("link_method") != "fuzzy_title_price").groupBy("retailer", "link_method")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("linked_product_url").alias("products")))


@query("J9b_policy_backfill_by_keys", POLICY_SQL + """
SELECT l_orderkey, l_linenumber, CASE WHEN NOT fuzzy_only THEN coalesce(eu, nu, cu, tu) ELSE tu END AS linked_product_url,
  CASE WHEN NOT fuzzy_only AND eu IS NOT NULL THEN 'exact_url' WHEN NOT fuzzy_only AND nu IS NOT NULL THEN 'normalized_url'
    WHEN NOT fuzzy_only AND cu IS NOT NULL THEN 'product_code' WHEN tu IS NOT NULL THEN 'exact_title_price' END AS link_method
FROM gated""")
def policy_backfill(v):
    links = linking.backfill_links(v.b_snapshots.select(*KEY, *READ), v.b_products, learned_patterns(v), fuzzy_level=False)
    return links.select(*KEY, "linked_product_url", "link_method")


# A seventh of the listings is known by nothing but its first image.
UNKNOWN = "l_orderkey % 7 = 0"
CLASSIFY_IMAGES_SQL = CLASSIFY_SQL.split("SELECT l_orderkey, l_linenumber,")[0].replace(
    "WITH m AS (SELECT * FROM b_snapshots WHERE scan_type = 'monitor')",
    f"WITH m AS (SELECT * REPLACE (CASE WHEN {UNKNOWN} THEN concat('https://new.example.com/', l_orderkey, '/', l_linenumber) ELSE catalog_url END AS catalog_url, "
    f"CASE WHEN {UNKNOWN} THEN 'never seen before' ELSE title END AS title, CASE WHEN {UNKNOWN} THEN NULL ELSE product_code END AS product_code) "
    "FROM b_listings WHERE scan_type = 'monitor')") + """,
im AS (SELECT retailer, i AS k, min(url) AS u FROM (SELECT retailer, url, unnest(string_split(image_csv, ',')) AS i FROM b_products_full) WHERE i <> '' GROUP BY ALL),
ji AS (SELECT j.*, im.u AS iu FROM j LEFT JOIN im ON j.retailer = im.retailer AND string_split(j.image_csv, ',')[1] = im.k)
SELECT l_orderkey, l_linenumber,
  CASE WHEN coalesce(eu, hu, nu, cu, tu, htu) IS NOT NULL THEN 'confirmed_existing' WHEN iu IS NOT NULL THEN 'suspected_duplicate' ELSE 'confirmed_new' END AS status,
  CASE WHEN coalesce(eu, hu) IS NOT NULL THEN 'exact_url' WHEN nu IS NOT NULL THEN 'normalized_url' WHEN cu IS NOT NULL THEN 'product_code'
    WHEN coalesce(tu, htu) IS NOT NULL THEN 'title_price' WHEN iu IS NOT NULL THEN 'image_url' ELSE 'none' END AS match_method,
  coalesce(eu, hu, nu, cu, tu, htu, iu) AS matched_url
FROM ji"""


@query("J10_classify_by_images", CLASSIFY_IMAGES_SQL)
def classify_by_images(v):
    unknown = F.expr(UNKNOWN)
    now = with_images(v.b_listings.filter("scan_type = 'monitor'")).withColumns({
        "catalog_url": F.when(unknown, F.concat(F.lit("https://new.example.com/"), "l_orderkey", F.lit("/"), "l_linenumber")).otherwise(F.col("catalog_url")),
        "title": F.when(unknown, "never seen before").otherwise(F.col("title")), "product_code": F.when(~unknown, F.col("product_code"))})
    _, history = split_scans(v)
    found = linking.classify_listings(now.select(*KEY, *READ, "image_urls"), with_images(v.b_products_full), history, use_fuzzy=False)
    return found.select(*KEY, "status", "match_method", "matched_url")
