"""Change detection, upserts, merges and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries.base import AS_OF, as_of, query
from catalog_queries.linking import with_images
from shelfwatch.operators import changes, linking, ordered
from shelfwatch.session import scratch_path
from shelfwatch.sources.buckets import BucketTable

EXTRACT_JOIN = """
WITH j AS (SELECT x.*, p.shopify_id, p.images_uploaded, p.price AS op, p.original_price AS oo,
  p.sale_status AS os, p.stock_status AS ok, p.title AS ot, p.description AS od, p.image_csv AS oi
  FROM b_extracts x LEFT JOIN b_products_full p ON x.url = p.url),
c AS (SELECT *, concat_ws(',', CASE WHEN coalesce(abs(op - price) > 0.01, true) THEN 'price' END,
  CASE WHEN abs(coalesce(oo, 0) - coalesce(original_price, 0)) > 0.01 THEN 'original_price' END,
  CASE WHEN os IS DISTINCT FROM sale_status THEN 'sale_status' END,
  CASE WHEN ok IS DISTINCT FROM stock_status THEN 'stock_status' END,
  CASE WHEN lower(trim(coalesce(ot, ''))) <> lower(trim(coalesce(title, ''))) THEN 'title' END,
  CASE WHEN lower(trim(coalesce(od, ''))) <> lower(trim(coalesce(description, ''))) THEN 'description' END,
  CASE WHEN coalesce(oi, '') <> image_csv THEN 'images' END) AS changed FROM j),
a AS (SELECT *, CASE WHEN NOT success THEN 'failed' WHEN stock_status IN ('no_longer_available', 'delisted') THEN 'delisted'
  WHEN coalesce(shopify_id, 0) = 0 THEN 'not_found' WHEN changed = '' THEN 'unchanged' ELSE 'updated' END AS action FROM c)
"""


def outcomes(v):
    return changes.update_outcomes(with_images(v.b_extracts), with_images(v.b_products_full))


@query("F19_changed_fields", EXTRACT_JOIN + "SELECT url, changed FROM a")
def changed(v):
    return outcomes(v).select("url", F.array_join("changed_fields", ",").alias("changed"))


@query("F20_update_outcomes", EXTRACT_JOIN + "SELECT url, action FROM a")
def update_outcomes(v):
    return outcomes(v).select("url", "action")


@query("F17_needs_images", EXTRACT_JOIN + """
SELECT url, coalesce(images_uploaded, 0) = 0 AS needs_images FROM a""")
def needs_images(v):
    return outcomes(v).select("url", "needs_images")


@query("F21_failure_records", EXTRACT_JOIN + """,
f AS (SELECT url, action, CASE WHEN action = 'not_found' THEN 'Product not in DB or missing shopify_id' ELSE error END AS error FROM a WHERE action IN ('failed', 'not_found'))
SELECT url, error AS reason, CASE WHEN action = 'not_found' THEN 'database_lookup' WHEN contains(lower(error), 'extraction') THEN 'extraction'
  WHEN contains(lower(error), 'shopify') THEN 'shopify_update' WHEN contains(lower(error), 'image') THEN 'image_processing' ELSE 'unknown' END AS stage,
  action, CASE WHEN contains(error, 'Unknown') THEN 'uncertain' ELSE 'known_error' END AS certainty FROM f""")
def failure_records(v):
    return changes.failures(outcomes(v))


STAGE = """CASE WHEN source = 'new_product_import' THEN 'imported_direct' WHEN shopify_status = 'published' THEN 'assessed_approved'
  WHEN shopify_status = 'draft' AND modesty_status = 'not_modest' THEN 'assessed_rejected' WHEN shopify_status = 'draft' THEN 'pending_assessment'
  WHEN assessment_status IN ('queued', 'pending_modesty_review') THEN 'pending_assessment' ELSE 'unknown' END"""


@query("F22_lifecycle_backfill", f"""
SELECT url, {STAGE} AS lifecycle_stage, CASE WHEN shopify_status IN ('published', 'draft') THEN 'enriched' ELSE 'full' END AS data_completeness
FROM b_products_full""")
def lifecycle(v):
    return changes.backfill_lifecycle(v.b_products_full).select(
        "url", "lifecycle_stage", "data_completeness")


@query("A33_backfill_counts", f"""
SELECT {STAGE} AS lifecycle_stage, count(*) AS n FROM b_products_full GROUP BY ALL""")
def backfill_counts(v):
    return changes.backfill_lifecycle(v.b_products_full).groupBy("lifecycle_stage").agg(
        F.count(F.lit(1)).alias("n"))


@query("F24_publish_and_gate", """
SELECT url, CASE WHEN modesty_status IN ('modest', 'moderately_modest') THEN 'active' ELSE 'draft' END AS publish_status,
  CASE WHEN modesty_status IN ('modest', 'moderately_modest') THEN 'upload' ELSE 'skipped' END AS import_action FROM b_products_full""")
def gate(v):
    d = F.col("modesty_status")
    return v.b_products_full.select("url", changes.publish_status(d).alias("publish_status"),
                                    changes.import_gate(d).alias("import_action"))


STORED = ["url", "retailer", "title", "price", "description", "shopify_id", "shopify_status",
          "images_uploaded", "source", "assessment_status", "first_seen", "last_updated"]


def stored(v):
    return v.b_products_full.select(*STORED)


def incoming(v):
    return v.b_extracts.select("url", "retailer", "title", "price", "description")


UPSERT = f"""
SELECT coalesce(p.url, x.url) AS url, coalesce(p.retailer, x.retailer) AS retailer, coalesce(x.title, p.title) AS title,
  coalesce(x.price, p.price) AS price, coalesce(x.description, p.description) AS description, p.shopify_id,
  {{status}}, p.source, CASE WHEN p.url IS NOT NULL THEN p.first_seen ELSE {AS_OF} END AS first_seen,
  CASE WHEN x.url IS NOT NULL THEN {AS_OF} ELSE p.last_updated END AS last_updated
FROM b_products_full p FULL OUTER JOIN b_extracts x ON p.url = x.url"""


@query("K5_upsert_products", UPSERT.format(status="""
  CASE WHEN x.url IS NOT NULL THEN 'not_uploaded' ELSE p.shopify_status END AS shopify_status,
  CASE WHEN x.url IS NOT NULL THEN 0 ELSE p.images_uploaded END AS images_uploaded,
  CASE WHEN x.url IS NOT NULL THEN 'not_assessed' ELSE p.assessment_status END AS assessment_status"""))
def upsert(v):
    return changes.upsert_products(stored(v), incoming(v), as_of())


KEPT_STATUS = UPSERT.format(status="""
  coalesce(p.shopify_status, 'not_uploaded') AS shopify_status, coalesce(p.images_uploaded, 0) AS images_uploaded,
  coalesce(p.assessment_status, 'not_assessed') AS assessment_status""")


@query("K5_upsert_keep_status", KEPT_STATUS)
def upsert_keep(v):
    return changes.upsert_products(stored(v), incoming(v), as_of(), defaults_on_insert_only=True)


@query("K5a_insert_defaults", f"""
SELECT url, CASE WHEN shopify_id IS NOT NULL THEN 'draft' ELSE 'not_uploaded' END AS shopify_status, images_uploaded,
  CASE WHEN images_uploaded = 1 THEN {AS_OF} END AS images_uploaded_at,
  CASE WHEN source = 'baseline_scan' THEN 'not_for_assessment' ELSE 'not_assessed' END AS assessment_status,
  CASE WHEN image_csv <> '' THEN image_csv END AS images FROM b_products_full""")
def defaults(v):
    rows = with_images(v.b_products_full.select(
        "url", "shopify_id", "images_uploaded", "source", "image_csv"))
    return changes.insert_defaults(rows, as_of()).select(
        "url", "shopify_status", "images_uploaded", "images_uploaded_at", "assessment_status",
        F.array_join("image_urls", ",").alias("images"))


UPSERT_LISTINGS = f"""
WITH e AS (SELECT catalog_url, retailer, min(title) AS title, min(price) AS price, max(product_code) AS product_code, min(discovered_date) AS discovered_date FROM b_snapshots WHERE scan_type = 'baseline' GROUP BY ALL),
n AS (SELECT catalog_url, retailer, min(title) AS title, CASE WHEN count(*) > 1 THEN min(price) END AS price, max(product_code) AS product_code FROM b_snapshots WHERE scan_type = 'monitor' GROUP BY ALL)
SELECT coalesce(e.catalog_url, n.catalog_url) AS catalog_url, coalesce(e.retailer, n.retailer) AS retailer, coalesce(n.title, e.title) AS title,
  CASE WHEN n.catalog_url IS NOT NULL THEN n.price ELSE e.price END AS price, coalesce(n.product_code, e.product_code) AS product_code,
  coalesce(e.discovered_date, CAST({AS_OF} AS DATE)) AS discovered_date
FROM e FULL OUTER JOIN n ON e.catalog_url = n.catalog_url AND e.retailer = n.retailer"""


@query("K6_upsert_listings", UPSERT_LISTINGS)
def upsert_listings(v):
    return changes.upsert_listings(*listing_versions(v), as_of())


def listing_versions(v):
    keys = ["catalog_url", "retailer"]
    e = v.b_snapshots.filter("scan_type = 'baseline'").groupBy(*keys).agg(
        F.min("title").alias("title"), F.min("price").alias("price"),
        F.max("product_code").alias("product_code"),
        F.min("discovered_date").alias("discovered_date"))
    n = v.b_snapshots.filter("scan_type = 'monitor'").groupBy(*keys).agg(
        F.min("title").alias("title"),
        F.when(F.count(F.lit(1)) > 1, F.min("price")).alias("price"),
        F.max("product_code").alias("product_code"))
    return e, n


def in_buckets(rows, keys, updates, merge, group=None):
    """The table after one upsert of a bucket table made of ``rows``."""
    table = BucketTable.create(rows, scratch_path(rows.sparkSession, "table"), keys, 64, group)
    table.upsert(updates, merge)
    return table.read()


@query("K5_upsert_in_buckets", KEPT_STATUS)
def upsert_in_buckets(v):
    return in_buckets(stored(v), ["url"], incoming(v), lambda old, new: changes.upsert_products(
        old, new, as_of(), defaults_on_insert_only=True), "parse_url(url, 'HOST')")


@query("K6_upsert_listings_in_buckets", UPSERT_LISTINGS)
def upsert_listings_in_buckets(v):
    e, n = listing_versions(v)
    return in_buckets(e, ["catalog_url", "retailer"], n, lambda old, new: changes.upsert_listings(old, new, as_of()), "retailer")


APPLIED = EXTRACT_JOIN + f"""
SELECT p.url, CASE WHEN a.action NOT IN ('unchanged', 'delisted') AND coalesce(a.title, '') <> '' THEN a.title ELSE p.title END AS title,
  CASE WHEN a.action NOT IN ('unchanged', 'delisted') AND coalesce(a.price, 0) <> 0 THEN a.price ELSE p.price END AS price,
  CASE WHEN a.action NOT IN ('unchanged', 'delisted') THEN coalesce(a.sale_status, p.sale_status) ELSE p.sale_status END AS sale_status,
  CASE WHEN a.action = 'delisted' THEN 'delisted' WHEN a.action <> 'unchanged' THEN coalesce(a.stock_status, p.stock_status) ELSE p.stock_status END AS stock_status,
  CASE WHEN a.action <> 'unchanged' THEN {AS_OF} ELSE p.last_updated END AS last_updated,
  CASE WHEN a.url IS NOT NULL THEN {AS_OF} ELSE p.last_checked END AS last_checked
FROM b_products_full p LEFT JOIN (SELECT * FROM a WHERE action NOT IN ('failed', 'not_found')) a ON p.url = a.url"""


@query("K7_apply_updates", APPLIED)
def apply_updates(v):
    rows = outcomes(v).filter("action NOT IN ('failed', 'not_found')")
    cols = ["url", "title", "price", "sale_status", "stock_status", "last_updated", "last_checked"]
    return changes.apply_updates(v.b_products_full.select(*cols), rows, as_of())


@query("K7_apply_updates_in_buckets", APPLIED)
def apply_updates_in_buckets(v):
    rows = outcomes(v).filter("action NOT IN ('failed', 'not_found')")
    cols = ["url", "title", "price", "sale_status", "stock_status", "last_updated", "last_checked"]
    return in_buckets(v.b_products_full.select(*cols), ["url"], rows, lambda old, new: changes.apply_updates(old, new, as_of()),
                      "parse_url(url, 'HOST')")


@query("K12_mark_delisted", f"""
SELECT p.url, CASE WHEN x.url IS NOT NULL THEN 'delisted' ELSE p.stock_status END AS stock_status,
  CASE WHEN x.url IS NOT NULL THEN {AS_OF} ELSE p.last_updated END AS last_updated,
  CASE WHEN x.url IS NOT NULL THEN {AS_OF} ELSE p.last_checked END AS last_checked
FROM b_products_full p LEFT JOIN (SELECT DISTINCT url FROM b_extracts WHERE stock_status = 'no_longer_available') x ON p.url = x.url""")
def delisted(v):
    gone = v.b_extracts.filter("stock_status = 'no_longer_available'")
    return changes.mark_delisted(
        v.b_products_full.select("url", "stock_status", "last_updated", "last_checked"),
        gone, as_of())


@query("K12_set_status", f"""
SELECT p.url, CASE WHEN x.url IS NOT NULL THEN 'published' ELSE p.shopify_status END AS shopify_status,
  CASE WHEN x.url IS NOT NULL THEN {AS_OF} ELSE p.last_updated END AS last_updated
FROM b_products_full p LEFT JOIN b_extracts x ON p.url = x.url""")
def set_status(v):
    values = v.b_extracts.select("url", F.lit("published").alias("shopify_status"))
    return changes.set_columns(v.b_products_full.select("url", "shopify_status", "last_updated"),
                               values, as_of())


@query("K13_update_records", f"""
SELECT p.url, CASE WHEN x.url IS NOT NULL THEN x.title ELSE p.title END AS title,
  CASE WHEN x.url IS NOT NULL THEN x.price ELSE p.price END AS price,
  CASE WHEN x.url IS NOT NULL THEN coalesce(x.sale_status, 'regular') ELSE p.sale_status END AS sale_status,
  CASE WHEN x.url IS NOT NULL THEN coalesce(x.stock_status, 'in_stock') ELSE p.stock_status END AS stock_status,
  CASE WHEN x.url IS NOT NULL THEN {AS_OF} ELSE p.last_updated END AS last_updated
FROM b_products_full p LEFT JOIN b_extracts x ON p.url = x.url""")
def update_records(v):
    cols = ["url", "title", "price", "sale_status", "stock_status", "last_updated"]
    return changes.update_records(v.b_products_full.select(*cols), v.b_extracts, as_of())


@query("K2_snapshot_rows", f"""
SELECT catalog_url, retailer, 'dresses' AS category, title, price, product_code, CASE WHEN image_csv <> '' THEN image_csv ELSE '' END AS images,
  {AS_OF} AS discovered_date, 'baseline' AS review_status, 'monitor' AS scan_type, 'catalog_extraction' AS image_url_source
FROM b_listings WHERE scan_type = 'monitor'""")
def snapshot_rows(v):
    rows = with_images(v.b_listings.filter("scan_type = 'monitor'"))
    return changes.snapshot_rows(rows, F.lit("dresses"), as_of()).withColumn(
        "images", F.array_join("image_urls", ",")).drop("image_urls")


@query("K3_update_queue_rows", f"""
WITH n AS (SELECT retailer, rtrim(split_part(url, '?', 1), '/') AS k, min({{'u': url, 'p': price}}) AS m FROM b_products GROUP BY ALL)
SELECT n.m.u AS product_url, s.retailer, CASE WHEN abs(s.price - n.m.p) > 50 THEN 'high' ELSE 'normal' END AS priority,
  count(*) AS n FROM b_snapshots s JOIN n ON s.retailer = n.retailer AND rtrim(split_part(s.catalog_url, '?', 1), '/') = n.k
WHERE s.price <> 0 AND n.m.p <> 0 AND abs(s.price - n.m.p) >= 0.01 GROUP BY ALL""")
def update_queue(v):
    return linking.price_changes(v.b_snapshots, v.b_products, as_of()).groupBy(
        "product_url", "retailer", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("K4_baseline_header", f"""
SELECT retailer, scan_type AS category, count(*) AS total_products_seen, CAST({AS_OF} AS DATE) AS baseline_date FROM b_snapshots GROUP BY ALL""")
def baseline_header(v):
    return changes.baseline_header(
        v.b_snapshots.withColumn("category", F.col("scan_type")), as_of())


@query("J16_fill_gaps", """
SELECT x.url, coalesce(nullif(x.title, ''), p.title) AS title, coalesce(nullif(x.price, 0), p.price) AS price,
  CASE WHEN x.image_csv <> '' THEN x.image_csv ELSE coalesce(p.image_csv, '') END AS images,
  concat_ws(',', CASE WHEN length(coalesce(x.title, '')) < 5 THEN 'title' END, CASE WHEN coalesce(x.price, 0) = 0 THEN 'price' END,
    CASE WHEN x.image_csv = '' THEN 'images' END) AS gaps, p.product_code
FROM b_extracts x LEFT JOIN b_products_full p ON x.url = p.url""")
def gaps(v):
    primary = with_images(v.b_extracts.select(
        "url", "title", "price", "image_csv", F.lit(None).cast("string").alias("product_code")))
    out = changes.fill_gaps(primary, with_images(v.b_products_full))
    return out.select("url", "title", "price", "product_code",
                      F.coalesce(F.array_join("image_urls", ","), F.lit("")).alias("images"),
                      F.array_join("gaps", ",").alias("gaps"))


REMOTE = """
r AS (SELECT url, CASE WHEN shopify_status = 'published' THEN 'assessed_rejected' ELSE lifecycle_stage END AS lifecycle_stage,
  CASE WHEN images_uploaded = 1 THEN assessed_at + INTERVAL 40 DAY ELSE assessed_at END AS assessed_at, modesty_status, 'draft' AS shopify_status, last_updated
  FROM b_products_full WHERE title <> 'none')"""


@query("J14_merge_remote_reviews", f"""
WITH {REMOTE}, a AS (SELECT * FROM r WHERE lifecycle_stage IN ('assessed_approved', 'assessed_rejected') AND assessed_at IS NOT NULL),
j AS (SELECT p.*, a.url IS NOT NULL AND (coalesce(p.lifecycle_stage NOT IN ('assessed_approved', 'assessed_rejected'), true) OR p.assessed_at IS NULL OR a.assessed_at > p.assessed_at) AS t,
  a.lifecycle_stage AS al, a.assessed_at AS aa, a.modesty_status AS am, a.shopify_status AS ash, a.last_updated AS au FROM b_products_full p LEFT JOIN a ON p.url = a.url)
SELECT url, CASE WHEN t THEN al ELSE lifecycle_stage END AS lifecycle_stage, CASE WHEN t THEN aa ELSE assessed_at END AS assessed_at,
  CASE WHEN t THEN am ELSE modesty_status END AS modesty_status, CASE WHEN t THEN ash ELSE shopify_status END AS shopify_status,
  CASE WHEN t THEN au ELSE last_updated END AS last_updated, coalesce(t, false) AS was_merged FROM j""")
def merge_reviews(v):
    cols = ["url", "lifecycle_stage", "assessed_at", "modesty_status", "shopify_status",
            "last_updated"]
    remote = v.b_products_full.select(
        "url", F.when(F.col("shopify_status") == "published", "assessed_rejected")
        .otherwise(F.col("lifecycle_stage")).alias("lifecycle_stage"),
        F.when(F.col("images_uploaded") == 1, F.expr("assessed_at + INTERVAL 40 DAY"))
        .otherwise(F.col("assessed_at")).alias("assessed_at"),
        "modesty_status", F.lit("draft").alias("shopify_status"), "last_updated")
    return changes.merge_remote_reviews(v.b_products_full.select(*cols), remote)


# A chunk of the sequence spans a thousand orders of the binding.
CHUNK = 8 * 1000 * 10**10


@query("W2_price_history", """
SELECT catalog_url, discovered_date, seq, price, lag(price) OVER w AS previous_price, price - lag(price) OVER w AS price_change
FROM b_snapshots WINDOW w AS (PARTITION BY catalog_url ORDER BY discovered_date, seq)""")
def price_history(v):
    return ordered.price_history(v.b_snapshots, "seq", CHUNK).select(
        "catalog_url", "discovered_date", "seq", "price", "previous_price", "price_change")


@query("W3_latest_snapshot", """
SELECT catalog_url, discovered_date, seq, price FROM b_snapshots
QUALIFY row_number() OVER (PARTITION BY catalog_url ORDER BY discovered_date DESC, seq DESC) = 1""")
def latest(v):
    rows = v.b_snapshots.select("catalog_url", "discovered_date", "seq", "price")
    return ordered.latest_per_url(rows, "seq")


@query("W3_disappeared", """
WITH d AS (SELECT max(discovered_date) AS hi, min(discovered_date) AS lo FROM b_snapshots)
SELECT DISTINCT retailer, catalog_url FROM b_snapshots s, d WHERE s.discovered_date < d.hi
  AND NOT EXISTS (SELECT 1 FROM b_snapshots t, d WHERE t.discovered_date >= DATE '1998-06-01' AND t.retailer = s.retailer AND t.catalog_url = s.catalog_url)
  AND s.discovered_date < DATE '1998-06-01'""")
def disappeared(v):
    run = F.when(F.col("discovered_date") < F.lit("1998-06-01").cast("date"), F.lit("a")) \
        .otherwise(F.lit("b"))
    runs = v.b_snapshots.withColumn("discovered_date", run)
    return linking.disappeared_since(runs, F.lit("b"), F.lit("a"))


@query("W4_run_positions", """
SELECT batch_id, seq, row_number() OVER (PARTITION BY batch_id ORDER BY seq) - 1 AS position, count(*) OVER (PARTITION BY batch_id) AS total
FROM (SELECT retailer AS batch_id, seq FROM b_snapshots)""")
def positions(v):
    rows = v.b_snapshots.select(F.col("retailer").alias("batch_id"), "seq",
                               ordered.chunk_of(F.col("seq"), CHUNK).alias("_chunk"))
    return ordered.with_position(rows, ["batch_id"], ["_chunk"], ["_chunk", "seq"]).drop("_chunk")


@query("W6_checkpoint_marks", """
WITH p AS (SELECT batch_id, seq, row_number() OVER (PARTITION BY batch_id ORDER BY seq) - 1 AS position, count(*) OVER (PARTITION BY batch_id) AS total
FROM (SELECT retailer AS batch_id, seq FROM b_snapshots))
SELECT batch_id, seq, position, total, (position % 5 = 0 OR position = total - 1) AS save FROM p""")
def marks(v):
    rows = v.b_snapshots.select(F.col("retailer").alias("batch_id"), "seq")
    return ordered.checkpoint_marks(rows, "seq", width=CHUNK)
