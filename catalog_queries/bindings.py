"""SQL bindings: catalog entities derived from the supplied tables."""

from catalog_queries.base import BINDINGS

BINDINGS["b_products"] = """
SELECT p_partkey,
  concat('https://www.', lower(replace(p_brand,'#','')), '.example.com/', replace(p_name,' ','-'), '/dp/PC-', CAST(p_partkey AS STRING), '/') AS url,
  lower(replace(p_brand,'#','')) AS retailer, p_name AS title, p_retailprice AS price,
  concat('PC-', CAST(p_partkey AS STRING)) AS product_code, lower(p_type) AS clothing_type,
  CASE WHEN p_size > 40 THEN 'delisted' WHEN p_size > 30 THEN 'out_of_stock' ELSE 'in_stock' END AS stock_status,
  CASE WHEN p_size % 4 = 0 THEN 'on_sale' ELSE 'regular' END AS sale_status,
  CASE p_size % 5 WHEN 0 THEN 'assessed_approved' WHEN 1 THEN 'assessed_rejected' WHEN 2 THEN 'pending_assessment' WHEN 3 THEN 'imported_direct' ELSE NULL END AS lifecycle_stage,
  CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_partkey + 1000000 END AS shopify_id
FROM part
"""

# An order line can occur more than once; only ``seq`` tells all rows apart.
BINDINGS["b_snapshots"] = """
SELECT l.l_orderkey, l.l_linenumber, ((l.l_orderkey * 8 + l.l_linenumber) * 1000000 + l.l_partkey) * 10000 + l.l_suppkey AS seq, p.retailer, CAST(l.l_shipdate AS DATE) AS discovered_date,
  CASE WHEN l.l_linestatus = 'O' THEN 'monitor' ELSE 'baseline' END AS scan_type,
  CASE l.l_linenumber % 7
    WHEN 1 THEN p.url
    WHEN 2 THEN concat(p.url, '?page=', CAST(l.l_orderkey % 9 AS STRING))
    WHEN 3 THEN concat('https://www.', p.retailer, '.example.com/collections/dp/', p.product_code, '/')
    ELSE concat('https://www.', p.retailer, '.example.com/n/dp/NX-', CAST(l.l_orderkey AS STRING), '-', CAST(l.l_linenumber AS STRING), '/') END AS catalog_url,
  CASE l.l_linenumber % 7 WHEN 5 THEN concat(p.title, 's') WHEN 6 THEN concat('limited ', p.title) WHEN 0 THEN concat('unseen item ', CAST(l.l_orderkey AS STRING)) ELSE p.title END AS title,
  CASE WHEN l.l_returnflag = 'R' THEN p.price * (1 - l.l_discount) ELSE p.price END AS price,
  CASE WHEN l.l_linenumber % 7 IN (1, 2, 3) THEN p.product_code ELSE NULL END AS product_code
FROM lineitem l JOIN b_products p ON l.l_partkey = p.p_partkey
"""

BINDINGS["b_queue"] = """
SELECT o.o_orderkey AS id, concat('https://q.example.com/', CAST(o.o_orderkey AS STRING)) AS product_url,
  lower(c.c_mktsegment) AS retailer, CASE WHEN o.o_orderkey % 4 = 0 THEN 'duplication' ELSE 'modesty' END AS review_type,
  CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'high' WHEN o.o_orderpriority = '5-LOW' THEN 'low' ELSE 'normal' END AS priority,
  CASE o.o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'reviewed' ELSE 'skipped' END AS status,
  o.o_orderdate AS added_at, CASE WHEN o.o_orderstatus = 'O' THEN NULL ELSE o.o_orderdate + INTERVAL 3 DAY END AS reviewed_at,
  o.o_totalprice AS price
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

BINDINGS["b_attempts"] = """
SELECT event_id AS seq, ts AS attempted_at, concat('r', CAST(user_id % 10 AS STRING)) AS retailer,
  CASE WHEN event_id % 3 = 0 THEN 'catalog' ELSE 'product' END AS page_type, event_type AS method,
  event_type <> 'error' AS success, value AS processing_time, round(value / 1000, 6) AS cost,
  CASE WHEN event_type = 'error' THEN concat('E', CAST(event_id % 5 AS STRING)) ELSE NULL END AS errors,
  least(1.0, 0.5 + value / 1000) AS confidence, event_type = 'view' AS url_changed, props
FROM events
"""

BINDINGS["b_docs"] = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

BINDINGS["b_pages"] = """
SELECT page_id, url, html FROM pages
"""

# Products with every stored column. Image lists are comma-separated text here
# because both engines split them alike.
BINDINGS["b_products_full"] = """
SELECT p.*, x.p_brand AS brand, concat(p.title, ' in ', p.clothing_type) AS description,
  CASE WHEN x.p_size % 4 = 0 THEN round(p.price * 1.25, 2) ELSE NULL END AS original_price,
  CASE WHEN x.p_size % 7 = 0 THEN '' ELSE concat('https://img.example.com/', p.retailer, '/set/', CAST(p.p_partkey % 50 AS STRING), '.jpg,https://img.example.com/', p.retailer, '/', CAST(p.p_partkey AS STRING), '_small.jpg') END AS image_csv,
  CASE x.p_size % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'draft' ELSE 'not_uploaded' END AS shopify_status,
  CASE x.p_size % 4 WHEN 0 THEN 'modest' WHEN 1 THEN 'moderately_modest' WHEN 2 THEN 'not_modest' ELSE NULL END AS modesty_status,
  CASE x.p_size % 5 WHEN 0 THEN 'monitor' WHEN 1 THEN 'baseline_scan' WHEN 2 THEN 'new_product_import' WHEN 3 THEN 'monitor' ELSE NULL END AS source,
  CASE x.p_size % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'assessed' WHEN 2 THEN 'not_for_assessment' ELSE 'not_assessed' END AS assessment_status,
  CASE x.p_size % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'lightweight' ELSE 'enriched' END AS data_completeness,
  CASE x.p_size % 3 WHEN 0 THEN 'catalog_monitor' WHEN 1 THEN 'product_updater' ELSE 'new_product_importer' END AS last_workflow,
  CASE WHEN x.p_size % 2 = 0 THEN 1 ELSE 0 END AS images_uploaded,
  CAST(make_date(1995 + x.p_size % 4, 1 + x.p_size % 12, 1 + CAST(p.p_partkey % 28 AS INT)) AS TIMESTAMP) AS first_seen,
  CASE WHEN x.p_size % 11 = 0 THEN NULL ELSE CAST(make_date(2001, 1 + x.p_size % 12, 1 + CAST(p.p_partkey % 28 AS INT)) AS TIMESTAMP) END AS last_updated,
  CAST(make_date(2001, 1 + x.p_size % 6, 1 + CAST(p.p_partkey % 28 AS INT)) AS TIMESTAMP) AS last_checked,
  CASE WHEN x.p_size % 5 IN (0, 1) AND x.p_size % 9 <> 0 THEN CAST(make_date(2001, 1 + x.p_size % 11, 1 + CAST(p.p_partkey % 28 AS INT)) AS TIMESTAMP) ELSE NULL END AS assessed_at
FROM b_products p JOIN part x ON p.p_partkey = x.p_partkey
"""

# A fresh extraction of about half of the known products, with changed fields,
# delistings, failures and urls that are not known.
BINDINGS["b_extracts"] = """
SELECT CASE WHEN x.p_size % 13 = 0 THEN concat(p.url, 'gone') ELSE p.url END AS url, p.retailer,
  x.p_size % 17 <> 0 AS success,
  CASE WHEN x.p_size % 17 = 0 THEN CASE x.p_size % 3 WHEN 0 THEN 'Extraction failed' WHEN 1 THEN 'Shopify rejected it' ELSE 'Unknown image trouble' END ELSE NULL END AS error,
  CASE WHEN x.p_size % 6 = 1 THEN concat(p.title, ' new') WHEN x.p_size % 6 = 2 THEN concat(' ', upper(p.title), ' ') ELSE p.title END AS title,
  CASE WHEN x.p_size % 5 = 1 THEN p.price + 60.5 WHEN x.p_size % 5 = 2 THEN p.price - 0.5 WHEN x.p_size % 19 = 3 THEN NULL ELSE p.price END AS price,
  p.original_price, p.description, p.sale_status, p.image_csv,
  CASE WHEN x.p_size % 12 = 5 THEN 'no_longer_available' WHEN x.p_size % 12 = 6 THEN 'low_stock' ELSE p.stock_status END AS stock_status
FROM b_products_full p JOIN part x ON p.p_partkey = x.p_partkey WHERE x.p_size % 2 = 1 OR x.p_size % 3 = 0
"""

# Decisions of reviewers on finished queue rows.
BINDINGS["b_reviews"] = """
SELECT q.*, CASE WHEN q.status <> 'reviewed' THEN NULL
    WHEN q.review_type = 'duplication' THEN CASE WHEN q.id % 3 = 0 THEN 'duplicate' ELSE 'not_duplicate' END
    WHEN q.id % 5 = 0 THEN 'not_modest' WHEN q.id % 5 = 1 THEN 'moderately_modest' ELSE 'modest' END AS review_decision,
  concat('rev', CAST(q.id % 7 AS STRING)) AS reviewed_by,
  CASE WHEN q.id % 3 = 0 THEN 'dresses' ELSE 'tops' END AS category,
  CASE q.id % 4 WHEN 0 THEN 'baseline_scan' ELSE 'catalog_monitor' END AS source_workflow
FROM b_queue q
"""

# Listings as a crawl would give them: snapshots with image lists.
BINDINGS["b_listings"] = """
SELECT s.*, CASE WHEN s.l_orderkey % 9 = 0 THEN '' ELSE concat('https://img.example.com/', s.retailer, '/set/', CAST(s.l_orderkey % 60 AS STRING), '.jpg,https://img.example.com/', s.retailer, '/x', CAST(s.l_orderkey % 40 AS STRING), '.png') END AS image_csv
FROM b_snapshots s
"""
