"""Work selection, review queue and profile analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries.base import AS_OF, as_of, events_as_of, query
from catalog_queries.bindings import BINDINGS
from catalog_queries.linking import with_images
from shelfwatch.operators import profiles, review, linking
from shelfwatch.schemas import DOMAINS

KEEP = "(lifecycle_stage IS NULL OR (lifecycle_stage NOT ILIKE '%not_modest%' AND lifecycle_stage NOT ILIKE '%no_longer_available%'))"
AGE = f"epoch({AS_OF} - {{}}) / 86400.0"


@query("F1_select_work", f"""
SELECT url, retailer, last_updated FROM b_products_full WHERE {KEEP} AND sale_status = 'on_sale' AND stock_status = 'in_stock'
  AND modesty_status = 'modest' AND shopify_id IS NOT NULL AND {AGE.format('last_updated')} > 30""")
def select_work(v):
    return review.select_work(
        v.b_products_full, as_of(), modesty_status="modest", sale_status="on_sale",
        stock_status="in_stock", has_shopify_id=True, min_age_days=30).select(
        "url", "retailer", "last_updated")


@query("F2_smart_batches", f"""
SELECT 'on_sale' AS batch, url FROM b_products_full WHERE sale_status = 'on_sale' UNION ALL
SELECT 'low_stock', url FROM b_products_full WHERE stock_status = 'low_stock' UNION ALL
SELECT 'stale', url FROM b_products_full WHERE {AGE.format('last_updated')} >= 60 UNION ALL
SELECT 'recent', url FROM b_products_full WHERE {AGE.format('first_seen')} <= 7 UNION ALL
SELECT 'age_30', url FROM b_products_full WHERE {AGE.format('last_updated')} >= 30""")
def smart_batches(v):
    p, out = v.b_products_full, None
    parts = [(k, review.smart_batch(p, k, as_of())) for k in
             ("on_sale", "low_stock", "stale", "recent")]
    parts.append(("age_30", review.by_age(p, 30, as_of())))
    for name, rows in parts:
        rows = rows.select(F.lit(name).alias("batch"), "url")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("F3_stage_exclusion", f"""
SELECT url, lifecycle_stage, {KEEP} AS kept, ({KEEP} AND coalesce(lifecycle_stage <> 'assessed_rejected', true)) AS kept_strict FROM b_products_full""")
def stage_exclusion(v):
    s = F.col("lifecycle_stage")
    return v.b_products_full.select("url", s, review.stage_allowed(s).alias("kept"),
                                    review.stage_allowed(s, True).alias("kept_strict"))


@query("T1_stalest_first", f"""
SELECT url, last_updated FROM b_products_full WHERE {KEEP} ORDER BY last_updated ASC NULLS FIRST, url LIMIT 100""")
def stalest(v):
    return review.stalest_first(review.select_work(v.b_products_full, as_of())).select(
        "url", "last_updated")


@query("F12_retention", f"""
SELECT 'queue' AS log, count(*) FILTER (g) AS removed, count(*) FILTER (NOT g) AS kept FROM (SELECT coalesce(status IN ('reviewed', 'skipped') AND reviewed_at < {AS_OF} - INTERVAL 1000 DAY, false) AS g FROM b_queue)
UNION ALL SELECT 'attempts', count(*) FILTER (g), count(*) FILTER (NOT g) FROM (SELECT attempted_at < TIMESTAMP '2024-02-01' - INTERVAL 10 DAY AS g FROM b_attempts)
UNION ALL SELECT 'cache', count(*) FILTER (g), count(*) FILTER (NOT g) FROM (SELECT attempted_at < TIMESTAMP '2024-02-01' - INTERVAL 24 HOUR AS g FROM b_attempts)
UNION ALL SELECT 'calls', count(*) FILTER (g), count(*) FILTER (NOT g) FROM (SELECT attempted_at < TIMESTAMP '2024-02-01' - INTERVAL 20 DAY AS g FROM b_attempts)""")
def retention(v):
    done = F.col("status").isin("reviewed", "skipped")
    parts = [("queue", review.removed_count(v.b_queue, "reviewed_at", as_of(), "1000 DAYS", done))]
    parts += [(n, review.removed_count(v.b_attempts, "attempted_at", events_as_of(), age))
              for n, age in (("attempts", "10 DAYS"), ("cache", "24 HOURS"), ("calls", "20 DAYS"))]
    out = None
    for name, rows in parts:
        rows = rows.withColumn("log", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("F12_retained_queue", f"""
SELECT id, status, reviewed_at FROM b_queue WHERE NOT coalesce(status IN ('reviewed', 'skipped') AND reviewed_at < {AS_OF} - INTERVAL 1000 DAY, false)""")
def retained(v):
    return review.retain(v.b_queue, "reviewed_at", as_of(), "1000 DAYS",
                         F.col("status").isin("reviewed", "skipped")).select(
        "id", "status", "reviewed_at")


@query("F13_provenance", """
SELECT 'monitor' AS kind, url FROM b_products_full WHERE source = 'monitor' UNION ALL
SELECT 'baseline', url FROM b_products_full WHERE source IS NULL OR source = 'baseline_scan' UNION ALL
SELECT 'organic', url FROM b_products_full WHERE source = 'monitor' AND first_seen > TIMESTAMP '1997-01-01'""")
def provenance(v):
    out = None
    for kind in ("monitor", "baseline", "organic"):
        rows = review.provenance(v.b_products_full, kind, as_of("1997-01-01 00:00:00")).select(
            F.lit(kind).alias("kind"), "url")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("F14_snapshot_as_of", """
SELECT catalog_url, retailer, title, price FROM b_snapshots WHERE scan_type = 'monitor' AND discovered_date = DATE '1996-11-29'""")
def snapshot_as_of(v):
    return v.b_snapshots.filter((F.col("scan_type") == "monitor") & (
        F.col("discovered_date") == F.lit("1996-11-29").cast("date"))).select(
        "catalog_url", "retailer", "title", "price")


@query("F25_queue_listing", """
SELECT id, product_url, priority FROM b_reviews WHERE status = 'pending' AND retailer = 'building' AND category = 'tops' AND review_type = 'modesty' AND priority = 'high'""")
def queue_listing(v):
    return review.queue_listing(v.b_reviews, "building", "tops", "modesty", "high").select(
        "id", "product_url", "priority")


RANK = "CASE priority WHEN 'high' THEN 1 WHEN 'normal' THEN 2 WHEN 'low' THEN 3 END"


@query("T2_review_page", f"""
SELECT id, priority, added_at FROM b_queue WHERE status = 'pending' AND review_type = 'modesty' ORDER BY {RANK}, added_at, id LIMIT 50""")
def review_page(v):
    return review.review_page(review.queue_listing(v.b_queue)).select("id", "priority", "added_at")


@query("T2_newest_items", "SELECT id, added_at FROM b_queue ORDER BY added_at DESC, id DESC LIMIT 100")
def newest(v):
    return review.newest_items(v.b_queue).select("id", "added_at")


@query("W1_next_for_review", f"""
SELECT 'priority' AS mode, review_type, id FROM (SELECT * FROM b_queue WHERE status = 'pending') QUALIFY row_number() OVER (PARTITION BY review_type ORDER BY {RANK}, added_at, id) = 1
UNION ALL SELECT 'fifo', review_type, id FROM (SELECT * FROM b_queue WHERE status = 'pending') QUALIFY row_number() OVER (PARTITION BY review_type ORDER BY added_at, id) = 1""")
def next_items(v):
    a = review.next_for_review(v.b_queue).select(F.lit("priority").alias("mode"), "review_type", "id")
    return a.unionByName(review.next_for_review(v.b_queue, False).select(
        F.lit("fifo").alias("mode"), "review_type", "id"))


@query("T4_recent_approvals", """
SELECT url, title, modesty_status, assessed_at FROM b_products_full WHERE lifecycle_stage = 'assessed_approved' AND assessed_at IS NOT NULL ORDER BY assessed_at DESC, url LIMIT 10""")
def recent_approvals(v):
    rows = v.b_products_full.filter("lifecycle_stage = 'assessed_approved'")
    return review.most_recent(rows, "assessed_at", "url").select(
        "url", "title", "modesty_status", "assessed_at")


@query("T7_high_priority_updates", """
WITH n AS (SELECT retailer, rtrim(split_part(url, '?', 1), '/') AS k, min({'u': url, 'p': price}) AS m FROM b_products GROUP BY ALL)
SELECT s.l_orderkey, s.l_linenumber, n.m.u AS product_url, s.price - n.m.p AS price_difference
FROM b_snapshots s JOIN n ON s.retailer = n.retailer AND rtrim(split_part(s.catalog_url, '?', 1), '/') = n.k
WHERE s.price <> 0 AND n.m.p <> 0 AND abs(s.price - n.m.p) > 50""")
def urgent(v):
    return review.high_priority_updates(
        linking.price_changes(v.b_snapshots, v.b_products, as_of())).select(
        "l_orderkey", "l_linenumber", "product_url", "price_difference")


BINDINGS["b_new_items"] = """
SELECT CASE WHEN r.id % 3 = 0 THEN concat(r.product_url, '/new') ELSE r.product_url END AS product_url, r.retailer, r.category,
  CASE WHEN r.id % 5 = 0 THEN 'duplication' ELSE 'modesty' END AS review_type, r.priority, r.source_workflow, r.id AS seq
FROM b_reviews r
"""


@query("K8_add_to_queue", f"""
WITH f AS (SELECT product_url, review_type, min({{'seq': seq, 'retailer': retailer, 'category': category, 'priority': priority, 'w': source_workflow}}) AS m FROM b_new_items GROUP BY ALL)
SELECT product_url, review_type, m.retailer AS retailer, m.category AS category, m.priority AS priority, m.w AS source_workflow, 'pending' AS status, {AS_OF} AS added_at
FROM f WHERE NOT EXISTS (SELECT 1 FROM b_reviews q WHERE q.product_url = f.product_url AND q.review_type = f.review_type)""")
def add_to_queue(v):
    return review.add_to_queue(v.b_reviews, v.b_new_items, as_of(), "seq")


@query("K8_mark_queued", f"""
SELECT p.url, CASE WHEN x.url IS NOT NULL THEN 'queued' ELSE p.assessment_status END AS assessment_status,
  CASE WHEN x.url IS NOT NULL THEN {AS_OF} ELSE p.last_updated END AS last_updated
FROM b_products_full p LEFT JOIN (SELECT DISTINCT url FROM b_extracts) x ON p.url = x.url""")
def mark_queued(v):
    added = v.b_extracts.select(F.col("url").alias("product_url"))
    return review.mark_queued(v.b_products_full.select("url", "assessment_status", "last_updated"),
                              added, as_of())


BINDINGS["b_decided"] = """
SELECT q.id, CASE WHEN q.id % 2 = 0 THEN p.url ELSE concat(p.url, 'q') END AS product_url, q.retailer, q.category, q.review_type, q.review_decision,
  p.title, p.price, CASE WHEN q.id % 3 = 0 THEN NULL ELSE p.p_partkey + 5 END AS shopify_id
FROM b_reviews q JOIN b_products p ON q.id = p.p_partkey WHERE q.review_decision IS NOT NULL AND q.review_type = 'modesty'
"""


@query("J18_decided_products", f"""
SELECT coalesce(p.url, d.product_url) AS url, CASE WHEN p.url IS NOT NULL THEN p.retailer ELSE d.retailer END AS retailer,
  CASE WHEN p.url IS NOT NULL THEN p.title ELSE d.title END AS title,
  CASE WHEN d.id IS NOT NULL THEN CASE WHEN d.review_decision IN ('modest', 'moderately_modest') THEN 'published' ELSE 'draft' END ELSE p.shopify_status END AS shopify_status,
  CASE WHEN d.id IS NOT NULL THEN d.review_decision ELSE p.modesty_status END AS modesty_status,
  CASE WHEN d.id IS NOT NULL THEN CASE WHEN d.review_decision = 'not_modest' THEN 'assessed_rejected' ELSE 'assessed_approved' END ELSE p.lifecycle_stage END AS lifecycle_stage,
  CASE WHEN d.id IS NOT NULL THEN {AS_OF} ELSE p.assessed_at END AS assessed_at,
  CASE WHEN p.url IS NOT NULL THEN p.source ELSE 'web_assessment_backfill' END AS source
FROM b_products_full p FULL OUTER JOIN (SELECT * FROM b_decided WHERE shopify_id IS NOT NULL) d ON p.url = d.product_url""")
def decided(v):
    cols = ["url", "retailer", "title", "shopify_status", "modesty_status", "lifecycle_stage",
            "assessed_at", "source"]
    return review.decided_products(v.b_products_full.select(*cols), v.b_decided, as_of())


@query("J18b_promotions", f"""
SELECT product_url, 'modesty' AS review_type, retailer, category, 'high' AS priority, 'duplicate_review' AS source_workflow, 'pending' AS status, {AS_OF} AS added_at
FROM b_reviews r WHERE review_decision = 'not_duplicate' AND NOT EXISTS (SELECT 1 FROM b_reviews q WHERE q.product_url = r.product_url AND q.review_type = 'modesty')""")
def promoted(v):
    return review.promotions(v.b_reviews, v.b_reviews, as_of())


@query("J20_mark_reviewed", f"""
SELECT id, CASE WHEN id % 7 = 0 THEN 'reviewed' WHEN id % 7 = 1 THEN 'skipped' ELSE status END AS status,
  CASE WHEN id % 7 = 0 THEN 'modest' ELSE review_decision END AS review_decision,
  CASE WHEN id % 7 IN (0, 1) THEN {AS_OF} ELSE reviewed_at END AS reviewed_at FROM b_reviews""")
def mark_reviewed(v):
    reviews = v.b_reviews.filter("id % 7 IN (0, 1)").select(
        "id", F.when(F.col("id") % 7 == 0, "modest").alias("review_decision"),
        F.lit("n").alias("reviewer_notes"), "reviewed_by")
    queue = v.b_reviews.withColumn("reviewer_notes", F.lit(None).cast("string"))
    return review.mark_reviewed(queue, reviews, as_of()).select(
        "id", "status", "review_decision", "reviewed_at")


@query("J20_cascade_assessed", f"""
WITH u AS (SELECT DISTINCT product_url FROM b_decided WHERE review_decision <> 'not_modest')
SELECT p.url, CASE WHEN u.product_url IS NOT NULL THEN 'assessed' ELSE p.assessment_status END AS assessment_status,
  CASE WHEN u.product_url IS NOT NULL THEN {AS_OF} ELSE p.last_updated END AS last_updated
FROM b_products_full p LEFT JOIN u ON p.url = u.product_url""")
def cascade(v):
    reviews = v.b_decided.select("id", F.when(
        F.col("review_decision") != "not_modest", F.col("review_decision")).alias("review_decision"))
    return review.cascade_assessed(
        v.b_products_full.select("url", "assessment_status", "last_updated"), v.b_decided,
        reviews, as_of())


@query("F16_review_rows", """
SELECT id, retailer, title, CAST(price AS STRING) AS price, shopify_id, 1.0::DOUBLE AS confidence_score, 'unknown' AS clothing_type, '' AS brand,
  CASE WHEN id % 4 = 0 THEN concat('cdn', id) WHEN id % 4 = 1 THEN concat('img', id) ELSE '' END AS display_images FROM
  (SELECT id, retailer, CASE WHEN id % 5 = 0 THEN 'N/A' ELSE concat('item ', id) END AS title, id * 3 AS price, CASE WHEN id % 3 = 0 THEN id ELSE NULL END AS shopify_id FROM b_queue)""")
def review_rows(v):
    i = F.col("id")

    def list_of(prefix):
        return F.array(F.concat(F.lit(prefix), i))

    data = F.to_json(F.struct(
        F.when(i % 5 != 0, F.concat(F.lit("item "), i)).alias("title"), (i * 3).alias("price"),
        F.when(i % 3 == 0, i).alias("shopify_id"),
        F.when(i % 4 == 0, list_of("cdn")).otherwise(F.array().cast("array<string>"))
        .alias("shopify_image_urls"),
        F.when(i % 4 == 1, list_of("img")).alias("image_urls")))
    rows = v.b_queue.withColumn("product_data", data)
    return review.review_rows(rows).select(
        "id", "retailer", "title", "price", "shopify_id", "confidence_score", "clothing_type",
        "brand", F.array_join("display_images", ",").alias("display_images"))


# --- profiles ----------------------------------------------------------------------------

def pct(part, whole):
    return f"((100.0 * {part}) / {whole})::DECIMAL(18,1)::DOUBLE"


@query("A12_queue_statistics", f"""
SELECT review_type, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'reviewed') AS reviewed,
  count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'pending' AND priority = 'high') AS high_priority,
  count(*) FILTER (reviewed_at >= {AS_OF} - INTERVAL 1 DAY) AS reviewed_last_24h FROM b_queue GROUP BY ROLLUP (review_type)""")
def queue_statistics(v):
    return profiles.queue_statistics(v.b_queue, as_of())


@query("A13_dashboard", """
SELECT count(*) FILTER (status = 'pending') AS total_pending, count(*) FILTER (status = 'pending' AND review_type = 'modesty') AS pending_modesty,
  count(*) FILTER (status = 'pending' AND review_type = 'duplication') AS pending_duplication,
  count(*) FILTER (status = 'reviewed' AND CAST(reviewed_at AS DATE) = DATE '1996-05-05') AS approved_today,
  count(*) FILTER (status = 'reviewed') AS total_processed, count(*) FILTER (status = 'pending' AND priority = 'high') AS high_priority FROM b_queue""")
def dashboard(v):
    return profiles.dashboard(v.b_queue, as_of("1996-05-05 12:00:00"))


@query("A14_pending_by_retailer", "SELECT retailer, count(*) AS n FROM b_queue WHERE status = 'pending' GROUP BY ALL")
def pending_retailer(v):
    return profiles.pending_by(v.b_queue, "retailer")


@query("A14_pending_by_type", "SELECT review_type, count(*) AS n FROM b_queue WHERE status = 'pending' GROUP BY ALL")
def pending_type(v):
    return profiles.pending_by(v.b_queue, "review_type")


@query("A15_lifecycle_distribution", f"""
SELECT lifecycle_stage, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM b_products_full)')} AS percentage FROM b_products_full GROUP BY ALL""")
def lifecycle_distribution(v):
    return profiles.distribution(v.b_products_full, "lifecycle_stage")


@query("A16_assessment_rate", f"""
WITH a AS (SELECT * FROM b_products_full WHERE lifecycle_stage IN ('assessed_approved', 'assessed_rejected'))
SELECT lifecycle_stage, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM a)')} AS percentage FROM a GROUP BY ALL""")
def assessment_rate(v):
    return profiles.assessment_rate(v.b_products_full)


@query("A17_lifecycle_completeness", """
SELECT lifecycle_stage, data_completeness, count(*) AS n FROM b_products_full WHERE lifecycle_stage IS NOT NULL GROUP BY ALL""")
def cross_tab(v):
    return profiles.profile(v.b_products_full.filter("lifecycle_stage IS NOT NULL"),
                            "lifecycle_stage", "data_completeness")


@query("A18_throughput", """
SELECT CAST(assessed_at AS DATE) AS day, count(*) AS n FROM b_products_full WHERE assessed_at IS NOT NULL GROUP BY ALL""")
def throughput(v):
    return profiles.throughput(v.b_products_full)


PROFILED = ["last_workflow", "source", "shopify_status", "lifecycle_stage"]


@query("A19_profiles", " UNION ALL ".join(
    f"SELECT '{c}' AS profile, {c} AS value, count(*) AS n, max(assessed_at) AS latest FROM b_products_full GROUP BY {c}"
    for c in PROFILED) + """
UNION ALL SELECT 'scan_type', scan_type, count(*), NULL FROM b_snapshots GROUP BY scan_type""")
def profile_set(v):
    out = None
    for c in PROFILED:
        rows = profiles.profile(v.b_products_full, c, latest="assessed_at").select(
            F.lit(c).alias("profile"), F.col(c).alias("value"), "n", "latest")
        out = rows if out is None else out.unionByName(rows)
    scans = profiles.profile(v.b_snapshots, "scan_type").select(
        F.lit("scan_type").alias("profile"), F.col("scan_type").alias("value"), "n",
        F.lit(None).cast("timestamp_ntz").alias("latest"))
    return out.unionByName(scans)


@query("A19_awaiting_and_imported", """
SELECT retailer, count(*) FILTER (lifecycle_stage = 'imported_direct') AS imported_direct, count(*) FILTER (lifecycle_stage = 'pending_assessment') AS pending_assessment, count(*) AS processed
FROM b_products_full GROUP BY ALL""")
def awaiting(v):
    return profiles.run_counters(v.b_products_full, "retailer", "lifecycle_stage",
                                 ["imported_direct", "pending_assessment"])


@query("A21_image_coverage", f"""
SELECT count(*) AS total, count(*) FILTER (image_csv <> '') AS with_images, {pct("count(*) FILTER (image_csv <> '')", 'count(*)')} AS percentage FROM b_listings""")
def image_coverage(v):
    return profiles.image_coverage(with_images(v.b_listings))


@query("A22_snapshot_vs_new", """
SELECT (SELECT count(*) FROM b_snapshots WHERE scan_type = 'monitor' AND discovered_date >= DATE '1997-01-01') AS snapshots,
  (SELECT count(*) FROM b_products_full WHERE source = 'monitor' AND first_seen >= TIMESTAMP '1997-01-01') AS new_products""")
def snapshot_vs_new(v):
    return profiles.snapshot_vs_new(v.b_snapshots, v.b_products_full, as_of("1997-01-01 00:00:00"))


@query("A26_domain_audit", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {e} AS value, count(*) AS n FROM b_audited WHERE {e} NOT IN ({', '.join(repr(x) for x in DOMAINS[c])}) GROUP BY ALL"
    for c, e in (("lifecycle_stage", "lifecycle_stage"), ("shopify_status", "shopify_status"),
                 ("data_completeness", "data_completeness"))))
def domain_audit(v):
    return profiles.domain_audit(v.b_audited, ["lifecycle_stage", "shopify_status",
                                               "data_completeness"])


BINDINGS["b_audited"] = """
SELECT CASE WHEN p_partkey % 10 = 0 THEN 'approved' ELSE lifecycle_stage END AS lifecycle_stage,
  CASE WHEN p_partkey % 15 = 0 THEN 'live' ELSE shopify_status END AS shopify_status, data_completeness FROM b_products_full
"""

BINDINGS["b_marked_snapshots"] = """
SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 11 = 0 THEN concat('https://q.example.com/', CAST(o.o_orderkey - o.o_orderkey % 2 AS STRING)) ELSE concat('https://o.example.com/', CAST(o.o_orderkey AS STRING)) END AS catalog_url,
  lower(c.c_mktsegment) AS retailer, CASE WHEN o.o_orderkey % 2 = 0 THEN 'baseline' ELSE 'pending' END AS review_status FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""


OVERLAP = """
SELECT q.retailer, count(*) AS overlap FROM b_queue q JOIN b_marked_snapshots s ON q.product_url = s.catalog_url
WHERE q.status = 'pending' AND s.review_status = 'baseline' GROUP BY ALL"""


@query("J13_baseline_overlap", OVERLAP)
def overlap(v):
    return profiles.baseline_overlap(v.b_queue, v.b_marked_snapshots)


@query("J19_sync_difference", """
WITH c AS (SELECT (SELECT count(*) FROM b_queue WHERE status = 'pending' AND id % 3 <> 0) AS local_pending, (SELECT count(*) FROM b_queue WHERE status = 'pending') AS remote_pending,
 (SELECT count(*) FROM b_products_full WHERE lifecycle_stage IN ('assessed_approved', 'assessed_rejected') AND assessed_at < TIMESTAMP '2001-06-01') AS local_assessed,
 (SELECT count(*) FROM b_products_full WHERE lifecycle_stage IN ('assessed_approved', 'assessed_rejected') AND assessed_at IS NOT NULL) AS remote_assessed)
SELECT *, remote_pending - local_pending AS pending_difference, remote_assessed - local_assessed AS assessed_difference FROM c""")
def sync_difference(v):
    local = v.b_products_full.withColumn("assessed_at", F.when(
        F.col("assessed_at") < as_of("2001-06-01 00:00:00"), F.col("assessed_at")))
    return profiles.sync_difference(v.b_queue.filter("id % 3 <> 0"), v.b_queue, local,
                                    v.b_products_full)


@query("A34_new_product_digest", """
SELECT retailer, count(*) AS n, string_agg(DISTINCT category, ', ' ORDER BY category) AS categories FROM b_reviews WHERE status = 'pending' GROUP BY ALL""")
def digest(v):
    return profiles.new_product_digest(v.b_reviews.filter("status = 'pending'"))


@query("A35_backlog_digest", """
SELECT retailer, count(*) AS pending, count(*) FILTER (price < 20000) AS low_confidence, date_diff('day', CAST(min(added_at) AS DATE), DATE '2001-12-01') AS oldest_pending_days
FROM b_queue WHERE status = 'pending' GROUP BY ALL""")
def backlog(v):
    scored = v.b_queue.withColumn("confidence_score", F.col("price") / 40000.0)
    return profiles.backlog_digest(scored, as_of())


RUNS = """
WITH r AS (SELECT retailer AS batch_id, count(*) AS total, count(*) FILTER (success) AS successful, min(attempted_at) AS start_time, max(attempted_at) AS end_time FROM b_attempts GROUP BY ALL)
"""


@query("A36_batch_digest", RUNS + """
SELECT batch_id, total, successful, round(successful * 100.0::DOUBLE / total, 6) AS success_rate, round((floor(epoch(end_time)) - floor(epoch(start_time))) / 60.0, 6) AS minutes FROM r""")
def batch_digest(v):
    runs = v.b_attempts.groupBy(F.col("retailer").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"),
        F.min("attempted_at").alias("start_time"), F.max("attempted_at").alias("end_time"))
    return profiles.batch_digest(runs).withColumns(
        {c: F.round(c, 6) for c in ("success_rate", "minutes")})


@query("A28_run_counters", """
SELECT retailer, count(*) AS processed, count(*) FILTER (method = 'view') AS view, count(*) FILTER (method = 'click') AS click, count(*) FILTER (method = 'error') AS error FROM b_attempts GROUP BY ALL""")
def run_counters(v):
    return profiles.run_counters(v.b_attempts, "retailer", "method", ["view", "click", "error"])


@query("A37_failure_counts", """
WITH f AS (SELECT page_type AS workflow, method AS stage, CASE WHEN seq % 2 = 0 THEN 'uncertain' ELSE 'known_error' END AS certainty FROM b_attempts)
SELECT workflow, stage, certainty, count(*) AS n, grouping(workflow) * 4 + grouping(stage) * 2 + grouping(certainty) AS level FROM f GROUP BY CUBE (workflow, stage, certainty)""")
def failure_counts(v):
    rows = v.b_attempts.select(
        F.col("page_type").alias("workflow"), F.col("method").alias("stage"),
        F.when(F.col("seq") % 2 == 0, "uncertain").otherwise("known_error").alias("certainty"))
    return profiles.failure_counts(rows)


@query("A38_queue_red_flags", f"""
WITH d AS (SELECT retailer, CAST(added_at AS DATE) AS d, count(*) AS k, count(*) FILTER (source_workflow <> 'migration_from_catalog_products') AS fresh FROM b_reviews WHERE status = 'pending' GROUP BY ALL),
q AS (SELECT retailer, sum(k)::BIGINT AS pending, max(k) AS per_day, sum(fresh)::BIGINT AS fresh FROM d GROUP BY ALL),
m AS (SELECT retailer, count(*) AS monitored FROM b_reviews WHERE source_workflow = 'baseline_scan' AND retailer <> 'building' GROUP BY ALL),
b AS (SELECT retailer, count(*) AS baseline FROM b_marked_snapshots WHERE review_status = 'baseline' GROUP BY ALL), o AS ({OVERLAP}),
j AS (SELECT q.*, coalesce(monitored, 0) AS monitored, coalesce(baseline, 0) AS baseline, coalesce(overlap, 0) AS overlap FROM q LEFT JOIN m USING (retailer) LEFT JOIN b USING (retailer) LEFT JOIN o USING (retailer))
SELECT retailer, pending, per_day, concat_ws(',', CASE WHEN monitored = 0 THEN 'no_monitored_products' END, CASE WHEN fresh = 0 THEN 'only_migration_source' END,
  CASE WHEN overlap > 0 THEN 'baseline_overlap' END, CASE WHEN per_day > 20 THEN 'over_20_per_day' END, CASE WHEN pending > 50 THEN 'over_50_total' END,
  CASE WHEN pending > baseline * 0.1 THEN 'over_10_percent_of_baseline' END) AS flags FROM j""")
def red_flags(v):
    products = v.b_reviews.filter("retailer <> 'building'").select("retailer", F.when(
        F.col("source_workflow") == "baseline_scan", "monitor").alias("source"))
    return profiles.queue_red_flags(v.b_reviews, products, v.b_marked_snapshots).select(
        "retailer", "pending", "per_day", "flags")


@query("A39_baseline_image_audit", """
SELECT retailer, count(*) FILTER (image_csv <> '') AS images_extracted, count(*) FILTER (image_csv = '') AS images_missing,
  (count(*) FILTER (image_csv = '') > 0 AND count(*) FILTER (image_csv = '') > count(*) FILTER (image_csv <> '') * 0.5) AS warning FROM b_listings GROUP BY ALL""")
def image_audit(v):
    return profiles.baseline_image_audit(with_images(v.b_listings))


@query("A40_distinct_retailers", "SELECT DISTINCT retailer FROM b_snapshots")
def retailers(v):
    return v.b_snapshots.select("retailer").distinct()


@query("S10_point_lookup", "SELECT url, title, price FROM b_products WHERE p_partkey = 77")
def lookup(v):
    return v.b_products.filter("p_partkey = 77").select("url", "title", "price")


@query("S7_scan_products", "SELECT url, retailer, title, price, product_code, clothing_type, stock_status, sale_status, lifecycle_stage FROM b_products")
def scan(v):
    return v.b_products.drop("p_partkey", "shopify_id")
