"""Learning and cost analytics over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries.base import BINDINGS, events_as_of, query
from shelfwatch.functions import text as X
from shelfwatch.functions import urls as U
from shelfwatch.operators import learning, ordered, review


def six(df, *cols):
    """Derived doubles at six digits, as both engines round them alike there."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


FOLD = """
WITH f AS (SELECT retailer, count(*) AS n, count(*) FILTER (url_changed) AS ch, min({'seq': seq, 'm': method, 'c': confidence}) AS f,
  max({'c': confidence, 'o': -seq, 'm': method}) FILTER (success) AS b FROM b_attempts GROUP BY ALL)
SELECT retailer, n AS sample_size, ch AS url_changes_detected, round(1.0 - ch / n, 6) AS url_stability_score,
  CASE WHEN coalesce(b.c > f.c, false) THEN b.m ELSE f.m END AS best_dedup_method,
  CASE WHEN coalesce(b.c > f.c, false) THEN b.c ELSE f.c END AS dedup_confidence_threshold FROM f"""


@query("A3_fold_linking_attempts", FOLD)
def fold(v):
    return six(learning.fold_linking_attempts(v.b_attempts), "url_stability_score")


@query("A3_fold_onto_prior", """
WITH p AS (SELECT retailer, count(*) AS n0, count(*) FILTER (url_changed) AS c0, min({'s': seq, 'm': method}).m AS m0, 0.75 AS t0 FROM b_attempts WHERE seq % 2 = 0 GROUP BY ALL),
f AS (SELECT retailer, count(*) AS n, count(*) FILTER (url_changed) AS ch, max({'c': confidence, 'o': -seq, 'm': method}) FILTER (success) AS b FROM b_attempts WHERE seq % 2 = 1 GROUP BY ALL)
SELECT retailer, n + n0 AS sample_size, ch + c0 AS url_changes_detected, round(1.0 - (ch + c0) / (n + n0), 6) AS url_stability_score,
  CASE WHEN b.c > t0 THEN b.m ELSE m0 END AS best_dedup_method, CASE WHEN b.c > t0 THEN b.c ELSE t0 END::DOUBLE AS dedup_confidence_threshold FROM p JOIN f USING (retailer)""")
def fold_prior(v):
    prior = v.b_attempts.filter("seq % 2 = 0").groupBy("retailer").agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.count_if("url_changed").alias("url_changes_detected"),
        F.min_by("method", "seq").alias("best_dedup_method"),
        F.lit(0.75).alias("dedup_confidence_threshold"))
    return six(learning.fold_linking_attempts(v.b_attempts.filter("seq % 2 = 1"), prior),
               "url_stability_score")


@query("A3b_retailer_policy", FOLD + " WHERE retailer = 'r3'")
def policy(v):
    return six(learning.fold_linking_attempts(v.b_attempts).filter("retailer = 'r3'"),
               "url_stability_score")


COUNTERS = """
WITH c AS (SELECT retailer, page_type, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS failure_count, count(*) AS total_attempts,
  max(attempted_at) AS last_used, concat(retailer, '_', page_type) AS pattern_name,
  round(CASE WHEN count(*) = 1 THEN 0.0 ELSE count(*) FILTER (success) / count(*) END, 6)::DOUBLE AS success_rate FROM b_attempts GROUP BY ALL)
"""


@query("A4_pattern_counters", COUNTERS + "SELECT * FROM c")
def counters(v):
    return six(learning.pattern_counters(v.b_attempts), "success_rate")


@query("A5_pattern_totals", COUNTERS + """
SELECT count(*) AS total_patterns, sum(success_count)::BIGINT AS total_successes, sum(failure_count)::BIGINT AS total_failures, round(avg(success_count / total_attempts), 6) AS avg_success_rate FROM c""")
def totals(v):
    return six(learning.pattern_totals(learning.pattern_counters(v.b_attempts)), "avg_success_rate")


@query("A6_failing_patterns", COUNTERS + """
SELECT retailer, page_type, total_attempts, success_rate FROM c WHERE total_attempts >= 5 AND success_count / total_attempts <= 0.8""")
def failing(v):
    out = learning.failing_patterns(learning.pattern_counters(v.b_attempts), 5, 0.8)
    return six(out.select("retailer", "page_type", "total_attempts", "success_rate"),
               "success_rate")


@query("A7_common_errors", """
SELECT errors, count(*) AS n FROM b_attempts WHERE NOT success AND page_type = 'catalog' GROUP BY errors ORDER BY n DESC, errors LIMIT 3""")
def errors(v):
    return learning.common_errors(v.b_attempts, page_type="catalog", limit=3)


LAST50 = """
WITH l AS (SELECT * FROM b_attempts QUALIFY row_number() OVER (PARTITION BY retailer, page_type ORDER BY attempted_at DESC, seq DESC) <= 50)
"""


@query("W5_recent_attempts", LAST50 + "SELECT seq, retailer, page_type, method FROM l")
def recent(v):
    return ordered.recent_attempts(v.b_attempts).select("seq", "retailer", "page_type", "method")


@query("A8_best_extractor", LAST50 + """,
r AS (SELECT retailer, page_type, method, count(*) FILTER (success) / count(*) AS rate FROM l GROUP BY ALL)
SELECT retailer, page_type, CASE WHEN max(rate) > 0 THEN min({'r': -rate, 'm': method}).m ELSE 'deepseek_v3' END AS best_extractor FROM r GROUP BY ALL""")
def best(v):
    return learning.best_extractor(v.b_attempts)


@query("A9_extractor_statistics", """
SELECT retailer, method, count(*) AS total, count(*) FILTER (success) AS successes, round(sum(processing_time::DECIMAL(28,6))::DOUBLE / count(*), 6) AS avg_time FROM b_attempts GROUP BY ALL""")
def extractor_stats(v):
    return six(learning.extractor_statistics(v.b_attempts, "retailer", "method"), "avg_time")


@query("A9_extractor_statistics_by_type", """
SELECT method, page_type, count(*) AS total, count(*) FILTER (success) AS successes, round(sum(processing_time::DECIMAL(28,6))::DOUBLE / count(*), 6) AS avg_time FROM b_attempts WHERE retailer = 'r1' GROUP BY ALL""")
def extractor_stats_type(v):
    rows = v.b_attempts.filter("retailer = 'r1'")
    return six(learning.extractor_statistics(rows, "method", "page_type"), "avg_time")


BINDINGS["b_calls"] = """
SELECT seq, attempted_at, retailer, method, success, cost, CAST(seq % 900 AS BIGINT) AS tokens_used,
  concat('Extract from https://x.example.com/', CAST(seq AS STRING), ' item ', CAST(1000000 + seq AS STRING), ' code AB', CAST(seq % 13 AS STRING), ' group ', method, ' of ', retailer, ' ') AS prompt FROM b_attempts
"""

TRACK = """
WITH h AS (SELECT *, md5(trim(lower(concat('Extract from [URL] item [ID] code [CODE] group ', method, ' of ', retailer, ' ')))) AS prompt_hash FROM b_calls),
f AS (SELECT prompt_hash, min({'t': attempted_at, 's': seq}) AS f FROM h WHERE success GROUP BY ALL),
t AS (SELECT h.*, coalesce({'t': h.attempted_at, 's': h.seq} > f.f, false) AS response_cached FROM h LEFT JOIN f USING (prompt_hash))
"""


@query("A41_tracked_calls", TRACK + "SELECT seq, prompt_hash, response_cached FROM t")
def tracked(v):
    return learning.track_calls(v.b_calls).select("seq", "prompt_hash", "response_cached")


@query("A41_cache_usage", TRACK + """
SELECT prompt_hash, count(*) FILTER (response_cached) + 1 AS usage_count FROM t GROUP BY prompt_hash HAVING bool_or(success)""")
def usage(v):
    return learning.cache_usage(learning.track_calls(v.b_calls))


@query("X9_prompt_key", """
SELECT seq, trim(lower(concat('Extract from [URL] item [ID] code [CODE] group ', method, ' of ', retailer, ' '))) AS prompt_key, 'extraction' AS category FROM b_calls""")
def prompt_keys(v):
    return v.b_calls.select("seq", X.prompt_key(F.col("prompt")).alias("prompt_key"),
                            X.prompt_category(F.col("prompt")).alias("category"))


@query("X10_prompt_category", """
SELECT doc_id, CASE WHEN contains(lower(text), 'extract from') THEN 'extraction' WHEN contains(lower(text), 'screenshot') THEN 'screenshot' ELSE 'other' END AS category FROM documents""")
def categories(v):
    return v.documents.select("doc_id", X.prompt_category(F.col("text")).alias("category"))


SUMMARY = TRACK + """,
w AS (SELECT * FROM t WHERE attempted_at > TIMESTAMP '2024-02-01' - INTERVAL 15 DAY),
g AS (SELECT CASE WHEN grouping(method) + grouping(retailer) = 2 THEN 'all' WHEN grouping(method) = 0 THEN 'method' ELSE 'retailer' END AS breakdown, method, retailer,
  count(*) AS total_calls, count(*) FILTER (success) AS successful_calls, count(*) FILTER (response_cached) AS cached_calls, sum(cost::DECIMAL(28,6))::DOUBLE AS total_cost,
  coalesce(sum((tokens_used / 1000 * 0.002)::DECIMAL(28,6)) FILTER (response_cached), 0)::DOUBLE AS cache_savings FROM w GROUP BY GROUPING SETS ((), (method), (retailer))),
s AS (SELECT breakdown, method, retailer, total_calls, successful_calls, cached_calls, round(total_cost, 6) AS total_cost, round(successful_calls / total_calls, 6) AS success_rate,
  round(cached_calls / total_calls, 6) AS cache_hit_rate, round(coalesce(total_cost / nullif(successful_calls, 0), 0), 6) AS cost_per_success, round(total_cost / total_calls, 6) AS average_cost_per_call FROM g)
"""


@query("A10_cost_summary", SUMMARY + "SELECT * FROM s")
def cost(v):
    out = learning.cost_summary(learning.track_calls(v.b_calls), events_as_of(), 15)
    return six(out.drop("cache_savings"), "total_cost", "success_rate", "cache_hit_rate",
               "cost_per_success", "average_cost_per_call")


@query("A11_recommendations", SUMMARY + """
SELECT breakdown, method, 'low_cache_hit_rate' AS recommendation FROM s WHERE breakdown = 'all' AND cache_hit_rate < 0.3 UNION ALL
SELECT breakdown, method, 'low_success_rate' FROM s WHERE breakdown = 'all' AND success_rate < 0.85 UNION ALL
SELECT breakdown, method, 'high_cost_per_success' FROM s WHERE breakdown = 'all' AND cost_per_success > 0.01 UNION ALL
SELECT breakdown, method, 'method_needs_tuning' FROM s WHERE breakdown = 'method' AND success_rate < 0.7 AND total_calls > 5""")
def advice(v):
    return learning.recommendations(
        learning.cost_summary(learning.track_calls(v.b_calls), events_as_of(), 15))


@query("A23_download_statistics", """
SELECT retailer, regexp_extract(regexp_replace(catalog_url, '^https?://', ''), '^([^/]+(/[^/]+)?)', 1) AS url_pattern,
  count(*) FILTER (price > 1000) AS download_success, count(*) FILTER (NOT price > 1000) AS download_failure FROM b_snapshots GROUP BY ALL""")
def downloads(v):
    return learning.download_statistics(v.b_snapshots.select(
        "retailer", F.col("catalog_url").alias("url"), (F.col("price") > 1000).alias("success")))


@query("X12_url_pattern", """
SELECT page_id, regexp_extract(regexp_replace(url, '^https?://', ''), '^([^/]+(/[^/]+)?)', 1) AS url_pattern FROM pages""")
def pattern(v):
    return v.pages.select("page_id", U.url_pattern(F.col("url")).alias("url_pattern"))


@query("X12_pattern_without_host", """
SELECT page_id, substring(concat('/', regexp_replace(url, '^https?://', ''), '/', url), 1, 100) AS url_pattern FROM pages""")
def pattern_without_host(v):
    """Links that begin with a slash after the scheme: the fixed prefix takes the place of host and segment."""
    bare = F.regexp_replace("url", "^https?://", "")
    link = F.concat(F.lit("https:///"), bare, F.lit("/"), "url")
    return v.pages.select("page_id", U.url_pattern(link).alias("url_pattern"))


@query("A24_fetch_usage", """
SELECT retailer, count(*) AS requests, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, sum(cost::DECIMAL(28,6))::DOUBLE AS cost, sum(seq * 10)::BIGINT AS bytes,
  round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(sum(cost::DECIMAL(28,6))::DOUBLE / count(*), 6) AS avg_cost FROM b_attempts GROUP BY ROLLUP (retailer)""")
def fetches(v):
    rows = v.b_attempts.withColumn("bytes", F.col("seq") * 10)
    return six(learning.fetch_usage(rows), "success_rate", "avg_cost")


@query("A25_cache_statistics", """
SELECT count(*) AS total_entries, sum(length(html))::BIGINT AS total_chars, 75.0::DOUBLE AS hit_rate FROM pages""")
def cache_stats(v):
    return learning.cache_statistics(v.pages, 30, 10)


@query("A25_most_used_pages", "SELECT url, page_id % 17 AS accessed_count FROM pages ORDER BY accessed_count DESC, url LIMIT 5")
def most_used(v):
    return learning.most_used_pages(v.pages.select(
        "url", (F.col("page_id") % 17).alias("accessed_count")))


@query("A27_call_statistics", """
SELECT count(*) AS total_calls, count(*) FILTER (success) AS successful_calls, count(*) FILTER (NOT success) AS failed_calls, round(count(*) FILTER (success) / count(*) * 100, 6) AS success_rate,
  sum(cost::DECIMAL(28,6))::DOUBLE AS total_cost, round(sum(cost::DECIMAL(28,6))::DOUBLE / count(*), 6) AS avg_cost_per_call FROM b_attempts""")
def call_stats(v):
    return six(learning.call_statistics(v.b_attempts), "success_rate", "avg_cost_per_call")


@query("T4_recent_attempts", "SELECT retailer, page_type, success, attempted_at FROM b_attempts ORDER BY attempted_at DESC, seq LIMIT 10")
def recent_ten(v):
    return review.most_recent(v.b_attempts, "attempted_at", "seq").select(
        "retailer", "page_type", "success", "attempted_at")


@query("T5_placeholder_patterns", """
WITH d AS (SELECT retailer, props AS pattern, count(*) AS detection_count FROM b_attempts GROUP BY ALL)
SELECT retailer, pattern, detection_count, row_number() OVER (PARTITION BY retailer ORDER BY detection_count DESC, pattern) AS rank FROM d QUALIFY rank <= 20""")
def placeholders(v):
    d = v.b_attempts.groupBy("retailer", F.col("props").alias("pattern")).agg(
        F.count(F.lit(1)).alias("detection_count"))
    return learning.placeholder_patterns(d)
