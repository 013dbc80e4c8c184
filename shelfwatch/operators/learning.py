"""What the attempt, call and download logs teach.

Each rule of the form "for every attempt in order, update a counter" is an
aggregate here; order only matters through the first row and through running
maxima, and both have closed forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.text import prompt_hash
from shelfwatch.functions.urls import url_pattern
from shelfwatch.operators.ordered import recent_attempts, top_per_key

# Default extractor, assumed price per thousand tokens.
DEFAULT_EXTRACTOR = "deepseek_v3"
TOKEN_PRICE = 0.002


def money(c: Column) -> Column:
    """Exact sum of a double column, back as a double."""
    return F.sum(c.cast("decimal(28,6)")).cast("double")


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def fold_linking_attempts(attempts: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Retailer policy after all attempts, as if folded one by one in ``seq`` order.

    Without a prior state the first attempt sets method and threshold whether
    it succeeded or not; after that a successful attempt takes over when its
    confidence is strictly above the threshold. The best row is therefore the
    maximum by confidence, the earlier one on ties, among the first row (or the
    prior state) and all successful rows.
    """
    per = attempts.groupBy("retailer").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("url_changed").alias("changes"),
        F.min(F.struct("seq", "method", "confidence")).alias("first"),
        F.max(F.when(F.col("success"), F.struct(
            "confidence", (-F.col("seq")).alias("order"), "method"))).alias("best"))
    if prior is not None:
        state = prior.select("retailer", F.col("sample_size").alias("n0"),
                             F.col("url_changes_detected").alias("c0"),
                             F.col("best_dedup_method").alias("m0"),
                             F.col("dedup_confidence_threshold").alias("t0"))
        per = per.join(state, "retailer", "full_outer")
    else:
        per = per.withColumns({"n0": F.lit(None).cast("long"), "c0": F.lit(None).cast("long"),
                               "m0": F.lit(None).cast("string"),
                               "t0": F.lit(None).cast("double")})
    known = F.col("n0").isNotNull()
    start_method = F.when(known, F.col("m0")).otherwise(F.col("first.method"))
    start_level = F.when(known, F.col("t0")).otherwise(F.col("first.confidence"))
    wins = F.coalesce(F.col("best.confidence") > start_level, F.lit(False))
    n = F.coalesce("n", F.lit(0)) + F.coalesce("n0", F.lit(0))
    changed = F.coalesce("changes", F.lit(0)) + F.coalesce("c0", F.lit(0))
    return per.select(
        "retailer", n.alias("sample_size"), changed.alias("url_changes_detected"),
        (1.0 - changed / n).alias("url_stability_score"),
        F.when(wins, F.col("best.method")).otherwise(start_method).alias("best_dedup_method"),
        F.when(wins, F.col("best.confidence")).otherwise(start_level)
        .alias("dedup_confidence_threshold"))


def pattern_counters(attempts: DataFrame, smooth: bool = False) -> DataFrame:
    """Success counters per (retailer, page_type).

    The stored rate is only computed from the second attempt on, so a single
    attempt shows 0.0; ``smooth`` gives the plain rate.
    """
    out = attempts.groupBy("retailer", "page_type").agg(
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"),
        F.count(F.lit(1)).alias("total_attempts"), F.max("attempted_at").alias("last_used"))
    plain = F.col("success_count") / F.col("total_attempts")
    shown = plain if smooth else F.when(F.col("total_attempts") == 1, 0.0).otherwise(plain)
    return out.withColumns({"pattern_name": F.concat_ws("_", "retailer", "page_type"),
                            "success_rate": shown})


def pattern_totals(counters: DataFrame) -> DataFrame:
    return counters.agg(
        F.count(F.lit(1)).alias("total_patterns"),
        F.coalesce(F.sum("success_count"), F.lit(0)).alias("total_successes"),
        F.coalesce(F.sum("failure_count"), F.lit(0)).alias("total_failures"),
        F.coalesce(F.avg("success_rate"), F.lit(0.0)).alias("avg_success_rate"))


def failing_patterns(counters: DataFrame, min_attempts: int = 5,
                     max_rate: float = 0.5) -> DataFrame:
    return counters.filter((F.col("total_attempts") >= min_attempts)
                           & (F.col("success_rate") <= max_rate)).orderBy(
        "success_rate", F.desc("total_attempts"), "pattern_name")


def common_errors(attempts: DataFrame, retailer: str | None = None, page_type: str | None = None,
                  limit: int = 10) -> DataFrame:
    rows = attempts.filter(~F.col("success"))
    for name, value in (("retailer", retailer), ("page_type", page_type)):
        if value:
            rows = rows.filter(F.col(name) == value)
    return (rows.groupBy("errors").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "errors").limit(limit))


def best_extractor(attempts: DataFrame, last: int = 50) -> DataFrame:
    """Extractor with the best success rate over the last attempts per (retailer, page_type)."""
    rates = (recent_attempts(attempts, last).groupBy("retailer", "page_type", "method")
             .agg((F.count_if("success") / F.count(F.lit(1))).alias("rate")))
    best = rates.groupBy("retailer", "page_type").agg(
        F.min(F.struct((-F.col("rate")).alias("r"), "method")).alias("m"))
    return best.select("retailer", "page_type", F.when(F.col("m.r") < 0, F.col("m.method"))
                       .otherwise(F.lit(DEFAULT_EXTRACTOR)).alias("best_extractor"))


def extractor_statistics(attempts: DataFrame, *by: str) -> DataFrame:
    n = F.count(F.lit(1))
    return attempts.groupBy(*by).agg(
        n.alias("total"), F.count_if("success").alias("successes"),
        (money(F.col("processing_time")) / n).alias("avg_time"))


def track_calls(calls: DataFrame) -> DataFrame:
    """Adds ``prompt_hash`` and ``response_cached``.

    A call is served from the cache if an earlier call with the same normalized
    prompt succeeded: that is any call after the first success of its prompt,
    so one minimum per prompt replaces a running window.
    """
    rows = calls.withColumn("prompt_hash", prompt_hash(F.col("prompt")))
    first = rows.filter("success").groupBy("prompt_hash").agg(
        F.min(F.struct("attempted_at", "seq")).alias("_first"))
    return (rows.join(first, "prompt_hash", "left").withColumn(
        "response_cached", F.coalesce(F.struct("attempted_at", "seq") > F.col("_first"),
                                      F.lit(False))).drop("_first"))


def cache_usage(tracked: DataFrame) -> DataFrame:
    """Uses per cached prompt: the first success and every call after it."""
    return (tracked.groupBy("prompt_hash").agg(
        F.max(F.col("success") & ~F.col("response_cached")).alias("stored"),
        F.count_if("response_cached").alias("reused"))
        .filter("stored").select("prompt_hash", (F.col("reused") + 1).alias("usage_count")))


def _recent(calls: DataFrame, as_of: Column, days: int) -> DataFrame:
    return calls.filter(F.col("attempted_at") > as_of - F.expr(f"INTERVAL {days} DAYS"))


def cost_summary(calls: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Totals, per method and per retailer in one pass over the recent calls."""
    n, ok = F.count(F.lit(1)), F.count_if("success")
    cached = F.count_if("response_cached")
    cost = money(F.col("cost"))
    out = (_recent(calls, as_of, days)
           .groupingSets([[], ["method"], ["retailer"]], "method", "retailer")
           .agg(n.alias("total_calls"), ok.alias("successful_calls"),
                cached.alias("cached_calls"), cost.alias("total_cost"),
                money(F.when(F.col("response_cached"), F.col("tokens_used")) / 1000 * TOKEN_PRICE)
                .alias("cache_savings"), F.grouping_id("method", "retailer").alias("level")))
    return out.select(
        F.when(F.col("level") == 3, "all").when(F.col("level") == 1, "method")
        .otherwise("retailer").alias("breakdown"), "method", "retailer", "total_calls",
        "successful_calls", "cached_calls", "total_cost",
        rate(F.col("successful_calls"), F.col("total_calls")).alias("success_rate"),
        rate(F.col("cached_calls"), F.col("total_calls")).alias("cache_hit_rate"),
        rate(F.col("total_cost"), F.col("successful_calls")).alias("cost_per_success"),
        rate(F.col("total_cost"), F.col("total_calls")).alias("average_cost_per_call"),
        F.coalesce("cache_savings", F.lit(0.0)).alias("cache_savings"))


def recommendations(summary: DataFrame) -> DataFrame:
    """Advice rows where a summary row passes a fixed threshold."""
    whole = F.col("breakdown") == "all"
    advice = F.array_compact(F.array(
        F.when(whole & (F.col("cache_hit_rate") < 0.3), F.lit("low_cache_hit_rate")),
        F.when(whole & (F.col("success_rate") < 0.85), F.lit("low_success_rate")),
        F.when(whole & (F.col("cost_per_success") > 0.01), F.lit("high_cost_per_success")),
        F.when((F.col("breakdown") == "method") & (F.col("success_rate") < 0.7)
               & (F.col("total_calls") > 5), F.lit("method_needs_tuning"))))
    return summary.select("breakdown", "method", F.explode(advice).alias("recommendation"))


def download_statistics(downloads: DataFrame) -> DataFrame:
    """Successes and failures per retailer and url pattern."""
    return downloads.groupBy("retailer", url_pattern(F.col("url")).alias("url_pattern")).agg(
        F.count_if("success").alias("download_success"),
        F.count_if(~F.col("success")).alias("download_failure"))


def fetch_usage(fetches: DataFrame) -> DataFrame:
    """Requests, successes, failures, cost and bytes per retailer and overall."""
    n = F.count(F.lit(1))
    out = fetches.rollup("retailer").agg(
        n.alias("requests"), F.count_if("success").alias("successes"),
        F.count_if(~F.col("success")).alias("failures"), money(F.col("cost")).alias("cost"),
        F.sum("bytes").alias("bytes"))
    return out.withColumns({"success_rate": rate(F.col("successes"), F.col("requests")),
                            "avg_cost": rate(F.col("cost"), F.col("requests"))})


def cache_statistics(pages: DataFrame, hits: int = 0, misses: int = 0) -> DataFrame:
    return pages.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.coalesce(F.sum(F.length("html")), F.lit(0)).alias("total_chars"),
        F.lit(hits / max(hits + misses, 1) * 100).alias("hit_rate"))


def most_used_pages(pages: DataFrame, n: int = 5) -> DataFrame:
    return pages.orderBy(F.desc("accessed_count"), "url").limit(n)


def call_statistics(calls: DataFrame) -> DataFrame:
    """Calls, outcomes and cost of a fallback extractor."""
    n, ok, cost = F.count(F.lit(1)), F.count_if("success"), money(F.col("cost"))
    return calls.agg(n.alias("total_calls"), ok.alias("successful_calls"),
                     (n - ok).alias("failed_calls"),
                     (rate(ok, n) * 100).alias("success_rate"),
                     F.coalesce(cost, F.lit(0.0)).alias("total_cost"),
                     rate(cost, n).alias("avg_cost_per_call"))


def placeholder_patterns(detections: DataFrame, n: int = 20) -> DataFrame:
    """Most detected placeholder patterns per retailer."""
    return top_per_key(detections, ["retailer"], [F.desc("detection_count"), F.col("pattern")], n)
