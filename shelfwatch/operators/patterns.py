"""What linking results say about a retailer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ["exact_url", "normalized_url", "product_code", "exact_title_price",
           "fuzzy_title_price"]


def linking_statistics(links: DataFrame) -> DataFrame:
    """Counts per retailer and, in the row without retailer, over all."""
    conf, linked = F.col("link_confidence"), F.col("linked_product_url").isNotNull()
    return links.rollup("retailer").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(linked).alias("linked"),
        F.count_if(conf >= 0.95).alias("high_confidence"),
        F.count_if((conf >= 0.85) & (conf < 0.95)).alias("medium_confidence"),
        F.count_if(~linked).alias("unlinked"),
        *[F.count_if(F.col("link_method") == m).alias(f"by_{m}") for m in METHODS])


def linking_summary(links: DataFrame) -> DataFrame:
    """Count and mean confidence per method."""
    total = F.sum(F.col("link_confidence").cast("decimal(18,6)"))
    n = F.count(F.lit(1))
    return (links.filter(F.col("linked_product_url").isNotNull()).groupBy("link_method")
            .agg(n.alias("n"), (total / n).cast("decimal(18,3)").cast("double")
                 .alias("mean_confidence")))


def retailer_patterns(links: DataFrame) -> DataFrame:
    """URL stability, most used method and mean confidence per retailer.

    The most used method comes from counts per (retailer, method); equal counts
    go to the later name.
    """
    linked = F.col("linked_product_url").isNotNull()
    counted = (links.groupBy("retailer", "link_method").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(linked).alias("hits"),
        F.count_if(linked & (F.col("linked_product_url") != F.col("catalog_url"))).alias("moved"),
        F.sum(F.col("link_confidence").cast("decimal(18,6)")).alias("confidence")))
    hits = F.sum("hits")
    out = (counted.groupBy("retailer").agg(
        F.sum("rows").alias("total"), hits.alias("sample_size"),
        F.sum("moved").alias("url_changes_detected"),
        F.sum("confidence").cast("double").alias("confidence"),
        F.max(F.when(F.col("hits") > 0, F.struct("hits", "link_method")))["link_method"]
        .alias("best_dedup_method"))
        .filter(F.col("sample_size") > 0)
        .withColumn("url_stability_score",
                    1.0 - F.col("url_changes_detected") / F.col("sample_size"))
        .withColumn("dedup_confidence_threshold", F.col("confidence") / F.col("sample_size")))
    note = F.format_string(
        "Initialized from backfill: %d products linked (%.1f%% success rate). "
        "URL stability: %.1f%%. Primary method: %s.",
        F.col("sample_size"), F.col("sample_size") / F.col("total") * 100,
        F.col("url_stability_score") * 100, F.col("best_dedup_method"))
    return out.select("retailer", "url_stability_score", "sample_size",
                      (F.col("url_stability_score") > 0.80).alias("path_stable"),
                      F.lit(True).alias("image_urls_consistent"), "best_dedup_method",
                      "dedup_confidence_threshold", "url_changes_detected", note.alias("notes"))
