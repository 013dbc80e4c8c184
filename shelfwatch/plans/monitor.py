"""Whole runs built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.operators import changes, linking, patterns, profiles, quality, review
from shelfwatch.schemas import DOMAINS


def monitor_report(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Changed prices and new listings of each retailer's latest run date."""
    newest = listings.groupBy("retailer").agg(F.max("discovered_date").alias("discovered_date"))
    latest = listings.join(newest, ["retailer", "discovered_date"])
    as_of = F.col("discovered_date").cast("timestamp_ntz")
    changes = linking.price_changes(latest, products, as_of).select(
        "retailer", F.lit("price_change").alias("finding"), F.col("product_url").alias("url"),
        "title", F.col("products_price").alias("old_price"),
        F.col("catalog_price").alias("new_price"), "priority", "detected_at")
    fresh = (linking.classify_listings(latest, products)
             .filter(F.col("status") != "confirmed_existing")
             .select("retailer", F.col("status").alias("finding"),
                     F.col("catalog_url").alias("url"), "title",
                     F.lit(None).cast("double").alias("old_price"),
                     F.col("price").alias("new_price"), F.lit("normal").alias("priority"),
                     as_of.alias("detected_at")))
    return changes.unionByName(fresh)


def new_items(found: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """(review items, drafts) of classified listings.

    New listings go to the modesty review with normal priority, suspected duplicates to the duplicate review with low
    priority. Where the garment type is known, one retailer's new listings of other types become drafts instead.
    """
    suspect = F.col("status") == "suspected_duplicate"
    route = F.lit("assessment")
    if "clothing_type" in found.columns:
        route = F.when(suspect, "assessment").otherwise(quality.assessment_route(F.col("retailer"), F.col("clothing_type")))
    rows = found.filter(F.col("status") != "confirmed_existing").withColumn("route", route)
    items = rows.filter("route = 'assessment'").select(
        seq, F.col("catalog_url").alias("product_url"), "retailer",
        F.when(suspect, "duplication").otherwise("modesty").alias("review_type"),
        F.when(suspect, "low").otherwise("normal").alias("priority"),
        F.lit("catalog_monitor").alias("source_workflow"), F.col("matched_url").alias("suspected_match"))
    return items, rows.filter("route = 'draft'").drop("route")


def monitor_run(listings: DataFrame, products: DataFrame, queue: DataFrame, category, as_of,
                seq: str, history: DataFrame | None = None) -> dict[str, DataFrame]:
    """All outputs of one monitor run: snapshot, price changes, queue items, drafts, counters."""
    rows = linking.unify_fields(listings)
    found = linking.classify_listings(rows, products, history)
    items, drafts = new_items(found, seq)
    return {
        "snapshot": changes.snapshot_rows(rows, category, as_of),
        "price_changes": linking.price_changes(rows, products, as_of),
        "queue_items": review.add_to_queue(queue, items, as_of, seq),
        "drafts": drafts,
        "counters": profiles.run_counters(found, "retailer", "status", DOMAINS["match_status"]),
    }


def update_run(products: DataFrame, extracts: DataFrame, as_of) -> dict[str, DataFrame]:
    """All outputs of one refresh: next product version, counters, failure records."""
    outcomes = changes.update_outcomes(extracts, products)
    applied = outcomes.filter(~F.col("action").isin("failed", "not_found"))
    return {
        "products": changes.apply_updates(products, applied, as_of),
        "counters": profiles.run_counters(outcomes, "retailer", "action", DOMAINS["action"]),
        "failures": changes.failures(outcomes),
    }


def backfill_run(snapshots: DataFrame, products: DataFrame,
                 policy: DataFrame | None = None) -> dict[str, DataFrame]:
    """History linked to products, with the statistics and retailer policy learned from it."""
    links = linking.backfill_links(snapshots, products, policy)
    return {"links": links, "statistics": patterns.linking_statistics(links),
            "patterns": patterns.retailer_patterns(links)}
