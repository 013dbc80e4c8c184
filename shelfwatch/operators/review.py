"""Work selection and the human-review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.operators.changes import publish_status, set_columns
from shelfwatch.operators.ordered import top_per_key

# Review order of the priorities.
PRIORITY_RANK = {"high": 1, "normal": 2, "low": 3}


def priority_rank(priority: Column) -> Column:
    out = None
    for name, rank in PRIORITY_RANK.items():
        out = F.when(priority == name, rank) if out is None else out.when(priority == name, rank)
    return out


def age_days(ts: Column, as_of: Column) -> Column:
    """Age in days, fractions included."""
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))
    return seconds / F.lit(86400.0)


def stage_allowed(stage: Column, strict: bool = False) -> Column:
    """Null-safe exclusion of rejected and unavailable stages.

    The two patterns are wildcard matches in which an underscore stands for any
    character. No canonical stage contains them; ``strict`` also drops rows
    whose assessment rejected them.
    """
    keep = stage.isNull() | ~(stage.ilike("%not_modest%") | stage.ilike("%no_longer_available%"))
    return keep & (stage.isNull() | (stage != "assessed_rejected")) if strict else keep


def select_work(products: DataFrame, as_of: Column, retailer: str | None = None,
                modesty_status: str | None = None, sale_status: str | None = None,
                stock_status: str | None = None, has_shopify_id: bool = False,
                min_age_days: float | None = None, strict: bool = False) -> DataFrame:
    """Products due for an update; every filter is optional and reaches the scan."""
    out = products.filter(stage_allowed(F.col("lifecycle_stage"), strict))
    for name, value in (("retailer", retailer), ("modesty_status", modesty_status),
                        ("sale_status", sale_status), ("stock_status", stock_status)):
        if value:
            out = out.filter(F.col(name) == value)
    if has_shopify_id:
        out = out.filter(F.col("shopify_id").isNotNull())
    if min_age_days:
        out = out.filter(age_days(F.col("last_updated"), as_of) > min_age_days)
    return out


def stalest_first(products: DataFrame, limit: int = 100) -> DataFrame:
    """The report's first rows: never updated first, then oldest; url breaks ties."""
    return products.orderBy(F.asc_nulls_first("last_updated"), "url").limit(limit)


def smart_batch(products: DataFrame, kind: str, as_of: Column) -> DataFrame:
    """Named update batches."""
    rules = {
        "on_sale": lambda: F.col("sale_status") == "on_sale",
        "low_stock": lambda: F.col("stock_status") == "low_stock",
        "stale": lambda: age_days(F.col("last_updated"), as_of) >= 60,
        "recent": lambda: age_days(F.col("first_seen"), as_of) <= 7,
    }
    return products.filter(rules[kind]())


def by_age(products: DataFrame, days: float, as_of: Column) -> DataFrame:
    return products.filter(age_days(F.col("last_updated"), as_of) >= days)


def provenance(products: DataFrame, kind: str, since: Column | None = None) -> DataFrame:
    """``monitor``, legacy ``baseline`` or ``organic`` growth since a time."""
    source = F.col("source")
    if kind == "monitor":
        return products.filter(source == "monitor")
    if kind == "baseline":
        return products.filter(source.isNull() | (source == "baseline_scan"))
    return products.filter((source == "monitor") & (F.col("first_seen") > since))


def retain(log: DataFrame, ts: str, as_of: Column, age: str, drops: Column | None = None) -> DataFrame:
    """Rows kept after removing those older than ``age`` (and matching ``drops``).

    ``age`` is interval text such as ``30 DAYS``. Rows without a time stay.
    """
    old = F.col(ts) < as_of - F.expr(f"INTERVAL {age}")
    gone = F.coalesce(old & (drops if drops is not None else F.lit(True)), F.lit(False))
    return log.filter(~gone)


def removed_count(log: DataFrame, ts: str, as_of: Column, age: str,
                  drops: Column | None = None) -> DataFrame:
    old = F.col(ts) < as_of - F.expr(f"INTERVAL {age}")
    gone = F.coalesce(old & (drops if drops is not None else F.lit(True)), F.lit(False))
    return log.agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept"))


# --- queue -------------------------------------------------------------------------------

def add_to_queue(queue: DataFrame, items: DataFrame, as_of: Column, seq: str) -> DataFrame:
    """Items to append: one per (product_url, review_type) not yet in the queue.

    Within a batch the first item by ``seq`` wins; an aggregate picks it, so a
    url repeated any number of times is one row per map task.
    """
    keys = ["product_url", "review_type"]
    rest = [c for c in items.columns if c not in keys and c != seq]
    first = (items.filter(F.col("product_url").isNotNull()).groupBy(*keys)
             .agg(F.min(F.struct(seq, *rest)).alias("m"))
             .select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest]))
    return (first.join(queue.select(*keys), keys, "left_anti")
            .withColumn("status", F.lit("pending")).withColumn("added_at", as_of))


def mark_queued(products: DataFrame, added: DataFrame, as_of: Column) -> DataFrame:
    urls = added.select(F.col("product_url").alias("url")).distinct().withColumn(
        "assessment_status", F.lit("queued"))
    return set_columns(products, urls, as_of)


def next_for_review(queue: DataFrame, by_priority: bool = True) -> DataFrame:
    """The next pending item of every review type."""
    order = ([priority_rank(F.col("priority"))] if by_priority else []) + [
        F.col("added_at"), F.col("id")]
    return top_per_key(queue.filter(F.col("status") == "pending"), ["review_type"], order, 1) \
        .drop("rank")


def queue_listing(queue: DataFrame, retailer: str | None = None, category: str | None = None,
                  review_type: str | None = "modesty", priority: str | None = None) -> DataFrame:
    out = queue.filter(F.col("status") == "pending")
    for name, value in (("retailer", retailer), ("category", category),
                        ("review_type", review_type), ("priority", priority)):
        if value:
            out = out.filter(F.col(name) == value)
    return out


def review_page(queue: DataFrame, limit: int = 50) -> DataFrame:
    """The review page: by priority, then first in first out."""
    return queue.orderBy(priority_rank(F.col("priority")), "added_at", "id").limit(limit)


def newest_items(queue: DataFrame, limit: int = 100) -> DataFrame:
    return queue.orderBy(F.desc("added_at"), F.desc("id")).limit(limit)


def most_recent(rows: DataFrame, ts: str, tie: str, limit: int = 10) -> DataFrame:
    return rows.filter(F.col(ts).isNotNull()).orderBy(F.desc(ts), tie).limit(limit)


def high_priority_updates(updates: DataFrame) -> DataFrame:
    return updates.filter(F.col("priority") == "high")


def display_images(shopify: Column, image_urls: Column, images: Column) -> Column:
    """The first of the three image lists that is not empty."""
    return (F.when(F.size(shopify) > 0, shopify).when(F.size(image_urls) > 0, image_urls)
            .when(F.size(images) > 0, images).otherwise(F.array().cast("array<string>")))


def review_rows(queue: DataFrame) -> DataFrame:
    """Queue items flattened for display, from the JSON they carry, with defaults."""
    data = F.try_parse_json("product_data")

    def get(path, kind):
        return F.try_variant_get(data, path, kind)

    return queue.select(
        "id", F.col("product_url").alias("url"), "retailer", "review_type", "priority",
        "added_at",
        F.coalesce(get("$.title", "string"), F.lit("N/A")).alias("title"),
        F.coalesce(get("$.price", "string"), F.lit("N/A")).alias("price"),
        F.coalesce(get("$.brand", "string"), F.lit("")).alias("brand"),
        get("$.shopify_id", "bigint").alias("shopify_id"),
        F.coalesce(get("$.confidence_score", "double"), F.lit(1.0)).alias("confidence_score"),
        F.coalesce(get("$.clothing_type", "string"), F.lit("unknown")).alias("clothing_type"),
        display_images(get("$.shopify_image_urls", "array<string>"),
                       get("$.image_urls", "array<string>"),
                       get("$.images", "array<string>")).alias("display_images"))


# --- decisions ------------------------------------------------------------------------------

def mark_reviewed(queue: DataFrame, reviews: DataFrame, as_of: Column) -> DataFrame:
    """Close queue rows by ``reviews`` (one per id: decision, notes, reviewer).

    A null decision skips the row: it keeps its notes and date but no decision.
    """
    r = reviews.select("id", F.struct("review_decision", "reviewer_notes", "reviewed_by").alias("r"))
    hit, decided = F.col("r").isNotNull(), F.col("r.review_decision").isNotNull()
    new = {
        "status": F.when(decided, "reviewed").otherwise("skipped"),
        "review_decision": F.when(decided, F.col("r.review_decision"))
        .otherwise(F.col("review_decision")),
        "reviewer_notes": F.col("r.reviewer_notes"),
        "reviewed_at": as_of,
        "reviewed_by": F.when(decided, F.col("r.reviewed_by")).otherwise(F.col("reviewed_by")),
    }
    return queue.join(r, "id", "left").select(*[
        F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
        for c in queue.columns])


def cascade_assessed(products: DataFrame, queue: DataFrame, reviews: DataFrame,
                     as_of: Column) -> DataFrame:
    """Products of the rows reviewed (not skipped) become ``assessed``."""
    urls = (queue.join(reviews.filter(F.col("review_decision").isNotNull()).select("id"), "id",
                       "left_semi")
            .select(F.col("product_url").alias("url")).distinct()
            .withColumn("assessment_status", F.lit("assessed")))
    return set_columns(products, urls, as_of)


def decided_products(products: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """Next version of the product table after modesty decisions.

    ``items`` are decided queue rows with ``review_decision``, ``shopify_id``
    and the product fields. Rows without a store id change nothing; an unknown
    url is inserted. The decision with the largest queue id wins.
    """
    carried = [c for c in ("title", "price", "brand", "description", "image_urls")
               if c in items.columns and c in products.columns]
    d = (items.filter(F.col("shopify_id").isNotNull() & (F.col("shopify_id") != 0))
         .groupBy(F.col("product_url").alias("_url"))
         .agg(F.max(F.struct("id", "review_decision", "retailer", "shopify_id", *carried))
              .alias("d")))
    decision = F.col("d.review_decision")
    stage = (F.when(decision.isin("modest", "moderately_modest"), "assessed_approved")
             .when(decision == "not_modest", "assessed_rejected"))
    status = F.when(publish_status(decision) == "active", "published").otherwise("draft")
    hit, old = F.col("d").isNotNull(), F.col("url").isNotNull()
    set_always = {"shopify_status": status, "modesty_status": decision, "lifecycle_stage": stage,
                  "assessed_at": as_of, "last_updated": as_of}
    on_insert = {"url": F.col("_url"), "retailer": F.coalesce("d.retailer", F.lit("unknown")),
                 "shopify_id": F.col("d.shopify_id"), "first_seen": as_of,
                 "source": F.lit("web_assessment_backfill"),
                 "data_completeness": F.lit("partial"), "last_workflow": F.lit("web_assessment"),
                 **{c: F.col(f"d.{c}") for c in carried}}
    if "title" in on_insert:
        on_insert["title"] = F.coalesce(on_insert["title"], F.lit("Unknown"))
    out = []
    for c in products.columns:
        kind = products.schema[c].dataType
        if c in set_always:
            out.append(F.when(hit, set_always[c].cast(kind)).otherwise(F.col(c)).alias(c))
        elif c in on_insert:
            out.append(F.when(old, F.col(c)).otherwise(on_insert[c].cast(kind)).alias(c))
        else:
            out.append(F.col(c))
    return products.join(d, F.col("url") == F.col("_url"), "full_outer").select(*out)


def promotions(queue: DataFrame, decided: DataFrame, as_of: Column) -> DataFrame:
    """New modesty items for rows decided ``not_duplicate``, unless already queued."""
    items = decided.filter(F.col("review_decision") == "not_duplicate").select(
        "id", "product_url", "retailer", "category", F.lit("modesty").alias("review_type"),
        F.lit("high").alias("priority"), F.lit("duplicate_review").alias("source_workflow"))
    return add_to_queue(queue, items, as_of, "id")
