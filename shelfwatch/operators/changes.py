"""Change detection, update outcomes and upserts.

Stored tables are plain parquet, so an upsert is a full outer join on the key
that yields the next version of the table. Several incoming rows for one key
are first folded by aggregates, so a hot key is never multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.text import title_key

# Columns an upsert may overwrite with a non-null value.
MERGED = ["title", "price", "brand", "description", "shopify_id", "modesty_status",
          "shopify_status", "images_uploaded", "images_uploaded_at", "source",
          "assessment_status", "lifecycle_stage", "data_completeness", "last_workflow",
          "extracted_at", "assessed_at", "image_urls"]
DEFAULTED = ["shopify_status", "images_uploaded", "images_uploaded_at", "assessment_status"]

# Both spellings mean the product is gone for good.
GONE = ["no_longer_available", "delisted"]


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def _set_text(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(
        F.coalesce(c, F.array().cast("array<string>")))), "\u0001")


def changed_fields(old: str, new: str) -> Column:
    """Names of the fields that differ between two struct columns.

    Prices within a cent are equal, a missing price on either side is a change;
    titles and whole descriptions compare trimmed and lower case, image lists as
    sets.
    """
    def o(n):
        return F.col(f"{old}.{n}")

    def n(name):
        return F.col(f"{new}.{name}")

    def differs(name):
        return ~o(name).eqNullSafe(n(name))

    def words(c):
        return title_key(F.coalesce(c, F.lit("")))

    tests = [
        ("price", F.coalesce(F.abs(o("price") - n("price")) > 0.01, F.lit(True))),
        ("original_price", F.abs(F.coalesce(o("original_price"), F.lit(0.0))
                                 - F.coalesce(n("original_price"), F.lit(0.0))) > 0.01),
        ("sale_status", differs("sale_status")),
        ("stock_status", differs("stock_status")),
        ("title", words(o("title")) != words(n("title"))),
        ("description", words(o("description")) != words(n("description"))),
        ("images", _set_text(o("image_urls")) != _set_text(n("image_urls"))),
    ]
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests]))


FIELDS = ["price", "original_price", "sale_status", "stock_status", "title", "description",
          "image_urls"]


def update_outcomes(extracts: DataFrame, products: DataFrame) -> DataFrame:
    """One row per extraction with ``action`` and the changed fields."""
    known = products.select("url", F.struct("shopify_id", "images_uploaded", *FIELDS)
                            .alias("old"))
    rows = (extracts.withColumn("new", F.struct(*FIELDS)).join(known, "url", "left")
            .withColumn("changed_fields", changed_fields("old", "new")))
    missing = F.coalesce(F.col("old.shopify_id"), F.lit(0)) == 0
    return (rows.withColumn(
        "action", F.when(~F.col("success"), "failed")
        .when(F.col("new.stock_status").isin(GONE), "delisted")
        .when(missing, "not_found")
        .when(F.size("changed_fields") == 0, "unchanged").otherwise("updated"))
        .withColumn("needs_images", needs_image_work(F.col("old.images_uploaded")))
        .withColumn("error", F.when(
            F.col("action") == "not_found",
            F.lit("Product not in DB or missing shopify_id")).otherwise(F.col("error"))))


def needs_image_work(images_uploaded: Column) -> Column:
    return F.coalesce(images_uploaded.cast("int"), F.lit(0)) == 0


def failure_stage(action: Column, error: Column) -> Column:
    """Stage a failed row broke in, read from its error text."""
    low = F.lower(F.coalesce(error, F.lit("")))
    by_text = (F.when(F.contains(low, F.lit("extraction")), "extraction")
               .when(F.contains(low, F.lit("shopify")), "shopify_update")
               .when(F.contains(low, F.lit("image")), "image_processing").otherwise("unknown"))
    return (F.when(action == "failed", by_text)
            .when(action == "not_found", "database_lookup").otherwise("unknown"))


def failure_certainty(error: Column) -> Column:
    return F.when(_blank(error) | F.contains(error, F.lit("Unknown")), "uncertain").otherwise(
        "known_error")


def failures(outcomes: DataFrame) -> DataFrame:
    """Failure records of a run."""
    reason = F.when(_blank(F.col("error")),
                    "Unknown error - no error details provided").otherwise(F.col("error"))
    return (outcomes.filter(F.col("action").isin("failed", "not_found"))
            .select("url", reason.alias("reason"),
                    failure_stage(F.col("action"), F.col("error")).alias("stage"), "action",
                    failure_certainty(F.col("error")).alias("certainty")))


def lifecycle_stage(source: Column, shopify: Column, modesty: Column, assessment: Column) -> Column:
    return (F.when(source == "new_product_import", "imported_direct")
            .when(shopify == "published", "assessed_approved")
            .when((shopify == "draft") & (modesty == "not_modest"), "assessed_rejected")
            .when(shopify == "draft", "pending_assessment")
            .when(assessment.isin("queued", "pending_modesty_review"), "pending_assessment")
            .otherwise("unknown"))


def backfill_lifecycle(products: DataFrame) -> DataFrame:
    """Derived lifecycle stage and completeness for rows stored before both existed."""
    return products.withColumns({
        "lifecycle_stage": lifecycle_stage(F.col("source"), F.col("shopify_status"),
                                           F.col("modesty_status"), F.col("assessment_status")),
        "data_completeness": F.when(F.col("shopify_status").isin("published", "draft"),
                                    "enriched").otherwise("full")})


def publish_status(decision: Column) -> Column:
    return F.when(decision.isin("modest", "moderately_modest"), "active").otherwise("draft")


def import_gate(decision: Column) -> Column:
    """Only the two accepted classes are uploaded."""
    return F.when(decision.isin("modest", "moderately_modest"), "upload").otherwise("skipped")


# --- upserts --------------------------------------------------------------------------

def insert_defaults(incoming: DataFrame, as_of: Column) -> DataFrame:
    """Fill the values a saved product must have, from what the row came with."""
    have = set(incoming.columns)

    def col(name, kind="string"):
        return F.col(name) if name in have else F.lit(None).cast(kind)

    def filled(name):
        return F.when(F.size(F.col(name)) > 0, F.col(name)) if name in have else \
            F.lit(None).cast("array<string>")

    uploaded = F.coalesce(
        col("images_uploaded", "int").cast("int"),
        F.when(F.size(F.col("downloaded_image_paths")) > 0, 1).otherwise(0)
        if "downloaded_image_paths" in have else F.lit(0))
    out = incoming.withColumns({
        "shopify_status": F.coalesce(
            col("shopify_status"),
            F.when(F.coalesce(col("shopify_id", "long"), F.lit(0)) != 0, "draft")
            .otherwise("not_uploaded")),
        "images_uploaded": uploaded,
        "images_uploaded_at": F.when(uploaded == 1, as_of),
        "assessment_status": F.coalesce(
            col("assessment_status"),
            F.when(col("source") == "baseline_scan", "not_for_assessment")
            .otherwise("not_assessed")),
        "image_urls": F.coalesce(filled("images"), filled("image_urls")),
    })
    return out.drop("images")


def fold_by_key(incoming: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Fold rows of one key as if applied in order: last non-null value per column."""
    rest = [c for c in incoming.columns if c not in keys and c != seq]
    return incoming.groupBy(*keys).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest])


def upsert_products(existing: DataFrame, incoming: DataFrame, as_of: Column,
                    seq: str | None = None, defaults_on_insert_only: bool = False) -> DataFrame:
    """Next version of the product table.

    A non-null incoming value replaces the stored one, ``last_updated`` is
    always set, ``retailer`` and ``first_seen`` never change on an update. The
    default values count as incoming values and so reset the stored status
    columns, unless ``defaults_on_insert_only``.
    """
    if seq is not None:
        incoming = fold_by_key(incoming, ["url"], seq)
    given = {c for c in MERGED if c in incoming.columns}
    new = insert_defaults(incoming, as_of)
    e, n = existing.alias("e"), new.withColumn("_in", F.lit(True)).alias("n")
    joined = e.join(n, F.col("e.url") == F.col("n.url"), "full_outer")
    hit, old = F.col("n._in").isNotNull(), F.col("e.url").isNotNull()
    out = []
    for c in existing.columns:
        kind = existing.schema[c].dataType
        stored = F.col(f"e.{c}")
        if c == "url":
            out.append(F.coalesce(stored, F.col("n.url")).alias(c))
        elif c == "last_updated":
            out.append(F.when(hit, as_of.cast(kind)).otherwise(stored).alias(c))
        elif c == "first_seen":
            fresh = F.coalesce(F.col("n.first_seen"), as_of) if "first_seen" in new.columns \
                else as_of
            out.append(F.when(old, stored).otherwise(fresh.cast(kind)).alias(c))
        elif c == "retailer":
            out.append(F.when(old, stored).otherwise(F.col("n.retailer")).alias(c))
        elif c in MERGED and c in new.columns:
            value = F.col(f"n.{c}").cast(kind)
            if defaults_on_insert_only and c in DEFAULTED and c not in given:
                value = F.when(~old, value)
            out.append(F.coalesce(value, stored).alias(c))
        else:
            out.append(stored.alias(c))
    return joined.select(*out)


def upsert_listings(existing: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Next version of the snapshot table, keyed by (catalog_url, retailer).

    All values merge by "new unless null" but the price, which the incoming row
    overwrites even when it is null.
    """
    keys = ["catalog_url", "retailer"]
    e, n = existing.alias("e"), incoming.withColumn("_in", F.lit(True)).alias("n")
    joined = e.join(n, [F.col(f"e.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    hit = F.col("n._in").isNotNull()
    out = []
    for c in existing.columns:
        stored = F.col(f"e.{c}")
        if c == "price":
            out.append(F.when(hit, F.col("n.price")).otherwise(stored).alias(c))
        elif c == "discovered_date":
            kind = existing.schema[c].dataType
            out.append(F.coalesce(stored, F.when(hit, as_of.cast(kind))).alias(c))
        elif c in incoming.columns:
            out.append(F.coalesce(F.col(f"n.{c}"), stored).alias(c))
        else:
            out.append(stored.alias(c))
    return joined.select(*out)


def apply_updates(products: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Apply one update row per url by its action.

    ``unchanged`` only stamps ``last_checked``; ``delisted`` sets the stock
    status; anything else writes the non-empty title and price and the non-null
    statuses.
    """
    u = updates.select("url", F.struct("action", "title", "price", "sale_status",
                                       "stock_status").alias("u"))
    hit, action = F.col("u").isNotNull(), F.col("u.action")
    full = hit & ~action.isin("unchanged", "delisted")
    stamped = hit & (action != "unchanged")
    rules = {
        "title": F.when(full & ~_blank(F.col("u.title")), F.col("u.title")),
        "price": F.when(full & (F.coalesce(F.col("u.price"), F.lit(0.0)) != 0), F.col("u.price")),
        "sale_status": F.when(full, F.col("u.sale_status")),
        "stock_status": F.when(hit & (action == "delisted"), F.lit("delisted"))
        .when(full, F.col("u.stock_status")),
        "last_updated": F.when(stamped, as_of),
        "last_checked": F.when(hit, as_of),
    }
    joined = products.join(u, "url", "left")
    return joined.select(*[F.coalesce(rules[c], F.col(c)).alias(c) if c in rules else F.col(c)
                           for c in products.columns])


def set_columns(products: DataFrame, values: DataFrame, as_of: Column | None = None,
                key: str = "url", stamp: tuple[str, ...] = ("last_updated",)) -> DataFrame:
    """Overwrite the columns of ``values`` (one row per key) where they are not null."""
    names = [c for c in values.columns if c != key]
    v = values.select(key, F.struct(*names).alias("_v"))
    joined = products.join(v, key, "left")
    hit = F.col("_v").isNotNull()
    out = []
    for c in products.columns:
        if c in names:
            out.append(F.coalesce(F.col(f"_v.{c}"), F.col(c)).alias(c))
        elif as_of is not None and c in stamp:
            out.append(F.when(hit, as_of).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def mark_delisted(products: DataFrame, urls: DataFrame, as_of: Column) -> DataFrame:
    gone = urls.select("url").distinct().withColumn("stock_status", F.lit("delisted"))
    return set_columns(products, gone, as_of, stamp=("last_updated", "last_checked"))


def update_records(products: DataFrame, data: DataFrame, as_of: Column) -> DataFrame:
    """Write title and price as given (nulls too), statuses with their defaults,
    and the image columns the data rows carry."""
    images = [c for c in ("images_uploaded", "images_uploaded_at", "images_failed_count",
                          "last_image_error") if c in data.columns]
    d = data.select("url", F.struct("title", "price", "sale_status", "stock_status", *images)
                    .alias("_d"))
    hit = F.col("_d").isNotNull()
    new = {"title": F.col("_d.title"), "price": F.col("_d.price"),
           "sale_status": F.coalesce("_d.sale_status", F.lit("regular")),
           "stock_status": F.coalesce("_d.stock_status", F.lit("in_stock")),
           "last_updated": as_of, **{c: F.col(f"_d.{c}") for c in images}}
    return products.join(d, "url", "left").select(*[
        F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
        for c in products.columns])


def snapshot_rows(listings: DataFrame, category: Column, as_of: Column) -> DataFrame:
    """Full-catalog snapshot of a monitor run, ready to append."""
    return listings.select(
        "catalog_url", "retailer", category.alias("category"), "title", "price", "product_code",
        "image_urls", as_of.alias("discovered_date"), F.lit("baseline").alias("review_status"),
        F.lit("monitor").alias("scan_type"), F.lit("catalog_extraction").alias("image_url_source"))


def baseline_header(listings: DataFrame, as_of: Column) -> DataFrame:
    """One header row per (retailer, category) of a baseline scan."""
    return listings.groupBy("retailer", "category").agg(
        F.count(F.lit(1)).alias("total_products_seen")).withColumn(
        "baseline_date", as_of.cast("date"))


def fill_gaps(primary: DataFrame, secondary: DataFrame, key: str = "url") -> DataFrame:
    """Fill title, price, images and code of the primary record from the secondary.

    ``gaps`` lists what the primary lacked: a title under five characters, no
    price, fewer than two images.
    """
    s = secondary.select(key, F.struct("title", "price", "image_urls", "product_code").alias("s"))
    size = F.coalesce(F.size("image_urls"), F.lit(0))
    short = F.length(F.coalesce("title", F.lit(""))) < 5
    unpriced = F.coalesce("price", F.lit(0.0)) == 0
    gaps = F.array_compact(F.array(F.when(short, F.lit("title")), F.when(unpriced, F.lit("price")),
                                   F.when(size < 2, F.lit("images"))))
    new = {"title": F.coalesce(F.nullif("title", F.lit("")), "s.title"),
           "price": F.coalesce(F.nullif("price", F.lit(0.0)), "s.price"),
           "image_urls": F.when(size > 0, F.col("image_urls")).otherwise(F.col("s.image_urls")),
           "product_code": F.coalesce(F.nullif("product_code", F.lit("")), "s.product_code")}
    return primary.join(s, key, "left").select(
        *[new[c].alias(c) if c in new else F.col(c) for c in primary.columns], gaps.alias("gaps"))


def merge_remote_reviews(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Take over remote assessments that are newer or locally missing.

    Remote rows count when assessed and dated. They replace the local values if
    the local row is not assessed, has no date or an older one; urls unknown
    locally are skipped.
    """
    done = F.col("lifecycle_stage").isin("assessed_approved", "assessed_rejected")
    names = ["lifecycle_stage", "assessed_at", "modesty_status", "shopify_status", "last_updated"]
    r = (remote.filter(done & F.col("assessed_at").isNotNull())
         .groupBy("url").agg(F.max(F.struct("assessed_at", F.struct(*names).alias("v"))).alias("m"))
         .select("url", F.col("m.v").alias("r")))
    take = F.col("r").isNotNull() & (
        F.coalesce(~done, F.lit(True)) | F.col("assessed_at").isNull()
        | (F.col("r.assessed_at") > F.col("assessed_at")))
    return local.join(r, "url", "left").select(*[
        F.when(take, F.col(f"r.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
        for c in local.columns], F.coalesce(take, F.lit(False)).alias("was_merged"))
