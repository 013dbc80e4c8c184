"""Counts, shares and digests over products, snapshots, queue and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwatch.schemas import DOMAINS

N = "n"


def count_rows() -> Column:
    return F.count(F.lit(1))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage rounded half up on an exact decimal quotient."""
    quotient = part.cast("decimal(20,0)") * 100 / F.nullif(whole, F.lit(0)).cast("decimal(20,0)")
    return quotient.cast(f"decimal(18,{digits})").cast("double")


def profile(rows: DataFrame, *by: str, latest: str | None = None) -> DataFrame:
    """Row count (and latest time) per value of the given columns."""
    aggs = [count_rows().alias(N)] + ([F.max(latest).alias("latest")] if latest else [])
    return rows.groupBy(*by).agg(*aggs)


def distribution(rows: DataFrame, by: str) -> DataFrame:
    """Counts per value with their percentage of all rows.

    The total is a window over the few aggregated rows, not a second scan.
    """
    counted = profile(rows, by)
    return counted.withColumn("percentage", share(
        F.col(N), F.sum(N).over(W.partitionBy(F.lit(1)))))


def assessment_rate(products: DataFrame) -> DataFrame:
    return distribution(products.filter(F.col("lifecycle_stage").isin(
        "assessed_approved", "assessed_rejected")), "lifecycle_stage")


def throughput(products: DataFrame, ts: str = "assessed_at") -> DataFrame:
    return profile(products.filter(F.col(ts).isNotNull())
                   .select(F.to_date(ts).alias("day")), "day")


def image_coverage(snapshots: DataFrame) -> DataFrame:
    have = F.count_if(F.coalesce(F.size("image_urls"), F.lit(0)) > 0)
    return snapshots.agg(count_rows().alias("total"), have.alias("with_images")).withColumn(
        "percentage", share(F.col("with_images"), F.col("total")))


def snapshot_vs_new(snapshots: DataFrame, products: DataFrame, since: Column) -> DataFrame:
    """Monitor snapshot rows against new monitored products since a time: one row."""
    a = snapshots.filter((F.col("scan_type") == "monitor")
                         & (F.col("discovered_date") >= since.cast("date"))) \
        .select(F.lit("s").alias("side"))
    b = products.filter((F.col("source") == "monitor") & (F.col("first_seen") >= since)) \
        .select(F.lit("p").alias("side"))
    return a.unionByName(b).agg(F.count_if(F.col("side") == "s").alias("snapshots"),
                                F.count_if(F.col("side") == "p").alias("new_products"))


def domain_audit(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values outside their enumeration, with counts; nulls are no violation."""
    pairs = F.explode(F.array(*[
        F.when(~F.col(c).isin(DOMAINS[c]),
               F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")))
        for c in columns])).alias("p")
    return (rows.select(pairs).filter(F.col("p").isNotNull()).select("p.*")
            .groupBy("column_name", "value").agg(count_rows().alias(N)))


def queue_statistics(queue: DataFrame, as_of: Column) -> DataFrame:
    """Counts per review type; the row without a type is the whole queue."""
    pending = F.col("status") == "pending"
    return queue.rollup("review_type").agg(
        count_rows().alias("total"), F.count_if(pending).alias("pending"),
        F.count_if(F.col("status") == "reviewed").alias("reviewed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(pending & (F.col("priority") == "high")).alias("high_priority"),
        F.count_if(F.col("reviewed_at") >= as_of - F.expr("INTERVAL 1 DAY"))
        .alias("reviewed_last_24h"))


def dashboard(queue: DataFrame, as_of: Column) -> DataFrame:
    pending, done = F.col("status") == "pending", F.col("status") == "reviewed"
    return queue.agg(
        F.count_if(pending).alias("total_pending"),
        F.count_if(pending & (F.col("review_type") == "modesty")).alias("pending_modesty"),
        F.count_if(pending & (F.col("review_type") == "duplication")).alias("pending_duplication"),
        F.count_if(done & (F.to_date("reviewed_at") == F.to_date(as_of))).alias("approved_today"),
        F.count_if(done).alias("total_processed"),
        F.count_if(pending & (F.col("priority") == "high")).alias("high_priority"))


def pending_by(queue: DataFrame, column: str) -> DataFrame:
    return profile(queue.filter(F.col("status") == "pending"), column)


def baseline_overlap(queue: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Pending items whose url is in the baseline, counted per joined row.

    Both sides are counted per url first, so a url that is on many rows of both
    sides multiplies two numbers and not two groups of rows.
    """
    q = (queue.filter(F.col("status") == "pending").groupBy("retailer", "product_url")
         .agg(count_rows().alias("a")))
    s = (snapshots.filter(F.col("review_status") == "baseline")
         .groupBy(F.col("catalog_url").alias("product_url")).agg(count_rows().alias("b")))
    return q.join(s, "product_url").groupBy("retailer").agg(
        F.sum(F.col("a") * F.col("b")).alias("overlap"))


def sync_difference(local_queue: DataFrame, remote_queue: DataFrame,
                    local_products: DataFrame, remote_products: DataFrame) -> DataFrame:
    """Pending and assessed counts of both sides and their differences: one row."""
    def pending(df, side):
        return df.filter(F.col("status") == "pending").select(F.lit(side).alias("side"))

    def assessed(df, side):
        return df.filter(F.col("lifecycle_stage").isin("assessed_approved", "assessed_rejected")
                         & F.col("assessed_at").isNotNull()).select(F.lit(side).alias("side"))

    rows = (pending(local_queue, "lp").unionByName(pending(remote_queue, "rp"))
            .unionByName(assessed(local_products, "la"))
            .unionByName(assessed(remote_products, "ra")))
    out = rows.agg(*[F.count_if(F.col("side") == s).alias(n) for s, n in (
        ("lp", "local_pending"), ("rp", "remote_pending"), ("la", "local_assessed"),
        ("ra", "remote_assessed"))])
    return out.withColumns({
        "pending_difference": F.col("remote_pending") - F.col("local_pending"),
        "assessed_difference": F.col("remote_assessed") - F.col("local_assessed")})


def new_product_digest(listings: DataFrame) -> DataFrame:
    cats = F.array_sort(F.collect_set(F.coalesce("category", F.lit("unknown"))))
    return listings.groupBy(F.coalesce("retailer", F.lit("unknown")).alias("retailer")).agg(
        count_rows().alias(N), F.array_join(cats, ", ").alias("categories"))


def backlog_digest(queue: DataFrame, as_of: Column, low: float = 0.5) -> DataFrame:
    pending = queue.filter(F.col("status") == "pending")
    scored = F.col("confidence_score") if "confidence_score" in queue.columns else F.lit(1.0)
    return pending.groupBy("retailer").agg(
        count_rows().alias("pending"), F.count_if(scored < low).alias("low_confidence"),
        F.datediff(F.to_date(as_of), F.to_date(F.min("added_at"))).alias("oldest_pending_days"))


def batch_digest(runs: DataFrame) -> DataFrame:
    """Success percentage and minutes per batch; zero where nothing ran."""
    seconds = (F.unix_timestamp(F.col("end_time").cast("timestamp"))
               - F.unix_timestamp(F.col("start_time").cast("timestamp")))
    return runs.select("batch_id", "total", "successful", F.coalesce(
        F.try_divide(F.col("successful") * 100.0, F.col("total")), F.lit(0.0))
        .alias("success_rate"), F.coalesce(seconds / 60.0, F.lit(0.0)).alias("minutes"))


def run_counters(results: DataFrame, run: str, column: str, values: list[str]) -> DataFrame:
    """One row per run with a count per value; the value list is fixed, so no extra job."""
    return results.groupBy(run).agg(count_rows().alias("processed"), *[
        F.count_if(F.col(column) == v).alias(v) for v in values])


def failure_counts(failures: DataFrame) -> DataFrame:
    """All combinations of workflow, stage and certainty, with totals."""
    return failures.cube("workflow", "stage", "certainty").agg(
        count_rows().alias(N), F.grouping_id().alias("level"))


def queue_red_flags(queue: DataFrame, products: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Signs per retailer that pending items are not really new."""
    pend = queue.filter(F.col("status") == "pending")
    daily = (pend.groupBy("retailer", F.to_date("added_at").alias("d")).agg(
        count_rows().alias("k"),
        F.count_if(F.col("source_workflow") != "migration_from_catalog_products").alias("fresh"))
        .groupBy("retailer").agg(F.sum("k").alias("pending"), F.max("k").alias("per_day"),
                                 F.sum("fresh").alias("fresh")))
    monitored = products.filter(F.col("source") == "monitor").groupBy("retailer").agg(
        count_rows().alias("monitored"))
    base = snapshots.filter(F.col("review_status") == "baseline").groupBy("retailer").agg(
        count_rows().alias("baseline"))
    j = (daily.join(monitored, "retailer", "left").join(base, "retailer", "left")
         .join(baseline_overlap(queue, snapshots), "retailer", "left")
         .na.fill(0, ["monitored", "baseline", "overlap"]))
    flags = F.array_compact(F.array(
        F.when(F.col("monitored") == 0, F.lit("no_monitored_products")),
        F.when(F.col("fresh") == 0, F.lit("only_migration_source")),
        F.when(F.col("overlap") > 0, F.lit("baseline_overlap")),
        F.when(F.col("per_day") > 20, F.lit("over_20_per_day")),
        F.when(F.col("pending") > 50, F.lit("over_50_total")),
        F.when(F.col("pending") > F.col("baseline") * 0.1, F.lit("over_10_percent_of_baseline"))))
    return j.withColumn("flags", F.array_join(flags, ","))


def baseline_image_audit(listings: DataFrame) -> DataFrame:
    """Rows with and without images per retailer; more missing than half of present warns."""
    have = F.coalesce(F.size("image_urls"), F.lit(0)) > 0
    return listings.groupBy("retailer").agg(
        F.count_if(have).alias("images_extracted"),
        F.count_if(~have).alias("images_missing")).withColumn(
        "warning", (F.col("images_missing") > 0)
        & (F.col("images_missing") > F.col("images_extracted") * 0.5))
