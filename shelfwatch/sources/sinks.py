"""Writers. Each takes rows an operator made and appends or replaces whole files.

Output folders are partitioned by columns readers prune on. Rows are spread by
those columns before the write and large partitions are split by their measured
size, so one large retailer or day is written by many tasks. Nothing random takes
part, so a task that runs again writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.urls import url_hash
from shelfwatch.operators.ordered import top_per_key
from shelfwatch.session import staged


def append_partitioned(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.hint("rebalance", *by).write.mode("append").partitionBy(*by).parquet(path)


def append_snapshot(rows: DataFrame, path: str) -> None:
    dated = rows.withColumn("run_date", F.to_date("discovered_date"))
    append_partitioned(dated, path, ["retailer", "run_date"])


def append_log(rows: DataFrame, path: str, ts: str = "attempted_at") -> None:
    append_partitioned(rows.withColumn("log_date", F.to_date(ts)), path, ["log_date"])


def write_version(rows: DataFrame, path: str, version: str) -> str:
    """Write the next version of a table beside the ones readers still use."""
    target = f"{path.rstrip('/')}/version={version}"
    rows.write.mode("errorifexists").parquet(target)
    return target


def failure_headers(failures: DataFrame) -> DataFrame:
    """Header row per run: how many of its records failed."""
    keys = [c for c in ("workflow", "batch_id", "retailer", "category", "modesty_level")
            if c in failures.columns]
    return failures.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_failed"))


def write_failures(failures: DataFrame, path: str) -> None:
    """Failure records as JSON lines per workflow and batch, headers beside them.

    One line per record and no collected list: a run may fail on every row.
    """
    failures = staged(failures, "failures")  # its two outputs must not run the job twice
    failures.write.mode("append").partitionBy("workflow", "batch_id").json(f"{path}/records")
    failure_headers(failures).write.mode("append").json(f"{path}/headers")


def export_batch(products: DataFrame, path: str) -> None:
    """The next update batch as JSON lines."""
    products.select("url", "retailer").write.mode("errorifexists").json(path)


def export_feed(feed_rows: DataFrame, path: str) -> None:
    """Feed rows (one JSON text per product) as text lines."""
    feed_rows.select("value").write.mode("errorifexists").text(path)


def store_pages(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Next version of the page store: the newest page per url, its counters reset."""
    new = fetched.select(url_hash(F.col("url")).alias("url_hash"), "url", "retailer", "html",
                         "cached_at").withColumns(
        {"accessed_count": F.lit(1).cast("long"), "last_accessed": F.col("cached_at")})
    both = stored.select(*new.columns).unionByName(new)
    return top_per_key(both, ["url_hash"], [F.desc("cached_at"), F.col("accessed_count")], 1) \
        .drop("rank")


def fresh_pages(stored: DataFrame, as_of: Column, age: str = "24 HOURS") -> DataFrame:
    return stored.filter(F.col("cached_at") >= as_of - F.expr(f"INTERVAL {age}"))
