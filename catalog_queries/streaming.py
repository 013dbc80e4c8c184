"""Streaming jobs run over the supplied tables as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries.base import Views, as_of, query
from catalog_queries.learned import FOLD
from catalog_queries.linking import with_images
from shelfwatch.session import scratch_path
from shelfwatch.streaming import jobs, running


class StreamViews(Views):
    """Views in which the named tables arrive as file streams."""

    def __init__(self, views: Views, streamed: list[str]):
        super().__init__(views.spark, views.sf_dir)
        self.streamed = streamed

    def get(self, name):
        if name in self.streamed and name not in self._made:
            schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
            df = (self.spark.readStream.schema(schema)
                  .option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir))
            df.createOrReplaceTempView(name)
            self._made[name] = df
        return super().get(name)


def folders(v, label):
    root = scratch_path(v.spark, label)
    return f"{root}/rows", f"{root}/progress"


@query("ST1_snapshot_ingest", """
SELECT retailer, discovered_date, count(*) AS n, 'monitor' AS scan_type, 'baseline' AS review_status FROM b_listings GROUP BY ALL""")
def ingest(v):
    live = StreamViews(v, ["lineitem"])
    rows = jobs.snapshot_stream(with_images(live.b_listings), F.lit("dresses"))
    out = running.append_available(rows, *folders(v, "ingest"), by=["retailer"])
    return out.groupBy("retailer", "discovered_date", "scan_type", "review_status").agg(
        F.count(F.lit(1)).alias("n"))


REPEATS = """
SELECT DISTINCT lower(rtrim(regexp_replace(catalog_url, '[?#].*$', ''), '/')) AS url_key, discovered_date AS seen_on FROM b_snapshots"""


@query("ST2_suppress_repeats", REPEATS)
def repeats(v):
    live = StreamViews(v, ["lineitem"])
    rows = live.b_snapshots.select(F.col("catalog_url").alias("url"), F.col(
        "discovered_date").cast("timestamp").alias("seen_at"), "retailer")
    out = running.update_available(rows, *folders(v, "repeats"), apply=jobs.kept_sights("seen_at"), mode="append")
    newest = out.agg(F.max("batch_id")).first()[0]
    return out.filter((F.col("batch_id") == newest) & F.col("kept")).select("url_key", F.to_date("seen_at").alias("seen_on"))


@query("ST2_sight_log", REPEATS)
def sight_log(v):
    rows = StreamViews(v, ["lineitem"]).b_snapshots.select(
        F.col("catalog_url").alias("url"), F.col("discovered_date").cast("timestamp").alias("seen_at"), "retailer")
    log = running.update_available(rows, *folders(v, "sights"), apply=jobs.sight_log("seen_at", buckets=64), mode="append", by=["bucket"])
    return jobs.kept_in_log(log).select("url_key", F.to_date("seen_at").alias("seen_on"))


ALERTS = """
WITH p AS (SELECT catalog_url, discovered_date, seq, price, lag(price) OVER (PARTITION BY catalog_url ORDER BY discovered_date, seq) AS old_price FROM b_snapshots WHERE price <> 0)
SELECT catalog_url, seq, old_price, price AS new_price FROM p WHERE abs(price - old_price) >= 0.01"""


@query("ST3_price_alerts", ALERTS)
def alerts(v):
    live = StreamViews(v, ["lineitem"])
    rows = live.b_snapshots.select("catalog_url", F.col("discovered_date").cast("timestamp")
                                   .alias("seen_at"), "seq", "price")
    out = running.append_available(jobs.price_alerts(rows), *folders(v, "alerts"))
    return out.drop("micros")


@query("ST3_last_price_alerts", ALERTS)
def last_price_alerts(v):
    rows = StreamViews(v, ["lineitem"]).b_snapshots.select(
        "catalog_url", F.col("discovered_date").cast("timestamp").alias("seen_at"), "seq", "price")
    apply = jobs.last_price_alerts(scratch_path(v.spark, "last_prices"), buckets=64, block="30 days")
    return running.stateful_available(rows, *folders(v, "alerts"), apply).select("catalog_url", "seq", "old_price", "new_price")


@query("ST4_retailer_state", "SELECT retailer, sample_size, url_changes_detected, best_dedup_method, dedup_confidence_threshold FROM (" + FOLD + ")")
def state(v):
    live = StreamViews(v, ["events"])
    rows = live.b_attempts.select("retailer", "seq", "method", "success", "confidence", "url_changed")
    out = running.update_available(rows, *folders(v, "state"), apply=jobs.retailer_state(), mode="append")
    return running.latest_updates(out, ["retailer"])


RATES = """
SELECT retailer, time_bucket(INTERVAL 1 HOUR, attempted_at) AS window_start, time_bucket(INTERVAL 1 HOUR, attempted_at) + INTERVAL 1 HOUR AS window_end, count(*) AS attempts, count(*) FILTER (success) AS successes,
  round(count(*) FILTER (success) / count(*), 6) AS success_rate FROM b_attempts GROUP BY ALL"""


def plain(df, *ts):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ts})


def timed(v):
    return v.b_attempts.withColumn("attempted_at", F.col("attempted_at").cast("timestamp"))


@query("ST5_hourly_rates_batch", RATES)
def hourly_batch(v):
    out = jobs.success_rates(timed(v), "attempted_at", "1 hour")
    return plain(out.withColumn("success_rate", F.round("success_rate", 6)),
                 "window_start", "window_end")


@query("ST5_daily_sliding_rates_batch", """
WITH h AS (SELECT retailer, time_bucket(INTERVAL 1 HOUR, attempted_at) AS s, count(*) AS n, count(*) FILTER (success) AS ok FROM b_attempts GROUP BY ALL),
o AS (SELECT unnest(range(24)) AS k)
SELECT retailer, s - to_hours(k) AS window_start, s - to_hours(k) + INTERVAL 24 HOUR AS window_end, sum(n)::BIGINT AS attempts, sum(ok)::BIGINT AS successes, round(sum(ok) / sum(n), 6) AS success_rate FROM h, o GROUP BY ALL""")
def sliding_batch(v):
    out = jobs.success_rates(timed(v), "attempted_at", "24 hours", "1 hour")
    return plain(out.withColumn("success_rate", F.round("success_rate", 6)),
                 "window_start", "window_end")


@query("ST5_hourly_rates_stream", RATES)
def hourly_stream(v):
    """Windows as they stand when the input ends: the last update of each, open ones too."""
    rates = jobs.success_rates(timed(StreamViews(v, ["events"])), "attempted_at", "1 hour")
    out = running.latest_updates(running.update_available(rates, *folders(v, "rates")), ["retailer", "window_start", "window_end"])
    return plain(out.withColumn("success_rate", F.round("success_rate", 6)), "window_start", "window_end")


SESSIONS = """
WITH e AS (SELECT concat('rev', CAST(user_id % 7 AS STRING)) AS reviewed_by, ts FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY reviewed_by ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY reviewed_by ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT reviewed_by, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS reviews FROM s GROUP BY reviewed_by, k"""


@query("ST6_review_sessions_batch", SESSIONS)
def sessions_batch(v):
    return plain(jobs.review_sessions(reviews(v), "reviewed_at"), "session_start", "session_end")


def reviews(v):
    return v.events.select(F.concat(F.lit("rev"), (F.col("user_id") % 7).cast("string"))
                           .alias("reviewed_by"), F.col("ts").cast("timestamp").alias("reviewed_at"))


@query("ST6_review_sessions_stream", SESSIONS)
def sessions_stream(v):
    out = running.update_available(reviews(StreamViews(v, ["events"])), *folders(v, "sessions"),
                                   apply=jobs.merged_sessions("reviewed_at"), mode="append")
    newest = out.agg(F.max("batch_id")).first()[0]
    return plain(out.filter(F.col("batch_id") == newest).drop("batch_id"), "session_start", "session_end")


@query("ST6_sessions_from_slots", SESSIONS)
def sessions_from_slots(v):
    slots = running.update_available(reviews(StreamViews(v, ["events"])), *folders(v, "slots"),
                                     apply=jobs.session_slots("reviewed_at"), mode="append")
    return plain(jobs.sessions_of_slots(slots), "session_start", "session_end")


@query("ST7_classify_micro_batches")
def classify_stream(v):
    live = StreamViews(v, ["lineitem"])
    apply = jobs.classify_and_queue(v.b_products, v.b_reviews, as_of(), "seq")
    listings = live.b_snapshots.filter("scan_type = 'monitor'")
    out = running.update_available(listings, *folders(v, "classified"), apply=apply, mode="append")
    return out.drop("batch_id")
