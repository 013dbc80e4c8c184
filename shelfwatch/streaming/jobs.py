"""Streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions.urls import url_key_v3
from shelfwatch.operators import changes, linking, ordered, review
from shelfwatch.plans import monitor
from shelfwatch.session import staged
from shelfwatch.sources.buckets import BucketTable
from shelfwatch.streaming.running import latest_updates, use_rocksdb


def snapshot_stream(listings: DataFrame, category: Column) -> DataFrame:
    """Snapshot rows of arriving listings, stamped with the date they were found."""
    return changes.snapshot_rows(listings, category, F.col("discovered_date"))


#: Stands for a missing time; no sight with a time is near it.
_NO_TIME = -(1 << 62)


def _sights(listings: DataFrame, ts: str, url: str) -> DataFrame:
    return listings.withColumns({"url_key": url_key_v3(F.col(url)), "event_micros": F.coalesce(F.unix_micros(F.col(ts)), F.lit(_NO_TIME))})


def _micros(spark, freshness: str) -> int:
    return spark.sql(f"SELECT timestampdiff(MICROSECOND, TIMESTAMP '1970-01-01', TIMESTAMP '1970-01-01' + INTERVAL {freshness}) AS n").first().n


def suppress_repeats(listings: DataFrame, ts: str, freshness: str = "24 hours",
                     url: str = "url") -> DataFrame:
    """Sights of each listing, without repeats inside the freshness time of one that was kept; appends only.

    Rows of a micro-batch are taken in event order. State is all kept times of a url (they do not expire), so a late row
    is kept unless a kept sight lies less than the freshness time before or after it. What has been appended stays, so a
    late row shortly before a kept sight counts as its repeat; :func:`kept_sights` has the same answer for any batches.
    Of a url's rows without a time one is kept. The result has url_key and the time column, and whatever else the rows
    of that sight have.
    """
    import bisect

    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    use_rocksdb(listings.sparkSession)
    rows = _sights(listings, ts, url)
    columns = [c for c in rows.columns if c != "event_micros"]
    schema = rows.select(*columns).schema
    span = _micros(listings.sparkSession, freshness)

    class KeptTimes(StatefulProcessor):
        def init(self, handle):
            self.times = handle.getListState("times", "micros bigint")

        def handleInputRows(self, key, rows, timerValues):
            batch = pd.concat(list(rows)).sort_values("event_micros", kind="stable")
            held, kept, new = sorted(t[0] for t in self.times.get()), [], []
            for i, t in enumerate(batch["event_micros"].tolist()):
                at = bisect.bisect_right(held, t)
                if (at and t - held[at - 1] < span) or (at < len(held) and held[at] - t < span):
                    continue
                held.insert(at, t)
                kept.append(i)
                new.append((t,))
            if kept:
                self.times.appendList(new)
                yield batch.iloc[kept][columns]

        def close(self):
            pass

    return rows.groupBy("url_key").transformWithStateInPandas(
        statefulProcessor=KeptTimes(), outputStructType=schema, outputMode="append", timeMode="none")


def kept_sights(ts: str, freshness: str = "24 hours", url: str = "url"):
    """Function for one micro-batch of listings: all sights as they stand after it, with ``kept`` false for repeats.

    Each version has every sight, so the kept ones are those of all rows in event order (then by a hash of the row),
    whatever micro-batches they came in. A sight is a repeat inside the freshness time of a kept one before it; of a url's
    rows without a time one is kept. A url's sights are spread over tasks by time, as in :func:`sight_log`; old versions
    may be removed.
    """
    def apply(batch: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
        rows = _sights(batch, ts, url).withColumn("event_hash", F.xxhash64(*batch.columns))
        if earlier is not None:
            newest = earlier.agg(F.max("batch_id")).first()[0]
            rows = rows.unionByName(earlier.filter(F.col("batch_id") == newest).select(*rows.columns))
        spot = ["url_key", "event_micros"]
        rows = staged(rows, "sights")
        points = ordered.spaced(rows.select(*spot).distinct(), *spot, _micros(batch.sparkSession, freshness))
        nth = F.row_number().over(Window.partitionBy(*spot).orderBy("event_hash"))
        marked = ordered._same(rows.withColumn("_nth", nth), points, spot)
        return marked.withColumn("kept", F.col("kept") & (F.col("_nth") == 1)).drop("_nth")

    return apply


def sight_log(ts: str, freshness: str = "24 hours", url: str = "url", buckets: int = 256):
    """Function for one micro-batch of listings: rows of a log whose last state has the kept sights (:func:`kept_in_log`).

    As :func:`kept_sights`, without writing older sights again: a batch adds its own sights (one row per url and time,
    of several rows of one time that of the smallest hash) and the earlier ones of which it changes the verdict. Earlier
    sights are read for its urls alone, from the folders of their buckets (the stream is run with ``by=["bucket"]``), and
    a url's sights are spread over tasks by time (:func:`~shelfwatch.operators.ordered.spaced`). Any order of files gives
    the same kept sights.
    """
    def apply(batch: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
        spot = ["url_key", "event_micros"]
        rows = _sights(batch, ts, url).withColumn("event_hash", F.xxhash64(*batch.columns))
        rest = [c for c in rows.columns if c not in (*spot, "event_hash")]
        held = F.struct("event_hash", *rest)
        bucket = F.pmod(F.xxhash64("url_key"), F.lit(buckets)).cast("int").alias("bucket")
        now = staged(rows.groupBy(*spot).agg(F.min_by(held, "event_hash").alias("held")).select("*", bucket), "sights")
        span = _micros(batch.sparkSession, freshness)
        if earlier is None:
            both = now.withColumns({"was": F.lit(None).cast("boolean"), "old_hash": F.lit(None).cast("bigint")})
        else:
            touched = now.filter("bucket >= 0").select("bucket").distinct()  # at most ``buckets`` numbers: small enough to broadcast
            past = earlier.join(F.broadcast(touched), "bucket", "left_semi")  # prunes the folders when it runs
            past = ordered._same(past, now.select("url_key").distinct(), ["url_key"], "left_semi")
            past = past.groupBy(*spot, "bucket").agg(F.max_by(F.struct("kept", held.alias("held")), "batch_id").alias("m"))
            past = past.select(*spot, "bucket", "m.held", F.col("m.kept").alias("was"))
            both = now.withColumn("was", F.lit(None).cast("boolean")).unionByName(past)
            both = staged(both.groupBy(*spot, "bucket").agg(
                F.min_by("held", F.col("held.event_hash")).alias("held"), F.max("was").alias("was"),
                F.max_by(F.col("held.event_hash"), F.col("was").isNotNull()).alias("old_hash")), "sights")
        marked = ordered._same(both, ordered.spaced(both.select(*spot), *spot, span), spot)
        news = F.col("was").isNull() | (F.col("was") != F.col("kept")) | (F.col("old_hash") != F.col("held.event_hash"))
        return marked.filter(news).select(*spot, "bucket", "kept", "held.*")

    return apply


def kept_in_log(log: DataFrame) -> DataFrame:
    """The kept sights among the folders that a stream of :func:`sight_log` wrote."""
    rest = [c for c in log.columns if c not in ("url_key", "event_micros", "bucket", "batch_id", "kept", "event_hash")]
    last = log.groupBy("url_key", "event_micros").agg(F.max_by(F.struct("kept", *rest), "batch_id").alias("m"))
    return last.filter("m.kept").select("url_key", *[F.col(f"m.{c}").alias(c) for c in rest])


def last_price_alerts(state: str, min_change: float = 0.01, buckets: int = 256, block: str = "1 hour"):
    """Function for one numbered micro-batch of listings: changes against the last price seen per listing.

    Columns and results as :func:`price_alerts`, without Python. The last price of each url lies in a bucket table at
    ``state``, of which a batch reads and rewrites the buckets its urls lie in; a batch's rows are compared with the row
    before by a lag inside ``block`` of time, one summary row per url and block carrying the price across, so that a url
    may hold any share of a batch. Rows before the stored one are late and ignored; null times and numbers come first.
    For :func:`~shelfwatch.streaming.running.stateful_available`.
    """
    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("catalog_url").agg(F.max(F.struct("micros", "seq", "price")).alias("m")).select("catalog_url", "m.*")

    def apply(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        rows = staged(batch.filter(F.coalesce("price", F.lit(0.0)) != 0).select(
            "catalog_url", F.coalesce(F.unix_micros(F.col("seen_at").cast("timestamp")), F.lit(_NO_TIME)).alias("micros"),
            F.coalesce("seq", F.lit(_NO_TIME)).cast("bigint").alias("seq"), F.col("price").cast("double").alias("price")), "prices")
        if number == 0:
            empty = spark.createDataFrame([], "catalog_url string, micros bigint, seq bigint, price double")
            table = BucketTable.create(empty, state, ["catalog_url"], buckets) if not _made(spark, state) else BucketTable(spark, state)
        else:
            table = BucketTable(spark, state)
        base = table.version(number)
        held = table.read(base, table.touched(rows))
        if held.isEmpty():  # no url has a price before this batch
            live = rows.withColumn("_new", F.lit(1))
        else:
            known = held.select("catalog_url", F.struct("micros", "seq").alias("_held"))
            live = ordered._same(rows, known, ["catalog_url"], "left").filter(
                F.col("_held").isNull() | (F.struct("micros", "seq") >= F.col("_held"))).drop("_held")
            live = staged(live.withColumn("_new", F.lit(1)).unionByName(
                ordered._same(held, rows.select("catalog_url").distinct(), ["catalog_url"], "left_semi").withColumn("_new", F.lit(0))), "prices")
        table.upsert(live.filter("_new = 1").drop("_new"), lambda old, new: newest(old.unionByName(new)), at=number)
        width = _micros(spark, block)
        cut = live.withColumn("_block", F.col("micros") - F.pmod(F.col("micros"), F.lit(width)))
        seen = ordered.with_previous(cut, ["catalog_url"], ["_block"], ["micros", "seq", "_new", "price"], "price", "old_price")
        return seen.filter((F.col("_new") == 1) & (F.abs(F.col("price") - F.col("old_price")) >= min_change)).select(
            "catalog_url", "micros", "seq", "old_price", F.col("price").alias("new_price"))

    return apply


def _made(spark, path: str) -> bool:
    """A table of an earlier try of the first micro-batch."""
    try:
        return not spark.read.text(f"{path}/table").isEmpty()
    except AnalysisException:
        return False


def price_alerts(listings: DataFrame, min_change: float = 0.01, buckets: int = 4096) -> DataFrame:
    """Changes against the last price seen per listing.

    Needs ``catalog_url``, ``seen_at`` (timestamp), ``seq`` and ``price``. A row
    older than the stored one is late and ignored. Rows of one url inside a
    micro-batch are taken in (seen_at, seq) order, nulls first; the size of a
    micro-batch bounds what a hot url can bring to one task. The last prices of
    a hash bucket of urls are one list of state, so that Python is called once
    per bucket and micro-batch and not per url; a touched bucket's list is read
    and written whole. A checkpoint of the form with a state per url does not
    fit.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    use_rocksdb(listings.sparkSession)

    class LastPrices(StatefulProcessor):
        def init(self, handle):
            self.last = handle.getListState("last", "catalog_url string, price double, micros bigint, seq bigint")

        def handleInputRows(self, key, rows, timerValues):
            seen = sorted((r for part in rows for r in zip(*(part[c].tolist() for c in ("micros", "seq", "price", "catalog_url")))),
                          key=lambda r: r[:3])
            last, out = {r[0]: tuple(r[1:]) for r in self.last.get()}, []
            for micros, seq, price, url in seen:
                held = last.get(url)
                if held is not None and (micros, seq) < held[1:]:
                    continue
                if held is not None and abs(price - held[0]) >= min_change:
                    out.append((url, micros, seq, held[0], price))
                last[url] = (price, micros, seq)
            self.last.put([(url, *held) for url, held in last.items()])
            if out:
                yield pd.DataFrame(out, columns=["catalog_url", "micros", "seq", "old_price",
                                                 "new_price"])

        def close(self):
            pass

    rows = listings.filter(F.coalesce("price", F.lit(0.0)) != 0).select(
        "catalog_url", F.coalesce(F.unix_micros(F.col("seen_at").cast("timestamp")), F.lit(_NO_TIME)).alias("micros"),
        F.coalesce("seq", F.lit(_NO_TIME)).alias("seq"), "price",
        F.pmod(F.xxhash64("catalog_url"), F.lit(buckets)).alias("bucket"))
    found = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=LastPrices(),
        outputStructType="catalog_url string, micros bigint, seq bigint, old_price double, "
                         "new_price double",
        outputMode="append", timeMode="none")
    return found.withColumns({c: F.nullif(c, F.lit(_NO_TIME)) for c in ("micros", "seq")})


def retailer_state():
    """Function for one micro-batch of attempts: running linking policy of each retailer it holds.

    A batch is folded by aggregates (first attempt, best success, counts) and then joined to the policy before it, one
    row per retailer; nothing is gathered, so a retailer may hold any share of the rows.
    """
    held = ["sample_size", "url_changes_detected", "best_dedup_method", "dedup_confidence_threshold"]

    def apply(batch: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
        best = F.when(F.col("success"), F.struct("confidence", (-F.col("seq")).alias("early"), "method"))
        new = batch.groupBy("retailer").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("url_changed").alias("changes"),
            F.min(F.struct("seq", "method", "confidence")).alias("first"), F.max(best).alias("best"))
        if earlier is None:
            rows = new.withColumn("old", F.lit(None).cast(
                "struct<sample_size bigint, url_changes_detected bigint, best_dedup_method string, dedup_confidence_threshold double>"))
        else:
            rows = new.join(latest_updates(earlier, ["retailer"]).select("retailer", F.struct(*held).alias("old")), "retailer", "left")
        level = F.coalesce("old.dedup_confidence_threshold", "first.confidence")
        better = F.coalesce(F.col("best.confidence") > level, F.lit(False))
        return rows.select(
            "retailer", (F.coalesce("old.sample_size", F.lit(0)) + F.col("n")).alias(held[0]),
            (F.coalesce("old.url_changes_detected", F.lit(0)) + F.col("changes")).alias(held[1]),
            F.when(better, F.col("best.method")).otherwise(F.coalesce("old.best_dedup_method", "first.method")).alias(held[2]),
            F.when(better, F.col("best.confidence")).otherwise(level).alias(held[3]))

    return apply


def success_rates(attempts: DataFrame, ts: str, width: str, slide: str | None = None,
                  late: str = "1 hour") -> DataFrame:
    """Attempts and success rate per retailer and time window; one plan for both modes."""
    n, ok = F.count(F.lit(1)), F.count_if("success")
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (attempts.withWatermark(ts, late).groupBy(window.alias("w"), "retailer")
            .agg(n.alias("attempts"), ok.alias("successes"))
            .select("retailer", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "attempts", "successes",
                    (F.col("successes") / F.col("attempts")).alias("success_rate")))


def review_sessions(reviews: DataFrame, ts: str, gap: str = "30 minutes",
                    late: str = "1 hour") -> DataFrame:
    """Review sessions per reviewer: bursts without a pause longer than the gap."""
    return (reviews.withWatermark(ts, late)
            .groupBy(F.session_window(ts, gap).alias("w"), "reviewed_by")
            .agg(F.count(F.lit(1)).alias("reviews"))
            .select("reviewed_by", F.col("w.start").alias("session_start"),
                    F.col("w.end").alias("session_end"), "reviews"))


def merged_sessions(ts: str, gap: str = "30 minutes"):
    """Function for one micro-batch of reviews: all sessions as they stand after it.

    A batch's rows are first brought down to one row per reviewer and burst, then merged with the sessions of the
    version before, so a busy reviewer costs a few rows; late rows join what they touch. Open sessions are part of every
    version, so nothing is left behind when the input ends.
    """
    def apply(batch: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
        new = (batch.groupBy(F.session_window(ts, gap).alias("w"), "reviewed_by").agg(F.count(F.lit(1)).alias("reviews"))
               .select("reviewed_by", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "reviews"))
        if earlier is None:
            return new
        newest = earlier.agg(F.max("batch_id")).first()[0]
        rows = new.unionByName(earlier.filter(F.col("batch_id") == newest).select(new.columns))
        order = Window.partitionBy("reviewed_by").orderBy("session_start", "session_end")
        reach = F.max("session_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        first = F.coalesce((F.col("session_start") >= reach).cast("int"), F.lit(1))  # a session ends one gap after its last review
        rows = rows.withColumn("_first", first).withColumn("_nth", F.sum("_first").over(order))
        return rows.groupBy("reviewed_by", "_nth").agg(
            F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
            F.sum("reviews").alias("reviews")).drop("_nth")

    return apply


def session_slots(ts: str, gap: str = "30 minutes"):
    """Function for one micro-batch of reviews: its first and last review and their number per reviewer and slot of time.

    A slot is as long as the gap, so its reviews are of one session whatever comes later, and the slots of several
    batches add up. A batch writes its own slots and reads nothing; :func:`sessions_of_slots` makes the sessions, so a late
    row extends, joins or opens them. A pause of the gap or more ends a session. Reviews without a time are of no session.
    """
    def apply(batch: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        width = _micros(batch.sparkSession, gap)
        rows = batch.select("reviewed_by", micros.alias("at")).filter("at IS NOT NULL")
        return rows.groupBy("reviewed_by", (F.col("at") - F.pmod(F.col("at"), F.lit(width))).alias("slot")).agg(
            F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("reviews"))

    return apply


def sessions_of_slots(slots: DataFrame, gap: str = "30 minutes", block: str = "1 day") -> DataFrame:
    """Review sessions per reviewer from the slots that batches have written.

    Slots of a reviewer are joined inside blocks of time (a day has 48 of half an hour at most). Blocks are then chained by
    one summary row each, which says where its last session began if that may go on in the next one; only these meet by
    reviewer, so a reviewer may hold any share of the reviews.
    """
    span, width = _micros(slots.sparkSession, gap), _micros(slots.sparkSession, block)
    rows = slots.groupBy("reviewed_by", "slot").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("reviews").alias("reviews"))
    rows = rows.withColumn("_block", F.col("slot") - F.pmod(F.col("slot"), F.lit(width)))
    inside = Window.partitionBy("reviewed_by", "_block").orderBy("slot")
    opens = F.coalesce(F.col("first_at") - F.lag("last_at").over(inside) >= span, F.lit(True))
    rows = rows.withColumn("_opens", opens.cast("int")).withColumn("_nth", F.sum("_opens").over(inside))
    pieces = rows.groupBy("reviewed_by", "_block", "_nth").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("reviews").alias("reviews"))
    blocks = pieces.groupBy("reviewed_by", "_block").agg(
        F.min("first_at").alias("head"), F.max("last_at").alias("tail"), F.max("_nth").alias("n"), F.max("first_at").alias("tail_start"))
    chain = Window.partitionBy("reviewed_by").orderBy("_block")
    goes_on = F.coalesce(F.col("head") - F.lag("tail").over(chain) < span, F.lit(False))
    blocks = blocks.withColumn("_goes_on", goes_on)
    # where the session that reaches the end of a block began: in the last block that has a beginning of it
    began = F.when((F.col("n") > 1) | ~F.col("_goes_on"), F.col("tail_start"))
    blocks = blocks.withColumn("_began", F.last(began, ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, -1)))
    heads = blocks.select("reviewed_by", "_block", F.when(F.col("_goes_on"), F.col("_began")).alias("_start"))
    joined = ordered._same(pieces, heads, ["reviewed_by", "_block"])
    start = F.when(F.col("_nth") == 1, F.coalesce("_start", "first_at")).otherwise(F.col("first_at"))
    return joined.groupBy("reviewed_by", start.alias("_start")).agg(
        F.max("last_at").alias("_last"), F.sum("reviews").alias("reviews")).select(
        "reviewed_by", F.timestamp_micros("_start").alias("session_start"),
        F.timestamp_micros(F.col("_last") + span).alias("session_end"), "reviews")


def classify_and_queue(products: DataFrame, queue: DataFrame, as_of: Column, seq: str):
    """Function for one micro-batch: listings and what earlier batches queued in, queue rows to append out.

    New listings go to review, suspected duplicates to the duplicate queue; one
    item per (product_url, review_type), whatever batches the listings come in.
    """
    keys = ["product_url", "review_type"]

    def apply(batch: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
        items, _ = monitor.new_items(linking.classify_listings(batch, products), seq)
        known = queue.select(*keys)
        if earlier is not None:
            known = known.unionByName(earlier.select(*keys))
        return review.add_to_queue(known, items, as_of, seq)

    return apply
