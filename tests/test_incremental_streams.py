"""Streams whose batches write what they change: same rows as plain loops for any split of the input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import ordered
from shelfwatch.streaming import jobs, running

START = dt.datetime(2025, 1, 1)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def greedy(times, span):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= span:
            kept.append(t)
    return kept


@pytest.mark.parametrize("light_rows", [0, 20, 10_000])
def test_spaced_points_equal_the_plain_loop(spark, light_rows):
    pick = random.Random(light_rows)
    points = {("a", t) for t in range(0, 3000, 3)} | {("b", pick.randrange(-500, 9000)) for _ in range(400)}
    points |= {("c", -(1 << 62)), ("c", 5), ("c", 105), ("d", 7), (None, 0), (None, 99), (None, 100)}
    got = ordered.spaced(spark.createDataFrame(sorted(points, key=str), "k string, at bigint"), "k", "at", 100, light_rows).collect()
    assert len(got) == len(points)
    for key in {k for k, _ in points}:
        assert sorted(r["at"] for r in got if r.k == key and r.kept) == greedy([t for k, t in points if k == key], 100), key


def test_spaced_points_of_no_rows(spark):
    assert ordered.spaced(spark.createDataFrame([], "k string, at bigint"), "k", "at", 10).collect() == []


@pytest.mark.parametrize("parts", [1, 4])
def test_kept_sights_in_a_log_for_any_order_of_files(spark, tmp_path, parts):
    schema = "url string, seen_at timestamp, note int"
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    hours = (120, 20, 3000, 40, 0, 24, None, 121, 47, None, 0, 24)
    rows = [("https://s.com/a?x", None if h is None else START + dt.timedelta(hours=h), i) for i, h in enumerate(hours)]
    rows.append((None, START, 0))
    written = []
    for k in range(parts):
        put(spark, src, rows[k::parts], schema)
        stream = spark.readStream.schema(schema).parquet(src)
        log = running.update_available(stream, out, chk, apply=jobs.sight_log("seen_at", buckets=4), mode="append", by=["bucket"])
        written.append(log.filter(F.col("batch_id") == k).count())
    kept = jobs.kept_in_log(log).collect()
    times = [r.seen_at for r in kept if r.url]
    assert times.count(None) == 1 and sum(r.url is None for r in kept) == 1
    assert sorted(round((t - START).total_seconds() / 3600) for t in times if t) == [0, 24, 120, 3000]
    again = running.update_available(stream, out, chk, apply=jobs.sight_log("seen_at", buckets=4), mode="append", by=["bucket"])
    assert again.count() == sum(written)


def test_a_batch_of_sights_writes_its_own_rows(spark, tmp_path):
    schema = "url string, seen_at timestamp"
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    put(spark, src, [(f"https://s.com/{i % 50}", START + dt.timedelta(hours=i)) for i in range(500)], schema)
    run = lambda: running.update_available(spark.readStream.schema(schema).parquet(src), out, chk,
                                           apply=jobs.sight_log("seen_at", buckets=8), mode="append", by=["bucket"])
    run()
    put(spark, src, [("https://s.com/3", START + dt.timedelta(hours=600)), ("https://s.com/new", START)], schema)
    assert run().filter("batch_id = 1").count() == 2


def alerts_of(rows, batches):
    """Plain loop over batches: sorted rows of each url, those before the held one left out."""
    held, out = {}, []
    for part in batches:
        for url, at, seq, price in sorted((rows[i] for i in part), key=lambda r: (r[1], r[2], r[3])):
            if not price or (url in held and (at, seq) < held[url][:2]):
                continue
            if url in held and abs(price - held[url][2]) >= 0.01:
                out.append((url, seq, held[url][2], price))
            held[url] = (at, seq, price)
    return sorted(out)


@pytest.mark.parametrize("parts, shuffled", [(1, False), (3, False), (3, True)])
def test_alerts_from_last_prices_in_buckets(spark, tmp_path, parts, shuffled):
    schema = "catalog_url string, seen_at timestamp, seq bigint, price double"
    src, out, chk, state = (str(tmp_path / n) for n in ("in", "out", "chk", "state"))
    pick = random.Random(parts)
    rows = [("hot" if i % 3 else f"u{i % 5}", START + dt.timedelta(minutes=20 * (i // 2)), i, pick.choice([0.0, 5.0, 5.005, 6.0, 7.0])) for i in range(90)]
    rows += [("hot", START + dt.timedelta(minutes=600), 400, 5.0), ("hot", START + dt.timedelta(minutes=600), 400, 9.0)]  # a tie
    order = list(range(len(rows)))
    order.sort(key=lambda i: rows[i][1:3])
    if shuffled:
        pick.shuffle(order)
    size = -(-len(order) // parts)
    batches = [order[lo:lo + size] for lo in range(0, len(order), size)]
    for part in batches:
        put(spark, src, [rows[i] for i in part], schema)
        stream = spark.readStream.schema(schema).parquet(src)
        got = running.stateful_available(stream, out, chk, jobs.last_price_alerts(state, buckets=4))
    assert sorted((r.catalog_url, r.seq, r.old_price, r.new_price) for r in got.collect()) == alerts_of(rows, batches)
    if not shuffled:
        assert alerts_of(rows, batches) == alerts_of(rows, [order])
    # a batch that runs again, its state already written, gives the rows it gave
    last = spark.createDataFrame([rows[i] for i in batches[-1]], schema)
    again = jobs.last_price_alerts(state, buckets=4)(last, len(batches) - 1)
    want = got.filter(F.col("batch_id") == len(batches) - 1).drop("batch_id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))


def sessions_of(rows):
    """Plain loop: a pause of half an hour or more ends a session."""
    gap, out = dt.timedelta(minutes=30), []
    for who, at in sorted((r for r in rows if r[1]), key=lambda r: (r[0] or "", r[1])):
        if out and out[-1][0] == who and at - out[-1][2] < gap:
            out[-1][2], out[-1][3] = at, out[-1][3] + 1
        else:
            out.append([who, at, at, 1])
    return sorted(((who, first, last + gap, n) for who, first, last, n in out), key=str)


@pytest.mark.parametrize("parts", [1, 10])
def test_sessions_from_slots_do_not_depend_on_the_batches(spark, tmp_path, parts):
    schema = "reviewed_by string, reviewed_at timestamp"
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    pick = random.Random(2)
    rows = [(f"r{i % 2}", START + dt.timedelta(seconds=pick.randrange(400_000))) for i in range(300)]
    rows += [("long", START + dt.timedelta(minutes=29 * i)) for i in range(160)]  # over three days without a pause
    rows += [("edge", START + dt.timedelta(minutes=m)) for m in (0, 30, 59, 1439, 1441, 1471)] + [(None, START), ("r0", None)]
    pick.shuffle(rows)
    for k in range(parts):
        put(spark, src, rows[k::parts], schema)
        stream = spark.readStream.schema(schema).parquet(src)
        got = running.update_available(stream, out, chk, apply=jobs.session_slots("reviewed_at"), mode="append")
    have = jobs.sessions_of_slots(got)
    assert sorted(map(tuple, have.collect()), key=str) == sessions_of(rows)


def test_batches_of_reviews_write_little(spark, tmp_path):
    schema = "reviewed_by string, reviewed_at timestamp"
    rows = [(f"r{i % 7}", START + dt.timedelta(minutes=37 * (i // 7), seconds=i)) for i in range(1400)]
    apply, written = jobs.session_slots("reviewed_at"), 0
    for k in range(0, 1400, 350):
        batch = spark.createDataFrame(rows[k:k + 350], schema)
        written += apply(batch).count()
    whole = jobs.sessions_of_slots(apply(spark.createDataFrame(rows, schema))).count()
    assert whole == 1400 and written <= 3 * whole
