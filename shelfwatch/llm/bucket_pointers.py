"""Exact removal of repeated byte strings by sampled suffixes and bucket-pointer refinement.

A byte goes if it is covered by a string of LENGTH bytes that also starts anywhere else, in another document or the
same one. Sorting every suffix is not needed to find them: each such window selects an anchor inside it, the place of
its smallest hashed q-gram (the leftmost of equal ones), so equal windows select equal anchors at equal offsets.

1. Tasks cut every document into its anchors, about 2 in LENGTH - Q + 1 bytes, each with the stretch of windows that
   select it, the anchor's q-gram hash (its bucket) and a hash of the bytes that the stretch covers.
2. A bucket with one place repeats nothing. Places whose whole stretch stands elsewhere too are settled: all their
   windows go. What is left are places whose bucket is shared but whose stretch is not.
3. Only for those buckets, one stretch of bytes per distinct stretch is fetched, and the suffixes of a bucket's
   stretches are sorted by bucket-pointer refinement: 8-byte buckets are refined by the bucket numbers found 8 bytes
   further on, then 16, 32 and 64 with the updated numbers, and last at the offset that makes up LENGTH; suffixes that
   are alone in their bucket leave. Windows that still share a bucket go. Buckets of more than LARGE stretches are
   settled by grouping the windows themselves, which spreads them over all tasks.
4. Spans come back to their document, are merged, and the rest of its bytes is kept.

Equality of anchors, stretches and (in large buckets) windows is that of 64-bit hashes; step 3 compares bytes.
Null texts count as empty. Rows that repeat id and text are documents of their own and repeat each other. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.llm.common import STEP_BYTES, blank_null, sliced, staged
from shelfwatch.llm.shingles import _BASE, _BYTE, _INVERSE, _powers, bytes_of, mixed

LENGTH = 200
Q = 32
#: Distinct stretches a bucket may have to be sorted inside one task, and bytes sorted at a time.
LARGE = 20_000
BLOCK_BYTES = 4_000_000


class Hashed:
    """Hashes of any stretch of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.append(np.uint64(0), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64))
        self.back = _powers(_INVERSE, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, bucket, stretch hash, first and last window start) of each anchor of some concatenated documents."""
    if len(data) < LENGTH:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    hashed, width = Hashed(data), LENGTH - Q + 1
    place = np.arange(len(data) - Q + 1)
    gram = hashed(place, place + Q)
    least = (gram & ~np.uint64(0xFFFFFFFF)) | place.astype(np.uint64)
    k = 1
    while 2 * k <= width:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    if width > k:
        least = np.minimum(least[:k - width], least[width - k:])
    chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(chosen))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(start)]
    whole = start + LENGTH <= offsets[doc + 1]
    start, chosen, doc = start[whole], chosen[whole], doc[whole]
    if not len(start):
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    head = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])))
    first, last, doc = start[head], start[np.append(head[1:], len(start)) - 1], doc[head]
    return doc, gram[chosen[head]], hashed(first, last + LENGTH), first - offsets[doc], last - offsets[doc]


def refined(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True for those of the suffixes at ``starts`` whose first LENGTH bytes another of them shares."""
    padded = np.append(data, np.zeros(LENGTH, np.uint8)).astype(np.uint64)
    n = len(padded) - 7
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word = word << np.uint64(8) | padded[j:n + j]
    _, bucket, count = np.unique(word, return_inverse=True, return_counts=True)
    active, size = np.flatnonzero(count[bucket] > 1), 8
    bucket = np.append(bucket, np.zeros(LENGTH, np.int64))
    wanted = np.zeros(len(bucket), bool)
    wanted[starts] = True
    while True:
        step = min(size, LENGTH - size)
        size += step
        if size == LENGTH:
            active = active[wanted[active]]
        pair = bucket[active] << np.int64(32) | bucket[active + step]
        _, number, count = np.unique(pair, return_inverse=True, return_counts=True)
        shared = count[number] > 1
        if size == LENGTH:
            out = np.zeros(len(bucket), bool)
            out[active[shared]] = True
            return out[starts]
        fresh = bucket.copy()  # a suffix alone in its bucket keeps its number
        fresh[active] = number + bucket.max() + 1
        bucket, active = fresh, active[shared]


def _key(id_col: str, text: Column) -> Column:
    """Names a document; rows that repeat id and text share it."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places to compare with other batches (n > 0: how many this one stands for) and spans settled here (n = 0).

    Of places with the same stretch in a batch one goes on, so what a text or many texts repeat is a row per batch.
    """
    for batch in sliced(batches, "text", most=2 * STEP_BYTES):
        data, offsets = bytes_of(batch.column("text"))
        doc, bucket, stretch, first, last = anchors(data, offsets)
        if not len(doc):
            continue
        keys = batch.column("key").to_numpy()
        _, one, of, count = np.unique(stretch, return_index=True, return_inverse=True, return_counts=True)
        n = np.zeros(len(doc), np.int64)
        n[one] = count
        end = last + LENGTH
        at = np.flatnonzero(n == 0)  # neighbouring settled places make one span
        if len(at):
            head = np.flatnonzero(np.append(True, (doc[at[1:]] != doc[at[:-1]]) | (first[at[1:]] > end[at[:-1]])))
            tail = np.append(head[1:], len(at)) - 1
            end[at[head]] = end[at[tail]]
            at = at[head]
        rows = np.sort(np.append(one, at))
        for lo in range(0, len(rows), 100_000):
            r = rows[lo:lo + 100_000]
            yield pa.record_batch([pa.array(bucket[r].view(np.int64)), pa.array(stretch[r].view(np.int64)), pa.array(keys[doc[r]]),
                                   pa.array(first[r].astype(np.int32)), pa.array(end[r].astype(np.int32)), pa.array(n[r])], ["bucket", "stretch", "key", "first", "end", "n"])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted stretches of each text."""
    for batch in sliced(batches, "text", most=4 * STEP_BYTES):
        data, offsets = bytes_of(batch.column("text"))
        wanted = batch.column("wanted")
        for i in range(batch.num_rows):
            rows = wanted[i].as_py()
            raw = data[offsets[i]:offsets[i + 1]].tobytes()
            for at in range(0, len(rows), 5000):
                some = rows[at:at + 5000]
                yield pa.record_batch([pa.array([r["bucket"] for r in some], pa.int64()), pa.array([r["settled"] for r in some], pa.bool_()), pa.array([r["classes"] for r in some], pa.int64()),
                                       batch.column("key").slice(i, 1).take(pa.array([0] * len(some))), pa.array([r["first"] for r in some], pa.int32()),
                                       pa.array([raw[r["first"]:r["end"]] for r in some], pa.binary())], ["bucket", "settled", "classes", "key", "first", "bytes"])


def _runs(key: np.ndarray, first: np.ndarray, windows: np.ndarray, owner: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """Spans of neighbouring repeated windows; ``windows`` are starts inside the owner's stretch."""
    w, o = windows[hit], owner[hit]
    head = np.flatnonzero(np.append(True, (w[1:] != w[:-1] + 1) | (o[1:] != o[:-1]))) if len(w) else np.empty(0, np.int64)
    tail = np.append(head[1:], len(w)) - 1 if len(w) else head
    return pa.record_batch([pa.array(key[o[head]]), pa.array((first[o[head]] + w[head]).astype(np.int32)), pa.array((first[o[head]] + w[tail] + LENGTH).astype(np.int32))], ["key", "start", "end"])


def _stretch_windows(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(bytes, offsets, windows' starts inside their stretch, owner of each window) of some stretches."""
    offsets = np.append(0, np.cumsum([len(x) for x in column.to_pylist()])).astype(np.int64)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    n = np.diff(offsets) - LENGTH + 1
    owner = np.repeat(np.arange(len(n)), n)
    return data, offsets, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the unsettled stretches; rows come by bucket, and whole buckets are sorted at a time."""
    def settle(table: pa.Table) -> pa.RecordBatch:
        data, offsets, windows, owner = _stretch_windows(table.column("bytes").combine_chunks())
        hit = refined(data, offsets[owner] + windows) & ~table.column("settled").to_numpy()[owner]
        return _runs(table.column("key").to_numpy(), table.column("first").to_numpy(), windows, owner, hit)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) >= BLOCK_BYTES:
            table = pa.Table.from_batches(held)
            bucket = table.column("bucket").to_numpy()
            cut = int(np.flatnonzero(bucket == bucket[-1])[0])  # the last bucket may go on
            if cut:
                yield settle(table.slice(0, cut))
                held = table.slice(cut).to_batches()
    if held:
        yield settle(pa.Table.from_batches(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of every window of the stretches of large buckets."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            data, offsets, windows, owner = _stretch_windows(some.column("bytes"))
            begin = offsets[owner] + windows
            yield pa.record_batch([pa.array(Hashed(data)(begin, begin + LENGTH).view(np.int64)), some.column("key").take(pa.array(owner)),
                                   pa.array((some.column("first").to_numpy()[owner] + windows).astype(np.int32)), some.column("settled").take(pa.array(owner))], ["mark", "key", "start", "settled"])


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, start, end): byte spans to remove, overlapping ones not merged; ``key`` names a document."""
    text = blank_null(text_col)
    rows = docs.select(_key(id_col, text).alias("key"), text.alias("text"))
    cut = staged(rows.mapInArrow(_cut, "bucket long, stretch long, key long, first int, end int, n long"), "suffix-cut")
    here = cut.where("n = 0").select("key", F.col("first").alias("start"), "end")
    bucket, stretch = Window.partitionBy("bucket"), Window.partitionBy("bucket", "stretch")
    places = cut.where("n > 0").repartition("bucket").withColumns({
        "all": F.sum("n").over(stretch), "nth": F.row_number().over(stretch.orderBy("key", "first"))})
    places = places.withColumns({"in_bucket": F.sum("n").over(bucket), "unsettled": F.min("all").over(bucket) == 1,
                                 "classes": F.sum((F.col("nth") == 1).cast("long")).over(bucket)}).where("in_bucket > 1")
    places = staged(places.select("bucket", "key", "first", "end", "all", "classes", (F.col("unsettled") & (F.col("nth") == 1)).alias("fetch")), "suffix-places")
    settled = here.unionByName(places.where("all > 1").select("key", F.col("first").alias("start"), "end"))
    wanted = places.where("fetch").groupBy("key").agg(F.collect_list(F.struct("bucket", (F.col("all") > 1).alias("settled"), "classes", "first", "end")).alias("wanted"))
    bytes_ = rows.join(wanted, "key").select("key", "text", "wanted").mapInArrow(_fetched, "bucket long, settled boolean, classes long, key long, first int, bytes binary")
    bytes_ = staged(bytes_, "suffix-stretches")
    kind = "key long, start int, end int"
    sorted_ = bytes_.where(F.col("classes") <= LARGE).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sorted_out, kind)
    marks = bytes_.where(F.col("classes") > LARGE).mapInArrow(_windows, "mark long, key long, start int, settled boolean")
    again = marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1")
    large = marks.where("not settled").join(again, "mark", "left_semi").select("key", "start", (F.col("start") + LENGTH).alias("end"))
    return settled.unionByName(sorted_).unionByName(large)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (bytes) of each row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    text = blank_null(text_col)
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = docs.select(F.col(id_col).alias("id"), _key(id_col, text).alias("key"), text.alias("text")).join(spans, "key", "left").select("id", "text", "spans")
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", most=4 * STEP_BYTES):
            data, offsets = bytes_of(batch.column("text"))
            sizes, gone, runs, kept = np.diff(offsets), [], [], []
            for i in range(batch.num_rows):
                own, spans = data[offsets[i]:offsets[i + 1]], batch.column("spans")[i]
                if not spans.is_valid:
                    gone.append(0), runs.append(0), kept.append(own.tobytes())
                    continue
                start, end = (spans.values.field(c).to_numpy() for c in ("start", "end"))
                cover = np.cumsum(np.bincount(start, minlength=len(own) + 1) - np.bincount(end, minlength=len(own) + 1))[:-1] > 0
                gone.append(int(cover.sum()))
                runs.append(int(np.count_nonzero(cover & ~np.append(False, cover[:-1]))))
                kept.append(own[~cover].tobytes())
            yield pa.record_batch([batch.column("id"), pa.array(sizes), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], schema=arrow)

    return rows.mapInArrow(removed, schema).select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
