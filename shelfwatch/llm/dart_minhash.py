"""Near-duplicate detection with DartMinHash signatures.

A text is the multiset of its five-word shingles; similarity is the weighted Jaccard similarity, a link is 0.8 or more.

Signatures. Every unit of an element's weight is a region onto which darts are thrown: a Poisson stream of ranks that
depends on nothing but the hashed element and unit, so equal regions of two texts get equal darts. Only darts whose
rank is below t / weight(text) are thrown, about t = k ln k + 2k whatever the text's length; each falls on one of k
coordinates and the earliest dart of a coordinate is its value. Texts left with an empty coordinate throw further.

Joining. Exact copies collapse first (a 128-bit digest of the lower-cased text). BANDS bands of ROWS values
are bucket keys; a pair at 0.8 shares no bucket with probability 5e-5. Inside a bucket no pairs are multiplied out.
First every text is compared with the bucket's most popular text (the one with the largest buckets overall, which in a
group of copies is the one nearest to all) and with its neighbours in the order of the rest of the signature; buckets
of at most SMALL texts are thereby compared in full. Signatures discard pairs far below 0.8, the rest are compared
shingle by shingle on whole texts. In buckets that these links leave in more than one part, the texts outside the
lead's part are then compared with all others, BLOCK by BLOCK, as products of two matrices; only links come out, one
for each text and part. So no bucket is cut short, and a group costs more than its size only where it is not one
class. Classes are the connected components of the links.

Null texts count as empty; texts without words are copies of each other only if equal. The class id is the smallest
doc_id of the class, and that document stays; repeated rows with one id count as one document. Rows without an id are
not compared and stay. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import STEP_BYTES, blank_null, sliced, staged, staged_few, tidy
from shelfwatch.llm.components import components
from shelfwatch.llm.shingles import mixed, shingles

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
#: Pairs whose signatures agree less than this are not read again (four standard deviations below 0.8).
SKETCH_LEAST = 0.65
#: Buckets of at most so many texts are compared in full; in larger ones so many neighbours are looked at.
SMALL, NEIGHBOURS = 8, 4
#: Texts a side has in a block of the full comparison, and shingles a matrix has at a time.
BLOCK = 256
COLUMNS = 5_000
#: Times a text is longer than compressed, about.
PACKED = 3

_STEP, _SIDE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def units(element: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One key per unit of weight: the element's hash with the number of its earlier occurrences in the same text."""
    order = np.lexsort((element, owner))
    element, owner = element[order], owner[order]
    new = np.append(True, (element[1:] != element[:-1]) | (owner[1:] != owner[:-1]))
    start = np.flatnonzero(new)
    nth = np.arange(len(element)) - np.repeat(start, np.diff(np.append(start, len(element))))
    return mixed(element + nth.astype(np.uint64) * _SIDE), owner


def signatures(element: np.ndarray, owner: np.ndarray, n: int, k: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """(n x k values, whether a text has one): the earliest dart of each coordinate."""
    key, owner = units(element, owner)
    weight = np.bincount(owner, minlength=n)
    value, has = np.zeros((n, k), np.uint64), weight > 0
    reach, todo = k * np.log(k) + 2 * k, has.copy()
    while todo.any():
        at = todo[owner]
        live_key, live_owner = key[at], owner[at]
        limit = reach / weight[live_owner]
        rank, throw = np.zeros(len(live_key)), np.uint64(0)
        spots, ranks, darts = [], [], []
        while len(live_key):
            with np.errstate(over="ignore"):
                throw += np.uint64(1)
                h = mixed(live_key + throw * _STEP)
            rank = rank - np.log((h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54)
            on = np.flatnonzero(rank < limit)
            live_key, live_owner, limit, rank, h = live_key[on], live_owner[on], limit[on], rank[on], h[on]
            dart = mixed(h ^ _SIDE)
            spots.append(live_owner * k + (dart >> np.uint64(33)).astype(np.int64) % k)
            ranks.append(rank)
            darts.append(dart)
        spot, rank, dart = (np.concatenate(x) for x in (spots, ranks, darts))
        best = np.full(n * k, np.inf)
        np.minimum.at(best, spot, rank)
        first = rank == best[spot]
        flat = np.zeros(n * k, np.uint64)
        flat[spot[first]] = dart[first]
        full = todo & np.isfinite(best).reshape(n, k).all(1)
        value[full] = flat.reshape(n, k)[full]
        todo &= ~full
        reach *= 2
    return value, has


def _bands(value: np.ndarray) -> np.ndarray:
    factor = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
    return mixed((value * factor).reshape(len(value), BANDS, ROWS).sum(2) + np.arange(BANDS, dtype=np.uint64) * _STEP)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        element, owner = shingles(batch.column("text"), WIDTH)
        value, has = signatures(element, owner, batch.num_rows)
        bands = _bands(value).view(np.int64)
        sketch = (value & np.uint64(0xFF)).astype(np.uint8)
        yield pa.record_batch([batch.column("id"), batch.column("copy"), pa.array([b if h else [] for b, h in zip(bands, has)], pa.list_(pa.int64())),
                               pa.array([s.tobytes() for s in sketch], pa.binary())], ["id", "copy", "bands", "sketch"])


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are about to be shuffled more than once."""
    for batch in sliced(batches, "text"):
        packed = [zlib.compress(t.encode(), 1) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("id"), pa.array(packed, pa.binary())], ["id", "packed"])


def _agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity that two signatures of one byte a coordinate point to."""
    return ((left == right).mean(1) - 1 / 256) / (1 - 1 / 256)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a sorted partition: each row with its bucket's lead and with the rows after it."""
    keep = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if keep is None else [*keep.to_batches(), batch]).combine_chunks()
        old = 0 if keep is None else keep.num_rows
        id_, group, bucket, size, lead = (table.column(c).to_numpy() for c in ("id", "component", "bucket", "size", "lead"))
        lead_group = table.column("lead_component").to_numpy()
        sketch, lead_sketch = (_matrix(table.column(c).combine_chunks()) for c in ("sketch", "lead_sketch"))
        out = []
        at = np.arange(old, len(id_))
        at = at[(group[at] != lead_group[at]) & (id_[at] != lead[at])]
        out.append((id_[at], lead[at], sketch[at], lead_sketch[at]))
        for d in range(1, SMALL):
            b = np.arange(max(old, d), len(id_))
            a = b - d
            ok = (bucket[a] == bucket[b]) & (group[a] != group[b]) & ((d <= NEIGHBOURS) | (size[b] <= SMALL))
            out.append((id_[a[ok]], id_[b[ok]], sketch[a[ok]], sketch[b[ok]]))
        for a, b, x, y in out:
            if len(a):
                near = _agreement(x, y) >= SKETCH_LEAST
                yield pa.record_batch([pa.array(np.minimum(a, b)[near]), pa.array(np.maximum(a, b)[near])], ["a", "b"])
        keep = table.slice(max(0, len(id_) - SMALL))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole texts have a weighted similarity of at least 0.8."""
    for batch in sliced(batches, "left", "right", most=STEP_BYTES // PACKED):
        n = batch.num_rows
        unit, owner = [], []
        for c in ("left", "right"):
            u, o = _units_of(batch.column(c))
            unit.append(u)
            owner.append(o)
        sizes = [np.bincount(o, minlength=n) for o in owner]
        both_unit, both_owner = np.concatenate(unit), np.concatenate(owner)
        order = np.lexsort((both_unit, both_owner))
        u, o = both_unit[order], both_owner[order]
        same = np.flatnonzero((u[1:] == u[:-1]) & (o[1:] == o[:-1]))  # a unit stands once in each text
        shared = np.bincount(o[same], minlength=n)
        ok = (shared > 0) & (shared >= LEAST * (sizes[0] + sizes[1] - shared) - 1e-9)
        yield pa.record_batch([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])


def _units_of(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Units of compressed texts and the text each belongs to."""
    texts = pa.array([zlib.decompress(x).decode() for x in packed.to_pylist()], pa.large_string())
    return units(*shingles(texts, WIDTH))


def _block(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between the texts of two sides, one for each left text and part of the right side."""
    none = pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
    if not left.num_rows or not right.num_rows:
        return none
    sides = []
    for t in (left, right):
        found, at = [], 0
        for part in sliced(t.select(["packed"]).to_batches(), "packed", most=STEP_BYTES // PACKED):
            u, o = _units_of(part.column(0))
            found.append((u, o + at))
            at += part.num_rows
        sides.append(tuple(np.concatenate(x) for x in zip(*found)))
    both = np.intersect1d(*(np.unique(u) for u, _ in sides), assume_unique=True)
    shared = np.zeros((left.num_rows, right.num_rows), np.float32)
    for at in range(0, len(both), COLUMNS):
        some, parts = both[at:at + COLUMNS], []
        for (u, o), t in zip(sides, (left, right)):
            column = np.searchsorted(some, u)
            hit = some[np.minimum(column, len(some) - 1)] == u
            parts.append(np.zeros((t.num_rows, len(some)), np.float32))
            parts[-1][o[hit], column[hit]] = 1
        shared += parts[0] @ parts[1].T
    size = [np.bincount(o, minlength=t.num_rows) for (_, o), t in zip(sides, (left, right))]
    ids, part = ([t.column(c).to_numpy() for t in (left, right)] for c in ("id", "component"))
    link = (shared > 0) & (shared >= LEAST * (size[0][:, None] + size[1][None] - shared) - 1e-4) & (part[0][:, None] != part[1][None])
    x, y = np.nonzero(link)
    _, first = np.unique(np.stack([x, part[1][y]]), axis=1, return_index=True)
    x, y = x[first], y[first]
    return pa.table([pa.array(np.minimum(ids[0][x], ids[1][y])), pa.array(np.maximum(ids[0][x], ids[1][y]))], names=["a", "b"])


def _rest(now: DataFrame, whole: DataFrame) -> DataFrame:
    """Links that buckets in more than one part still hold; ``now`` has each row's part and its bucket's lead's."""
    open_ = now.where(F.col("size") > SMALL)
    outside = F.col("component") != F.col("lead_component")
    n = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = open_.groupBy("bucket").agg(F.count("*").alias("all"), F.count_if(outside).alias("outside"))
    rows = open_.select("id", "component", "lead_component", "bucket").join(sizes, "bucket").join(whole, "id")
    mark = F.xxhash64("id")
    left = rows.where(outside).withColumn("x", F.pmod(mark, n("outside"))).withColumn("y", F.explode(F.sequence(F.lit(0), n("all") - 1)))
    right = rows.withColumn("y", F.pmod(mark, n("all"))).withColumn("x", F.explode(F.sequence(F.lit(0), n("outside") - 1)))
    names = ["bucket", "x", "y", "id", "component", "packed"]
    left, right = (d.select(*(F.col(c).cast("int").alias(c) if c in "xy" else F.col(c).alias(c) for c in names)).groupBy("bucket", "x", "y") for d in (left, right))
    return left.cogroup(right).applyInArrow(_block, "a long, b long").distinct()


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_size, kept) of each row."""
    low = F.lower(blank_null(text_col))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), low.alias("text"), F.md5(low).alias("copy"))
    signed = staged(rows.mapInArrow(tidy(_signed), "id long, copy string, bands array<bigint>, sketch binary"), "dart-signatures")
    n = signed.count()
    few = lambda df, label: staged_few(df, label, n)  # noqa: E731  tables of a small record a document or link
    first = signed.groupBy("copy").agg(F.min("id").alias("first"))
    of_copy = few(signed.select("id", "copy").join(first, "copy").select("id", "first"), "dart-copies")
    alone = of_copy.where("id = first").select("id").distinct()
    texts = few(signed.join(alone, "id", "left_semi").dropDuplicates(["id"]).select("id", "bands", "sketch"), "dart-texts-signed")
    keys = texts.select("id", F.explode("bands").alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    keys = few(keys.join(sizes, "bucket"), "dart-buckets")
    popular = keys.groupBy("id").agg(F.sum("size").alias("popular"))
    popular = popular.join(texts.select("id", "sketch"), "id")
    members = few(keys.join(popular, "id"), "dart-members")
    wanted = members.select("id").distinct()
    whole = rows.select("id", "text").mapInArrow(tidy(_pressed), "id long, packed binary")
    # Most documents may be wanted: the plan of large tables, at every size.
    whole = few(whole.join(wanted.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "dart-texts")

    def led(rows: DataFrame) -> DataFrame:
        """Rows of buckets in more than one part, each with its bucket's lead."""
        leads = rows.groupBy("bucket").agg(F.max(F.struct("popular", (-F.col("id")).alias("low"), "id", "component", "sketch")).alias("lead"),
                                           F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
        return rows.join(leads.select("bucket", F.col("lead.id").alias("lead"), F.col("lead.component").alias("lead_component"), F.col("lead.sketch").alias("lead_sketch")), "bucket")

    large = F.col("size") > SMALL  # splitters may fall inside a large bucket, never inside a small one
    now = led(members.withColumn("component", F.col("id"))).withColumn("order", F.substring("sketch", 1, 16))
    now = now.repartitionByRange("bucket", F.when(large, F.col("order")), F.when(large, F.col("id"))).sortWithinPartitions("bucket", "order", "id")
    now = now.select("id", "component", "bucket", "size", "sketch", "lead", "lead_component", "lead_sketch")
    pairs = few(now.mapInArrow(tidy(_sides), "a long, b long").distinct(), "dart-pairs")
    judged = pairs.join(whole.select(F.col("id").alias("a"), F.col("packed").alias("left")), "a")
    judged = judged.join(whole.select(F.col("id").alias("b"), F.col("packed").alias("right")), "b")
    links = few(judged.select("a", "b", "left", "right").mapInArrow(tidy(_judged), "a long, b long"), "dart-links")
    parts = components(links, "dart-parts", n)
    now = members.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    links = links.unionByName(few(_rest(led(now), whole), "dart-rest"))
    groups = components(links, "dart-classes", n)
    classes = of_copy.join(groups.withColumnRenamed("id", "first"), "first", "left").groupBy("id").agg(F.min(F.coalesce("component", "first")).alias("class_id"))
    classes = few(classes, "dart-class-ids")
    counts = classes.groupBy("class_id").agg(F.count("*").alias("class_size"))
    done = classes.join(counts, "class_id").select(F.col("id").alias("_id"), "class_id", "class_size")
    out = docs.select(F.col(id_col).alias("_row")).join(done, F.col("_row").cast("long") == F.col("_id"), "left")
    return out.select(F.col("_row").alias(id_col), "class_id", "class_size", (F.col("_id").isNull() | (F.col("_id") == F.col("class_id"))).alias("kept"))


def drop_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = near_classes(docs, id_col=id_col, text_col=text_col).where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
