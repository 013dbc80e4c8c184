"""Ranked lexical search by walking a tree of items and a tree of documents together.

Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased. All scores are integers: a term's weight w
comes from the number of documents that hold it, its impact in a document from its occurrences and the document's
length, and a score is the sum of w * impact over the item's terms, once each.

Trees. A leaf of the item tree is an item, a node holds the maximum weight of each term below it; a leaf of the
document tree is a document, a node holds the maximum impact of each term below it. The product of two nodes' maxima
bounds every score between the items and the documents below them. A pair of nodes whose bound is less than the
weakest k-th score among its items is dropped with all pairs below it; nothing else is dropped, so the ranking is exact.

Distribution. One pass over the texts writes, per document, its length and the items' terms it holds (document
vectors); their number, length and document frequencies are aggregates of that table. Every task then builds trees over
the documents it reads, a batch at a time, ordered by their most telling term so that neighbours are alike, and keeps
the k best documents of each item so far; the k-th of those is the item's bound. A first look over one in FIRST_LOOK
documents gives bounds to start from (the k-th score among some documents is never above the k-th among all), so that
tasks over the whole table send few rows; each sends at most k rows an item, and the last selection is a window that
Spark cuts to k rows an item before and after its shuffle.

Items are taken in blocks, a hash of the item's id and text apart, of about BLOCK_TERMS terms in all: what is sent to
the tasks is one block's items, whatever the number of items, and each block makes one pass over the texts.

Null texts have no terms; documents without terms are not counted and never found, items without terms find nothing.
Rows without an id are documents like others and rank after equal scores with an id; repeated rows are documents of
their own, and rows of items with one id are ranked on their own. Very long texts are counted whole. Empty tables give
an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.llm.common import staged

TOP = 50
#: Terms of a block of items, counted once an item; one of so many documents is looked at first.
BLOCK_TERMS = 1_000_000
FIRST_LOOK = 32
#: Children of a node; cells of the document x item table of a batch; term matches expanded at a time.
FAN = 8
CELLS = 1 << 20
EXPANDED = 1 << 20
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_VECTOR = "doc_id {id}, n long, terms array<int>, counts array<int>"


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_LOWER))


class Sparse:
    """Rows of (column, value) pairs; ``rows`` ascends and a row has a column once."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n_rows: int):
        self.rows, self.cols, self.vals, self.n_rows = rows, cols, vals, n_rows
        self.at = np.searchsorted(rows, np.arange(n_rows + 1))

    def maxima(self, fan: int) -> Sparse:
        """The rows of the next tree level: maxima of each column over ``fan`` rows."""
        rows = self.rows // fan
        order = np.lexsort((self.cols, rows))
        rows, cols, vals = rows[order], self.cols[order], self.vals[order]
        first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (cols[1:] != cols[:-1]))) if len(rows) else np.empty(0, np.int64)
        best = np.maximum.reduceat(vals, first) if len(first) else vals
        return Sparse(rows[first], cols[first], best, -(-self.n_rows // fan))

    def picked(self, keep: np.ndarray) -> Sparse:
        """The rows marked in ``keep``, numbered as before."""
        on = keep[self.rows]
        return Sparse(self.rows[on], self.cols[on], self.vals[on], self.n_rows)


class Items:
    """The item tree of one block: per level, the nodes that hold each term."""

    def __init__(self, ids: list, rows: np.ndarray, cols: np.ndarray, weights: np.ndarray):
        # Items that share their heaviest term become neighbours.
        n = len(ids)
        heavy = np.full(n, -1)
        order = np.lexsort((cols, weights[cols], rows))
        heavy[rows[order]] = cols[order]  # the last of a row, its heaviest
        place = np.argsort(np.argsort(heavy, kind="stable"))
        self.ids = [ids[i] for i in np.argsort(place)]
        rows = place[rows]
        order = np.argsort(rows, kind="stable")
        level = Sparse(rows[order], cols[order], weights[cols[order]], n)
        self.weights, self.levels = weights, []
        while True:
            by_term = np.argsort(level.cols, kind="stable")
            self.levels.append((level.rows[by_term], np.searchsorted(level.cols[by_term], np.arange(len(weights) + 1)), level.n_rows))
            if level.n_rows <= FAN:
                break
            level = level.maxima(FAN)


def pair_sums(docs: Sparse, items: tuple[np.ndarray, np.ndarray, int], weights: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Sum of value * weight over shared terms, for the active (document node, item node) pairs; 0 for the others."""
    nodes, at, n_items = items
    sums = np.zeros(docs.n_rows * n_items, np.int64)
    docs = docs.picked(active.any(axis=1))
    length = at[docs.cols + 1] - at[docs.cols]
    ends = np.cumsum(length)
    start, flat = 0, active.ravel()
    while start < len(length):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + EXPANDED, "right")))
        some = slice(start, stop)
        reps = length[some]
        total = int(reps.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(reps) - reps, reps)
        cell = np.repeat(docs.rows[some] * n_items, reps) + nodes[np.repeat(at[docs.cols[some]], reps) + inside]
        on = flat[cell]
        part = np.repeat(docs.vals[some] * weights[docs.cols[some]], reps)[on]
        cell = cell[on]
        if len(cell):
            low, high = int(cell.min()), int(cell.max()) + 1
            # Halves of 26 bits add up exactly in doubles.
            halves = (np.bincount(cell - low, x, high - low).astype(np.int64) for x in (part & 0x3FFFFFF, part >> 26))
            sums[low:high] += next(halves) + (next(halves) << 26)
        start = stop
    return sums.reshape(docs.n_rows, n_items)


class Search:
    """Walks batches of documents against the item tree, holding the best documents of each item."""

    def __init__(self, items: Items, bounds: dict[int, int], top: int):
        self.items, self.top = items, top
        n = len(items.ids)
        self.floor = np.array([bounds.get(i, 0) for i in range(n)], np.int64)
        self.item, self.score, self.doc = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object)

    def batch(self, ids: np.ndarray, docs: Sparse) -> None:
        levels = [docs]
        while levels[-1].n_rows > FAN:
            levels.append(levels[-1].maxima(FAN))
        of_items = self.items.levels
        active, was = np.ones((1, 1), bool), (None, None)
        depth = max(len(levels), len(of_items))
        for step in range(depth - 1, -1, -1):  # the higher tree comes down alone until both stand at the same height
            d, i = min(step, len(levels) - 1), min(step, len(of_items) - 1)
            n_docs, n_items = levels[d].n_rows, of_items[i][2]
            if was[0] is not None:
                if d != was[0]:
                    active = np.repeat(active, FAN, axis=0)[:n_docs]
                if i != was[1]:
                    active = np.repeat(active, FAN, axis=1)[:, :n_items]
            else:
                active = np.ones((n_docs, n_items), bool)
            was = d, i
            sums = pair_sums(levels[d], of_items[i], self.items.weights, active)
            floor = self.floor
            for _ in range(i):
                floor = np.minimum.reduceat(floor, np.arange(0, len(floor), FAN))
            active = (sums > 0) & (sums >= floor)
            if not active.any():
                return
        doc, item = np.nonzero(active)
        self.keep(item, sums[doc, item], ids[doc])

    def keep(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.append(self.item, item), np.append(self.score, score), np.append(self.doc, doc)
        none = np.array([x is None for x in doc], bool)
        rank = np.zeros(len(doc), np.int64)
        rank[~none] = np.unique(doc[~none], return_inverse=True)[1] if (~none).any() else 0
        rank[none] = len(doc)
        order = np.lexsort((rank, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.searchsorted(item, item)
        on = np.arange(len(item)) - first < self.top
        self.item, self.score, self.doc = item[on], score[on], doc[on]
        last = np.flatnonzero(np.arange(len(item)) - first == self.top - 1)
        self.floor[item[last]] = np.maximum(self.floor[item[last]], score[last])


def vectors(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id, n, terms, counts of the documents (doc_id, text) with a term; terms are those of the vocabulary, ascending."""
    shape = _VECTOR.format(id=docs.schema["doc_id"].dataType.simpleString())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, size, found = [], [], ([], [])
            for i, text in enumerate(b["text"]):
                words = terms_of(text.as_py())
                if words:
                    known = sorted((vocabulary[t], c) for t, c in Counter(words).items() if t in vocabulary)
                    keep.append(i)
                    size.append(len(words))
                    for held, one in zip(found, zip(*known) if known else ((), ())):
                        held.append(one)
            lists = [pa.array(x, pa.list_(pa.int32())) for x in found]
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(keep, pa.int64())), pa.array(size, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(work, shape)


def searched(found: DataFrame, items: Items, totals: tuple[int, int], bounds: dict[int, int], top: int) -> DataFrame:
    """item (place in ``items``), doc_id, score: at most ``top`` rows an item and task, all that can be among the best."""
    n_docs, n_terms = totals
    kind = found.schema["doc_id"].dataType.simpleString()
    per_batch = max(FAN, min(4096, CELLS // max(1, len(items.ids))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, bounds, top)
        for whole in batches:
            for at in range(0, whole.num_rows, per_batch):
                b = whole.slice(at, per_batch)
                ids = np.empty(b.num_rows, object)
                ids[:] = b["doc_id"].to_pylist()
                n = b["n"].to_numpy()
                m = 50 + (50 * n * n_docs) // n_terms
                lists = b["terms"]
                size = np.diff(lists.offsets.to_numpy())
                rows = np.repeat(np.arange(len(n)), size)
                cols = lists.flatten().to_numpy().astype(np.int64)
                count = b["counts"].flatten().to_numpy().astype(np.int64)
                impact = (1_000_000_000 * count) // (1000 * count + 20 * m[rows])
                # Documents in the order of their most telling term, so that nodes hold alike documents.
                telling = np.full(len(n), -1)
                order = np.lexsort((cols, items.weights[cols] * impact, rows))
                telling[rows[order]] = cols[order]
                by = np.argsort(telling, kind="stable")
                place = np.argsort(by)
                order = np.argsort(place[rows], kind="stable")
                search.batch(ids[by], Sparse(place[rows][order], cols[order], impact[order], len(n)))
        yield pa.RecordBatch.from_arrays([pa.array(search.item), pa.array(list(search.doc), whole_type), pa.array(search.score)], ["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    whole_type = to_arrow_type(found.schema["doc_id"].dataType)
    return found.mapInArrow(work, f"item long, doc_id {kind}, score long")


def best(found: DataFrame, by: list[str], top: int) -> DataFrame:
    """The ``top`` rows of each ``by``, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked(items: DataFrame, docs: DataFrame, *, top: int = TOP, item_col: str = "item_id", item_text_col: str = "text", id_col: str = "doc_id",
           text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` best documents of each row of ``items`` with a score above 0."""
    spark = docs.sparkSession
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    size = rows.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # more than its terms
    blocks = max(1, math.ceil(size / block_terms))
    block_of = F.pmod(F.xxhash64(F.col("item_id"), F.col("text")), F.lit(blocks))
    out = None
    for block in range(blocks):
        one = _block(spark, [(r.item_id, r.text) for r in rows.where(block_of == block).collect()], few, rows.schema["item_id"].dataType, top)
        out = one if out is None else out.unionByName(one)
    return out


def _block(spark, held: list[tuple], docs: DataFrame, item_type: T.DataType, top: int) -> DataFrame:
    held.sort(key=lambda x: (str(x[0]), x[1] or ""))  # any order; a fixed one gives equal plans
    own = [sorted(set(terms_of(text))) for _, text in held]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*own)))}
    shape = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type)])
    if not vocabulary:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()),
                                                       T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())]))
    found = staged(vectors(docs, vocabulary), "search-vectors")
    n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
    df = {r.term: r.n for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # at most the block's terms
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
    cols = np.array([vocabulary[t] for x in own for t in x], np.int64)
    tree = Items([i for i, _ in held], rows, cols, weights)
    totals = (n_docs, max(1, n_terms or 0))
    look = found.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST_LOOK)) == 0)
    bounds = {r.item: r.score for r in best(searched(look, tree, totals, {}, top), ["item"], top).where(F.col("rank") == top).select("item", "score").collect()}
    best_rows = best(searched(found, tree, totals, bounds, top), ["item"], top)
    names = spark.createDataFrame(list(enumerate(tree.ids)), shape)
    return best_rows.join(names, "item").select("item_id", "rank", "doc_id", "score")
