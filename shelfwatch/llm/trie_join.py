"""SimHash near-dedup: fingerprints joined with themselves by walking pairs of binary trie nodes.

A text is lower-cased (A-Z only), cut into words and three-word shingles, repeats included. Each shingle is hashed with
XXH64 (UTF-8, seed 42); a bit of the 64-bit fingerprint is 1 if it is set in over half the hashes. Fingerprints that
differ in at most BUDGET bits are linked, classes are the connected components of the links.

The join. Node pairs of the trie are walked together, from (root, root) down: a pair goes on to the pairs of its
children, a step into different children costs one bit, and a pair over the budget is dropped with all below it. To
keep the upper levels, where every prefix exists, from making all pairs, the fingerprint is turned so that each of its
BUDGET + 1 parts of 16 bits leads once: of two fingerprints that differ in BUDGET bits one part is equal, so in the
turn that this part leads, the walk may spend nothing on the first 16 bits and starts at the pairs (node, node) there.

Distribution. Equal fingerprints are one leaf (counted out by a map-side aggregate). A node pair with at most LEAVES
leaves on either side is one unit of work; larger nodes (a hot prefix, however many leaves it has) are opened in Spark,
STEP bits at a time, as a table of node pairs joined with the table of child counts, until their pairs are small.
So no prefix has to fit a task. Inside a unit the walk runs over arrays of node pairs and finds links; pairs of nodes
whose leaves all belong to one class already are dropped too, as they can only link what is linked. A unit returns
the links that joined something (fewer than its leaves), and components of all links give the classes.

Null texts count as empty, a text without words has fingerprint zero and links like any other, a text of fewer than
three words is one shingle. Repeated rows and rows without an id get their row; a null id is nobody's component_id
unless a class has no other (then it is null). Very long texts are hashed in slices. An empty table gives an empty
result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import staged, staged_few
from shelfwatch.llm.components import components

WIDTH = 3
SEED = 42
#: Bits in which linked fingerprints may differ, and bits of the part that leads a turn.
BUDGET = 3
LEAD = 64 // (BUDGET + 1)
#: Leaves that either node of a unit may have, and bits by which larger nodes are opened.
LEAVES = 4096
STEP = 8
#: Leaves gathered before a task walks the units they make up; node pairs the walk opens at a time.
GATHERED = 1 << 17
OPENED = 1 << 18
_SLICE = 1 << 14


def fingerprint(text: str | None) -> int:
    """Fingerprint of one text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white space characters alone
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    reach = min(WIDTH, len(words)) - 1
    starts, ends = starts[:len(words) - reach], ends[reach:]
    set_bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SLICE):
        some = zip(starts[at:at + _SLICE].tolist(), ends[at:at + _SLICE].tolist())
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in some), np.uint64, min(_SLICE, len(starts) - at))
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long), one row per row of ``docs``."""
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in b["text"]), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    kind = few.schema["doc_id"].dataType.simpleString()
    return few.mapInArrow(work, f"doc_id {kind}, fingerprint long")


def turned(value: Column, turn: int) -> Column:
    """The fingerprint with its part ``turn`` in front."""
    by = turn * LEAD
    return value if not by else F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by))


def _prefix(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(value, 64 - bits)


def work_units(leaves: DataFrame, limit: int = LEAVES) -> DataFrame:
    """The node pairs to walk, (turn, depth, a, b, spent): prefixes of ``depth`` bits with at most ``limit`` leaves each.

    ``leaves``: turn, value. A pair of a node with itself has a = b; nodes of a single leaf are no pair.
    """
    units, depth = None, LEAD
    counts = staged(leaves.groupBy("turn", _prefix(F.col("value"), LEAD).alias("node")).agg(F.count("*").alias("n")), "trie-nodes")
    pairs = counts.where("n > 1").select("turn", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("spent"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    while True:
        big = (F.col("n_a") > limit) | (F.col("n_b") > limit)
        done = pairs.where(~big | F.lit(depth >= 64)).select("turn", F.lit(depth).alias("depth"), "a", "b", "spent")
        units = done if units is None else units.unionByName(done)
        if depth >= 64 or not pairs.where(big).limit(1).count():
            return units
        # The leaves below the nodes that are opened are counted by their next bits; the pairs of children follow.
        opened = staged(pairs.where(big), "trie-pairs")
        nodes = opened.select("turn", F.col("a").alias("node")).unionByName(opened.select("turn", F.col("b").alias("node"))).distinct()
        below = leaves.withColumn("node", _prefix(F.col("value"), depth)).join(nodes, ["turn", "node"], "left_semi")
        step = min(STEP, 64 - depth)
        depth += step
        children = staged(below.groupBy("turn", "node", _prefix(F.col("value"), depth).alias("child")).agg(F.count("*").alias("n")), "trie-nodes")
        side = lambda x: children.select("turn", F.col("node").alias(x), F.col("child").alias(f"c_{x}"), F.col("n").alias(f"m_{x}"))
        pairs = opened.drop("n_a", "n_b").join(side("a"), ["turn", "a"]).join(side("b"), ["turn", "b"])
        pairs = pairs.withColumn("spent", F.col("spent") + F.bit_count(F.col("c_a").bitwiseXOR(F.col("c_b")).bitwiseAND(F.lit((1 << step) - 1))))
        pairs = pairs.where((F.col("spent") <= BUDGET) & ((F.col("a") != F.col("b")) | (F.col("c_a") <= F.col("c_b"))))
        pairs = pairs.where((F.col("c_a") != F.col("c_b")) | (F.col("a") != F.col("b")) | (F.col("m_a") > 1))
        pairs = staged(pairs.select("turn", F.col("c_a").alias("a"), F.col("c_b").alias("b"), "spent", F.col("m_a").alias("n_a"), F.col("m_b").alias("n_b")), "trie-pairs")


class _Classes:
    """Classes of leaves, merged by smallest number."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the classes of the pairs; returns the pairs that joined two classes."""
        used = [], []
        while True:
            x, y = self.of[a], self.of[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return np.concatenate([np.empty(0, np.int64), *used[0]]), np.concatenate([np.empty(0, np.int64), *used[1]])
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            order = np.lexsort((low, high))
            first = order[np.append(True, high[order][1:] != high[order][:-1])]  # one smaller class for each class
            used[0].append(a[first])
            used[1].append(b[first])
            self.of[high[first]] = low[first]
            while True:
                up = self.of[self.of]
                if np.array_equal(up, self.of):
                    break
                self.of = up


def walk(values: np.ndarray, lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray, depth: np.ndarray, spent: np.ndarray,
         groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked leaves that tie together all leaves within the budget, for node pairs given as ranges of ``values``.

    ``values`` is ascending inside each of the ranges of leaves that ``groups`` numbers (ascending). A pair of a node
    with itself has equal ranges.
    """
    classes, links = _Classes(len(values)), ([], [])

    def tie(a: np.ndarray, b: np.ndarray) -> None:
        for held, new in zip(links, classes.link(a, b)):
            held.append(new)

    # Neighbours in the order of the values are tied first, so that most pairs inside a class need no walk.
    near = np.flatnonzero((groups[1:] == groups[:-1]) & (np.bitwise_count(values[1:] ^ values[:-1]) <= BUDGET))
    tie(near, near + 1)
    bit_of = lambda d: np.uint64(1) << (np.uint64(63) - d.astype(np.uint64))
    stack = [(lo_a, hi_a, lo_b, hi_b, depth, spent)]
    while stack:
        pairs = stack.pop()
        if len(pairs[0]) > OPENED:
            stack.append(tuple(x[OPENED:] for x in pairs))
            pairs = tuple(x[:OPENED] for x in pairs)
        la, ha, lb, hb, d, s = pairs
        # Leaves of one class need no more links among themselves.
        steps = np.append(0, np.cumsum(classes.of[1:] != classes.of[:-1]))
        one = (steps[ha - 1] == steps[la]) & (steps[hb - 1] == steps[lb]) & (classes.of[la] == classes.of[lb])
        la, ha, lb, hb, d, s = (x[~one] for x in (la, ha, lb, hb, d, s))
        single = (ha - la == 1) & (hb - lb == 1)
        at = np.flatnonzero(single)
        at = at[np.bitwise_count(values[la[at]] ^ values[lb[at]]) <= BUDGET]
        tie(la[at], lb[at])
        la, ha, lb, hb, d, s = (x[~single] for x in (la, ha, lb, hb, d, s))
        if not len(la):
            continue
        same = (la == lb) & (ha == hb)
        mid_a, mid_b = _split(values, la, ha, bit_of(d)), _split(values, lb, hb, bit_of(d))
        d = d + 1
        out = []
        for a0, a1, x in ((la, mid_a, 0), (mid_a, ha, 1)):
            for b0, b1, y in ((lb, mid_b, 0), (mid_b, hb, 1)):
                cost = s + (x != y)
                on = (a0 < a1) & (b0 < b1) & (cost <= BUDGET)
                on &= ~same if x > y else ~same | (x != y) | (a1 - a0 > 1)
                out.append((a0[on], a1[on], b0[on], b1[on], d[on], cost[on]))
        stack.append(tuple(np.concatenate(x) for x in zip(*out)))
    return np.concatenate([np.empty(0, np.int64), *links[0]]), np.concatenate([np.empty(0, np.int64), *links[1]])


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Place of the first value with ``bit`` set in each of the ranges, whose values agree above that bit and ascend."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        low = (values[mid] & bit[open_]) == 0
        lo[open_] = np.where(low, mid + 1, lo[open_])
        hi[open_] = np.where(low, hi[open_], mid)


def _walk_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (turn, depth, a, b, spent, side, value) in the order of (unit, side, value) to links (a, b) of fingerprints."""
    held: list[pa.RecordBatch] = []
    key = ["turn", "depth", "a", "b"]

    def links(table: pa.Table) -> pa.RecordBatch:
        col = {c: table[c].to_numpy() for c in table.column_names}
        values = col["value"].view(np.uint64)
        new = lambda *names: np.append(True, np.logical_or.reduce([col[c][1:] != col[c][:-1] for c in names]))
        units, sides = np.flatnonzero(new(*key)), np.flatnonzero(new(*key, "side"))
        ends = np.append(sides[1:], len(values))
        at = np.searchsorted(sides, units)
        two = np.append(at[1:], len(sides)) - at == 2  # a unit of two nodes, or of a node with itself
        other = at + two
        full = two | (col["a"][units] == col["b"][units])  # a side without leaves cannot be, but would give nothing
        pick = lambda x: x[full].astype(np.int64)
        a, b = walk(values, pick(sides[at]), pick(ends[at]), pick(sides[other]), pick(ends[other]), pick(col["depth"][units]),
                    pick(col["spent"][units]), np.cumsum(new(*key, "side")))
        back = (col["turn"] * LEAD).astype(np.uint64)

        def original(i: np.ndarray) -> np.ndarray:
            v, by = values[i], back[i]
            return np.where(by == 0, v, (v >> by) | (v << ((np.uint64(64) - by) & np.uint64(63)))).view(np.int64)

        return pa.RecordBatch.from_arrays([pa.array(original(a)), pa.array(original(b))], ["a", "b"])

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= GATHERED:
            table = pa.Table.from_batches(held)
            ids = [table[c].to_numpy() for c in key]
            last = np.logical_and.reduce([x == x[-1] for x in ids])
            cut = int(np.argmax(last))  # the last unit may go on
            if cut:
                yield links(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            rows -= cut
    if held:
        yield links(pa.Table.from_batches(held))


def fingerprint_links(distinct: DataFrame, *, limit: int = LEAVES) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fingerprint``, long) that tie together all within BUDGET bits."""
    turns = F.array(*(F.struct(F.lit(t).alias("turn"), turned(F.col("fingerprint"), t).alias("value")) for t in range(BUDGET + 1)))
    leaves = distinct.select(F.explode(turns).alias("t")).select("t.turn", "t.value")
    units = staged(work_units(leaves, limit), "trie-units")
    depths = [r.depth for r in units.select("depth").distinct().collect()]  # 16, 24, ... 64 at most
    sides = None
    for depth in sorted(depths):
        here = units.where(F.col("depth") == depth)
        nodes = here.select("*", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
        nodes = nodes.withColumn("node", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))
        found = leaves.withColumn("node", _prefix(F.col("value"), depth)).join(nodes, ["turn", "node"])
        found = found.select("turn", "depth", "a", "b", "spent", "side", "value")
        sides = found if sides is None else sides.unionByName(found)
    if sides is None:
        return distinct.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")).where("false")
    unsigned = F.col("value").bitwiseXOR(F.lit(-(1 << 63)))  # the order of the bits, not of the sign
    rows = sides.repartition("turn", "depth", "a", "b").sortWithinPartitions("turn", "depth", "a", "b", "side", unsigned)
    return rows.mapInArrow(_walk_units, "a long, b long")


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LEAVES) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row of ``docs``."""
    prints = staged(fingerprints(docs, id_col=id_col, text_col=text_col), "trie-prints")
    n = prints.count()
    distinct = staged_few(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "trie-leaves", n)
    linked = components(fingerprint_links(distinct, limit=limit), "trie-classes", n)
    linked = linked.select(F.col("id").alias("fingerprint"), "component")
    least = distinct.join(linked, "fingerprint").groupBy("component").agg(F.min("least").alias("component_id"))
    classes = distinct.join(linked.join(least, "component"), "fingerprint", "left")
    classes = classes.select("fingerprint", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    classes = staged_few(classes, "trie-components", n)  # a table of its own, so that a hot fingerprint's rows can be split in the join
    return prints.join(classes, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
