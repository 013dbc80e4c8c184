"""Language identification with error-correcting output codes.

Every language gets a codeword. One binary classifier per bit, linear over hashed byte trigrams of the lower-cased
letters, predicts whether a text's language has that bit set. Decoding is loss-weighted: a language's loss is the sum
over bits of exp(-bit x margin), weighted by how often the bit's classifier was right for that language in training;
the nearest codeword wins, its score is its share of exp(-loss), and a small lead over the second is flagged.

Fitting takes at most TRAIN_DOCS labelled documents of a language (a hash picks them evenly over the table); trigram
sums and hit rates are Spark aggregates with a few rows per task, and the driver holds one table of DIMS counts per
language (at most MAX_LANGUAGES). Prediction reads every whole text.

Texts that are null or have no letter, and everything when no language could be learned, get ``und`` with score 0.
Null labels and null ids are not learned from. Repeated rows and empty tables need no special care.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.llm.common import sliced

TRAIN_DOCS = 20_000
MAX_LANGUAGES = 1000
DIMS = 1 << 15
#: Counts travel in blocks of this many features.
BLOCK = 1 << 9
#: Margins are divided by this before the loss.
MARGIN_SCALE = 0.25
AMBIGUOUS_LEAD = 0.1


def letters(text: Column) -> Column:
    """Lower-cased letters with one blank for everything else, and a blank at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts and the text each belongs to."""
    data = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode(), np.uint8).astype(np.uint32)
    size = np.array([len((t or "").encode()) for t in texts.to_pylist()], np.int64)
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    feature = (code * np.uint32(2654435761)) >> np.uint32(17)
    owner = np.repeat(np.arange(len(size)), size)
    whole = owner[2:] == owner[:-2]
    return feature[whole].astype(np.int64), owner[:-2][whole]


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1/-1: all splits of the classes for up to five, else the best of some random codes."""
    if k <= 5:
        bits = max(1, 2 ** (k - 1) - 1)
        return np.array([[1 if c == 0 or (b + 1) >> (c - 1) & 1 == 0 else -1 for b in range(bits)] for c in range(k)], np.int8)
    draw, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.int8), (k, bits))
        d = (bits - code.astype(int) @ code.T.astype(int)) / 2
        mixed = (np.abs(code.sum(0)) < k).all()
        if mixed and (near := d[~np.eye(k, dtype=bool)].min()) > far:
            best, far = code, near
    return best


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * DIMS)
        sides = [np.where(self.code == side, 1.0, 0.0) for side in (1, -1)]
        mean = [(s / np.maximum(s.sum(0), 1)).T @ p for s in sides]
        self.weights = np.log(np.maximum(mean[0], 1e-9) / np.maximum(mean[1], 1e-9)).T.astype(np.float32)  # DIMS x bits
        if len(languages) == 1:
            self.weights = np.ones_like(self.weights)
        self.trust = np.full(self.code.shape, 1 / self.code.shape[1])

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Mean margin of each bit for each text."""
        out = np.zeros((len(texts), self.code.shape[1]))
        feature, owner = _features(texts)
        n = np.bincount(owner, minlength=len(texts))
        for at in range(0, len(feature), 1 << 20):
            f, o = feature[at:at + (1 << 20)], owner[at:at + (1 << 20)]
            starts = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
            out[o[starts]] += np.add.reduceat(self.weights[f], starts, axis=0, dtype=np.float64)
        return out / np.maximum(n, 1)[:, None]

    def trusting(self, hits: np.ndarray, seen: np.ndarray) -> Model:
        """With each language's bits weighted by their hit rate in training."""
        rate = (hits + 0.5) / (seen[:, None] + 1)
        self.trust = rate / rate.sum(1, keepdims=True)
        return self

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, score, lead over the second."""
        scaled = np.clip(self.margins(texts) / MARGIN_SCALE, -20, 20)
        loss = np.stack([(np.exp(-scaled * self.code[c]) * self.trust[c]).sum(1) for c in range(len(self.languages))], 1)
        near = np.exp(-np.clip(loss - loss.min(1, keepdims=True), 0, 700))
        share = near / near.sum(1, keepdims=True)
        order = np.sort(share, 1)
        lead = order[:, -1] - (order[:, -2] if share.shape[1] > 1 else 0)
        return share.argmax(1), share.max(1), lead


def fit(labelled: DataFrame, *, text_col: str = "text", label_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model | None:
    """A model of the labels of ``labelled``, or None if it has none."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).alias("label"), letters(F.col(text_col)).alias("text"), F.xxhash64(text_col).alias("draw"))
    sizes = rows.groupBy("label").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    part = F.lit(0.0)
    for r in sizes:
        part = F.when(F.col("label") == r.label, min(1.0, train_docs / r["count"])).otherwise(part)
    sample = rows.where(F.pmod("draw", F.lit(1 << 20)) < part * (1 << 20)).select("label", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in sliced(batches, "text"):
            label = np.array(batch.column("label").to_pylist(), object)
            for name in set(label):
                texts = batch.column("text").filter(pa.array(label == name))
                sums[name] = sums.get(name, 0) + np.bincount(_features(texts)[0], minlength=DIMS)
        for name, n in sums.items():
            yield pa.record_batch([pa.array([name] * (DIMS // BLOCK)), pa.array(range(DIMS // BLOCK), pa.int32()), pa.array(n.reshape(-1, BLOCK).tolist(), pa.list_(pa.int64()))],
                                  ["label", "block", "n"])

    found = sample.mapInArrow(counted, "label string, block int, n array<bigint>")
    found = found.select("label", "block", F.posexplode("n").alias("i", "n")).groupBy("label", "block", "i").agg(F.sum("n").alias("n"))
    found = found.groupBy("label", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("n"))
    languages = sorted(r.label for r in sizes)
    counts = np.zeros((len(languages), DIMS))
    for r in found.toLocalIterator():
        counts[languages.index(r.label), r.block * BLOCK:(r.block + 1) * BLOCK] = r.n
    model = Model(languages, counts)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, seen = np.zeros(model.code.shape), np.zeros(len(languages))
        for batch in sliced(batches, "text"):
            truth = np.array([languages.index(x) for x in batch.column("label").to_pylist()], np.int64)
            right = model.margins(batch.column("text")) * model.code[truth] > 0
            np.add.at(hits, truth, right)
            np.add.at(seen, truth, 1)
        yield pa.record_batch([pa.array(range(len(languages)), pa.int32()), pa.array(seen), pa.array(hits.tolist(), pa.list_(pa.float64()))], ["k", "seen", "hits"])

    judged_rows = sample.mapInArrow(judged, "k int, seen double, hits array<double>").select("k", "seen", F.posexplode("hits").alias("bit", "hit"))
    hits, seen = np.zeros(model.code.shape), np.zeros(len(languages))
    for r in judged_rows.groupBy("k", "bit").agg(F.sum("seen").alias("seen"), F.sum("hit").alias("hit")).toLocalIterator():
        hits[r.k, r.bit], seen[r.k] = r.hit, r.seen
    return model.trusting(hits, seen)


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and ambiguous of each row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    has = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.when(has, letters(F.col(text_col))).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def guessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            text, name, score, unsure = batch.column("text"), ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            if model is not None and batch.num_rows:
                best, share, lead = model.predict(text)
                there = text.is_valid().to_numpy(zero_copy_only=False)
                name = [model.languages[b] if t else "und" for b, t in zip(best, there)]
                score, unsure = np.where(there, share, 0.0), ~there | (lead < AMBIGUOUS_LEAD)
            yield pa.record_batch([batch.column("id"), pa.array(name), pa.array(score), pa.array(unsure)], schema=arrow)

    return rows.mapInArrow(guessed, schema).select(F.col("id").alias(id_col), "lang_pred", "score", "ambiguous")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
