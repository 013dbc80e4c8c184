"""Token counts of a sentencepiece BPE model by rank-synchronous merging of arrays.

A batch's distinct pre-tokens are held as one ragged numpy array of symbols. In each round every pre-token finds its
pair of lowest rank and merges it wherever it stands, all pre-tokens at once; what is left is counted. The library
merges one pair at a time, leftmost first, so within a pre-token the round stops after the first merge that creates a
pair of the same or a lower rank: that pair comes next, before the other occurrences.

Texts are cut before runs of the model's space mark and at line feeds, where no piece of the vocabulary reaches
across (checked when the model is loaded). Symbols outside the vocabulary count as their UTF-8 bytes (byte fallback).
Null texts are empty and have no tokens. Repeated rows, null ids and empty tables need no special care: every row is
counted on its own. Counts of distinct pre-tokens are remembered inside a task, for at most MEMO of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.llm.common import sliced

SPACE = "▁"
MEMO = 500_000
#: No pair: larger than any rank.
_NONE = np.int32(2**31 - 1)


class PieceModel:
    """Vocabulary of a sentencepiece BPE model as arrays."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        score = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)}
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in score):
            raise ValueError("pieces reach across the places where texts are cut")
        if model.encode(" a  b ", out_type=str) != self._reference_pieces(model):
            raise ValueError("the model normalises its input")
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        symbols = sorted({*score, *(c for p in score for c in p)})
        index = {p: i for i, p in enumerate(symbols)}
        self.width = len(symbols)
        self.cost = np.array([1 if p in score else len(p.encode()) for p in symbols], np.int64)
        self.of_char = np.full(0x110000, -1, np.int64)
        for p, i in index.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        rows = sorted((index[p[:k]] * self.width + index[p[k:]], rank[s], index[p]) for p, s in score.items() for k in range(1, len(p))
                      if p[:k] in index and p[k:] in index)
        self.keys, self.ranks, self.merged = (np.array(c, t) for c, t in zip(zip(*rows), (np.int64, np.int32, np.int64)))

    @staticmethod
    def _reference_pieces(model) -> list[str]:
        """What an identity-normalised text with a dummy prefix gives."""
        return model.encode(f"{SPACE}a{SPACE}{SPACE}b{SPACE}", out_type=str)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair."""
        key = np.where((left < 0) | (right < 0), -1, left * self.width + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(words), np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        seq = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym = self.of_char[points]
        unknown = sym < 0
        out += np.bincount(seq[unknown], 1 + (points[unknown] > 0x7F) + (points[unknown] > 0x7FF) + (points[unknown] > 0xFFFF), len(words)).astype(np.int64)
        while len(sym) > 1:
            rank, merged = self.pairs(sym[:-1], sym[1:])
            rank[seq[:-1] != seq[1:]] = _NONE
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            owner = np.cumsum(np.append(True, seq[1:] != seq[:-1])) - 1
            least = np.minimum.reduceat(np.append(rank, _NONE), starts)
            busy = (least < _NONE)[owner]
            if not busy.all():  # finished pre-tokens leave
                done = ~busy & (sym >= 0)
                out += np.bincount(seq[done], self.cost[sym[done]], len(words)).astype(np.int64)
                keep = np.flatnonzero(busy)
                if not len(keep):
                    return out
                rank = np.append(rank, _NONE)[keep][:-1]
                merged = np.append(merged, 0)[keep][:-1]
                owner = owner[keep]
                sym, seq = sym[keep], seq[keep]
            hits = np.flatnonzero(rank == least[owner[:-1]])
            hits = hits[rank[hits] < _NONE]
            # of overlapping places (a a a) every second one, from the left
            run = np.cumsum(np.append(True, np.diff(hits) > 1)) - 1
            first = np.flatnonzero(np.append(True, np.diff(run) > 0))
            hits = hits[(np.arange(len(hits)) - first[run]) % 2 == 0]
            new, low, own = merged[hits], rank[hits], owner[hits]
            prev = hits - 1
            before = np.where((prev >= 0) & (owner[prev] == own), sym[prev], -1)
            glued = np.append(False, hits[1:] == hits[:-1] + 2) & np.append(False, own[1:] == own[:-1])
            before[glued] = new[np.flatnonzero(glued) - 1]
            nxt = np.minimum(hits + 2, len(sym) - 1)
            after = np.where((hits + 2 < len(sym)) & (owner[nxt] == own), sym[nxt], -1)
            creates = np.minimum(self.pairs(before, new)[0], self.pairs(new, after)[0]) <= low
            made = np.cumsum(creates) - creates  # creating merges before this one
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            base = np.repeat(made[head], np.diff(np.append(head, len(own))))
            hits, new = hits[made == base], new[made == base]
            sym = sym.copy()
            sym[hits] = new
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            sym, seq = sym[keep], seq[keep]
        known = sym >= 0
        return out + np.bincount(seq[known], self.cost[sym[known]], len(words)).astype(np.int64)


_CUT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")


def pre_tokens(text: str) -> list[str]:
    return _CUT.findall(SPACE + text.replace(" ", SPACE)) if text else []


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    arrow = to_arrow_schema(schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = PieceModel(path), {}
        for batch in sliced(batches, "text"):
            n_bytes = np.diff(np.frombuffer(batch.column("text").buffers()[1], np.int32)[batch.column("text").offset:][:batch.num_rows + 1])
            texts = [pre_tokens(t) for t in batch.column("text").to_pylist()]
            new = list({w for t in texts for w in t if w not in memo})
            for at in range(0, len(new), 50_000):
                memo.update(zip(new[at:at + 50_000], model.counts(new[at:at + 50_000]).tolist()))
            n = [sum(map(memo.__getitem__, t)) for t in texts]
            yield pa.record_batch([batch.column("id"), pa.array(n_bytes.astype(np.int64)), pa.array(n, pa.int64())], schema=arrow)
            if len(memo) > MEMO:
                memo = {}

    return rows.mapInArrow(counted, schema).select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
