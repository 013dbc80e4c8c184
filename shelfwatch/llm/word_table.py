"""BPE encoding and decoding through a table of distinct words.

Splitting runs in Spark tasks: a chunk of documents becomes, per document, the codes of its words in the order they
stand, and the chunk's own list of distinct words. The words are dealt by their hash into as many buckets as the
session has shuffle partitions, one compressed row per chunk and bucket; a bucket's task encodes each distinct word
once and sends the ids back to the chunks, where they replace the codes by position. What is shuffled is thus a
chunk's distinct words and compressed codes, not every occurrence with its place; no word is hot (a chunk sends it
once), nothing is broadcast, and a chunk is bounded by CHUNK_CHARS or one document. A bucket's task holds its share of
the distinct words, so more shuffle partitions make it smaller.

Splitting runs once for each side, so its input must give the same partitions when it is read again (a file scan
does); a seal over the chunk's words is checked and a difference is an error, never a wrong result.

Decoding joins ids to pieces in a table as large as the vocabulary and joins the bytes by position.

The tokenizer file must be a byte-level BPE with the usual word pattern. Strings of added tokens inside a text become
their ids, as the tokenizer does by default. Null texts count as empty and give no ids. Repeated rows and null ids
are rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.llm.common import BATCH_ROWS, give_back, tidy

#: Code points a chunk may hold before the next one begins.
CHUNK_CHARS = 4_000_000
#: Words the tokenizer encodes at a time.
ENCODED = 10_000
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The pre-tokenizer's word pattern (fixed value), its white space class spelled out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: The same for texts of ASCII and Latin-1 letters only, which the faster of the two engines can express.
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^ \t-\r{_LATIN}0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"


def _added(path: str) -> list[str]:
    """Strings that the tokenizer takes out of a text before it looks for words, longest first."""
    tokens = json.load(open(path, encoding="utf-8"))["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
        raise ValueError("added tokens with flags are not supported")
    return sorted((t["content"] for t in tokens), key=len, reverse=True)


def pieces(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizer file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    data = json.load(open(path, encoding="utf-8"))
    ids = {i: bytes(byte_of[c] for c in word) for word, i in data["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in data["added_tokens"]}
    return [ids.get(i, b"") for i in range(max(ids) + 1)]


@functools.cache
def _tokenizer(path: str):
    """The file's tokenizer, one for all tasks of a worker, working in the calling thread only.

    Every tokenizer that has encoded leaves some megabytes behind in each thread it used, however it is dropped. A worker
    that made one a task, with the library's threads, grew with the number of tasks.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _splitter(path: str):
    import regex

    any_word, latin_word, other, added = regex.compile(PATTERN), re.compile(LATIN_PATTERN), re.compile(rf"[^\x00-\x7f{_LATIN}]"), _added(path)
    special = re.compile("|".join(map(re.escape, added))) if added else None

    def words(text: str) -> list[str]:
        word = any_word if other.search(text) else latin_word
        if special is None or not special.search(text):
            return word.findall(text)
        out, at = [], 0
        for m in special.finditer(text):
            out += [*word.findall(text[at:m.start()]), m[0]]
            at = m.end()
        return out + word.findall(text[at:])

    return words


def _packed(codes: np.ndarray) -> bytes:
    """Codes as four planes of bytes, which compress well."""
    return zlib.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


class _Codes(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


def _chunks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[int, pa.Array, list[np.ndarray], list[str]]]:
    """(chunk number, ids, codes of each document, distinct words) of each chunk of a partition; frequent words first."""
    words_of, part, number = _splitter(path), TaskContext.get().partitionId(), 0
    code_of, ids, codes, chars = _Codes(), [], [], 0

    def chunk():
        words = list(code_of)
        count = np.bincount(np.concatenate(codes), minlength=len(words)) if words else np.empty(0, np.int64)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return part << 24 | number, pa.concat_arrays(ids), [rank[c] for c in codes], [words[i] for i in order]

    for batch in batches:
        for i, text in enumerate(batch.column(1)):
            text = text.as_py() or ""
            if chars and chars + len(text) > CHUNK_CHARS:
                yield chunk()
                code_of, ids, codes, chars, number = _Codes(), [], [], 0, number + 1
            ids.append(batch.column(0).slice(i, 1))
            codes.append(np.array(list(map(code_of.__getitem__, words_of(text))), np.uint32))
            chars += len(text)
    if ids:
        yield chunk()


def _seal(words: list[str]) -> bytes:
    return b"%d:%d" % (len(words), zlib.crc32("\n".join(words).encode()))


def _joined(parts: list[bytes]) -> tuple[bytes, bytes]:
    """Lengths and contents of byte strings, both compressed."""
    return _packed(np.array([len(p) for p in parts], np.uint32)), zlib.compress(b"".join(parts), 1)


def _parts(sizes: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(_unpacked(sizes)).tolist()
    data = zlib.decompress(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _text(ids: bytes, table: list[bytes]) -> str:
    return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """(id, ids) of each row: ``ids`` holds the token ids as little-endian unsigned 32-bit integers.

    ``decoded_col`` adds what the ids decode to, as :func:`decode` would, without another pass through Python.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    id_type = to_arrow_type(kind)

    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, found, words in _chunks(batches, path):
            seal = _seal(words)
            for at in range(0, len(found), BATCH_ROWS):
                some = [_packed(c) for c in found[at:at + BATCH_ROWS]]
                yield pa.record_batch([pa.array([chunk] * len(some), pa.int64()), ids.slice(at, BATCH_ROWS).cast(id_type), pa.array(some, pa.binary()),
                                       pa.array([seal] * len(some), pa.binary())], ["chunk", "id", "codes", "seal"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _, words in _chunks(batches, path):
            raw, seal, rows = [w.encode() for w in words], _seal(words), []
            bucket = np.array([zlib.crc32(w) for w in raw], np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            for b, own in zip(*(lambda u, at: (u, np.split(order, at[1:])))(*np.unique(bucket[order], return_index=True))):
                rows.append((int(b), _packed(np.diff(own, prepend=0)), *_joined([raw[i] for i in own])))
            rows = rows or [(0, _packed(np.empty(0, np.uint32)), *_joined([]))]
            yield pa.record_batch([pa.array([chunk] * len(rows), pa.int64()), pa.array([seal] * len(rows), pa.binary()),
                                   *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary())))],
                                  ["chunk", "seal", "bucket", "codes", "sizes", "data"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        memo: dict[bytes, bytes] = {}
        at_bucket = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("bucket", "sizes", "data")}
                if row["bucket"] != at_bucket:  # rows come by bucket
                    at_bucket, memo = row["bucket"], {}
                words = _parts(row["sizes"], row["data"])
                new = [w for w in words if w not in memo]
                for at in range(0, len(new), ENCODED):
                    some = new[at:at + ENCODED]
                    memo.update(zip(some, (np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False))))
                sizes, data = _joined([memo[w] for w in words])
                yield pa.record_batch([batch.column("chunk").slice(i, 1), batch.column("seal").slice(i, 1), batch.column("codes").slice(i, 1),
                                       pa.array([sizes], pa.binary()), pa.array([data], pa.binary())], ["chunk", "seal", "codes", "sizes", "data"])

    held: dict[str, list[bytes]] = {}  # the piece table, read once in a task

    def placed(left: pa.Table, right: pa.Table) -> pa.Table:
        code, values = [], []
        for c, sizes, data in zip(*(right.column(n).to_pylist() for n in ("codes", "sizes", "data"))):
            code.append(np.cumsum(_unpacked(c), dtype=np.uint32))
            values += _parts(sizes, data)
        code = np.concatenate(code) if code else np.empty(0, np.uint32)
        if left.num_rows:
            seal = set(left.column("seal").to_pylist())
            if len(seal) != 1 or seal != set(right.column("seal").to_pylist()) or int(next(iter(seal)).split(b":")[0]) != len(code):
                raise ValueError("a chunk was split differently when it was read again; write the input to a table first")
        order = np.argsort(code)
        size = np.array([len(values[i]) // 4 for i in order], np.int64)
        flat = np.frombuffer(b"".join([values[i] for i in order]), "<u4")
        starts = np.append(0, np.cumsum(size))
        out = []
        for packed in left.column("codes").to_pylist():
            at = _unpacked(packed)
            n = size[at]
            ends = np.cumsum(n)
            out.append(flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - ends + n, n)].astype("<u4").tobytes())
        table = {"id": left.column("id"), "ids": pa.array(out, pa.binary())}
        if decoded_col:
            if path not in held:
                held[path] = pieces(path)
            table["decoded"] = pa.array([_text(x, held[path]) for x in out], pa.string())
        return pa.table(table)

    def placed_tidily(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return placed(left, right)
        finally:
            give_back()

    binary = lambda *names: [T.StructField(n, T.BinaryType()) for n in names]
    chunk = T.StructField("chunk", T.LongType())
    table = T.StructType([chunk, *binary("seal"), T.StructField("bucket", T.IntegerType()), *binary("codes", "sizes", "data")])
    words = rows.mapInArrow(tidy(distinct), table).repartition("bucket").sortWithinPartitions("bucket")
    words = words.mapInArrow(tidy(encoded), T.StructType([chunk, *binary("seal", "codes", "sizes", "data")]))
    lines = rows.mapInArrow(tidy(codes), T.StructType([chunk, T.StructField("id", kind), *binary("codes", "seal")]))
    whole = lines.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(placed_tidily, T.StructType(
        [T.StructField("id", kind), *binary("ids"), *([T.StructField("decoded", T.StringType())] if decoded_col else [])]))
    return whole.select(F.col("id").alias(id_col), "ids", *([F.col("decoded").alias(decoded_col)] if decoded_col else []))


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])
    arrow = to_arrow_schema(schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch in batches:
            text = [None if ids is None else _text(ids, table) for ids in batch.column(ids_col).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(text, pa.string())], schema=arrow)

    return encoded.mapInArrow(tidy(joined), schema)
