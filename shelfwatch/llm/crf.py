"""Secret scan: fixed patterns plus a linear-chain conditional random field.

The patterns (password-like assignments, access keys, long hex strings) give the base spans. The random field tags
every token of every line as secret begin, inside or outside from its shape, length and digits, the neighbouring words
and features of the file, decoded by Viterbi; spans it finds that touch no base span are added. A line is one chain.
Features read all characters of a token; a length over 63 counts as 64.

What a word adds to the scores is worked out once per distinct word, a text's scores are sums of such rows. A token at
which leaving the outside cannot pay whatever its neighbours are tagged splits its line into parts that are decoded
one by one, with the same result as the whole line (see ``Field._outside``).

The field learns from the base spans of about TRAIN_DOCS documents that a hash of the text picks (tokens covered by
a span are begin/inside, the others outside): lines with a span first, then lines with a long token, then
one of PLAIN_PART other lines, at most TRAIN_CHAINS in all; lines over TRAIN_LENGTH tokens are learned in parts. The
driver fits the weights by stochastic gradient ascent on the conditional likelihood. Every whole text is scanned.

So that the field does not just repeat the patterns, each line with a span is also learned in DISGUISES copies in which
the words that tell a known form (the key's name) are hidden from their neighbours and most secrets are rewritten as
random strings of other alphabets. On planted secrets of seven forms that no training row has it finds nine in ten and
tags nothing in ten thousand documents without one (see the README).

Null texts count as empty and have no spans. Positions are code points, ends exclusive. Repeated rows, null ids and
empty tables need no special care.
"""

from __future__ import annotations

import bisect
import random
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.llm.common import sliced
from shelfwatch.llm.shingles import mixed

TRAIN_DOCS = 20_000
TRAIN_CHAINS = 40_000
#: One of so many lines without span and long token with a digit is learned from, and a line in parts of so many tokens.
PLAIN_PART = 32
TRAIN_LENGTH = 256
#: A token of so many characters is a long one even without a digit.
HARD = 16
#: Disguised copies of a line with a span (see ``disguised``).
DISGUISES = 8
BATCH = 32
#: Passes over the chains; few chains are passed over more often, up to so many times for so many steps.
EPOCHS, MOST_EPOCHS, STEPS = 4, 40, 1000
DIMS = 1 << 14
B, I, O = range(3)
KINDS = ("assign", "access", "hex", "crf")

# Base patterns (fixed values).
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TRIGGERS = ("passw", "secret", "token", "api")

_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+|[^\sA-Za-z0-9+/_.=-]+")
_PIECE = re.compile(r"\n|" + _TOKEN.pattern)
_LONG = re.compile(r"[A-Za-z+/_.=-]*[0-9][A-Za-z0-9+/_.=-]*")
_NEAR = (-3, -2, -1, 1)
#: A scan forgets its words beyond so many of them, or characters of them.
MOST_WORDS, MOST_CHARS = 200_000, 20_000_000
#: New words read at a time.
FRESH = 20_000


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself), by start and then kind."""
    out = []
    low = text.lower()
    if any(t in low for t in _TRIGGERS):
        out += [(m.start(), m.end(), "assign", m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", m.start()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _hashed(value: np.ndarray, name: int) -> np.ndarray:
    """Feature numbers of some values under a feature's number; 0 is the feature that says nothing."""
    return (mixed(value.astype(np.uint64) + np.uint64(name * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(DIMS - 1)).astype(np.int64) + 1


class _Read:
    """What words look like, worked out for all of them at once over all their characters."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.owner = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(self.code)) - self.start[self.owner]
        self.n = len(words)

    def total(self, per_char: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, per_char, self.n)

    def hashed(self, per_char: np.ndarray, place: np.ndarray, on: np.ndarray) -> np.ndarray:
        """A hash of each word's marked characters, in order."""
        part = mixed(per_char.astype(np.uint64) + mixed(place.astype(np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum(np.where(on, part, np.uint64(0)), dtype=np.uint64))
        return sums[self.start + self.size] - sums[self.start]

    def lowered(self) -> np.ndarray:
        code = np.where((self.code >= 65) & (self.code <= 90), self.code + 32, self.code)
        return self.hashed(code, self.place, np.ones(len(code), bool))

    def own(self) -> np.ndarray:
        """What words say of themselves, OWN feature numbers each."""
        code, size = self.code, np.maximum(self.size, 1)
        digit, upper, lower = (code >= 48) & (code <= 57), (code >= 65) & (code <= 90), (code >= 97) & (code <= 122)
        kind = np.where(digit, 1, np.where(upper, 2, np.where(lower, 3, code + 4)))
        new = np.append(True, kind[1:] != kind[:-1]) | (self.place == 0) if len(code) else np.empty(0, bool)
        run = np.cumsum(new) - 1 if len(code) else np.empty(0, np.int64)
        long_run = np.bincount(run) > 1 if len(code) else np.empty(0, bool)
        nth = np.cumsum(new) - np.append(0, np.cumsum(new))[self.start][self.owner] if len(code) else run
        shape = self.hashed(2 * kind + long_run[run], nth, new) if len(code) else np.zeros(self.n, np.uint64)
        # Bits of entropy per character, in halves.
        order = np.lexsort((code, self.owner))
        c, o = code[order], self.owner[order]
        head = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (o[1:] != o[:-1]))) if len(code) else np.empty(0, np.int64)
        count = np.diff(np.append(head, len(code)))
        share = count / size[o[head]]
        spread = (2 * np.bincount(o[head], -share * np.log2(share), self.n) + 1e-9).astype(np.int64)
        digits, signs = self.total(digit), self.total(~(digit | upper | lower))
        cases = 2 * (self.total(upper) > 0) + (self.total(lower) > 0)
        turns = 10 * self.total(new) // size  # changes from one kind of character to another
        length = np.minimum(self.size, 64) // 4
        wide = np.searchsorted([8, 12, 16, 24], self.size, "right")
        rows = [np.zeros(self.n), shape, length, spread, self.hashed(code, self.place, self.place < 4), 10 * digits // size, np.minimum(signs, 9), cases, turns,
                (wide * 16 + np.minimum(turns, 15)) * 16 + np.minimum(spread, 15), (wide * 16 + 10 * digits // size) * 4 + cases, wide * 8 + np.minimum(signs, 7)]
        return np.stack([_hashed(np.asarray(x), k) for k, x in enumerate(rows)], 1)


OWN = 12


def _beside(lowered: np.ndarray) -> np.ndarray:
    """What words say of those that have them at each of the places _NEAR, from their hash."""
    return np.stack([_hashed(lowered, OWN + k) for k in range(len(_NEAR))], 1)


#: Beyond the line there is the empty word.
_NOTHING = _beside(np.zeros(1, np.uint64))[0]


def _file(text: str) -> np.ndarray:
    digits, marks = min(9, 200 * sum(map(text.count, "0123456789")) // max(1, len(text))), min(5, text.count("=") + text.count(":"))
    return np.array([_hashed(np.array([x]), OWN + len(_NEAR) + k)[0] for k, x in enumerate((digits, marks))])


def _lines(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """(start, end, word) of the tokens of each line that has any."""
    line: list = []
    for m in _PIECE.finditer(text):
        if m[0] != "\n":
            line.append((m.start(), m.end(), m[0]))
        elif line:
            yield line
            line = []
    if line:
        yield line


def _chain(words: list[str], file: np.ndarray, hidden: np.ndarray | None = None) -> np.ndarray:
    """Features of a line's tokens, a row each; neighbours do not see the ``hidden`` words."""
    read = _Read(words)
    beside = _beside(read.lowered())
    if hidden is not None:
        beside[hidden] = 0
    padded = np.concatenate([np.repeat(_NOTHING[None], 3, 0), beside, _NOTHING[None]])
    near = [padded[3 + d:3 + d + len(words), k] for k, d in enumerate(_NEAR)]
    return np.concatenate([read.own(), np.stack(near, 1), np.repeat(file[None], len(words), 0)], 1)


def chains(text: str) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """All tokens of each line: (start, end, features)."""
    file = _file(text)
    for line in _lines(text):
        yield [(a, b, f) for (a, b, _), f in zip(line, _chain([w for _, _, w in line], file))]


class Stretches:
    """Merged stretches of some spans, to look up what overlaps them."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.start, self.end = [], []
        for a, b in sorted(spans):
            if self.end and a < self.end[-1]:
                self.end[-1] = max(self.end[-1], b)
            else:
                self.start.append(a)
                self.end.append(b)

    def hit(self, a: int, b: int) -> int | None:
        """Number of the last stretch that overlaps a to b, if any."""
        i = bisect.bisect_left(self.start, b) - 1
        return i if i >= 0 and self.end[i] > a else None


def _labels(line: list[tuple[int, int, str]], secrets: Stretches) -> list[int]:
    out, inside = [], None
    for start, end, _ in line:
        hit = secrets.hit(start, end)
        out.append(O if hit is None else I if hit == inside else B)
        inside = hit
    return out


#: Alphabets and lengths of the strings that stand for secrets of other forms in training.
_ALPHABETS = [(string.ascii_letters + string.digits, 12, 40), (string.ascii_letters, 12, 24), (string.ascii_uppercase + string.digits, 14, 32),
              (string.ascii_letters + string.digits + "+/_-", 16, 64), (string.ascii_lowercase + string.digits, 14, 40)]


def disguised(words: list[str], tags: list[int], draw: random.Random) -> tuple[list[str], np.ndarray]:
    """A line's words with its secrets rewritten in another alphabet, and which words their neighbours shall not see.

    What tells the known forms apart (the key's name, the shape of the string) is thus missing from a part of training.
    """
    words, hidden = list(words), np.zeros(len(words), bool)
    rewrite = draw.random() < 0.8
    for i, tag in enumerate(tags):
        if tag == O:
            continue
        if rewrite:
            letters, least, most = draw.choice(_ALPHABETS)
            words[i] = "".join(draw.choices(letters, k=draw.randint(least, most)))
            if draw.random() < 0.4:  # behind a name of its own, as one token
                words[i] = "".join(draw.choices(string.ascii_lowercase, k=draw.randint(2, 6))) + draw.choice("_-=") + words[i]
        for j in (*range(max(0, i - 3), i), *range(i + 1, min(len(words), i + 2))):
            if tags[j] == O and (words[j].isalnum() or draw.random() < 0.5):
                hidden[j] = True
    return words, hidden


class Field:
    """Weights of tags by feature and of tag pairs; a chain begins and ends outside, and inside never follows outside."""

    def __init__(self):
        self.by_feature, self.pairs = np.zeros((DIMS, 3)), np.zeros((3, 3))
        self._seen, self._seen_pairs = np.full((DIMS, 3), 1e-2), np.full((3, 3), 1e-2)
        self.barred = np.zeros((3, 3))
        self.barred[O, I] = -1e9

    def _scores(self, features: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.stack([self.by_feature[f].sum(0) for f in features]), self.pairs + self.barred

    def learn(self, features: list[list[int]], tags: list[int], rate: float = 0.2) -> None:
        """One step up the gradient of a chain's log-likelihood."""
        self.learn_all([(features, tags)], rate)

    def learn_all(self, batch: list[tuple[list[list[int]], list[int]]], rate: float = 0.2) -> None:
        """One step up the gradient of the log-likelihood of some chains: observed minus expected counts (forward-backward).

        Shorter chains go on outside to the length of the longest, which adds the same to all their paths.
        """
        k, n = len(batch), max(len(t) for _, t in batch)
        flat = np.concatenate([np.asarray(f, np.int64) for chain, _ in batch for f in chain])
        width = np.array([len(f) for chain, _ in batch for f in chain])
        col = np.repeat(np.arange(k), [len(t) for _, t in batch])
        row = np.concatenate([np.arange(len(t)) for _, t in batch])
        tags = np.full((n, k), O)
        tags[row, col] = np.concatenate([np.asarray(t) for _, t in batch])
        emit, trans = np.full((n, k, 3), -1e9), self.pairs + self.barred
        emit[:, :, O] = 0
        emit[row, col] = np.add.reduceat(self.by_feature[flat], np.cumsum(width) - width, axis=0)
        lse = lambda x, axis: (m := x.max(axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))
        ahead, back = np.zeros((n, k, 3)), np.zeros((n, k, 3))
        ahead[0] = trans[O] + emit[0]
        for i in range(1, n):
            ahead[i] = lse(ahead[i - 1][:, :, None] + trans, 1) + emit[i]
        back[-1] = trans[:, O]
        for i in range(n - 2, -1, -1):
            back[i] = lse(trans + (emit[i + 1] + back[i + 1])[:, None], 2)
        whole = lse(ahead[-1] + back[-1], 1)
        expected = np.exp(ahead + back - whole[:, None])
        step_pairs = -np.exp(ahead[:-1, :, :, None] + trans + (emit + back)[1:, :, None] - whole[:, None, None]).sum((0, 1))
        step_pairs[O] -= expected[0].sum(0)
        step_pairs[:, O] -= expected[-1].sum(0)
        out = np.full((1, k), O)
        np.add.at(step_pairs, (np.concatenate([out, tags]), np.concatenate([tags, out])), 1)
        step = (np.eye(3)[tags] - expected)[row, col].repeat(width, axis=0)
        step = np.stack([np.bincount(flat, step[:, t], DIMS) for t in range(3)], axis=1)
        step[0] = 0  # says nothing
        self._seen += step ** 2
        self.by_feature += rate * step / np.sqrt(self._seen)
        self._seen_pairs += step_pairs ** 2
        self.pairs += rate * step_pairs / np.sqrt(self._seen_pairs)

    def viterbi(self, features: list[list[int]]) -> list[int]:
        return self._decode(self._scores(features)[0])

    def _decode(self, emit: np.ndarray) -> list[int]:
        """The best tags of a chain that begins and ends outside."""
        trans = (self.pairs + self.barred).tolist()
        columns, rows = list(zip(*trans)), emit.tolist()
        best, came = [a + b for a, b in zip(trans[O], rows[0])], []
        for e in rows[1:]:
            x, y, z = best
            best, back = [], []
            for (p, q, r), s in zip(columns, e):
                p, q, r = x + p, y + q, z + r
                top = p if p >= q and p >= r else q if q >= r else r
                back.append(B if top == p else I if top == q else O)
                best.append(top + s)
            came.append(back)
        last = [a + b for a, b in zip(best, columns[O])]
        tags = [last.index(max(last))]
        for back in reversed(came):
            tags.append(back[tags[-1]])
        return tags[::-1]

    def _outside(self, emit: np.ndarray) -> np.ndarray:
        """Whether a token is outside in every best path, for rows of scores in which each line is followed by a row of its end.

        Take a path with another tag s at token j, between a and b. If b is not inside, put outside in place of s: the
        score grows by the gap of j and a difference of pair weights, whose least value over a and b is ``plain``. If b is
        inside, which must not follow outside, make it begin as well: the scores of j + 1 and the pair after it come in
        (``begun``). Where both sums are above zero for begin and inside, no best path has anything but outside at j.
        """
        t = self.pairs + self.barred
        swap = np.append(emit[1:, B] - emit[1:, I], 0.0)
        sure = np.ones(len(emit), bool)
        for s in (B, I):
            gap = emit[:, O] - emit[:, s]
            plain = min(t[a, O] + t[O, b] - t[a, s] - t[s, b] for a in range(3) for b in (B, O))
            begun = min(t[a, O] + t[O, B] + t[B, c] - t[a, s] - t[s, I] - t[I, c] for a in range(3) for c in range(3))
            sure &= (gap + plain > 1e-6) & (gap + swap + begun > 1e-6)
        return sure

    def _emissions(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the tokens and line ends of a text, and which are line ends."""
        words = _words_of(self.by_feature)
        ids = np.array([0, 0, 0, *map(words.__getitem__, _PIECE.findall(text)), 0, 0])
        words.score()
        n = len(ids) - 4
        own, one, after = ids[3:3 + n], ids[2:2 + n], ids[4:4 + n]
        two = np.where(one == 0, 0, ids[1:1 + n])  # what lies beyond a line end does not count
        three = np.where(two == 0, 0, ids[:n])
        emit = words.own[own] + self.by_feature[_file(text)].sum(0)
        for k, at in enumerate((three, two, one, after)):
            emit += words.beside[k][at]
        return emit, own == 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        emit, ends = self._emissions(text)
        at = np.flatnonzero(~(self._outside(emit) | ends))
        if not len(at):
            return []
        tags = np.full(len(emit), O)
        for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            tags[part] = self._decode(emit[part])
        if (tags == O).all():
            return []
        out: list[list[int]] = []
        for m, tag in zip(_PIECE.finditer(text), tags.tolist()):
            if tag == B:
                out.append([m.start(), m.end()])
            elif tag == I:
                out[-1][1] = m.end()
        return [tuple(s) for s in out]


class _Words(dict):
    """Numbers of words, 0 for a line end, and what each adds to the scores of its own and of the tokens beside it."""

    def __init__(self, by_feature: np.ndarray):
        super().__init__({"\n": 0})
        self.by_feature, self.fresh, self.chars, self.done = by_feature, [], 0, 1
        self.own, self.beside = np.zeros((1024, 3)), np.zeros((4, 1024, 3))
        self.beside[:, 0] = by_feature[_NOTHING]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        self.chars += len(word)
        return n

    def score(self) -> None:
        """Scores of the words that came since the last call."""
        if not self.fresh:
            return
        if len(self) > len(self.own):
            more = max(len(self), 2 * len(self.own)) - len(self.own)
            self.own, self.beside = np.pad(self.own, ((0, more), (0, 0))), np.pad(self.beside, ((0, 0), (0, more), (0, 0)))
        for at in range(0, len(self.fresh), FRESH):
            read = _Read(self.fresh[at:at + FRESH])
            rows = slice(self.done, self.done + read.n)
            self.own[rows] = self.by_feature[read.own()].sum(1)
            self.beside[:, rows] = self.by_feature[_beside(read.lowered())].transpose(1, 0, 2)
            self.done += read.n
        self.fresh = []


#: The word table of the field this process works with; the tasks of a worker share it.
_held: list[_Words] = []


def _words_of(by_feature: np.ndarray) -> _Words:
    """The table for these weights; each task of a worker brings its own copy of equal weights."""
    if not _held or not np.array_equal(_held[0].by_feature, by_feature) or len(_held[0]) > MOST_WORDS or _held[0].chars > MOST_CHARS:
        _held[:] = [_Words(by_feature.copy())]
    return _held[0]


def fit(docs: DataFrame, *, text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Field:
    """A field that has learned from the base spans of some of ``docs``."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    part = min(1.0, train_docs / max(1, docs.count()))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out = []

            def add(rank: int, mark: int, features: np.ndarray, tags: list[int]) -> None:
                while len(tags):  # a part ends where the next token is no inside
                    n = next((i for i in range(TRAIN_LENGTH, len(tags)) if tags[i] != I), len(tags))
                    out.append((rank, mark, features[:n].astype(np.uint16).tobytes(), bytes(tags[:n])))
                    features, tags = features[n:], tags[n:]

            for text in batch.column(0).to_pylist():
                secrets, file = Stretches([(s[3], s[1]) for s in base_spans(text)]), None
                for line in _lines(text):
                    words = [w for _, _, w in line]
                    mark = zlib.crc32("".join(words).encode("utf-8", "surrogatepass"))
                    tags = _labels(line, secrets)
                    rank = 0 if any(t != O for t in tags) else 1 if any(len(w) >= HARD or len(w) >= 8 and _LONG.fullmatch(w) for w in words) else 2
                    if rank == 2 and mark % PLAIN_PART:
                        continue
                    file = _file(text) if file is None else file
                    add(rank, mark, _chain(words, file), tags)
                    for k in range(DISGUISES if rank == 0 else 0):
                        add(rank, mark, _chain(*(x := disguised(words, tags, random.Random(mark * DISGUISES + k)))[:1], file, x[1]), tags)
            columns = zip(*out) if out else [[]] * 4
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["rank", "mark", "features", "tags"])

    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(part * (1 << 20)))
    chosen = sample.mapInArrow(sent, "rank int, mark long, features binary, tags binary").orderBy("rank", "mark", "tags", "features").limit(TRAIN_CHAINS)
    found = sorted((bytes(r.tags), bytes(r.features)) for r in chosen.collect())  # the same order whatever the tasks' order
    chain = lambda i: (np.frombuffer(found[i][1], np.uint16).reshape(len(found[i][0]), -1), list(found[i][0]))
    field, order = Field(), np.random.default_rng(11)
    for _ in range(max(EPOCHS, min(MOST_EPOCHS, STEPS * BATCH // max(1, len(found))))):
        # Chains of like length go together, the groups in random order.
        mixed = sorted(order.permutation(len(found)).tolist(), key=lambda i: len(found[i][0]).bit_length())
        groups = [mixed[lo:lo + BATCH] for lo in range(0, len(mixed), BATCH)]
        for g in order.permutation(len(groups)):
            field.learn_all([chain(i) for i in groups[g]])
    return field


def scan(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans (array of kind, start, end; base spans first by place, then kind) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", span)])
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                spans = [s[:3] for s in base_spans(text)]
                known = Stretches([s[:2] for s in spans])
                spans += [(a, b, "crf") for a, b in field.spans(text) if known.hit(a, b) is None]
                out.append([{"kind": k, "start": a, "end": b} for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))])
            yield pa.record_batch([batch.column("id"), pa.array(out, kinds)], ["id", "spans"])

    return rows.mapInArrow(tagged, schema).select(F.col("id").alias(id_col), "spans")
