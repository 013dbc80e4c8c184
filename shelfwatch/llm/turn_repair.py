"""Conversation structure repair as a shortest path with scalar big-integer weights.

A conversation's role initials shall read ``(s?(ua)+)?``. Rows may be kept (0), given the role user or assistant (2) or
deleted (3; blank rows and repetitions must be), and an empty user or assistant row may be inserted anywhere (2); a
truncated row that is not deleted adds 1. Of all cheapest repairs the one whose audit string (K, R, D, I in order) is
least in ASCII is taken.

Weights. The repair is a path through a DAG of (rows read, last role). Its weight is one integer: the cost in the high
digits, below it one fixed-width digit per audit letter, the first letter highest, zeros at the end. Adding an edge adds
its cost and its letter's digit at the next place, and the integer minimum decides cost and audit order at once.
Two equally cheap paths to a node are never one the start of the other (more letters mean more insertions), so the
places below their first difference do not matter and the minimum at a node is the start of the minimum behind it.
The digits of the best integer are the audit; no way back is stored.

Distribution. Rows are sorted by (conversation, turn, role, text) in ranges, so a conversation lies in one task or, if
it is long or stands at a border, in pieces: a task cuts it after PIECE_ROWS rows or PIECE_CHARS characters. A
conversation in one piece is repaired where it lies. For the others, what an earlier piece has seen is found by an
aggregate over row digests, each piece gives the best path between each pair of last roles (piece by piece, at most 16
integers), one pass over these in order takes the integer minimum over their chains, and each piece is repaired
between the roles chosen for it. No task holds more than a piece's rows; only audit strings of a long conversation, which are part of
the result, come together.

Null conversation ids are a conversation. Rows are ordered by turn (nulls first), then role, text (bytes). Null roles and
texts count as one space. Repeated rows are rows. Dropped rows keep their conversation in the result. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import staged

PIECE_ROWS = 4096
PIECE_CHARS = 4_000_000
#: Audit letters by digit, in ASCII order; digits have three bits and zero is the padding.
LETTERS = "?DIKR"
_SPELLED = str.maketrans("1234", LETTERS[1:])
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
BITS = 3  # a digit is an octal one
#: Last role read: none yet, system, user, assistant. A conversation may end before its first row or after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
_NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: Where an inserted or rerolled row leads.
_ANY = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAME = {USER: "user", ASSISTANT: "assistant"}
_SPACE = " \t\n\x0b\x0c\r"

#: Number of the piece without rows that ends a conversation in several pieces.
_END = (1 << 63) - 1
_ROW = "array<struct<role: string, text: string, fault: string>>"
_FIXED = ("conv_id {id}, piece long, whole boolean, n long, first_role string, last_role string, first_turn long, last_turn long, turns long, "
          "blank long, duplicate long, truncated long, illegal long, cost long, audit string, rows " + _ROW)


def damaged(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, times of the rows after the fixed damage; dropped rows have times 0."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(said(id_col), F.lit(":"), said(turn_col))) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(said(text_col))
    return turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.when(lot == 4, "user").otherwise(said(role_col)).alias("role"), text.alias("text"),
                        F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).alias("times"))


def fault_of(text: str, again: bool) -> str | None:
    bare = text.rstrip(_SPACE)
    return "blank" if not bare else "duplicate" if again else None if bare[-1] in ".!?" else "truncated"


def _letters(digits: int, places: int, n: int) -> str:
    """The first ``n`` of the letters in so many places."""
    octal = f"{digits:0{places}o}"[:n] if n else ""
    return octal.translate(_SPELLED)


class Paths:
    """Lightest paths through rows read so far: by last role, (weight, letters)."""

    def __init__(self, places: int, begin: int):
        self.high = BITS * places  # the cost stands above this bit
        self.best: dict[int, tuple[int, int]] = {begin: (0, 0)}

    def _edges(self, edges: list[tuple[int, int, int, int]], stay: bool) -> None:
        """Take (from, to, cost, letter) edges; ``stay`` keeps the nodes the edges start from."""
        new = dict(self.best) if stay else {}
        for a, b, cost, letter in edges:
            if a in self.best:
                weight, n = self.best[a]
                weight += (cost << self.high) + (letter << (self.high - BITS * (n + 1)))
                if b not in new or weight < new[b][0]:
                    new[b] = weight, n + 1
        self.best = new

    def insert(self) -> None:
        for _ in range(2):  # a third insertion would come back to the role after the first
            self._edges([(a, b, 2, INSERT) for a, b in _ANY.items()], True)

    def row(self, role: str, fault: str | None) -> None:
        self.insert()
        edges = [(a, a, 3, DELETE) for a in range(4)]
        if fault not in ("blank", "duplicate"):
            more = int(fault == "truncated")
            edges += [(a, _ANY[a], 2 + more, REROLE) for a in range(4)]
            edges += [(a, to[role[:1]], more, KEEP) for a, to in _NEXT.items() if role[:1] in to]
        self._edges(edges, False)

    def read(self, end: int) -> tuple[int, str]:
        """Cost and audit of the path to ``end``."""
        weight, n = self.best[end]
        return weight >> self.high, _letters(weight & ((1 << self.high) - 1), self.high // BITS, n)


def best_paths(rows: list[tuple[str, str, str | None]], begin: int, last: bool) -> Paths:
    """Lightest paths through (role, text, fault) rows from the role ``begin``; insertions behind the last row only if ``last``."""
    paths = Paths(3 * len(rows) + 2, begin)
    for role, _, fault in rows:
        paths.row(role, fault)
    if last:
        paths.insert()
    return paths


def applied(rows: list[tuple[str, str, str | None]], audit: str, begin: int) -> list[tuple[str, str]]:
    """(role, text) of the rows that the audit's edits leave."""
    out, at, here = [], iter(rows), begin
    for letter in audit:
        role, text, _ = next(at) if letter != "I" else ("", "", None)
        if letter == "K":
            here = _NEXT[here][role[:1]]
            out.append((role, text))
        elif letter != "D":
            here = _ANY[here]
            out.append((_NAME[here], text))
    return out


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


class _Piece:
    """Rows of one conversation in order, as far as one task holds them."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.chars, self.seen, self.turns = conv_id, [], 0, set(), []

    def add(self, turn: int | None, role: str, text: str) -> None:
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        self.rows.append((role, text, fault_of(text, mark in self.seen)))
        self.seen.add(mark)
        self.chars += len(role) + len(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    @property
    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.chars >= PIECE_CHARS

    def record(self, number: int, whole: bool) -> dict:
        out = {"conv_id": self.conv_id, "piece": number, "whole": whole, "n": len(self.rows)}
        out |= {"first_turn": self.turns[0] if self.turns else None, "last_turn": self.turns[-1] if self.turns else None, "turns": len(self.turns)}
        roles = [r for r, *_ in self.rows]
        out |= {"first_role": roles[0] if roles else None, "last_role": roles[-1] if roles else None, "illegal": _illegal(roles)}
        out |= {k: sum(f == k for *_, f in self.rows) for k in ("blank", "duplicate", "truncated")}
        rows = self.rows
        if whole:
            paths = best_paths(rows, START, True)
            out["cost"], out["audit"] = paths.read(min((e for e in ENDS if e in paths.best), key=lambda e: paths.best[e][0]))
            rows = [(*r, None) for r in applied(rows, out["audit"], START)]
        out["rows"] = [dict(zip(("role", "text", "fault"), r)) for r in rows]
        return out


def _pieces(shape: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, first, continued, ready, chars = None, True, False, [], 0

        def out() -> pa.RecordBatch:
            nonlocal ready, chars
            batch = pa.RecordBatch.from_pylist(ready, schema=shape)
            ready, chars = [], 0
            return batch

        def close(border: bool) -> None:
            """``border``: the conversation may go on in the next task, or in this task's next piece."""
            nonlocal first, chars
            ready.append(piece.record(number, not (border or first or continued)))
            chars += piece.chars

        for b in batches:
            for conv, turn, role, text, times, row in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "times", "row"))):
                if piece is None or conv != piece.conv_id or piece.full:
                    if piece is not None:
                        more = conv == piece.conv_id
                        close(more)
                        first, continued = first and more, more
                        if len(ready) >= 1000 or chars >= PIECE_CHARS:
                            yield out()
                    piece, number = _Piece(conv), row
                for _ in range(times):
                    piece.add(turn, role, text)
        if piece is not None:
            close(True)
            yield out()

    return work


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a conversation in order, with their paths, to the role each begins with and its edits.

    A chain's weight is again one integer: a piece widens it by the piece's places, adds its cost to the high digits and
    its letters behind the chain's letters.
    """
    conv, held, best, places = None, [], {}, 0  # held: (piece, last role -> (role before it, the piece's cost and audit))
    shape = None

    def settled() -> pa.RecordBatch:
        out, end = [], min((e for e in ENDS if e in best), key=lambda e: best[e][0])
        for piece, came in reversed(held):
            begin, cost, audit = came[end]
            out.append({"conv_id": conv[0], "piece": piece, "begin": begin, "cost": cost, "audit": audit})
            end = begin
        return pa.RecordBatch.from_pylist(out, schema=shape)

    for b in batches:
        shape = pa.schema([b.schema.field("conv_id"), ("piece", pa.int64()), ("begin", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        for r in b.to_pylist():
            if conv is None or conv[0] != r["conv_id"]:
                if conv is not None:
                    yield settled()
                conv, held, best, places = (r["conv_id"],), [], {START: (0, 0)}, 0
            wider, came, new = r["places"], {}, {}
            for p in r["paths"]:
                if p["begin"] in best:
                    weight, n = best[p["begin"]]
                    own = int.from_bytes(p["weight"], "big")
                    cost, low = own >> (BITS * wider), own & ((1 << (BITS * wider)) - 1)
                    weight = (weight << (BITS * wider)) + (cost << (BITS * (places + wider))) + (low << (BITS * (places - n)))
                    if p["end"] not in new or weight < new[p["end"]][0]:
                        new[p["end"]], came[p["end"]] = (weight, n + p["letters"]), (p["begin"], cost, _letters(low, wider, p["letters"]))
            best, places = new, places + wider
            held.append((r["piece"], came))
    if conv is not None:
        yield settled()


def repaired(turns: DataFrame) -> DataFrame:
    """The pieces of each conversation, repaired: conv_id, piece (ascending in its order), whole, the counts of its faults, cost, audit, rows.

    ``turns``: conv_id, turn, role, text, times (how often the row stands there; 0 keeps only the conversation).
    ``rows`` are the rows of the repair (role, text); a conversation in one piece has ``whole``.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    keys = ["conv_id", "turn", "role"]
    rows = turns.withColumn("row", F.monotonically_increasing_id())
    # Equal rows may be dealt apart: their order among themselves does not matter.
    rows = rows.repartitionByRange(*keys, F.substring("text", 1, 64), "row").sortWithinPartitions(*keys, "text")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shape = to_arrow_schema(_parse_datatype_string(_FIXED.format(id=kind)))
    pieces = staged(rows.mapInArrow(_pieces(shape), _FIXED.format(id=kind)), "repair-pieces")
    whole = pieces.where("whole")
    parts = pieces.where("not whole")

    # What an earlier piece of the conversation has seen is a duplicate: digests of rows, first piece of each.
    same = F.array_distinct(F.transform("rows", lambda r: F.md5(F.concat(F.length(r["role"]).cast("string"), F.lit(":"), r["role"], r["text"]))))
    marks = parts.select("conv_id", "piece", F.explode(same).alias("mark"))
    firsts = marks.groupBy("conv_id", "mark").agg(F.min("piece").alias("first")).withColumnsRenamed({"conv_id": "_conv", "mark": "_mark"})
    again = marks.join(firsts, marks["conv_id"].eqNullSafe(firsts["_conv"]) & (marks["mark"] == firsts["_mark"]) & (marks["piece"] > firsts["first"]))
    again = again.groupBy("piece").agg(F.collect_set("mark").alias("again")).withColumnRenamed("piece", "_piece")  # a piece's digests at most
    parts = parts.join(again, parts["piece"] == again["_piece"], "left")
    fault = lambda r: F.when((r["fault"].isNull() | (r["fault"] == "truncated")) & F.coalesce(F.array_contains("again", F.md5(F.concat(
        F.length(r["role"]).cast("string"), F.lit(":"), r["role"], r["text"]))), F.lit(False)), "duplicate").otherwise(r["fault"])
    parts = parts.withColumn("rows", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"), fault(r).alias("fault"))))
    count = lambda k: F.size(F.filter("rows", lambda r: r["fault"] == k)).cast("long")
    counts = {k: count(k) for k in ("blank", "duplicate", "truncated")}
    parts = staged(parts.withColumns(counts).select(*pieces.columns), "repair-parts")

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, places = [], []
            for held in b["rows"]:
                rows, out = [(r["role"], r["text"], r["fault"]) for r in held.as_py()], []
                for begin in range(4):
                    # Insertions behind the last row are those before the next piece's first.
                    ways = best_paths(rows, begin, False)
                    out += [{"begin": begin, "end": end, "weight": w.to_bytes((w.bit_length() + 7) // 8, "big"), "letters": n} for end, (w, n) in ways.best.items()]
                found.append(out)
                places.append(ways.high // BITS)
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["piece"], pa.array(places, pa.int64()), pa.array(found, steps)], ["conv_id", "piece", "places", "paths"])

    steps = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("weight", pa.binary()), ("letters", pa.int64())]))
    found = parts.select("conv_id", "piece", "rows").mapInArrow(
        paths, f"conv_id {kind}, piece long, places long, paths array<struct<begin: int, end: int, weight: binary, letters: bigint>>")
    # Each conversation ends with a piece without rows, which can only insert.
    ending = []
    for begin in range(4):
        ways = best_paths([], begin, True)
        ending += [(begin, end, w.to_bytes((w.bit_length() + 7) // 8, "big"), n) for end, (w, n) in ways.best.items()]
    ending_col = F.array(*(F.struct(*(F.lit(v).cast(t).alias(c) for c, v, t in zip(("begin", "end", "weight", "letters"), x, ("int", "int", "binary", "long")))) for x in ending))
    ends = parts.select("conv_id").distinct().select("conv_id", F.lit(_END).alias("piece"), F.lit(ways.high // BITS).cast("long").alias("places"), ending_col.alias("paths"))
    found = found.unionByName(ends).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    chosen = staged(found.mapInArrow(_chained, f"conv_id {kind}, piece long, begin int, cost long, audit string"), "repair-chosen")
    both = parts.drop("cost", "audit").join(chosen.where(F.col("piece") < _END).drop("conv_id"), "piece")
    empty = {c: F.lit(None).cast("string") for c in ("first_role", "last_role")} | {c: F.lit(None).cast("long") for c in ("first_turn", "last_turn")}
    empty |= {c: F.lit(0).cast("long") for c in ("n", "turns", "blank", "duplicate", "truncated", "illegal")}
    both = both.unionByName(chosen.where(F.col("piece") == _END).withColumns(empty | {"whole": F.lit(False), "rows": F.array().cast(_ROW)}))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = []
            for held, audit, begin in zip(b["rows"], b["audit"].to_pylist(), b["begin"].to_pylist()):
                rows = [(r["role"], r["text"], r["fault"]) for r in held.as_py()]
                left.append([{"role": r, "text": t, "fault": None} for r, t in applied(rows, audit, begin)])
            at = b.schema.get_field_index("rows")
            b = b.set_column(at, b.schema.field(at), pa.array(left, b.schema.field(at).type))
            yield b.select(shape.names)

    edited = both.select(*shape.names, "begin").mapInArrow(edit, _FIXED.format(id=kind))
    return whole.unionByName(edited)


def summary(pieces: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repaired`: gaps, fault counts, cost, audit and the digest of the repaired rows."""
    said = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    gaps = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0).cast("long")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    whole = pieces.where("whole").withColumns({"gaps": gaps, "repaired_sha256": F.sha2(said, 256)}).select(*names)
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces in order, one at a time; a digest of one text can only be taken in its order."""
        now, schema = None, None

        def row() -> pa.RecordBatch:
            gaps = now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0
            values = (now["conv_id"], gaps, *(now[k] for k in names[2:7]), "".join(now["audit"]), now["sha"].hexdigest())
            return pa.RecordBatch.from_pylist([dict(zip(names, values))], schema=schema)

        for b in batches:
            schema = pa.schema([b.schema.field("conv_id"), *((c, pa.int64()) for c in names[1:7]), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        yield row()
                    now = {"conv_id": r["conv_id"], "first": None, "last": None, "turns": 0, "role": None, "sha": hashlib.sha256(), "any": False, "audit": []} | dict.fromkeys(names[2:7], 0)
                for k in names[2:7]:
                    now[k] += r[k]
                now["audit"].append(r["audit"])
                if r["turns"]:
                    now["turns"] += r["turns"] - (now["last"] == r["first_turn"])
                    now["first"], now["last"] = r["first_turn"] if now["first"] is None else now["first"], r["last_turn"]
                if r["n"]:
                    now["illegal"] += now["role"] is not None and now["role"][:1] + r["first_role"][:1] not in ("su", "ua", "au")
                    now["role"] = r["last_role"]
                for x in r["rows"]:
                    now["sha"].update(("\n" if now["any"] else "").encode() + f"{x['role']}:{x['text']}".encode())
                    now["any"] = True
        if now is not None:
            yield row()

    parts = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    types = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in names[1:7]) + ", audit string, repaired_sha256 string"
    return whole.unionByName(parts.mapInArrow(joined, types))
