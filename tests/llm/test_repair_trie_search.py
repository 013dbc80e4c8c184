"""Conversation repair, the trie join and the dual-tree search on hard rows, against SQL and brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import ROWS, SCHEMA
from oracle import compare, duck
from pyspark.sql import functions as F

from shelfwatch.llm import dual_tree, trie_join, turn_repair
from shelfwatch.llm import queries as q
from shelfwatch.llm.components import components

TURNS = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"), (1, 3, "user", "Why"), (1, 9, "tool", None), (None, 0, "user", "Lost."),
         (None, None, None, None), (2, None, "user", "No turn?"), (2, None, "user", "No turn?"), (2, None, "assistant", ""), (2, 4, "user", " \n\t"), (3, 5, "", "x."), (3, 5, "", "x."),
         (3, 5, "sys", "y."), (3, 6, None, "z."), (4, 1, "assistant", "Only a reply."), (5, 1, "user", "One "), (6, -3, "user", "a.\n"), (6, 7, "assistant", "b:c\nd."), (None, None, None, None)]


@pytest.fixture(scope="module")
def conversations(spark, tmp_path_factory):
    rng = random.Random(7)
    rows = list(TURNS)
    for conv in range(10, 60):
        for turn in range(rng.randrange(1, 30)):
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None]),
                         rng.choice(["Yes.", "No", " ", "", None, f"text {turn}.", f"text {turn % 3}!", "é🙂?"])))
    path = tmp_path_factory.mktemp("talk")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "turn AS piece", "role AS rows", "turn AS n", "text AS audit")
    df.toPandas().astype({"conv_id": "Int64", "turn": "Int64", "piece": "Int64", "n": "Int64"}).to_parquet(path / "conversations.parquet")
    return str(path)


@pytest.mark.parametrize("rows", [4096, 4, 1])
def test_repair_of_hard_conversations(spark, conversations, monkeypatch, rows):
    monkeypatch.setattr(turn_repair, "PIECE_ROWS", rows)
    diff, n = compare(spark, duck(conversations), "op11", q.QUERIES["op11_turn_repair"], q.ORACLE["op11_turn_repair"], conversations)
    assert diff is None and n == 57


def test_repair_is_the_cheapest_of_all(spark):
    """All edit strings up to a length, tried one by one."""
    def best(rows):
        found = []
        for length in range(2 * len(rows) + 3):
            for audit in itertools.product("DIKR", repeat=length):
                if sum(x != "I" for x in audit) != len(rows):
                    continue
                at, here, cost = iter(rows), turn_repair.START, 0
                for x in audit:
                    role, text, fault = next(at) if x != "I" else ("", "", None)
                    cost += {"D": 3, "I": 2, "K": 0, "R": 2}[x] + (fault == "truncated" and x != "D")
                    if x in "KR" and fault in ("blank", "duplicate"):
                        here = None
                    elif x == "K":
                        here = turn_repair._NEXT[here].get(role[:1])
                    elif x != "D":
                        here = turn_repair._ANY[here]
                    if here is None:
                        break
                if here in turn_repair.ENDS:
                    found.append((cost, "".join(audit)))
        return min(found)

    rng = random.Random(3)
    for n in (0, 1, 2, 2, 3, 3, 3):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), "t", rng.choice([None, None, "truncated", "blank", "duplicate"])) for _ in range(n)]
        paths = turn_repair.best_paths(rows, turn_repair.START, True)
        end = min((e for e in turn_repair.ENDS if e in paths.best), key=lambda e: paths.best[e][0])
        assert paths.read(end) == best(rows)


def test_repair_of_one_long_conversation_and_of_nothing(spark):
    """A conversation with most rows, half of them equal, cut into pieces over many tasks."""
    df = spark.range(9000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("conv_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("turn"),
                                  F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"),
                                  F.when(F.col("id") % 2 == 0, F.concat(F.lit("text "), F.col("id").cast("string"), F.lit("."))).otherwise("the same").alias("text"), F.lit(1).alias("times"))
    got = {r.conv_id: r for r in turn_repair.summary(turn_repair.repaired(df.repartition(20))).collect()}
    long = got[7]
    assert len(got) == 901 and long.duplicate == 4500 - 2 and len(long.audit.replace("I", "")) == 8100
    rows = sorted(((r.turn is not None, r.turn or 0, r.role, r.text) for r in df.where("conv_id = 7").collect()))
    seen, faults = set(), []
    for *_, role, text in rows:
        faults.append((role, text, turn_repair.fault_of(text, (role, text) in seen)))
        seen.add((role, text))
    paths = turn_repair.best_paths(faults, turn_repair.START, True)
    assert (long.cost, long.audit) == paths.read(min(turn_repair.ENDS, key=lambda e: paths.best[e][0]))
    assert turn_repair.summary(turn_repair.repaired(df.where("false"))).count() == 0


def brute_classes(prints: np.ndarray, ids: list) -> list:
    best = np.array(ids)
    near = [np.flatnonzero(np.bitwise_count(prints ^ x) <= 3) for x in prints]
    while True:
        new = np.array([best[n].min() for n in near])
        if (new == best).all():
            return best.tolist()
        best = new


def brute_print(text) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").translate(dict.fromkeys(map(ord, "\t\n\x0c\r"), " ")).split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_trie_join_of_documents(spark, sample):
    got = {r.doc_id: r for r in q.QUERIES["op12_trie_join"](spark, "/root/testdata/sf0.001").collect()}
    prints = [brute_print(t) for _, t in sample]
    assert [got[i].fingerprint for i, _ in sample] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i, _ in sample] == brute_classes(np.array(prints, np.uint64), [i for i, _ in sample])


def test_trie_join_of_hard_rows(hard, nothing):
    got = Counter(tuple(r) for r in trie_join.near_components(hard).collect())
    prints = np.array([brute_print(r[1]) for r in ROWS], np.uint64)
    far = 1 << 60
    classes = brute_classes(prints, [far if r[0] is None else r[0] for r in ROWS])
    assert got == Counter((r[0], f"{int(p):016x}", None if c == far else c) for r, p, c in zip(ROWS, prints, classes))
    assert trie_join.near_components(nothing).count() == 0


@pytest.mark.parametrize("limit", [4096, 60, 8])
def test_trie_join_of_clusters(spark, limit):
    """Clusters around a few centres, all of them under one hot prefix; small limits make Spark open the nodes."""
    rng = np.random.default_rng(5)
    values = set()
    for centre in rng.integers(0, 1 << 40, 12).tolist():
        for _ in range(120):
            values.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False)))
    values = np.array(sorted(values), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    links = trie_join.fingerprint_links(df, limit=limit)
    assert all((r.a ^ r.b).bit_count() <= 3 or bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in links.collect())
    found = {r.id: r.component for r in components(links).collect()}
    want = brute_classes(values, list(range(len(values))))
    same = lambda labels: Counter(frozenset(g) for g in _groups(labels))
    assert same([found.get(int(v), ("alone", i)) for i, v in enumerate(values.view(np.int64))]) == same(want)


def _groups(labels):
    held = {}
    for i, label in enumerate(labels):
        held.setdefault(label, []).append(i)
    return held.values()


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    """Hard documents and items: nulls, no terms, ties, repeated rows, one id twice, clashing columns."""
    path = tmp_path_factory.mktemp("search")
    more = [(100 + i, f"common words here {'rare' + str(i % 4)} " * (1 + i % 3) + "Ünïcode ÉA", "en", "s", i) for i in range(150)]
    docs = spark.createDataFrame(ROWS + more, SCHEMA).selectExpr("*", "n_chars AS n", "lang AS terms", "n_chars AS score", "n_chars AS item")
    docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64", "n": "Int64", "score": "Int64", "item": "Int64"}).to_parquet(path / "documents.parquet")
    items = [(1, "COMMON rare1 rare1 é"), (1, "rare2 ünïcode"), (2, None), (3, "..."), (None, "word line alpha"), (4, "nowhere"), (5, "common " * 500 + "x"), (6, "common"), (6, "common")]
    spark.createDataFrame(items, "item_id long, text string").toPandas().astype({"item_id": "Int64"}).to_parquet(path / "benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("block_terms", [1_000_000, 100])
def test_search_of_hard_rows(spark, searched, block_terms):
    read = lambda s, d: dual_tree.ranked(s.read.parquet(f"{d}/benchmark.parquet"), s.read.parquet(f"{d}/documents.parquet"), block_terms=block_terms)
    diff, n = compare(spark, duck(searched), "op13", read, q.ORACLE["op13_dual_tree"], searched)
    assert diff is None and n > 200
    items, docs = spark.read.parquet(f"{searched}/benchmark.parquet"), spark.read.parquet(f"{searched}/documents.parquet")
    assert dual_tree.ranked(items.where("false"), docs).count() == dual_tree.ranked(items, docs.where("false")).count() == 0


def test_walk_bounds_scores_and_drops_pairs():
    """Scores of a batch equal a plain loop's, and most pairs are dropped above the leaves."""
    rng = np.random.default_rng(2)
    n_docs, n_items, n_terms = 1000, 90, 400
    weights = rng.integers(1, 9000, n_terms)
    docs = [{int(t): int(rng.integers(1, 900_000)) for t in rng.choice(n_terms, 12, replace=False)} for _ in range(n_docs)]
    items = [sorted(rng.choice(n_terms, 6, replace=False).tolist()) for _ in range(n_items)]
    rows, cols = np.repeat(np.arange(n_items), 6), np.array(list(itertools.chain(*items)))
    tree = dual_tree.Items(list(range(n_items)), rows, cols, weights)
    search = dual_tree.Search(tree, {}, 5)
    flat = [(d, t, v) for d, held in enumerate(docs) for t, v in sorted(held.items())]
    r, c, v = (np.array(x, np.int64) for x in zip(*flat))
    ids = np.empty(n_docs, object)
    ids[:] = range(n_docs)
    search.batch(ids, dual_tree.Sparse(r, c, v, n_docs))
    got = {}
    for i, s, d in zip(search.item, search.score, search.doc):
        got.setdefault(tree.ids[i], []).append((-s, d))
    for i, terms in enumerate(items):
        want = sorted((-sum(int(weights[t]) * held.get(t, 0) for t in terms), d) for d, held in enumerate(docs))
        assert sorted(got.get(i, [])) == [x for x in want if x[0] < 0][:5]
