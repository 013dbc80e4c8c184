"""Greedy deduplication against the plain loop."""

import random

import pytest

from shelfwatch.operators import dedup

SCHEMA = "seq bigint, url string, title string, price double, product_code string"


def loop(rows):
    seen, kept = set(), []
    for seq, url, title, price, code in sorted(rows):
        keys = ([url.split("?")[0].split("#")[0]] if url else []) + ([code] if code else [])
        if title and price:
            keys.append(f"{title.lower().strip()}:{price}")
        if not any(k in seen for k in keys):
            seen.update(keys)
            kept.append(seq)
    return set(kept)


def run(spark, rows):
    return {r.seq for r in dedup.greedy_dedup(spark.createDataFrame(rows, SCHEMA), "seq").collect()}


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, f"https://s.com/{rng.randint(0, 15)}?q={i}"]),
             rng.choice([None, "", f"T{rng.randint(0, 12)} "]), rng.choice([None, 0.0, 5.0, 7.5]),
             rng.choice([None, "", f"c{rng.randint(0, 15)}", "t1:5.0"])) for i in range(80)]
    assert run(spark, rows) == loop(rows)


def test_chain_of_partial_duplicates(spark):
    rows = [(i, f"https://s.com/{(i + 1) // 2}", None, None, f"c{i // 2}") for i in range(12)]
    assert run(spark, rows) == loop(rows)


def test_one_key_shared_by_a_third(spark):
    rows = [(i, f"https://s.com/{i}", None, None, "hot" if i % 3 == 0 else None) for i in range(3000)]
    assert run(spark, rows) == loop(rows)


def test_keep_first_by_key(spark):
    rows = [(1, "https://S.com/a/?x=1"), (0, "https://s.com/A#f"), (2, "https://s.com/b")]
    df = spark.createDataFrame(rows, "seq bigint, url string")
    assert {r.seq for r in dedup.unique_urls(df, "seq").collect()} == {0, 2}


def test_most_rows_are_decided_before_groups_are_sought(spark, monkeypatch):
    """Groups joined by a common key were found whole, in many passes over all rows, though one round decides most of them."""
    asked = []
    found = dedup.connected
    monkeypatch.setattr(dedup, "connected", lambda links: asked.append(links.count()) or found(links))
    rng = random.Random(3)
    rows = [(i, f"https://s.com/{rng.randint(0, 200)}", rng.choice(["sale", "n/a", f"t{i % 40}"]), rng.choice([0.5, 9.0]), f"c{rng.randint(0, 300)}") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.seq for r in dedup.greedy_dedup(df, "seq", group_rows=5).collect()} == loop(rows)
    assert sum(asked) < 500


@pytest.mark.parametrize("group_rows", [1, 200_000])
def test_numbers_given_twice_and_none(spark, group_rows):
    """Rows of one number are dropped or kept together, by the keys of them all; rows without one are kept and drop none."""
    rows = [(1, "https://s.com/a", None, None, "x"), (1, "https://s.com/b", None, None, "y"), (2, "https://s.com/b", None, None, None),
            (3, None, None, None, "x"), (4, "https://s.com/c", None, None, "z"), (4, "https://s.com/c", None, None, "z"),
            (None, "https://s.com/c", None, None, None), (None, "https://s.com/d", None, None, None), (5, "https://s.com/d", None, None, None)]
    got = dedup.greedy_dedup(spark.createDataFrame(rows, SCHEMA), "seq", group_rows=group_rows).collect()
    assert sorted((r.seq or 0) for r in got) == [0, 0, 1, 1, 4, 4, 5]
