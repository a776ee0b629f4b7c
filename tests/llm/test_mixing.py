"""Mixes: shares, caps, nesting, and sources that can't give their share."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from leafstream.llm import mixing

SIZES = "doc_id bigint, source string, n_tokens int"
TARGETS = "mix_id string, source string, target_share double, max_repeats int"


def documents(n=3000, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choices(["big", "mid", "small", None], [70, 25, 4, 1])[0], rnd.choice([0, 10, 200, rnd.randint(1, 900)])) for i in range(n)]


def mixed(spark, sizes, targets, **more):
    frames = spark.createDataFrame(sizes, SIZES), spark.createDataFrame(targets, TARGETS)
    return frames, {(r["mix_id"], r["doc_id"]): r for r in mixing.select(*frames, **more).collect()}


def test_shares(spark):
    sizes = documents()
    targets = [("m", "big", 0.5, 2), ("m", "mid", 0.3, 3), ("m", "small", 0.2, 4), ("n", "big", 0.9, 1), ("n", "absent", 0.1, 9)]
    frames, rows = mixed(spark, sizes, targets)
    tokens, caps = defaultdict(int), {(m, s): r for m, s, _, r in targets}
    for r in rows.values():
        tokens[r["mix_id"], r["source"]] += r["n_tokens"] * r["repeats"]
        assert 1 <= r["repeats"] <= caps[r["mix_id"], r["source"]]
    whole = sum(v for (m, _), v in tokens.items() if m == "m")
    for source, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(tokens["m", source] / whole - share) < 0.003
    # the scarcest source is used up: as large as can be
    assert tokens["m", "small"] == 4 * sum(n for _, s, n in sizes if s == "small")
    told = {(r["mix_id"], r["source"]): r for r in mixing.shares(*frames).collect()}
    assert told["n", "absent"]["tokens"] == 0 and told["n", "big"]["actual_share"] == 1.0
    assert all(told[k]["tokens"] == v for k, v in tokens.items())


def test_budget(spark):
    sizes = documents()
    _, small = mixed(spark, sizes, [("m", "big", 0.5, 1), ("m", "mid", 0.5, 1)], total_tokens=20_000)
    _, large = mixed(spark, sizes, [("m", "big", 0.5, 1), ("m", "mid", 0.5, 1)], total_tokens=60_000)
    assert set(small) < set(large)
    assert abs(sum(r["n_tokens"] for r in small.values()) - 20_000) < 900
    _, short = mixed(spark, sizes, [("m", "small", 0.9, 2), ("m", "mid", 0.1, 1)], total_tokens=10**9)
    assert {r["repeats"] for r in short.values() if r["source"] == "small"} == {2}


@pytest.mark.parametrize("n", [1, 2, 5])
def test_few_documents(spark, n):
    _, rows = mixed(spark, [(i, "a", 100) for i in range(n)], [("m", "a", 1.0, 1)], total_tokens=100.0)
    assert sum(r["repeats"] for r in rows.values()) == 1


def test_hot_hash_bucket(spark, monkeypatch):
    """Where all documents share the first buckets, only these are refined, and the budget is still met."""
    monkeypatch.setattr(mixing, "LEVEL", 2)
    monkeypatch.setattr(mixing, "BITS", 24)
    _, rows = mixed(spark, [(i, "a", 10) for i in range(1000)], [("m", "a", 1.0, 1)], total_tokens=3330.0)
    assert abs(sum(r["n_tokens"] for r in rows.values()) - 3330) <= 10


def test_dirt(spark):
    targets = [("m", "a", 0.5, None), ("m", "a", 0.5, 1), ("m", None, 0.5, 1), (None, "a", 1.0, 1), ("m", "b", 0.0, 1), ("m", "c", None, 1), ("k", "a", 1.0, 0)]
    _, rows = mixed(spark, [(1, "a", 10), (2, "b", 10), (3, None, 10), (4, "a", 0)], targets)
    assert set(rows) == {("m", 1)}
    assert mixed(spark, [], targets)[1] == {} and mixed(spark, [(1, "a", 10)], [])[1] == {}
