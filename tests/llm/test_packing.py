"""Containers: capacity, completeness, and how close the plan comes to the fewest possible."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from leafstream.llm import packing
from leafstream.llm.tokens import VOCABULARY, encoding, token_sizes


def fill(histogram, capacity):
    """The containers that a plan gives, as lists of lengths."""
    slots, n = packing.plan(histogram, capacity)
    out = defaultdict(list)
    for s in slots:
        for rank in range(s.first, s.last):
            out[s.container + (rank - s.first) // s.each].append(s.length)
    return out, n


@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 64, 512])
    lengths = [min(capacity, max(1, int(rnd.expovariate(4 / capacity)))) for _ in range(rnd.choice([1, 50, 3000]))]
    filled, n = fill(Counter(lengths), capacity)
    assert Counter(x for c in filled.values() for x in c) == Counter(lengths)
    assert all(sum(c) <= capacity for c in filled.values()) and set(filled) == set(range(n))
    # best fit decreasing, one document at a time
    rooms: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(best := min(fits))
            rooms.append(best - x)
        else:
            rooms.append(capacity - x)
    assert n == len(rooms)


def test_plan_grows_with_lengths_only():
    small = packing.plan({n: 10 for n in range(1, 513)}, 512)[0]
    large = packing.plan({n: 10_000_000 for n in range(1, 513)}, 512)[0]
    assert len(large) <= 2 * len(small) + 512


SIZES = "doc_id bigint, source string, n_tokens int"
KINDS = "container_kind string, capacity_tokens int"


def packed(spark, sizes, kinds):
    return packing.pack(spark.createDataFrame(sizes, SIZES), spark.createDataFrame(kinds, KINDS))


@pytest.mark.parametrize("together", [200_000, 7])
def test_pack(spark, monkeypatch, together):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", together)
    rnd = random.Random(1)
    sizes = [(i, "a", rnd.choice([0, 3, 3, 3, 50, 64, 65, 200, rnd.randint(1, 90)])) for i in range(400)]
    rows = packed(spark, sizes, [("s", 64), ("l", 1000), ("none", None), ("bad", 0), (None, 5), ("s", 64)]).collect()
    for kind, capacity in (("s", 64), ("l", 1000)):
        own = [r for r in rows if r["container_kind"] == kind]
        room, spans = Counter(), defaultdict(list)
        for r in own:
            room[r["container_no"]] += r["token_end"] - r["token_start"]
            spans[r["doc_id"]].append((r["token_start"], r["token_end"]))
        assert max(room.values()) <= capacity and set(room) == set(range(len(room)))
        for i, _, n in sizes:
            got = sorted(spans.get(i, []))
            assert (got[0][0], got[-1][1]) == (0, n) if n else not got
            assert all(a[1] == b[0] for a, b in zip(got, got[1:])) and (len(got) <= 1 or n > capacity)
        assert sum(room.values()) >= 0.97 * capacity * (len(room) - 1)
    assert {r["container_kind"] for r in rows} == {"s", "l"}


def test_report_and_empty(spark):
    row = packing.report(packed(spark, [(1, "a", 5), (2, "a", 5)], [("s", 10)])).first()
    assert (row["containers"], row["fewest"], row["pieces"], row["tokens"], row["unused_share"]) == (1, 1, 2, 10, 0.0)
    assert packed(spark, [], [("s", 10)]).count() == 0 and packed(spark, [(1, "a", 5)], []).count() == 0


def test_token_sizes(spark):
    texts = ["", None, "Hello world, 123", "é" * 5000, "  \n\n x <|endoftext|> "]
    rows = [(i, "s", t) for i, t in enumerate(texts)] + [(2, "s", texts[2]), (None, "s", "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 AS n_tokens", "2 AS length")
    found = {r["doc_id"]: r["n_tokens"] for r in token_sizes(frame).collect()}
    encode = encoding(VOCABULARY).encode_ordinary
    assert found == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}
    assert encoding(VOCABULARY).decode(encode(texts[4])) == texts[4]
