from __future__ import annotations

import random

import pytest

from leafstream.operators import chunking


def model(lengths, most):
    """Plain model of greedy packing."""
    out, size = [], 0
    for n in lengths:
        if size and size + n + 12 > most:
            out.append(out[-1] + 1)
            size = n + 12
        else:
            out.append(out[-1] if out else 0)
            size += n + 12
    return out


@pytest.mark.parametrize(("lengths", "most", "numbers"), [([10, 20, 30, 5, 100, 1], 60, [0, 0, 1, 1, 2, 3]), ([], 2500, []), ([5000], 2500, [0]), ([10, 30], 60, [0, 1])])
def test_model(lengths, most, numbers):
    assert model(lengths, most) == numbers


def packed(spark, documents, most, block):
    rows = [(d, i, "x" * n) for d, ns in documents.items() for i, n in enumerate(ns)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id int, seg_id int, text string")
    out = {}
    for r in chunking.make_chunks(frame, limit=most, block=block).orderBy("doc_id", "seg_id").collect():
        out.setdefault(r["doc_id"], []).append(r["chunk_no"])
    return out


@pytest.mark.parametrize("block", [3, 7, 50, 20_000])
def test_blocks_agree_with_model(spark, block):
    rnd = random.Random(block)
    documents = {d: [rnd.choice([0, 1, 5, 20, 50, 90, 300]) for _ in range(rnd.randint(1, 120))] for d in range(12)}
    found = packed(spark, documents, 130, block)
    assert found == {d: model(ns, 130) for d, ns in documents.items()}


def test_left_out_segments_and_dirt(spark):
    rows = [("a", 0, "x" * 10), ("a", 2, "x" * 30), ("a", 5, None), (None, 1, "x"), ("a", None, "x")]
    frame = spark.createDataFrame(rows, "doc_id string, seg_id int, text string")
    found = [(r["seg_id"], r["n_chars"], r["chunk_no"]) for r in chunking.make_chunks(frame, limit=60).orderBy("seg_id").collect()]
    assert found == [(0, 10, 0), (2, 30, 1), (5, 0, 1)]
    assert chunking.make_chunks(frame.limit(0)).count() == 0


def test_compose_is_the_chain():
    rnd = random.Random(5)
    for _ in range(300):
        costs = [rnd.randint(12, 80) for _ in range(rnd.randint(1, 20))]
        most, size = rnd.randint(20, 200), rnd.choice([0, rnd.randint(1, 200)])
        starts, end = chunking.chain(costs, most, size)
        assert chunking.compose(chunking.summarize(costs, most), size) == (len(starts), end)


def test_halves(spark):
    frame = spark.createDataFrame([("a", 0, [1, 2, 3], ["x", "yy", None]), ("a", 1, [4], ["z"])], "doc_id string, chunk_no int, seg_ids array<int>, texts array<string>")
    found = {(r["chunk_no"], r["part"]): (r["seg_ids"], r["chars"]) for r in chunking.halve(frame).collect()}
    assert found == {(0, 0): ([1], 1), (0, 1): ([2, 3], 2), (1, None): ([4], 1)}


def test_assemble(spark):
    frame = spark.createDataFrame([("a", i, t) for i, t in enumerate(["x", "y", "z"])], "doc_id string, seg_id int, text string")
    row = chunking.assemble(chunking.make_chunks(frame)).first()
    assert (row["seg_ids"], row["texts"], row["chars"]) == ([0, 1, 2], ["x", "y", "z"], 3)
