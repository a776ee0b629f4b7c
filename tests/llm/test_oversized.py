"""Splitting: an exact round trip, sizes, overlaps, and what an edit changes."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafstream.llm.oversized import oversized_found, split, split_oversized


def check(text, most, overlap):
    pieces = split(text, most, overlap)
    assert "".join(text[p.start + p.overlap : p.end] for p in pieces) == text
    assert all(p.end - p.start <= max(1, most) for p in pieces)
    assert all(0 <= p.overlap <= overlap and p.overlap < p.end - p.start for p in pieces[1:])
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,!?\n،。é👍🏽‍", max_size=300), st.integers(1, 60), st.integers(0, 40))
def test_round_trip(text, most, overlap):
    check(text, most, overlap)


def prose(seed, sentences=400):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 9))) for _ in range(500)]
    return " ".join(" ".join(rnd.choices(words, k=rnd.randint(4, 12))).capitalize() + "." for _ in range(sentences))


def test_cuts_at_sentences():
    pieces = check(prose(1), 600, 60)
    assert all(p.boundary in ("sentence", "line", "paragraph", "end") for p in pieces)
    assert sum(p.overlap for p in pieces[1:]) >= 0.7 * 60 * (len(pieces) - 1)


def test_no_boundaries():
    pieces = check("字" * 5000, 700, 50)
    assert {p.boundary for p in pieces} == {"none", "end"} and all(p.overlap == 50 for p in pieces[1:])


def test_graphemes_stay_whole():
    text = "👩‍🚀" * 400
    assert all(p.start % 3 == 0 and p.end % 3 == 0 for p in check(text, 100, 12))


def test_edit_alters_neighbours_only():
    text = prose(2, 900)
    edited = text[:20_000] + "An added sentence. " + text[20_000:]
    a = {text[p.start : p.end] for p in split(text, 800, 40)}
    b = {edited[p.start : p.end] for p in split(edited, 800, 40)}
    assert len(a ^ b) <= 8 and len(a) > 50


CHUNKS = "chunk_id bigint, job_id bigint, texts array<string>, attempts int, queued_at timestamp"


def tables(spark, chunks):
    jobs = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 9)], "job_id bigint, settings_id int")
    limits = spark.createDataFrame([(1, 10, 3), (2, None, None)], "settings_id int, max_chars int, overlap_chars int")
    return spark.createDataFrame(chunks, CHUNKS), jobs, limits


def test_table(spark):
    long = "aa bb cc dd ee"
    rows = [(7, 1, ["short", None, long, ""], 1, None), (7, 1, ["short", None, long, ""], 2, None), (8, 2, [long, "x" * 2600], 1, None), (9, None, ["x" * 2501], 1, None), (10, 4, ["x" * 2500, "y" * 2501], 1, None), (None, 1, [long], 1, None), (11, 1, None, 1, None), (12, 1, [], 1, None)]
    frames = tables(spark, rows)
    assert sorted(map(tuple, oversized_found(*frames).collect())) == [(7, 2), (8, 1), (9, 0), (10, 1)]
    pieces = split_oversized(*frames).where("chunk_id = 7").orderBy("piece_no").collect()
    assert [p["piece_no"] for p in pieces] == list(range(len(pieces)))
    assert "".join(p["piece"][p["overlap"] :] for p in pieces) == long and max(len(p["piece"]) for p in pieces) <= 10


@pytest.mark.parametrize("empty", [0, 1, 2])
def test_empty_tables(spark, empty):
    frames = list(tables(spark, [(1, 1, ["x" * 3000], 1, None)]))
    frames[empty] = frames[empty].limit(0)
    assert oversized_found(*frames).count() == (empty != 0)


def test_clashing_columns(spark):
    frames = [f.selectExpr("*", "1 AS text", "2 AS max_chars_", "3 AS boundary") for f in tables(spark, [(1, 1, ["x" * 30], 1, None)])]
    assert oversized_found(*frames).count() == 1


def test_overlaps_up_to_the_limit():
    text = " ".join(f"word{i}." for i in range(400))
    for overlap in (60, 80, 99, 100, 500):
        pieces = split(text, 100, overlap)
        assert all(p.end - p.start <= 100 for p in pieces) and "".join(text[p.start + p.overlap : p.end] for p in pieces) == text
        assert max(p.overlap for p in pieces) > min(overlap, 99) - 12
    long = "x" * 50 + "e" + "\u0301" * 70 + "y" * 300
    pieces = split(long, 120, 30)
    assert "".join(long[p.start + p.overlap : p.end] for p in pieces) == long and all(p.end - p.start <= 120 for p in pieces)
    assert not any(long[p.start + p.overlap] == "\u0301" for p in pieces)
