from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from leafstream.operators import layouts, segmentation
from leafstream.sources.plain import translatable


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "most", "pieces"),
    [
        ("aaa\nbbb\nccc", 7, ["aaa\nbbb", "ccc"]),
        ("Aa. Bb. Cc.", 7, ["Aa. Bb.", "Cc."]),
        ("abcdefghij", 4, ["abcdefghij"]),
        ("short", 10, ["short"]),
        ("", 10, [""]),
        (None, 10, None),
    ],
)
def test_split_long(spark, text, most, pieces):
    assert one(spark, lambda c: segmentation.split_long(c, most), text) == pieces


def model_split(text, most):
    """Plain model: units are put together as long as they fit."""
    if len(text) <= most:
        return [text]
    units = text.split("\n") if "\n" in text else re.split(r"(?<=[.!?…。！？])\s+", text)
    out, joint = [], "\n" if "\n" in text else " "
    for unit in units:
        if out and out[-1] and len(out[-1]) + len(unit) + 1 <= most:
            out[-1] += joint + unit
        elif out and not out[-1]:
            out[-1] = unit
        else:
            out.append(unit)
    return [p for p in out if p]


def test_split_long_against_model(spark):
    rnd = random.Random(3)
    texts = []
    for _ in range(200):
        words = ["".join(rnd.choice("abc.!? ") for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(1, 25))]
        texts.append(rnd.choice(["\n", ". ", " "]).join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r["i"]: r["x"] for r in rows.select("i", segmentation.split_long(F.col("t"), 20).alias("x")).collect()}
    for i, text in enumerate(texts):
        assert found[i] == model_split(text, 20), text


def built(spark, texts, results=()):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    items = segmentation.text_layouts(docs)
    pieces = segmentation.segments_of(items)
    done = spark.createDataFrame(list(results), "doc_id int, seg_id int, translation string")
    out = {r["doc_id"]: r["text"] for r in layouts.build_text(items, done).collect()}
    segments = {}
    for r in pieces.orderBy("doc_id", "seg_id").collect():
        segments.setdefault(r["doc_id"], []).append(r["text"])
    return out, segments


def test_text_layout(spark):
    texts = ["Hello world.\n\nSecond paragraph.", "A\n\n---\n\nB", "\n\n  x \n \n\n12\n\n y", "", None, "a\r\n\r\nb\rc", "z" * 9000, "Aa. " * 2000]
    out, segments = built(spark, texts)
    assert segments[0] == ["Hello world.", "Second paragraph."]
    assert segments[1] == ["A", "B"]
    assert out == {i: t.replace("\r\n", "\n").replace("\r", "\n") for i, t in enumerate(texts) if t is not None}
    assert len(segments[7]) > 1 and all(len(s) <= 4000 for s in segments[7])


def test_text_rendered(spark):
    text = "A\n\n---\n\n B "
    out, _ = built(spark, [text, text, text, ""], [(0, 0, "alpha"), (0, 1, "beta"), (9, 0, "none"), (1, 1, "b"), (1, 1, "c"), (1, 7, "x"), (2, 0, None), (3, 0, "x")])
    assert out == {0: "alpha\n\n---\n\n beta ", 1: "A\n\n---\n\n b ", 2: text, 3: ""}


def test_subtitles(spark):
    docs = spark.createDataFrame([(0, "1\n00:00:01,000 --> 00:00:02,000\nHi\nyou\n\n2\n00:00:03,000 --> 00:00:04,000\n...\n\nnote"), (1, ""), (2, None)], "doc_id int, text string")
    cues = segmentation.subtitle_cues(docs)
    rows = cues.where("doc_id = 0").orderBy("cue_no").collect()
    assert [(r["body"], r["translatable"]) for r in rows] == [("Hi\nyou", True), ("...", False), (None, False)]
    none = spark.createDataFrame([], "doc_id int, seg_id int, translation string")
    whole = segmentation.subtitle_layouts(docs)
    assert [r["text"] for r in segmentation.segments_of(whole).collect()] == ["Hi\nyou"]
    text = {r["doc_id"]: r["text"] for r in layouts.build_subtitles(whole, none).collect()}
    mark = "‏"
    assert text[0] == f"1\n00:00:01,000 --> 00:00:02,000\n{mark}Hi\n{mark}you\n\n2\n00:00:03,000 --> 00:00:04,000\n...\n\nnote\n"
    again = segmentation.subtitle_cues(spark.createDataFrame([(0, text[0])], "doc_id int, text string"))
    assert [r["body"] for r in again.orderBy("cue_no").collect()] == ["Hi\nyou", "...", None]


@pytest.mark.parametrize(
    ("page", "paragraphs"),
    [
        ("transla-\ntion works", ["translation works"]),
        ("one -\ntwo", ["one - two"]),
        ("a\n\nb", ["a", "b"]),
        ("", []),
        ("A long line that fills the width of it.\nShort end.\nAnother long line that fills the width", ["A long line that fills the width of it. Short end.", "Another long line that fills the width"]),
    ],
)
def test_paragraphs(spark, page, paragraphs):
    assert one(spark, segmentation.page_paragraphs, page) == paragraphs


def test_running_headers(spark):
    rows = [(d, p, [f"Book {p + 1}", f"Text of page {'abcd'[p]}"]) for d, n in ((0, 4), (1, 3)) for p in range(n)]
    pages = spark.createDataFrame(rows, "doc_id int, page_no int, paragraphs array<string>")
    kept = {(r["doc_id"], r["page_no"]): r["paragraphs"] for r in segmentation.drop_running_headers(pages).collect()}
    assert kept[0, 0] == ["Text of page a"] and kept[1, 0] == ["Book 1", "Text of page a"]


def test_plain_test_for_text():
    assert translatable("½") and translatable("a1") and not translatable("1_-٣")
