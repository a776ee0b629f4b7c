"""Putting rendered segments back into their documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstream.operators.segmentation import RTL_MARK, let


def rendered(segments: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """`segments` with the results' translations in place of their texts, where there are any."""
    found = results.select(key, "seg_id", "translation")
    joined = segments.join(found, [key, "seg_id"], "left")
    return joined.withColumn("text", F.coalesce("translation", "text")).drop("translation")


def filled(pieces: Column, results: Column) -> Column:
    """The pieces with results, an array of struct<seg_id, translation>, in their places; of several results for one
    the smallest holds, and those for none are left out."""
    entry = lambda at, kind, text: F.struct(at.alias("at"), F.lit(kind).alias("kind"), text.alias("text"))
    own = F.transform(pieces, lambda p, i: entry(i, 1, p))
    new = F.transform(F.filter(results, lambda r: (r["seg_id"] >= 0) & (r["seg_id"] < F.size(pieces)) & r["translation"].isNotNull()), lambda r: entry(r["seg_id"], 0, r["translation"]))
    firsts = lambda e: F.filter(e, lambda x, i: (i == 0) | (F.get(e, F.greatest(i - 1, F.lit(0)))["at"] != x["at"]))
    placed = let(F.array_sort(F.concat(new, own)), firsts)
    return F.when(F.size(F.coalesce(results, F.array())) == 0, pieces).otherwise(F.transform(placed, lambda x: x["text"]))


def _woven(layouts: DataFrame, results: DataFrame, key: str, dress: Callable[[Column], Column]) -> DataFrame:
    """(key, text): layouts with results (key, seg_id, translation). Only results move, and layouts to them."""
    by_key = results.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct(F.col("seg_id").cast("int").alias("seg_id"), "translation")).alias("_r"))
    rows = layouts.join(by_key, key, "left").select(key, F.col("layout.glue").alias("_g"), filled(F.col("layout.pieces"), F.col("_r")).alias("_p"))
    turns = F.zip_with("_g", "_p", lambda g, p: F.concat(g, F.when(p.isNull(), "").otherwise(dress(p))))
    return rows.select(key, F.array_join(turns, "").alias("text"))


def build_text(layouts: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): plain texts from their layouts and results; pieces without a result keep their text."""
    return _woven(layouts, results, key, lambda p: p)


def marked_lines(body: Column) -> Column:
    """A body whose lines, but empty ones, begin with a right-to-left mark."""
    line = lambda x: F.when(x == "", x).otherwise(F.concat(F.lit(RTL_MARK), x))
    return F.array_join(F.transform(F.split(body, "\n", -1), line), "\n")


def build_subtitles(layouts: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): subtitles from their layouts and results; cues with something to render are marked as right to
    left, whether rendered or not, and an empty result leaves a cue its header only."""
    return _woven(layouts, results, key, lambda p: F.when(p == "", "").otherwise(F.concat(F.lit("\n"), marked_lines(p))))


def build_pages(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pages): an array of arrays of paragraphs, from (key, page_no, item_no, text)."""
    by_page = items.groupBy(key, "page_no").agg(F.array_sort(F.collect_list(F.struct("item_no", "text"))).alias("_i"))
    whole = by_page.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_no", F.transform("_i", lambda i: i["text"]).alias("p")))).alias("_p"))
    return whole.select(key, F.transform("_p", lambda p: p["p"]).alias("pages"))
