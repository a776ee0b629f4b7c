"""Packing ordered segments into chunks of bounded size.

Packing is greedy: a chunk ends before the segment that would exceed the limit, so that where a chunk begins
depends on all before it. A long document is packed in blocks. Of the state at a block's beginning only the size
of the open chunk matters; it decides the first break in the block, and from there on the chunks are the same
whatever came before. So each block is summarized, by itself, as a small table from first breaks to its end;
the summaries of a document, one row for thousands of segments, are composed in order; and each block is then
packed with its true beginning. Documents of one block need the last step only.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstream.sources.shared import settle

#: Characters that each segment takes besides its own, for its marker.
OVERHEAD = 12
#: Segments of a block; also the span of segment numbers that share one.
BLOCK = 20_000


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """The rows of sorted batches by their first `keys` columns: (key, columns)."""
    current: tuple | None = None
    held: list[list] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:keys] != current:
                if current is not None:
                    yield current, held
                current, held = row[:keys], [[] for _ in columns]
            for column, value in zip(held, row):
                column.append(value)
    if current is not None:
        yield current, held


def chain(costs: list[int], limit: int, size: int) -> tuple[list[int], int]:
    """(the places where chunks begin, the size of the last one), with a chunk of `size` open before; with none
    open, `size` is 0 and the first chunk begins at the first place."""
    starts = []
    for place, cost in enumerate(costs):
        if size == 0 or size + cost > limit:
            starts.append(place)
            size = cost
        else:
            size += cost
    return starts, size


def summarize(costs: list[int], limit: int) -> tuple[list[int], list[int], list[int], int]:
    """A block as (least sizes, chunks begun, sizes at the end, its whole cost).

    With an open chunk of at least the n-th least size, and less than the one before it, the block's first new
    chunk begins at its n-th segment. Sizes below all of them leave the chunk open throughout the block.
    """
    total = 0
    sums = [0]
    for cost in costs:
        total += cost
        sums.append(total)
    least, begun, ends = [], [], []
    # from a beginning at a place: how many chunks begin until the block's end, and the last one's size
    count = [0] * (len(costs) + 1)
    size = [0] * (len(costs) + 1)
    for place in range(len(costs) - 1, -1, -1):
        following = bisect.bisect_right(sums, sums[place] + limit, place + 1) - 1
        following = max(following, place + 1)
        if following >= len(costs):
            count[place], size[place] = 1, total - sums[place]
        else:
            count[place], size[place] = 1 + count[following], size[following]
    for place in range(len(costs)):
        # the chunk breaks here for sizes over limit - sums[place + 1]
        at = limit - sums[place + 1] + 1
        least.append(max(1, at))
        begun.append(count[place])
        ends.append(size[place])
        if at <= 1:
            break
    return least, begun, ends, total


def compose(summary: tuple[list[int], list[int], list[int], int], size: int) -> tuple[int, int]:
    """(chunks begun in the block, size of the open chunk after it) for an open chunk of `size` before it."""
    least, begun, ends, total = summary
    if size == 0:  # nothing is open: the first segment begins a chunk
        return (begun[0], ends[0]) if begun else (0, 0)
    for place, at in enumerate(least):
        if size >= at:
            return begun[place], ends[place]
    return 0, size + total


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (key, block), columns in _groups(batches, 2):
        least, begun, ends, total = summarize([n + OVERHEAD for n in columns[3]], columns[4][0])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key], pa.string()),
                pa.array([block], pa.int64()),
                pa.array([least], pa.list_(pa.int64())),
                pa.array([begun], pa.list_(pa.int64())),
                pa.array([ends], pa.list_(pa.int64())),
                pa.array([total], pa.int64()),
            ],
            names=["_key", "_block", "least", "begun", "ends", "total"],
        )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (key,), columns in _groups(batches, 1):
        size = chunks = 0
        blocks, sizes, firsts = [], [], []
        for block, least, begun, ends, total in zip(*columns[1:]):
            blocks.append(block)
            sizes.append(size)
            firsts.append(chunks)
            more, size = compose((least, begun, ends, total), size)
            chunks += more
        yield pa.RecordBatch.from_arrays(
            [pa.array([key] * len(blocks), pa.string()), pa.array(blocks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64())],
            names=["_key", "_block", "_size", "_chunks"],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[], [], [], []]

    def flush() -> pa.RecordBatch:
        arrays = [pa.array(column, pa.int64() if at else pa.string()) for at, column in enumerate(out)]
        for column in out:
            column.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["_key", "_order", "n_chars", "chunk_no"])

    for (key, _), columns in _groups(batches, 2):
        size, chunks = columns[5][0], columns[6][0]
        starts, _end = chain([n + OVERHEAD for n in columns[3]], columns[4][0], size)
        begin = set(starts)
        number = chunks - 1
        for place, order in enumerate(columns[2]):
            number += place in begin
            out[0].append(key)
            out[1].append(order)
            out[2].append(columns[3][place])
            out[3].append(number)
        if len(out[0]) >= 10_000:
            yield flush()
    if out[0]:
        yield flush()


def plan_chunks(
    segments: DataFrame, key: str = "doc_id", order: str = "seg_id", length: str = "n_chars", limit: str | int = 2500, block: int = BLOCK
) -> DataFrame:
    """(key, order, n_chars, chunk_no): the chunks of segments of known length, counted from 0 in each document.

    Consecutive segments share a chunk as long as their lengths, with OVERHEAD for each, stay within `limit` (a
    number, or the column that holds each document's). A segment over the limit is a chunk by itself. Segments
    left out before don't part their neighbours. Rows with a null key or order are left out, a null length counts
    as 0; the order must be unique within a document.
    """
    limit_column = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    rows = segments.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    # read several times below: a narrow table, written once
    lengths = settle(
        rows.select(
            F.col(key).cast("string").alias("_key"),
            F.floor(F.col(order) / block).cast("long").alias("_block"),
            F.col(order).cast("long").alias("_order"),
            F.coalesce(F.col(length), F.lit(0)).cast("long").alias("_n"),
            limit_column.cast("long").alias("_limit"),
        ),
        "lengths",
    )
    by_block = lambda df: df.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_order")
    long = lengths.groupBy("_key").agg(F.min("_block").alias("a"), F.max("_block").alias("b")).where("a <> b").select("_key")
    parted = lengths.join(long, "_key", "left_semi")
    summaries = by_block(parted).mapInArrow(
        _summaries, "_key string, _block long, least array<long>, begun array<long>, ends array<long>, total long"
    )
    entries = (
        summaries.repartition("_key")
        .sortWithinPartitions("_key", "_block")
        .mapInArrow(_entries, "_key string, _block long, _size long, _chunks long")
    )
    begun = lengths.join(entries, ["_key", "_block"], "left").select(
        "_key", "_block", "_order", "_n", "_limit", F.coalesce("_size", F.lit(0)).alias("_size"), F.coalesce("_chunks", F.lit(0)).alias("_chunks")
    )
    packed = by_block(begun).mapInArrow(_packed, "_key string, _order long, n_chars long, chunk_no long")
    return packed.select(
        F.col("_key").cast(segments.schema[key].dataType).alias(key),
        F.col("_order").cast(segments.schema[order].dataType).alias(order),
        F.col("n_chars").cast("int").alias("n_chars"),
        F.col("chunk_no").cast("int").alias("chunk_no"),
    )


def make_chunks(
    segments: DataFrame, key: str = "doc_id", order: str = "seg_id", text: str = "text", limit: str | int = 2500, block: int = BLOCK
) -> DataFrame:
    """`segments` with the `n_chars` and `chunk_no` of :func:`plan_chunks`; a null text counts as empty."""
    own = [key, order, *([limit] if isinstance(limit, str) else [])]
    plan = plan_chunks(segments.select(*own, F.length(text).alias("n_chars")), key, order, "n_chars", limit, block)
    return segments.join(plan, [key, order])


def assemble(planned: DataFrame, key: str = "doc_id", order: str = "seg_id", text: str = "text") -> DataFrame:
    """(key, chunk_no, seg_ids, texts, chars): the chunks of a plan. A chunk's size bounds what is collected."""
    grouped = planned.groupBy(key, "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("s"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("_s"),
        F.sum("n_chars").cast("int").alias("chars"),
    )
    return grouped.select(key, "chunk_no", F.col("_s.s").alias("seg_ids"), F.col("_s.t").alias("texts"), "chars")


def halve(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each chunk of several segments as two, with fresh counters; others stay whole and are not split.

    `part` is 0 or 1 for the halves and null for a chunk that can't be halved.
    """
    half = F.floor(F.size("seg_ids") / 2).cast("int")
    piece = lambda at, n, no: F.struct(
        F.lit(no).cast("int").alias("part"), F.slice("seg_ids", at, n).alias("seg_ids"), F.slice("texts", at, n).alias("texts")
    )
    both = F.array(piece(F.lit(1), half, 0), piece(half + 1, F.size("seg_ids") - half, 1))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("part"), F.col("seg_ids"), F.col("texts")))
    rows = chunks.select(key, "chunk_no", F.explode(F.when(F.size("seg_ids") > 1, both).otherwise(whole)).alias("h"))
    sizes = F.aggregate("h.texts", F.lit(0), lambda a, t: a + F.length(F.coalesce(t, F.lit(""))))
    return rows.select(key, "chunk_no", "h.part", "h.seg_ids", "h.texts", sizes.alias("chars"))
