"""Filling containers of a fixed capacity with documents.

The plan is made over a histogram of lengths, not over documents: best fit places all documents of one length at
a time, longest first, into the fullest containers that still take them. What the plan says of a length are
ranges of ranks, and each document takes the place of its rank among those of its length. The histogram has at
most as many rows as the largest capacity has tokens, whatever the number of documents.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafstream.sources.shared import settle

#: Rows of one length that a task ranks at most, on average.
RANKED_TOGETHER = 200_000
#: Rows of a plan up to which it is broadcast (48 bytes each).
BROADCAST_ROWS = 400_000


@dataclass(frozen=True)
class Slots:
    """Documents of `length` with ranks from `first` to before `last` go to the containers from `container` on,
    `each` to a container."""

    length: int
    first: int
    last: int
    container: int
    each: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Slots], int]:
    """The slots for every length of the histogram, and the number of containers.

    Lengths are from 1 to the capacity. Containers with the same room left are kept as ranges of numbers, so
    that the work depends on the number of lengths only.
    """
    slots: list[Slots] = []
    rooms: list[int] = []  # room that some container has left, ascending
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room to ranges of containers
    containers = 0

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            if not groups[room]:
                bisect.insort(rooms, room)
            groups[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
                each = room // length
                if each * count <= left:
                    used, per = count, each
                elif left >= each:
                    used, per = left // each, each
                else:
                    used, per = 1, left
                add(room, first + used, count - used)
            else:
                each = capacity // length
                used, per = (left // each, each) if left >= each else (1, left)
                first, room = containers, capacity
                containers += used
            slots.append(Slots(length, rank, rank + used * per, first, per))
            add(room - per * length, first, used)
            rank += used * per
            left -= used * per
    return slots, containers


def pieces_of(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, doc_id, piece_no, token_start, token_end, length): a row for each
    document and capacity, or for each piece of a document that exceeds the capacity by itself.

    Such a document is cut into pieces of the whole capacity and a rest. Documents without tokens take no room
    and have no row; nor do capacities that are null or less than 1.
    """
    kinds = capacities.where("container_kind IS NOT NULL AND capacity_tokens >= 1").groupBy("container_kind").agg(
        F.min("capacity_tokens").alias("capacity_tokens")
    )
    # a row for each kind of container; a handful, collected so that each becomes a constant of the plan
    known = [(r["container_kind"], r["capacity_tokens"]) for r in kinds.orderBy("container_kind").collect()]
    kinds_of = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("capacity")) for k, c in known])
    if not known:
        kinds_of = F.from_json(F.lit("[]"), "array<struct<kind:string,capacity:int>>")
    rows = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(kinds_of).alias("k"))
    capacity = F.col("k.capacity")
    last = ((F.col("n_tokens") - 1) / capacity).cast("int")
    cut = rows.select(
        F.col("k.kind").alias("container_kind"),
        capacity.alias("capacity_tokens"),
        "doc_id",
        "n_tokens",
        F.explode(F.sequence(F.lit(0), last)).alias("piece_no"),
    )
    start = F.col("piece_no") * F.col("capacity_tokens")
    end = F.least(F.col("n_tokens"), start + F.col("capacity_tokens"))
    return cut.select(
        "container_kind",
        "capacity_tokens",
        "doc_id",
        "piece_no",
        start.alias("token_start"),
        end.alias("token_end"),
        (end - start).alias("length"),
    )


def pack(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """The pieces of :func:`pieces_of` with their `container_no`, which counts from 0 in each kind.

    Every piece has exactly one container, and no container more than its capacity. Which of several documents
    of one length takes which place follows from hashes of their ids, the same in each run.
    """
    spark = sizes.sparkSession
    pieces = pieces_of(sizes, capacities)
    histogram = pieces.groupBy("container_kind", "capacity_tokens", "length").agg(F.count(F.lit(1)).alias("n"))
    by_kind: dict[tuple[str, int], dict[int, int]] = defaultdict(dict)
    most = 0
    for r in histogram.collect():  # at most capacity_tokens rows a kind
        by_kind[r["container_kind"], r["capacity_tokens"]][r["length"]] = r["n"]
        most = max(most, r["n"])
    columns: list[list] = [[], [], [], [], [], []]
    for (kind, capacity), lengths in by_kind.items():
        for s in plan(lengths, capacity)[0]:
            for column, value in zip(columns, (kind, s.length, s.first, s.last, s.container, s.each)):
                column.append(value)
    types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    names = ["container_kind", "length", "first", "last", "container", "each"]
    planned = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names))
    if len(columns[0]) <= BROADCAST_ROWS:
        planned = F.broadcast(planned)
    # a length that many documents share is ranked in parts, each from where the one before it ends
    parts = 1
    while parts * RANKED_TOGETHER < most:
        parts *= 2
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    group = ["container_kind", "length", "part"]
    ranked = parted.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "piece_no")).cast("long") - 1
    )
    if parts > 1:
        ends = parted.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("container_kind", "length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = ends.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        ranked = ranked.join(offsets, group).withColumn("rank", F.col("rank") + F.col("offset"))
    placed = ranked.join(planned, ["container_kind", "length"]).where("rank >= first AND rank < last")
    number = F.col("container") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))
    return placed.select(
        "container_kind",
        "capacity_tokens",
        number.cast("long").alias("container_no"),
        "doc_id",
        "piece_no",
        "token_start",
        "token_end",
    )


def report(packed: DataFrame) -> DataFrame:
    """For each kind: containers, the fewest that the tokens would need, pieces, tokens and unused room."""
    filled = settle(packed, "packed")
    totals = filled.groupBy("container_kind", "capacity_tokens").agg(
        (F.max("container_no") + 1).alias("containers"),
        F.count(F.lit(1)).alias("pieces"),
        F.sum((F.col("token_end") - F.col("token_start")).cast("long")).alias("tokens"),
    )
    room = F.col("containers") * F.col("capacity_tokens")
    return totals.select(
        "container_kind",
        "capacity_tokens",
        "containers",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"),
        "pieces",
        "tokens",
        (1 - F.col("tokens") / room).alias("unused_share"),
    )
