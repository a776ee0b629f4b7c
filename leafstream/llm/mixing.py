"""Mixing sources to target shares of the total size.

A document's place is a hash of its id. Sizes are summed by source and hash bucket; a source's budget ends in one
bucket, and only that bucket is refined, until the hash below which documents are taken is found. The documents
are then filtered by it, without sorting. Since all mixes use the same hash, a smaller budget's selection lies
within a larger one's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the hash that one level of buckets takes, and all bits.
LEVEL, BITS = 12, 60


@dataclass
class Quota:
    """What a mix takes of one source: every document `whole` times, and those with a hash below `below` once more."""

    mix_id: str
    source: str
    target_share: float
    max_repeats: int
    available: int = 0
    target: float = 0.0
    wanted: float = 0.0
    whole: int = 0
    below: int = 0


def _place(doc_id: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 64 - BITS)


def quotas(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 0) -> list[Quota]:
    """The quotas of all mixes.

    Without `total_tokens`, each mix is as large as its scarcest present source allows with all its repeats, so
    that each present source has its share. With it, a source whose repeats don't reach its share gives all it
    has. A source without tokens gives nothing, and its share falls to the others in proportion. Targets that are
    null or not above 0, and repeats under 1, give nothing either. A source named twice in a mix counts by its
    largest target.
    """
    rows = targets.where("mix_id IS NOT NULL AND source IS NOT NULL AND target_share > 0").groupBy("mix_id", "source").agg(
        F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    out = [
        Quota(r["mix_id"], r["source"], r["target_share"], max(0, r["max_repeats"]))
        for r in rows.orderBy("mix_id", "source").collect()  # the table of targets: some rows a mix
    ]
    named = sorted({q.source for q in out})
    if not named:
        return out
    placed = sizes.where(F.col("source").isin(named) & (F.col("n_tokens") > 0)).select(
        "source", "n_tokens", _place(F.col("doc_id"), seed).alias("place")
    )

    def buckets(rows: DataFrame, level: int) -> dict[tuple[str, int], tuple[int, int]]:
        """Tokens and documents by source and bucket: at most 2 to the power of LEVEL rows for each open cell."""
        bucket = F.shiftright("place", BITS - LEVEL * level).alias("bucket")
        summed = rows.groupBy("source", bucket).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        return {(r["source"], r["bucket"]): (r["t"], r["n"]) for r in summed.collect()}

    cells = buckets(placed, 1)
    have = dict.fromkeys(named, 0)
    for (source, _), (tokens, _) in cells.items():
        have[source] += tokens
    for mix in sorted({q.mix_id for q in out}):
        own = [q for q in out if q.mix_id == mix]
        for q in own:
            q.available = have[q.source]
        able = [q for q in own if q.available and q.max_repeats]
        weight = sum(q.target_share for q in able)
        for q in able:
            q.target = q.target_share / weight
        whole = min((q.available * q.max_repeats / q.target for q in able), default=0.0)
        total = whole if total_tokens is None else total_tokens
        for q in able:
            q.wanted = min(total * q.target, q.available * q.max_repeats)
            q.whole = min(q.max_repeats, int(q.wanted // q.available))
    open_cells = []
    for q in out:
        rest = q.wanted - q.whole * q.available
        if rest > 0 and q.whole < q.max_repeats:
            open_cells.append((q, rest, 0))
    level = 1
    while open_cells:
        following = []
        sums: dict[str, list[tuple[int, int, int]]] = {}
        for (source, bucket), (tokens, n) in sorted(cells.items()):
            sums.setdefault(source, []).append((bucket, tokens, n))
        width = BITS - LEVEL * level
        for q, rest, prefix in open_cells:
            q.below = prefix << (BITS - LEVEL * (level - 1)) if level > 1 else 0
            for bucket, tokens, n in sums.get(q.source, ()):
                if level > 1 and bucket >> LEVEL != prefix:
                    continue
                if tokens <= rest:
                    rest -= tokens
                    q.below = (bucket + 1) << width
                    continue
                if n > 1 and level * LEVEL < BITS:
                    q.below = bucket << width
                    following.append((q, rest, bucket))
                else:
                    # a single document, or documents that no hash parts: with them if that comes nearer
                    q.below = (bucket + 1 if tokens - rest < rest else bucket) << width
                break
        open_cells = following
        if open_cells:
            at = F.shiftright("place", BITS - LEVEL * level)
            within = F.lit(False)
            for source, bucket in sorted({(q.source, b) for q, _, b in open_cells}):
                within = within | ((F.col("source") == source) & (at == bucket))
            level += 1
            cells = buckets(placed.where(within), level)
    return out


QUOTAS = (
    "mix_id string, source string, target_share double, max_repeats int, available bigint, whole int, below bigint"
)


def _quota_table(sizes: DataFrame, found: list[Quota]) -> DataFrame:
    rows = [(q.mix_id, q.source, q.target_share, q.max_repeats, q.available, q.whole, q.below) for q in found]
    return sizes.sparkSession.createDataFrame(rows, QUOTAS)


def select(
    sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 0, found: list[Quota] | None = None
) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, repeats): the documents of each mix and how often each is used.

    No document is used more than its source's `max_repeats`. Documents without source or tokens are in no mix.
    """
    known = found if found is not None else quotas(sizes, targets, total_tokens, seed)
    # a row for each row of the table of targets
    joined = sizes.where("n_tokens > 0").join(F.broadcast(_quota_table(sizes, known)), "source")
    once_more = (_place(F.col("doc_id"), seed) < F.col("below")).cast("int")
    return joined.withColumn("repeats", F.col("whole") + once_more).where("repeats > 0").select(
        "mix_id", "source", "doc_id", "n_tokens", "repeats"
    )


def shares(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 0) -> DataFrame:
    """For each mix and source: target and actual share, documents, tokens and most repeats; sources that gave
    nothing have a row of zeros."""
    known = quotas(sizes, targets, total_tokens, seed)
    taken = select(sizes, targets, total_tokens, seed, known).groupBy("mix_id", "source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.col("n_tokens").cast("long") * F.col("repeats")).alias("tokens"),
        F.max("repeats").alias("most_repeats"),
    )
    whole = taken.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    rows = _quota_table(sizes, known).join(taken, ["mix_id", "source"], "left").join(whole, "mix_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "mix_id",
        "source",
        "target_share",
        F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("actual_share"),
        zero("documents"),
        zero("tokens"),
        "available",
        "max_repeats",
        zero("most_repeats"),
    )
