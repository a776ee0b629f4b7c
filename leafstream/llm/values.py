"""The text elements of the run's tables, one row each, once per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_elements(chunks: DataFrame, *extra: str, keep: Column | None = None) -> DataFrame:
    """(chunk_id, text_no, text, extra...) for each non-null element of ``chunks.texts``.

    Rows without a chunk_id, null arrays and null elements give nothing; positions count from 0 and include
    nulls. `keep` is a condition on ``text`` applied before anything moves. A chunk that was delivered more
    than once still stands there as often: see :func:`once`.
    """
    rows = chunks.where(F.col("chunk_id").isNotNull()).select(
        "chunk_id", *extra, F.posexplode("texts").alias("text_no", "text")
    )
    rows = rows.where(F.col("text").isNotNull())
    return rows if keep is None else rows.where(keep)


def once(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key. Repeated deliveries hold the same text, so that any of them does; should texts
    differ, the smallest row is kept, whatever the order of delivery."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct(*rest)).alias("_kept")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_kept.{c}").alias(c) for c in rest])
