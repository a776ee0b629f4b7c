"""The checkpoint of finished segments: lookup, remaining work, merge and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstream.functions.text import segment_hash

KEYS = ["file_hash", "mode", "seg_sha1"]


def latest(entries: DataFrame) -> DataFrame:
    """One translation for each (file_hash, mode, seg_sha1): the one written last, the greatest in a tie.

    Entries with a null key or translation are none.
    """
    whole = entries.where(" AND ".join(f"{k} IS NOT NULL" for k in [*KEYS, "translation"]))
    return whole.groupBy(*KEYS).agg(F.max_by("translation", F.struct("written_at", "translation")).alias("translation"))


def lookup(segments: DataFrame, entries: DataFrame) -> DataFrame:
    """`segments` (with file_hash, mode and text) and their kept `translation`, null where there is none.

    The checkpoint is reduced to one entry a key before the join, so that segments keep their number.
    """
    hashed = segments.withColumn("seg_sha1", segment_hash(F.col("text")))
    return hashed.join(latest(entries), KEYS, "left")


def pending(segments: DataFrame, entries: DataFrame) -> DataFrame:
    """The segments that the checkpoint doesn't hold."""
    hashed = segments.withColumn("seg_sha1", segment_hash(F.col("text")))
    known = entries.where("translation IS NOT NULL").select(*KEYS)
    return hashed.join(known, KEYS, "left_anti")


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' translations by key, the new one's where both have one."""
    a = old.select(*keys, F.col("translation").alias("_old"))
    b = new.select(*keys, F.col("translation").alias("_new"))
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("_new", "_old").alias("translation"))


def write(results: DataFrame, path: str) -> None:
    """Appends results (file_hash, mode, seg_sha1, translation, written_at), parted by mode. Writing the same
    results again changes nothing that :func:`latest` gives."""
    results.select(*KEYS, "translation", "written_at").write.mode("append").partitionBy("mode").parquet(path)


def read(spark, path: str) -> DataFrame:
    """The checkpoint at a path; an empty one where there is nothing yet."""
    schema = "file_hash string, seg_sha1 string, translation string, written_at timestamp, mode string"
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
