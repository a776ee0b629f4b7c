"""Views of a run's tables that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstream.functions.text import segment_hash
from leafstream.operators.telemetry import attempts_of, deduplicated
from leafstream.sources.tables import table


def chunks(spark: SparkSession, directory: str, *columns: str) -> DataFrame:
    """Each chunk once, as delivered with the most attempts; only the columns named, and what tells deliveries apart."""
    wanted = ["chunk_id", *columns] + [c for c in ("attempts", "queued_at") if c not in columns]
    return deduplicated(table(spark, directory, "chunks").select(*wanted), "chunk_id", "attempts", "queued_at")


def segments(spark: SparkSession, directory: str) -> DataFrame:
    """(chunk_id, job_id, file_hash, chunk_no, text_no, seg_id, text): the segments of all chunks, nulls included."""
    rows = chunks(spark, directory, "job_id", "file_hash", "chunk_no", "seg_ids", "texts")
    return rows.select(
        "chunk_id",
        "job_id",
        "file_hash",
        "chunk_no",
        F.posexplode(F.arrays_zip("seg_ids", "texts")).alias("text_no", "_s"),
    ).select("chunk_id", "job_id", "file_hash", "chunk_no", "text_no", F.col("_s.seg_ids").alias("seg_id"), F.col("_s.texts").alias("text"))


def lengths(spark: SparkSession, directory: str) -> DataFrame:
    """(job_id, seg_id, n_chars): the segments of all chunks by their lengths, which are taken before anything moves."""
    sized = table(spark, directory, "chunks").withColumn("n", F.transform("texts", F.length))
    once = deduplicated(sized.select("chunk_id", "job_id", "seg_ids", "n", "attempts", "queued_at"), "chunk_id", "attempts", "queued_at")
    rows = once.select("job_id", F.explode(F.arrays_zip("seg_ids", "n")).alias("_s"))
    return rows.select("job_id", F.col("_s.seg_ids").alias("seg_id"), F.col("_s.n").alias("n_chars"))


def parts(spark: SparkSession, directory: str, *columns: str) -> DataFrame:
    """Each finished part once, as logged last; only the columns named are read."""
    wanted = ["part_id", *columns] + [c for c in ("logged_at",) if c not in columns]
    return deduplicated(table(spark, directory, "recent_parts").select(*wanted), "part_id", "logged_at")


def attempts(spark: SparkSession, directory: str, *columns: str) -> DataFrame:
    """Each attempt once, as logged last; only the columns named are read, and the provider."""
    wanted = ["attempt_id", "provider", *columns] + [c for c in ("logged_at",) if c not in columns]
    return attempts_of(table(spark, directory, "attempts").select(*wanted))


def job_settings(spark: SparkSession, directory: str) -> DataFrame:
    """(job_id, max_chars, persian_digits, mode, status, filename) with the defaults of missing settings."""
    jobs, settings = table(spark, directory, "jobs"), table(spark, directory, "dispatch_settings")
    own = settings.select("settings_id", "max_chars", "persian_digits", "run_mode")
    return jobs.join(own, "settings_id", "left").select(
        "job_id",
        F.coalesce("max_chars", F.lit(2500)).alias("max_chars"),
        F.coalesce("persian_digits", F.lit(False)).alias("persian_digits"),
        F.coalesce("run_mode", F.lit("translate")).alias("mode"),
        "status",
        "filename",
    )


def answered(spark: SparkSession, directory: str) -> DataFrame:
    """(part_id, job_id, file_hash, provider, seg_id, text, translation, finished_at): the finished parts by segment.

    A part's texts are told apart by the blank lines that join them; an answer with more or fewer than there are texts
    can't be attributed, and is left out.
    """
    own = chunks(spark, directory, "job_id", "seg_ids", "texts").select("chunk_id", "job_id", "seg_ids", "texts")
    done = parts(spark, directory, "chunk_id", "file_hash", "provider", "translation", "finished_at").where("translation IS NOT NULL")
    answers = F.when(F.size("texts") == 1, F.array("translation")).otherwise(F.split("translation", "\n\n", -1))
    both = done.join(own, "chunk_id").withColumn("answers", answers).where(F.size("answers") == F.size("texts"))
    rows = both.select("part_id", "job_id", "file_hash", "provider", "finished_at", F.explode(F.arrays_zip("seg_ids", "texts", "answers")).alias("_s"))
    return rows.select(
        "part_id", "job_id", "file_hash", "provider", F.col("_s.seg_ids").alias("seg_id"), F.col("_s.texts").alias("text"), F.col("_s.answers").alias("translation"), "finished_at"
    )


def checkpoint(spark: SparkSession, directory: str) -> DataFrame:
    """(file_hash, mode, seg_sha1, translation, written_at): what the finished parts give."""
    rows = answered(spark, directory).where("text IS NOT NULL").join(job_settings(spark, directory).select("job_id", "mode"), "job_id")
    return rows.select("file_hash", "mode", segment_hash(F.col("text")).alias("seg_sha1"), "translation", F.col("finished_at").alias("written_at"))
