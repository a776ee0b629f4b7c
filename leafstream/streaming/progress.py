"""Progress while the log of attempts grows.

The source is a folder to which attempts are appended as parquet files. Attempts may be logged late and more than
once; within the watermark each counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: How late an attempt may come, and the length of the spans that are counted.
LATENESS, SPAN = "7 days", "300 seconds"


def attempts_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 64) -> DataFrame:
    """The attempts of a folder as a stream, each once, providers in one letter case."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    named = log.where("attempt_id IS NOT NULL").withColumn("provider", F.lower(F.trim("provider")))
    return named.withWatermark("attempted_at", LATENESS).dropDuplicatesWithinWatermark(["attempt_id"])


def progress(stream: DataFrame, span: str = SPAN) -> DataFrame:
    """(span_start, provider, attempts, done, chars) by spans of time and providers."""
    ok = F.col("outcome") == "ok"
    counted = stream.groupBy(F.window("attempted_at", span).alias("span"), "provider").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("done"), F.coalesce(F.sum(F.when(ok, F.col("chars").cast("long"))), F.lit(0)).alias("chars")
    )
    return counted.select(F.col("span.start").alias("span_start"), "provider", "attempts", "done", "chars")


def drain(figures: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now, and gives its figures as a table."""
    query = (
        figures.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return figures.sparkSession.table(name)
