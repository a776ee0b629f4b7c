"""Reading of the run's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name` of a data directory; a file or a folder of part files alike."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
