"""A7–A9 from a rollup: counts per day that are stored once and merged, never recounted.

A rollup is a folder of partial counts, one subfolder for each batch of rows. Adding
a batch counts only its rows; reading sums the partials, at most one row per day and
batch. Counts add up, so late rows of any day are one more batch, and rows that were
taken back are a batch of negative counts. A batch is named by its caller and written
once: a save that is tried again under its name changes nothing.

Days and not months are counted, because A8 and A9 end at a reference date within a
month. Activities without a date have a day of NULL, as A7 counts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import save_table_once

SCHEMA = "date date, n bigint"


def daily_counts(a: DataFrame, sign: int = 1) -> DataFrame:
    """(date, n): rows per day, counted up or (sign=-1) down."""
    return a.groupBy("date").agg((F.count(F.lit(1)) * sign).alias("n"))


def add_batch(a: DataFrame, path: str, batch: str, sign: int = 1) -> bool:
    """Count the rows of a batch into the rollup at `path`; False if that batch is there already."""
    return save_table_once(daily_counts(a, sign).coalesce(1), f"{path.rstrip('/')}/batch={batch}")


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """(date, n) over all batches; days that have come to nothing are left out."""
    parts = spark.read.schema(SCHEMA + ", batch string").option("basePath", path).parquet(path)
    return parts.groupBy("date").agg(F.sum("n").alias("n")).filter("n <> 0")


def compact(spark: SparkSession, path: str, new_path: str) -> None:
    """The same counts as one batch at `new_path`, for a rollup with many batches."""
    save_table_once(read_rollup(spark, path).coalesce(1), f"{new_path.rstrip('/')}/batch=compacted")
