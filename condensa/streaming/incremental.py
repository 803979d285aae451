"""Incremental work as a stream: each text once, results appended, finished keys left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of work whose keys are not finished."""
    return work.join(done.select(keys).distinct(), keys, "left_anti")


def fan_out(rows: DataFrame, text: str, worked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Work once a distinct text and join the result to every row: worked gets (h, text) and gives h and
    more columns. A null text gets nulls."""
    once = rows.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("h"), F.col(text).alias("text")).dropDuplicates(["h"])
    return rows.withColumn("h", F.sha2(text, 256)).join(worked(once), "h", "left").drop("h")


def append_once(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], keys: list[str]) -> StreamingQuery:
    """Follow JSON Lines files in source, work on rows whose keys no earlier row had, and append the results to
    Parquet. The checkpoint keeps what was read and which keys were seen, so a run that was broken off goes on."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).json(source)
    fresh = work(rows.dropDuplicates(keys))
    return fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
