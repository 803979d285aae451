"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are texts, which cost more to work on than to move.
TEXTS = ("documents", "pages", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a text table that has fewer splits than the session has cores is dealt out to all of them. A table
    of any size has more, so this costs nothing there."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df
