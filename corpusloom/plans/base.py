"""Registration of queries: a function of (spark, sf_dir) and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that comes in fewer splits than there are cores, whatever its size, is dealt out to all of them (columns are still pruned below that)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def registry() -> tuple[dict, object]:
    entries: dict = {}

    def query(sql: str | None = None):
        def add(f):
            entries[f.__name__] = (f, sql)
            return f

        return add

    return entries, query
