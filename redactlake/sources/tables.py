"""Tables as document sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A known ``schema`` saves a look into a file footer before the query starts."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core on a table with fewer splits than cores; leave others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def read_documents(
    spark: SparkSession, path: str, keys: list[str], text: str = "text", schema: str | None = None
) -> DataFrame:
    """(keys, text) of a Parquet table.

    A table small enough to have fewer splits than there are cores is spread over them; a
    large one keeps its splits, so its texts are not moved.
    """
    return spread(read_table(spark, path, schema).select(*keys, text), *keys)
