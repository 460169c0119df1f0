"""Reading and writing the tables in the usual Spark formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Read a table; text formats need the declared schema."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def spread_few_files(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over all cores where a table has too few files to keep them busy.

    For work that is heavy per row, such as the text operators. A table with at least one
    split per core is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a declared schema; absent columns become null, others are dropped."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def append(df: DataFrame, path: str, partition_by: Sequence[str] = (),
           fmt: str = "parquet") -> None:
    """Append rows to a log table."""
    df.write.mode("append").format(fmt).partitionBy(*partition_by).save(path)


def append_with_date(df: DataFrame, path: str, ts: str, fmt: str = "parquet") -> None:
    """Append rows partitioned by the date of `ts`, never by session or user."""
    append(df.withColumn("date", F.to_date(ts)), path, ["date"], fmt)
