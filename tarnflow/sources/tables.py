"""Readers and writers of signed tables in the formats Spark has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarnflow.zset import with_weight


def read_signed(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A file table (parquet, orc, json, csv, text, avro where its package is there) as insertions.

    A ``__w`` column of the file is kept. Give a schema for text formats: inference reads the data twice.
    """
    r = spark.read.format(fmt).options(**options)
    return with_weight((r.schema(schema) if schema else r).load(path))


def stream_signed(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", **options: str) -> DataFrame:
    """The same as a stream of files, one micro-batch per ``maxFilesPerTrigger`` files."""
    return with_weight(spark.readStream.format(fmt).schema(schema).options(**options).load(path))


def write_signed(z: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition: tuple[str, ...] = ()) -> None:
    w = z.write.format(fmt).mode(mode)
    (w.partitionBy(*partition) if partition else w).save(path)
