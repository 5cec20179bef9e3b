"""Reading and writing the three tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailtally import schema
from trailtally.operators.filters import filter_date_range
from trailtally.operators.ingest import ingest_captures


def _scan(spark: SparkSession, path: str, table: T.StructType) -> DataFrame:
    return spark.read.schema(table).parquet(path).select(table.names)


def scan_images(
    spark: SparkSession, path: str, start: datetime | str | None = None, end: datetime | str | None = None
) -> DataFrame:
    """Listing columns of the images in the inclusive range; only its dates' files are read."""
    return filter_date_range(scan_image_rows(spark, path), start, end).select(schema.LISTING_COLUMNS)


def scan_image_rows(spark: SparkSession, path: str) -> DataFrame:
    """Image table with all columns, and ``capture_date`` where the files are split by it."""
    return spark.read.schema(schema.IMAGES).parquet(path)


def scan_tags(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, schema.TAGS)


def scan_image_tags(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, schema.IMAGE_TAGS)


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, **options: str) -> DataFrame:
    """A table of a running database; with ``key`` read in slices (pass the bounds as options)."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return (reader.option("partitionColumn", key) if key else reader).load()


def _rebalanced(images: DataFrame) -> DataFrame:
    """Rows of one capture date together; a date that holds many rows is split at run time."""
    dated = images.withColumn("capture_date", F.to_date("capture_time"))
    return dated.hint("rebalance", F.col("capture_date"))


def _write_images(images: DataFrame, path: str, mode: str) -> None:
    """Files split by date and sorted by time, so that a range reads few row groups."""
    dated = images.withColumn("capture_date", F.to_date("capture_time"))
    ordered = dated.sortWithinPartitions("capture_date", "capture_time")
    ordered.write.mode(mode).partitionBy("capture_date").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Add finished rows to the image table at ``path``."""
    _write_images(_rebalanced(rows), path, "append")


def append_images(captures: DataFrame, images: DataFrame, path: str, now: datetime | str) -> None:
    """Store the captures that are new, with ids and times set."""
    append_rows(ingest_captures(captures, images, now), path)


def recreate_images(images: DataFrame, path: str) -> None:
    """Replace the image table at ``path`` by the rows, which must not come from that path."""
    _write_images(_rebalanced(images).select(schema.IMAGES.names), path, "overwrite")


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Store rows at a new path and read them back; an existing path is an error."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Store rows as a catalog table split and sorted by ``key``.

    Tables with equally many buckets of the same key are joined and grouped on it without a
    shuffle, which pays for images and links that are joined again and again. An existing table
    is an error.
    """
    ready = df.repartition(buckets, key)
    ready.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)
