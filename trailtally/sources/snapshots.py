"""Snapshots of a table, and which old files to drop."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailtally.functions.text import is_log
from trailtally.functions.times import moment

SNAPSHOTS_KEPT = 7
MAX_AGE_DAYS = 7

_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _parts(folder: str, name: str, stamp: str) -> tuple[str, str]:
    return f"{folder}/{name}_schema_{stamp}", f"{folder}/{name}_data_{stamp}"


def export_snapshot(df: DataFrame, folder: str, name: str, stamp: str) -> None:
    """Write schema and rows apart, both compressed."""
    schema_path, data_path = _parts(folder, name, stamp)
    df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.option(
        "compression", "gzip"
    ).text(schema_path)
    df.write.option("compression", "gzip").option("timestampNTZFormat", _TIME_FORMAT).json(data_path)


def restore_snapshot(spark: SparkSession, folder: str, name: str, stamp: str) -> DataFrame:
    """Rows of a snapshot under its stored schema."""
    schema_path, data_path = _parts(folder, name, stamp)
    stored = T.StructType.fromJson(json.loads(spark.read.text(schema_path).first()["value"]))
    return spark.read.schema(stored).option("timestampNTZFormat", _TIME_FORMAT).json(data_path)


def keep_latest(
    df: DataFrame, kind: str, time: str, tie: str, n: int = SNAPSHOTS_KEPT
) -> DataFrame:
    """The newest ``n`` rows of each kind. Each task passes on at most ``n`` rows of a kind."""
    order = Window.partitionBy(kind).orderBy(F.col(time).desc_nulls_first(), tie)
    ranked = df.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def expired_rows(
    df: DataFrame, time: str | Column, now: datetime | str, days: int = MAX_AGE_DAYS
) -> DataFrame:
    """Rows older than ``days`` before ``now``."""
    cutoff = moment(now) - F.make_dt_interval(days=F.lit(days))
    return df.filter((F.col(time) if isinstance(time, str) else time) < cutoff)


def expired_files(files: DataFrame, now: datetime | str, prefix: str, days: int = MAX_AGE_DAYS) -> DataFrame:
    """Log files (path, modificationTime) of the program that names its logs by ``prefix``."""
    logs = files.filter(is_log(F.col("path"), prefix))
    return expired_rows(logs, F.col("modificationTime").cast("timestamp_ntz"), now, days)
