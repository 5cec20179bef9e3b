"""Weather trends and duplicate-free captures as streams with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailtally.functions.params import safe_interval
from trailtally.functions.times import from_instant, instant
from trailtally.operators.filters import not_null

# Length of a bucket and where buckets start; day 0 is a Thursday, and weeks start on Mondays.
WINDOWS = {"hour": ("1 hour", "0 seconds"), "day": ("1 day", "0 seconds"), "week": ("7 days", "4 days")}
DELAY = "1 day"


def _watermarked(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """``rows`` with ``_at``: the zone-free time as an instant, which may carry a watermark."""
    return not_null(rows, time).withColumn("_at", instant(F.col(time))).withWatermark("_at", delay)


def trends_stream(images: DataFrame, interval: str | None = "hour", delay: str = DELAY) -> DataFrame:
    """Statistics per hour, day or Monday-based week of a stream of captures, as the batch has them.

    A bucket is kept while captures of it may come, and changes with every one. A capture more
    than ``delay`` behind the newest of earlier batches is left out if its bucket is closed, so
    the state holds the open buckets only. Readings combine before the shuffle; a
    bucket's state grows with its distinct units and directions, not with its captures.
    """
    width, start = WINDOWS[safe_interval(interval)]
    bucket = F.window("_at", width, width, start)
    counted = _watermarked(images, "capture_time", delay).groupBy(bucket).agg(
        F.avg("temperature").alias("avg_temp"),
        F.min("temperature").alias("min_temp"),
        F.max("temperature").alias("max_temp"),
        F.mode("temperature_unit", deterministic=True).alias("temp_unit"),
        F.avg("wind_speed").alias("avg_wind"),
        F.min("wind_speed").alias("min_wind"),
        F.max("wind_speed").alias("max_wind"),
        F.mode("wind_unit", deterministic=True).alias("wind_unit"),
        F.mode("wind_direction", deterministic=True).alias("common_wind_dir"),
        F.count("*").alias("reading_count"),
    )
    statistics = [c for c in counted.columns if c != "window"]
    return counted.select(from_instant(F.col("window.start")).alias("interval_start"), *statistics)


def store_trends(trends: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the buckets that each batch changes, then stop when the source is drained.

    Start it once per polling period; open buckets are carried over in ``checkpoint``. A batch has a
    folder of its own, so one that is repeated after a failure replaces what it wrote. Both
    folders must be shared by all nodes.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        trends.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def scan_trends(spark: SparkSession, path: str) -> DataFrame:
    """The stored buckets, each as its latest batch left it."""
    stored = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    statistics = [c for c in stored.columns if c not in ("interval_start", "batch")]
    latest = stored.groupBy("interval_start").agg(F.max_by(F.struct(*statistics), F.col("batch")).alias("_latest"))
    return latest.select("interval_start", "_latest.*")


def distinct_stream(captures: DataFrame, keys: list[str], time: str = "capture_time", delay: str = DELAY) -> DataFrame:
    """The first capture of each combination of ``keys`` to arrive, within ``delay`` of its time.

    A key is remembered until the watermark passes its time by ``delay`` and then forgotten, so the
    state does not grow with the table; a copy that comes later than that passes.
    """
    return _watermarked(captures, time, delay).dropDuplicatesWithinWatermark(keys).drop("_at")


def store_rows(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to files at ``path``, each row once, then stop when the source is drained."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
