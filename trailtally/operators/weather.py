"""Weather per hour, day or week, and record days.

Readings are first reduced by bucket and by the three text columns whose most frequent value
is wanted. That step combines on the map side into fixed-width sums, so neither a busy bucket
nor a common unit gathers its readings in one task; everything after it works on a few
rows per bucket.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailtally.functions.params import safe_interval
from trailtally.functions.present import round1_or_null
from trailtally.functions.times import bucket_time, iso_seconds
from trailtally.operators.filters import filter_date_range, filter_times, not_null

_MODES = {
    "temp_unit": "temperature_unit",
    "wind_unit": "wind_unit",
    "common_wind_dir": "wind_direction",
}
_READINGS = {"temp": "temperature", "wind": "wind_speed"}

RECORD_COLUMNS = [
    "day", "min_temp", "max_temp", "avg_temp", "temp_unit",
    "min_wind", "max_wind", "avg_wind", "wind_unit", "common_wind_dir",
]


def _reduce_readings(df: DataFrame, start: str, unit: str, **keys: Column) -> DataFrame:
    """Sums, counts and extremes per bucket, further keys and combination of text values.

    Rows are grouped by date and hour, which are cheap; the bucket's ``start`` is made from the
    few groups.
    """
    time = F.col("capture_time")
    parts = {"_date": F.to_date(time)}
    grouped_time = F.col("_date").cast("timestamp_ntz")
    if unit == "hour":
        parts["_hour"] = F.hour(time)
        grouped_time = grouped_time + F.make_dt_interval(hours=F.col("_hour"))
    aggregates = [F.count("*").alias("n")]
    for short, column in _READINGS.items():
        aggregates += [
            F.sum(column).alias(f"{short}_sum"),
            F.count(column).alias(f"{short}_n"),
            F.min(column).alias(f"{short}_min"),
            F.max(column).alias(f"{short}_max"),
        ]
    grouped = df.groupBy(*[c.alias(k) for k, c in {**parts, **keys}.items()], *_MODES.values())
    return grouped.agg(*aggregates).withColumn(start, bucket_time(grouped_time, unit)).drop(*parts)


def _summarise(reduced: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: statistics, and the most frequent text values (ties: the smallest)."""
    sums = ["n", "temp_sum", "temp_n", "wind_sum", "wind_n"]
    lows, highs = ["temp_min", "wind_min"], ["temp_max", "wind_max"]
    votes = F.array(*[
        F.struct(F.lit(name).alias("mode"), F.col(column).alias("value")) for name, column in _MODES.items()
    ])
    counted = (
        reduced.select("*", F.inline(votes))
        .groupBy(*keys, "mode", "value")
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            *[F.min(c).alias(c) for c in lows],
            *[F.max(c).alias(c) for c in highs],
        )
    )
    # Every reading voted once per mode, so any one mode carries the complete sums.
    whole = F.col("mode") == next(iter(_MODES))

    def most_frequent(mode: str) -> Column:
        ballot = F.when(
            (F.col("mode") == mode) & F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value"))
        )
        return F.min(ballot)["value"].alias(mode)

    totals = counted.groupBy(*keys).agg(
        *[F.sum(F.when(whole, F.col(c))).alias(c) for c in sums],
        *[F.min(c).alias(c) for c in lows],
        *[F.max(c).alias(c) for c in highs],
        *[most_frequent(mode) for mode in _MODES],
    )
    return totals.select(
        *keys,
        F.try_divide("temp_sum", "temp_n").alias("avg_temp"),
        F.col("temp_min").alias("min_temp"),
        F.col("temp_max").alias("max_temp"),
        "temp_unit",
        F.try_divide("wind_sum", "wind_n").alias("avg_wind"),
        F.col("wind_min").alias("min_wind"),
        F.col("wind_max").alias("max_wind"),
        "wind_unit",
        "common_wind_dir",
        F.col("n").alias("reading_count"),
    )


def weather_by_bucket(
    df: DataFrame,
    interval: str | None = "hour",
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> DataFrame:
    """:func:`weather_trends` without the order."""
    readings = filter_date_range(not_null(df, "capture_time"), start, end)
    reduced = _reduce_readings(readings, "interval_start", safe_interval(interval))
    return _summarise(reduced, ["interval_start"])


def weather_trends(
    df: DataFrame,
    interval: str | None = "hour",
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> DataFrame:
    """Statistics per hour, day or week, newest first; always from all readings in the range."""
    return weather_by_bucket(df, interval, start, end).orderBy(F.col("interval_start").desc())


def _daily(df: DataFrame, required: str) -> DataFrame:
    reduced = _reduce_readings(not_null(df, required), "day", "day")
    return _summarise(reduced, ["day"]).select(RECORD_COLUMNS)


def daily_temps(df: DataFrame) -> DataFrame:
    """Statistics per day over captures that have a temperature."""
    return _daily(df, "temperature")


def daily_winds(df: DataFrame) -> DataFrame:
    """Statistics per day over captures that have a wind speed."""
    return _daily(df, "wind_speed")


def _rank(average: str) -> Column:
    """An average as it is ranked and shown: the last bits of a sum depend on its order."""
    return F.round(F.col(average), 9)


def coldest_day(df: DataFrame) -> DataFrame:
    """Day with the lowest average temperature; the earliest of equals."""
    return daily_temps(df).orderBy(_rank("avg_temp"), "day").limit(1)


def hottest_day(df: DataFrame) -> DataFrame:
    """Day with the highest average temperature; the earliest of equals."""
    return daily_temps(df).orderBy(_rank("avg_temp").desc(), "day").limit(1)


def windiest_day(df: DataFrame) -> DataFrame:
    """Day with the highest average wind speed; the earliest of equals."""
    return daily_winds(df).orderBy(_rank("avg_wind").desc(), "day").limit(1)


def weather_records(df: DataFrame) -> DataFrame:
    """The three record days in one pass over the captures, one row each with its ``record`` name."""
    has_temp, has_wind = F.col("temperature").isNotNull(), F.col("wind_speed").isNotNull()
    reduced = _reduce_readings(
        df.filter(has_temp | has_wind), "day", "day", has_temp=has_temp, has_wind=has_wind
    )
    bases = F.array_compact(F.array(
        F.when(F.col("has_temp"), F.lit("temperature")), F.when(F.col("has_wind"), F.lit("wind"))
    ))
    daily = _summarise(reduced.select("*", F.explode(bases).alias("basis")), ["basis", "day"])

    def best(basis: str, rank: Column) -> Column:
        row = F.struct(rank.alias("rank"), *RECORD_COLUMNS)
        return F.min(F.when((F.col("basis") == basis) & rank.isNotNull(), row))

    records = daily.agg(
        best("temperature", _rank("avg_temp")).alias("coldest_day"),
        best("temperature", -_rank("avg_temp")).alias("hottest_day"),
        best("wind", -_rank("avg_wind")).alias("windiest_day"),
    )
    rows = F.array(*[
        F.struct(F.lit(name).alias("record"), *[F.col(name)[c].alias(c) for c in RECORD_COLUMNS])
        for name in ("coldest_day", "hottest_day", "windiest_day")
    ])
    return records.select(F.inline(rows)).filter(F.col("day").isNotNull())


def images_on_day(df: DataFrame, day: DataFrame | datetime) -> DataFrame:
    """Captures of one day, given as such or as a row of daily statistics.

    Captures without readings are included. The day enters as bounds that skip other days'
    files; one that is still to be found is a number the scan waits for.
    """
    if not isinstance(day, DataFrame):
        return filter_times(df, start=day, before=day + timedelta(days=1))
    found = day.select("day").scalar()
    time = F.col("capture_time")
    own = df.filter((time >= found) & (time < found + F.make_dt_interval(days=F.lit(1))))
    return own.filter(F.col("capture_date") == F.to_date(found)) if "capture_date" in df.columns else own


def image_struct(image: Column | None = None) -> Column:
    """The short form of a capture shown with a record day."""
    field = F.col if image is None else image.getField
    return F.struct(
        field("id").alias("id"),
        field("cdn_url").alias("cdn_url"),
        iso_seconds(field("capture_time")).alias("capture_time"),
    )


def day_images(df: DataFrame, day: DataFrame | datetime) -> DataFrame:
    """Captures of the day in time order, one row (day, image) each."""
    return (
        images_on_day(df, day)
        .orderBy("capture_time", "id")
        .select(bucket_time(F.col("capture_time"), "day").alias("day"), image_struct().alias("image"))
    )


def weather_documents(summary: DataFrame, time: str = "interval_start", *kept: str) -> DataFrame:
    """Response form of trends or record rows: rounded readings nested by kind.

    The columns ``kept`` stay beside it.
    """
    extra = [c for c in ("record", "reading_count") if c in summary.columns] + list(kept)
    return summary.select(
        iso_seconds(F.col(time)).alias("timestamp"),
        F.struct(
            round1_or_null(_rank("avg_temp")).alias("average"),
            round1_or_null(F.col("min_temp")).alias("min"),
            round1_or_null(F.col("max_temp")).alias("max"),
            F.col("temp_unit").alias("unit"),
        ).alias("temperature"),
        F.struct(
            round1_or_null(_rank("avg_wind")).alias("average"),
            round1_or_null(F.col("min_wind")).alias("min"),
            round1_or_null(F.col("max_wind")).alias("max"),
            F.col("wind_unit").alias("unit"),
            F.col("common_wind_dir").alias("common_direction"),
        ).alias("wind"),
        *extra,
    )


def record_documents(df: DataFrame) -> DataFrame:
    """Response form of the record days, one row per record and capture of its day.

    The captures come from one scan that is joined with the three days at most.
    """
    records = weather_records(df)
    documents = weather_documents(records, "day", "day")
    dated = df.withColumn("day", bucket_time(F.col("capture_time"), "day")).select("day", image_struct().alias("image"))
    return dated.join(F.broadcast(documents), "day").select(*[c for c in documents.columns if c != "day"], "image")


def trends_info(
    df: DataFrame,
    interval: str | None = "hour",
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> DataFrame:
    """One row (interval, total_intervals) that goes with the trends; only buckets are grouped."""
    unit = safe_interval(interval)
    readings = filter_date_range(not_null(df, "capture_time"), start, end)
    buckets = readings.select(bucket_time(F.col("capture_time"), unit).alias("bucket")).distinct()
    return buckets.agg(F.count("*").alias("total_intervals")).select(F.lit(unit).alias("interval"), "total_intervals")
