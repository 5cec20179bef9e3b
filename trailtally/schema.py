"""Table and JSON schemas."""

from __future__ import annotations

from pyspark.sql import types as T

IMAGES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("source_id", T.StringType(), False),
    T.StructField("cdn_url", T.StringType(), False),
    T.StructField("capture_time", T.TimestampNTZType(), False),
    T.StructField("primary_location", T.StringType()),
    T.StructField("secondary_location", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("temperature_unit", T.StringType()),
    T.StructField("wind_speed", T.DoubleType()),
    T.StructField("wind_direction", T.StringType()),
    T.StructField("wind_unit", T.StringType()),
    T.StructField("raw_metadata", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("file_hash", T.StringType(), False),
])

TAGS = T.StructType([
    T.StructField("tag_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
])

IMAGE_TAGS = T.StructType([
    T.StructField("image_id", T.LongType(), False),
    T.StructField("tag_id", T.LongType(), False),
])

# What a listing shows of an image.
LISTING_COLUMNS = [f.name for f in IMAGES.fields if f.name not in ("updated_at", "file_hash")]

TAG_JSON = "type STRING, name STRING, count DOUBLE, display STRING"

METADATA_JSON = (
    "timestamp STRING, location STRUCT<primary: STRING, secondary: STRING>, "
    "temperature STRUCT<value: DOUBLE, unit: STRING>, "
    "wind STRUCT<direction: STRING, speed: DOUBLE, unit: STRING>, "
    "pressure STRUCT<value: DOUBLE, unit: STRING>, sun_status STRING, moon_phase STRING"
)

# Longest text each column takes.
TEXT_LIMITS = {
    "source_id": 255,
    "primary_location": 255,
    "secondary_location": 255,
    "temperature_unit": 10,
    "wind_direction": 10,
    "wind_unit": 10,
    "file_hash": 32,
}

REQUIRED_COLUMNS = ["id", "source_id", "cdn_url", "capture_time", "file_hash"]
