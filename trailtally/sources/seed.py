"""The three seed rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from trailtally import schema

# Source id, time, places, temperature, wind, pressure, sun, moon, hash.
SEED = [
    ("test1", "2024-01-01 12:00:00", "North Trail", "Cabin", 72.5, 5.2, "NW", 30.1, "Sunny", "Full Moon", "abc123"),
    ("test2", "2024-01-02 14:30:00", "South Ridge", "Stream", 68.0, 3.1, "SE", 29.9, "Partly Cloudy", "Waning", "def456"),
    ("test3", "2024-01-03 09:15:00", "East Creek", "Waterfall", 65.2, 7.8, "E", 30.0, "Cloudy", "New Moon", "ghi789"),
]


def seed_images(spark: SparkSession, now: datetime = datetime(2024, 1, 4)) -> DataFrame:
    rows = [
        (
            i, source_id, f"https://example.com/{source_id}.jpg", datetime.fromisoformat(taken),
            primary, secondary, temperature, "F", speed, direction, "mph",
            f'{{"pressure": {{"value": {pressure}, "unit": "inHg"}}, "sun_status": "{sun}", "moon_phase": "{moon}"}}',
            now, now, content_hash,
        )
        for i, (
            source_id, taken, primary, secondary, temperature, speed, direction, pressure, sun, moon, content_hash
        ) in enumerate(SEED, start=1)
    ]
    return spark.createDataFrame(rows, schema.IMAGES)
