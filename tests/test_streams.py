"""Streams: open buckets, late rows, keys that expire, restarts; and tables that are switched over."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailtally.functions import times
from trailtally.operators import scoring, weather
from trailtally.sources import catalog, media
from trailtally.streaming import trends

SHOTS = (
    "capture_time timestamp_ntz, temperature double, temperature_unit string, wind_speed double, wind_unit string, "
    "wind_direction string, file_hash string"
)


def shots(spark, rows):
    made = [(datetime.fromisoformat(t), x, "F", x, "mph", d, h) for t, x, d, h in rows]
    return spark.createDataFrame(made, SHOTS)


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_instants_do_not_depend_on_the_zone(spark, zone):
    moments = [datetime(2024, 3, 10, 2, 30), datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(1970, 1, 1), datetime(2024, 11, 3, 1, 30)]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz")
    found = df.select(F.unix_micros(times.instant(F.col("t"))).alias("n"), times.from_instant(times.instant(F.col("t"))).alias("t"))
    micro = timedelta(microseconds=1)
    assert [tuple(r) for r in found.collect()] == [((m - datetime(1970, 1, 1)) // micro, m) for m in moments]


@pytest.mark.parametrize("interval", ["hour", "day", "week"])
def test_trends_are_those_of_the_batch(spark, tmp_path, zone, interval):
    rows = [(f"2024-01-{d:02}T{h:02}:{d:02}:00", float(d * h % 11), "NESW"[d * h % 4], "x") for d in range(1, 20) for h in range(0, 24, 5)]
    inbox, stored = str(tmp_path / "inbox"), str(tmp_path / "trends")
    for part in (rows[:30], rows[30:31], rows[31:]):
        shots(spark, part).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SHOTS).parquet(inbox)
        query = trends.store_trends(trends.trends_stream(stream, interval, "2 days"), stored, str(tmp_path / "state"))
        assert query.awaitTermination(120)
    expected = weather.weather_by_bucket(shots(spark, rows), interval)
    columns = expected.columns
    assert sorted(trends.scan_trends(spark, stored).select(columns).collect()) == sorted(expected.collect())


def test_late_captures_are_left_out(spark, tmp_path):
    inbox, stored = str(tmp_path / "inbox"), str(tmp_path / "trends")
    parts = [
        [("2024-01-01T10:00:00", 1.0, "N", "a"), ("2024-01-01T15:30:00", 2.0, "N", "b")],
        # Two hours behind 15:30 is the border: 12:59 lies in a closed bucket, 13:05 in an open one.
        [("2024-01-01T12:59:00", 9.0, "N", "c"), ("2024-01-01T13:05:00", 3.0, "N", "d"), ("2024-01-01T15:45:00", 4.0, "S", "e")],
    ]
    for part in parts:
        shots(spark, part).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SHOTS).parquet(inbox)
        query = trends.store_trends(trends.trends_stream(stream, "hour", "2 hours"), stored, str(tmp_path / "state"))
        assert query.awaitTermination(120)
    found = {r.interval_start.hour: (r.reading_count, r.max_temp, r.common_wind_dir) for r in trends.scan_trends(spark, stored).collect()}
    assert found == {10: (1, 1.0, "N"), 13: (1, 3.0, "N"), 15: (2, 4.0, "N")}


def test_keys_expire_with_the_watermark(spark, tmp_path):
    inbox, stored = str(tmp_path / "inbox"), str(tmp_path / "rows")
    parts = [
        [("2024-01-01T10:00:00", 1.0, "N", "a"), ("2024-01-01T10:30:00", 2.0, "N", "a"), ("2024-01-01T10:30:00", 2.0, "N", "b")],
        [("2024-01-01T10:50:00", 3.0, "N", "b"), ("2024-01-01T18:00:00", 4.0, "N", "c")],
        # a and b are forgotten by now; a capture before the watermark is dropped as late.
        [("2024-01-01T18:10:00", 5.0, "N", "a"), ("2024-01-01T09:00:00", 6.0, "N", "z"), ("2024-01-01T18:20:00", 7.0, "N", "c")],
    ]
    for part in parts:
        shots(spark, part).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SHOTS).parquet(inbox)
        distinct = trends.distinct_stream(stream, ["file_hash"], delay="1 hour")
        assert trends.store_rows(distinct, stored, str(tmp_path / "state")).awaitTermination(120)
    found = spark.read.schema(SHOTS).parquet(stored).select("file_hash", F.hour("capture_time").alias("h")).collect()
    assert sorted(tuple(r) for r in found) == [("a", 10), ("a", 18), ("b", 10), ("c", 18)]


def test_published_tables_change_together(spark, tmp_path):
    def tables(n):
        return {"links": spark.range(n).toDF("image_id"), "tags": spark.range(n * 10).toDF("tag_id")}

    folder = f"{tmp_path}/it's here"
    catalog.publish(spark, "switched", folder, **tables(3))
    links, tags = catalog.published(spark, "switched", "links", "tags")
    assert (links.count(), tags.count()) == (3, 30)
    # New rows made of the old ones; who read the old ones still can.
    catalog.publish(spark, "switched", folder, links=links.filter("image_id > 0"), tags=tags.limit(0))
    assert (links.count(), tags.count()) == (3, 30)
    assert [df.count() for df in catalog.published(spark, "switched", "links", "tags")] == [2, 0]
    # Rows that cannot be written leave the name as it is.
    broken = links.select(F.raise_error(F.lit("no")).cast("bigint").alias("image_id"))
    with pytest.raises(Exception):
        catalog.publish(spark, "switched", folder, links=broken, tags=tags)
    assert [df.count() for df in catalog.published(spark, "switched", "links", "tags")] == [2, 0]
    spark.sql("DROP VIEW switched")


def test_key_index_grows(spark):
    def keys(*pairs):
        return spark.createDataFrame(list(pairs), "source_id string, file_hash string")

    catalog.add_stored_keys(keys(("a", "1"), ("b", None)), "growing", 2)
    stored = catalog.add_stored_keys(keys(("c", "3")), "growing", 2)
    assert sorted(r[0] for r in stored.source_id.collect()) == ["a", "b", "c"]
    assert sorted(r[0] for r in stored.file_hash.collect()) == ["1", "3"]
    for key in ("source_id", "file_hash"):
        spark.sql(f"DROP TABLE growing_{key}")


def test_files_are_chosen_when_listed(spark, tmp_path):
    import os

    for k, name in enumerate(("a.log", "b.log", "c.txt", "d/e.log")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(name)
        os.utime(path, (1_700_000_000 + k * 86_400,) * 2)
    found = media.scan_files(spark, str(tmp_path), "*.log", datetime.fromtimestamp(1_700_000_000 + 2 * 86_400))
    assert sorted(r["path"].rpartition("/")[2] for r in found.select("path").collect()) == ["a.log", "b.log"]
    assert media.scan_files(spark, str(tmp_path)).count() == 4


def test_stored_files_come_back(spark, tmp_path):
    rows = [("x/1.jpg", b"one"), ("x/2.PNG", b"2"), ("x/4.jpg", b""), ("y z/3.gif", b"\x00\xff")]
    files = spark.createDataFrame(rows, "path string, content binary")
    for _ in range(2):
        assert media.store_files(files, f"file:{tmp_path}/out") == 4
    # Spark reads no empty files.
    found = media.scan_media(spark, f"{tmp_path}/out").select("path", "content").collect()
    assert sorted((r["path"].rpartition("/")[2], bytes(r["content"])) for r in found) == [("1.jpg", b"one"), ("2.PNG", b"2"), ("3.gif", b"\x00\xff")]
    assert media.store_files(files.limit(0), f"{tmp_path}/none") == 0


def test_a_model_is_made_once_in_each_process(spark, tmp_path):
    notes = str(tmp_path)

    def make():
        import os
        import uuid

        open(f"{notes}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda contents: [str(len(c)) for c in contents]

    df = spark.range(400).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("cdn_url"))
    for _ in range(2):
        found = scoring.score_images(df, make_model=make, model=notes, partitions=16).collect()
        assert {r.image_id: r.answer for r in found} == {k: str(k) for k in range(400)} and all(r.ok for r in found)
    made = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert made and len(made) == len(set(made))
