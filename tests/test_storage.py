"""Files: tables, snapshots, pictures, and the ingest stream."""

import hashlib
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trailtally import schema, session
from trailtally.operators import filters
from trailtally.sources import media, snapshots, tables
from trailtally.sources.seed import seed_images
from trailtally.streaming.ingest import ingest_stream, read_inbox

NOW = datetime(2024, 2, 1)


def captures(spark, pairs, day="2024-01-05"):
    rows = [(i, s, h, "u", datetime.fromisoformat(day)) for i, (s, h) in enumerate(pairs)]
    seq = spark.createDataFrame(
        rows, "pos long, source_id string, file_hash string, cdn_url string, capture_time timestamp_ntz"
    )
    missing = [f for f in schema.IMAGES.fields if f.name not in (*seq.columns, "id", "created_at", "updated_at")]
    return seq.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


def test_image_table(spark, tmp_path):
    path = str(tmp_path / "images")
    tables.recreate_images(seed_images(spark), path)
    assert sorted(os.listdir(path))[-3:] == [f"capture_date=2024-01-0{i}" for i in (1, 2, 3)]
    stored = tables.scan_image_rows(spark, path)
    tables.append_images(captures(spark, [("test1", "x"), ("new1", "abc123"), ("new2", "y"), ("new3", "y")]), stored, path, NOW)
    stored = tables.scan_image_rows(spark, path)
    assert sorted(r["source_id"] for r in stored.collect()) == ["new2", "test1", "test2", "test3"]
    new = stored.filter("source_id = 'new2'").first()
    assert new["id"] > 3 and new["created_at"] == NOW and str(new["capture_date"]) == "2024-01-05"
    # The same captures again change nothing.
    tables.append_images(captures(spark, [("new2", "y")]), stored, path, NOW)
    assert tables.scan_images(spark, path).count() == 4
    assert tables.scan_images(spark, path).columns == schema.LISTING_COLUMNS
    some = tables.scan_images(spark, path, "2024-01-02", "2024-01-03")
    assert [r["source_id"] for r in some.collect()] == ["test2"]
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(capture_date" in plan
    tables.recreate_images(seed_images(spark).filter("id = 1"), path)
    assert tables.scan_images(spark, path).count() == 1


def test_image_table_of_other_writers(spark, tmp_path):
    path, empty = str(tmp_path / "flat"), str(tmp_path / "empty")
    seed_images(spark).write.parquet(path)
    assert [r["id"] for r in tables.scan_images(spark, path, end="2024-01-02").collect()] == [1]
    tables.recreate_images(seed_images(spark).limit(0), empty)
    tables.append_images(captures(spark, [("a", "1")]), tables.scan_image_rows(spark, empty), empty, NOW)
    assert [r["id"] for r in tables.scan_images(spark, empty).collect()] == [1]


def test_tag_tables(spark, tmp_path):
    tags = spark.createDataFrame([(1, "{}")], schema.TAGS)
    links = spark.createDataFrame([(1, 1), (1, 1)], schema.IMAGE_TAGS)
    assert tables.write_table(tags, str(tmp_path / "tags")).collect() == tags.collect()
    tables.write_table(links, str(tmp_path / "links"))
    assert tables.scan_tags(spark, str(tmp_path / "tags")).count() == 1
    assert tables.scan_image_tags(spark, str(tmp_path / "links")).count() == 2
    with pytest.raises(Exception):
        tables.write_table(tags, str(tmp_path / "tags"))


def test_snapshot_round_trip(spark, tmp_path):
    images = seed_images(spark).withColumn(
        "capture_time", F.lit("2024-01-01 01:02:03.000456").cast("timestamp_ntz")
    ).withColumn("temperature", F.when(F.col("id") > 1, F.col("temperature")))
    snapshots.export_snapshot(images, str(tmp_path), "images", "20240101_000000")
    names = [f for _, _, files in os.walk(tmp_path) for f in files if f.startswith("part")]
    assert names and all(n.endswith(".gz") for n in names)
    restored = snapshots.restore_snapshot(spark, str(tmp_path), "images", "20240101_000000")
    assert restored.dtypes == images.dtypes
    assert sorted(restored.collect()) == sorted(images.collect())


def test_media(spark, tmp_path):
    files = {"a/one.JPG": b"1", "a/two.gif": b"22", "b/one.JPG": b"333", "b/c/three.png": b"4444", "note.txt": b"5"}
    for order, (name, content) in enumerate(files.items()):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
        os.utime(path, (1_700_000_000 + order * 60,) * 2)
    found = media.scan_media(spark, str(tmp_path))
    assert found.count() == 4
    hashes = {r["path"].split(str(tmp_path))[1]: r["file_hash"] for r in media.hashed_media(media.valid_media(found)).collect()}
    assert hashes == {f"/{n}": hashlib.md5(files[n]).hexdigest() for n in ("a/one.JPG", "b/one.JPG", "b/c/three.png")}
    manifest = media.media_manifest(found).collect()
    assert [r["name"] for r in manifest] == ["three.png", "one.JPG", "two.gif", "one.JPG"]
    assert {r["shown_path"][-9:] for r in manifest if r["name"] == "one.JPG"} == {"a/one.JPG"}
    assert manifest[-1]["date_text"] == "November 14, 2023 10:13 PM"


def test_media_size_limit(spark):
    sizes = spark.createDataFrame([("a.jpg", 10485760), ("b.jpg", 10485761), ("c.gif", 1)], "path string, length long")
    assert [r["path"] for r in media.valid_media(sizes).collect()] == ["a.jpg"]
    assert sorted(tuple(r) for r in media.rejected_media(sizes).collect()) == [
        ("b.jpg", 10485761, "too large"), ("c.gif", 1, "not a picture type")
    ]


def test_media_written_from_documents(spark, data, tmp_path):
    kinds = {"en": "jpg", "de": "PNG", "fr": "gif", "es": "txt"}
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "text").limit(60).collect()
    hashes = {}
    for order, row in enumerate(rows):
        path = tmp_path / row["lang"] / f"{row['doc_id']}.{kinds[row['lang']]}"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(row["text"].encode())
        os.utime(path, (1_700_000_000 + order,) * 2)
        hashes[f"file:{path}"] = hashlib.md5(row["text"].encode()).hexdigest()
    pictures = {path for path in hashes if not path.endswith(".txt")}
    found = media.scan_media(spark, str(tmp_path))
    assert {r["path"]: r["file_hash"] for r in media.hashed_media(found).collect()} == {p: hashes[p] for p in pictures}
    assert [r["path"] for r in media.media_manifest(found).collect()] == [p for p in reversed(hashes) if p in pictures]
    kept = {r["path"] for r in media.valid_media(found).collect()}
    assert kept | {r["path"] for r in media.rejected_media(found).collect()} == pictures
    assert {p for p in pictures if p.endswith("gif")}.isdisjoint(kept)


def test_stream_ingests_each_capture_once(spark, tmp_path):
    inbox, table, checkpoint = (str(tmp_path / n) for n in ("inbox", "images", "checkpoint"))
    tables.recreate_images(seed_images(spark), table)

    def poll():
        query = ingest_stream(read_inbox(spark, inbox), table, checkpoint, clock=lambda: NOW)
        assert query.awaitTermination(120)
        return sorted(r["source_id"] for r in tables.scan_images(spark, table).collect())

    captures(spark, [("n1", "x1"), ("n2", "x1"), ("test1", "x3")]).coalesce(1).write.mode("append").parquet(inbox)
    assert poll() == ["n1", "test1", "test2", "test3"]
    # Positions start anew in every file, and two files arrive between polls.
    captures(spark, [("n1", "x9"), ("n4", "x4")], "2024-01-06").coalesce(1).write.mode("append").parquet(inbox)
    captures(spark, [("n4", "x4"), ("n5", "x5")], "2024-01-06").coalesce(1).write.mode("append").parquet(inbox)
    assert poll() == ["n1", "n4", "n5", "test1", "test2", "test3"]
    assert poll() == ["n1", "n4", "n5", "test1", "test2", "test3"]


def test_checkpoint_folder_comes_from_the_session(spark):
    assert session.ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    pinned = session.pin(spark.range(3).toDF("id"))
    assert filters.filter_ids(pinned, [1, 2]).count() == 2
