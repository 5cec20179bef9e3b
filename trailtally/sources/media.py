"""Picture files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailtally.functions.text import base_name, file_hash, mime_type
from trailtally.functions.times import capture_label_year

# What is accepted as a picture.
MEDIA_GLOB = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[gG][iI][fF]}"
ALLOWED_MIME_TYPES = ("image/jpeg", "image/png")
MAX_MEDIA_BYTES = 10 * 1024 * 1024


def scan_files(
    spark: SparkSession, folder: str, names: str = "*", before: datetime | str | None = None
) -> DataFrame:
    """Files below the folder: path, modificationTime, length and content.

    Names and age are looked at when the folder is listed, so other files cost nothing. ``names``
    is a glob, and ``before`` a time in the session's time zone. Content is only read by plans
    that use it. Empty files have no row.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names)
    if before is not None:
        reader = reader.option("modifiedBefore", datetime.fromisoformat(str(before)).strftime("%Y-%m-%dT%H:%M:%S"))
    return reader.load(folder)


def scan_media(spark: SparkSession, folder: str, before: datetime | str | None = None) -> DataFrame:
    """Picture files below the folder, as :func:`scan_files` has them."""
    return scan_files(spark, folder, MEDIA_GLOB, before)


def store_files(files: DataFrame, folder: str) -> int:
    """Write each ``content`` to its ``path`` below the folder; returns how many files there are.

    A path must be that of one row. A task that is repeated writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))
        made = set()
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                target = f"{root}/{path.as_py()}"
                parent = target.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(target) as out:
                    out.write(content.as_py())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows = files.select("path", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def valid_media(media: DataFrame) -> DataFrame:
    """JPEG and PNG files of at most 10 MiB; the size is checked before content is read."""
    return media.filter(
        (F.col("length") <= MAX_MEDIA_BYTES) & mime_type(F.col("path")).isin(*ALLOWED_MIME_TYPES)
    )


def rejected_media(media: DataFrame) -> DataFrame:
    """The other files, as (path, length, reason)."""
    reason = F.when(F.col("length") > MAX_MEDIA_BYTES, F.lit("too large")).otherwise(F.lit("not a picture type"))
    fine = (F.col("length") <= MAX_MEDIA_BYTES) & mime_type(F.col("path")).isin(*ALLOWED_MIME_TYPES)
    return media.filter(~fine).select("path", "length", reason.alias("reason"))


def hashed_media(media: DataFrame) -> DataFrame:
    """(path, length, file_hash) of the files."""
    return media.select("path", "length", file_hash(F.col("content")).alias("file_hash"))


def media_manifest(media: DataFrame) -> DataFrame:
    """Entries of a picture list, newest first: (name, date_text, path, shown_path).

    Files of one name from different folders share one copy, which is the oldest file's.
    """
    files = media.select("path", base_name(F.col("path")).alias("name"), "modificationTime")
    shown = files.groupBy("name").agg(
        F.min_by("path", F.struct("modificationTime", "path")).alias("shown_path")
    )
    return (
        files.join(shown, "name")
        .orderBy(F.col("modificationTime").desc(), "path")
        .select(
            "name",
            capture_label_year(F.col("modificationTime").cast("timestamp_ntz")).alias("date_text"),
            "path",
            "shown_path",
        )
    )
