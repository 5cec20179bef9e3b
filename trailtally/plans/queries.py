"""Registered queries: each runs an operator over whole tables of a folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailtally import schema
from trailtally.functions import params, present, tags, text, times
from trailtally.operators import answers, checks, filters, ingest, listing, mutate, scoring, tagging, weather
from trailtally.plans import bindings as b
from trailtally.plans import jobs
from trailtally.session import configure, ensure_checkpoint_dir
from trailtally.sources import catalog, media, snapshots, tables
from trailtally.streaming import ingest as ingest_streams
from trailtally.streaming import trends as trend_streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Request parameters, shared with the SQL twins.
RANGE = ("2024-01-08", "2024-01-21 12:00:00")
NOW = "2024-01-20 10:30:00"
TAG_NAMES = " Promo ,small,,promo"
LINK_RANGE_START = "1998-01-01"
BUCKETS = 8
# How far one run looks, and how much it stores.
MAX_ATTEMPTS, MAX_RECORDS = 200, 300


def query(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(configure(spark), folder)

    QUERIES[function.__name__] = run
    return function


def _rounded(df: DataFrame) -> DataFrame:
    """Averages to six decimals, since the last bits of a sum depend on its order."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in ("avg_temp", "avg_wind")})


def _scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all nodes share."""
    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


# weather


@query
def weather_trends_hour(spark, folder):
    return _rounded(weather.weather_trends(b.event_images(spark, folder), "hour"))


@query
def weather_trends_day(spark, folder):
    return _rounded(weather.weather_trends(b.event_images(spark, folder), "day"))


@query
def weather_trends_week(spark, folder):
    return _rounded(weather.weather_trends(b.event_images(spark, folder), "week"))


@query
def weather_trends_range(spark, folder):
    return _rounded(weather.weather_trends(b.event_images(spark, folder), "month", *RANGE))


@query
def coldest_day(spark, folder):
    return _rounded(weather.coldest_day(b.event_images(spark, folder)))


@query
def hottest_day(spark, folder):
    return _rounded(weather.hottest_day(b.event_images(spark, folder)))


@query
def windiest_day(spark, folder):
    return _rounded(weather.windiest_day(b.event_images(spark, folder)))


@query
def daily_temps(spark, folder):
    return _rounded(weather.daily_temps(b.event_images(spark, folder)))


@query
def daily_winds(spark, folder):
    return _rounded(weather.daily_winds(b.event_images(spark, folder)))


@query
def weather_records(spark, folder):
    return _rounded(weather.weather_records(b.event_images(spark, folder)))


@query
def coldest_day_images(spark, folder):
    images = b.event_images(spark, folder)
    found = weather.day_images(images, weather.coldest_day(images))
    return found.select("day", "image.*")


def _document_columns() -> list:
    return [
        "timestamp",
        F.col("temperature.average").alias("avg_temp"),
        F.col("temperature.min").alias("min_temp"),
        F.col("temperature.max").alias("max_temp"),
        F.col("temperature.unit").alias("temp_unit"),
        F.col("wind.average").alias("avg_wind"),
        F.col("wind.min").alias("min_wind"),
        F.col("wind.max").alias("max_wind"),
        F.col("wind.unit").alias("wind_unit"),
        F.col("wind.common_direction").alias("common_wind_dir"),
    ]


@query
def record_documents(spark, folder):
    found = weather.record_documents(b.event_images(spark, folder))
    return found.select("record", *_document_columns(), "image.*")


@query
def weather_documents(spark, folder):
    trends = weather.weather_by_bucket(b.event_images(spark, folder), "hour")
    return weather.weather_documents(trends).select(*_document_columns(), "reading_count")


@query
def trends_info(spark, folder):
    return weather.trends_info(b.event_images(spark, folder), "day", *RANGE)


# listing


@query
def scan_images(spark, folder):
    return b.event_images(spark, folder).select(schema.LISTING_COLUMNS)


@query
def list_images_filtered(spark, folder):
    images = b.event_images(spark, folder).select(schema.LISTING_COLUMNS)
    return listing.list_images(images, *RANGE, location="zone3", sort_by="temperature", sort_order="asc")


@query
def page_images(spark, folder):
    images = b.event_images(spark, folder).select(schema.LISTING_COLUMNS)
    return listing.page_images(images, page=2, per_page=20, sort_by="temperature", sort_order="DESC")


@query
def page_images_deep(spark, folder):
    images = b.event_images(spark, folder).select(schema.LISTING_COLUMNS)
    return listing.page_images(images, page=7, per_page=1000, sort_by="capture_time", sort_order="asc", max_top=100)


@query
def list_images_fallback(spark, folder):
    images = b.event_images(spark, folder).select(schema.LISTING_COLUMNS)
    return listing.list_images(images, *RANGE, sort_by="no such column", sort_order="ASC")


@query
def listing_info(spark, folder):
    return listing.listing_info(b.event_images(spark, folder), *RANGE, "zone3", sort_by="temperature")


@query
def coldest_day_images_stored(spark, folder):
    path = _scratch(spark)
    tables.recreate_images(b.event_images(spark, folder), path)
    images = tables.scan_image_rows(spark, path)
    found = weather.day_images(images, weather.coldest_day(images))
    return found.select("day", "image.*")


@query
def page_info(spark, folder):
    return listing.page_info(listing.filter_images(b.event_images(spark, folder), *RANGE, "zone3"), page=2)


@query
def count_images(spark, folder):
    return listing.count_images(b.event_images(spark, folder))


@query
def image_by_id(spark, folder):
    return listing.image_by_id(b.event_images(spark, folder).select(schema.LISTING_COLUMNS), 57)


@query
def images_by_ids(spark, folder):
    return listing.images_by_ids(b.event_images(spark, folder).select(schema.LISTING_COLUMNS), "53, 3,9,3,-1")


@query
def locations(spark, folder):
    return listing.locations(b.event_images(spark, folder))


@query
def latest_source_id(spark, folder):
    return listing.latest_source_id(b.event_images(spark, folder))


@query
def all_images_by_created(spark, folder):
    return listing.all_images_by_created(b.event_images(spark, folder))


@query
def not_null_temperature(spark, folder):
    return filters.not_null(b.event_images(spark, folder), "temperature").select("id", "temperature")


@query
def metadata_fields(spark, folder):
    return listing.image_metadata(b.event_images_with_metadata(spark, folder))


@query
def image_labels(spark, folder):
    return listing.image_labels(b.event_images_with_metadata(spark, folder))


@query
def image_documents(spark, folder):
    images = b.event_images(spark, folder).select(schema.LISTING_COLUMNS)
    return listing.image_documents(images)


@query
def time_labels_with_year(spark, folder):
    return b.event_images(spark, folder).select(
        "id", times.capture_label_year(F.col("capture_time")).alias("label")
    )


@query
def ids_from_texts(spark, folder):
    lists = F.concat_ws(", ", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    return b.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.posexplode(params.parse_ids_column(lists)).alias("place", "listed")
    )


@query
def images_in_id_table(spark, folder):
    images = b.event_images(spark, folder).select(schema.LISTING_COLUMNS)
    wanted = b.table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return filters.filter_id_table(images, wanted)


@query
def rounded_readings(spark, folder):
    return b.event_images(spark, folder).select(
        "id",
        present.round1_or_null(F.col("temperature")).alias("temperature"),
        present.round1_or_null(F.col("wind_speed")).alias("wind_speed"),
    )


# tags


@query
def images_with_tags(spark, folder):
    links = b.image_links(spark, folder)
    found = tagging.images_with_tags(
        b.order_images(spark, folder), links, b.part_tags(spark, folder), parts=tagging.link_parts(links)
    )
    return found.select("id", "source_id", "capture_time", "tag", "copies")


@query
def images_with_tags_bucketed(spark, folder):
    name = f"stored_{uuid.uuid4().hex}"
    images, links = b.order_images(spark, folder), b.image_links(spark, folder)
    buckets = max(BUCKETS, tagging.link_parts(images, links))
    images = tables.write_bucketed(images, f"{name}_images", "id", buckets)
    links = tables.write_bucketed(links, f"{name}_links", "image_id", buckets)
    found = tagging.images_with_tags(images, links, b.part_tags(spark, folder))
    return found.select("id", "source_id", "capture_time", "tag", "copies")


@query
def list_tagged_images(spark, folder):
    images = b.image_columns_filled(b.order_images(spark, folder))
    found = listing.list_tagged_images(
        images, b.image_links(spark, folder), b.part_tags(spark, folder),
        tag_names=TAG_NAMES, start=LINK_RANGE_START, sort_by="created_at", sort_order="asc",
    )
    return found.select("id", "source_id", "capture_time", "tag", "copies")


@query
def images_having_all_tags(spark, folder):
    return tagging.images_having_all_tags(
        b.order_images(spark, folder), b.image_links(spark, folder), b.part_tags(spark, folder), TAG_NAMES
    )


@query
def tags_masked_outside_range(spark, folder):
    links = b.image_links(spark, folder)
    found = tagging.tags_masked_outside_range(
        b.order_images(spark, folder), links, b.part_tags(spark, folder),
        F.col("capture_time") >= times.moment(LINK_RANGE_START), parts=tagging.link_parts(links),
    )
    return found.select("id", "tag", "copies")


@query
def list_tagged_images_masked(spark, folder):
    images = b.image_columns_filled(b.order_images(spark, folder))
    found = listing.list_tagged_images(
        images, b.image_links(spark, folder), b.part_tags(spark, folder),
        tag_names=TAG_NAMES, start=LINK_RANGE_START, mask_outside_range=True,
    )
    return found.select("id", "capture_time", "tag", "copies")


@query
def tag_rows(spark, folder):
    return tagging.tag_rows(b.image_links(spark, folder), b.part_tags(spark, folder))


@query
def filter_tag_type(spark, folder):
    return filters.filter_tag_type(b.part_tags(spark, folder), "animal")


@query
def filter_tag_names(spark, folder):
    return filters.filter_tag_names(b.part_tags(spark, folder), TAG_NAMES)


@query
def tag_image_counts(spark, folder):
    return tagging.tag_image_counts(b.image_links(spark, folder), b.part_tags(spark, folder))


@query
def available_tags(spark, folder):
    return tagging.available_tags(b.image_links(spark, folder), b.part_tags(spark, folder))


@query
def tags_parsed(spark, folder):
    rows = tagging.tag_rows(b.image_links(spark, folder), b.part_tags(spark, folder))
    return rows.select("image_id", tags.parse_tag(F.col("name")).alias("tag")).select("image_id", "tag.*")


@query
def untagged_images(spark, folder):
    return tagging.newest_untagged(b.order_images(spark, folder), b.image_links(spark, folder), 20)


@query
def all_untagged_images(spark, folder):
    return tagging.untagged_images(b.order_images(spark, folder), b.image_links(spark, folder))


@query
def count_untagged(spark, folder):
    return tagging.count_untagged(b.order_images(spark, folder), b.image_links(spark, folder))


@query
def next_tagging_batch(spark, folder):
    images, links = b.order_images(spark, folder), b.image_links(spark, folder)
    return ingest.next_tagging_batch(None, images, links)


@query
def next_tagging_batch_new(spark, folder):
    images, links = b.order_images(spark, folder), b.image_links(spark, folder)
    returned = b.table(spark, folder, "lineitem").filter(F.col("l_returnflag") == "R")
    new_ids = returned.select(F.concat(F.lit("order"), F.col("l_orderkey").cast("string")).alias("source_id"))
    return ingest.next_tagging_batch(new_ids, images, links)


# changes


def _removal(spark, folder):
    return mutate.remove_tag(b.image_links(spark, folder), b.part_tags(spark, folder), 7, "ECONOMY")


@query
def remove_tag_kept(spark, folder):
    return _removal(spark, folder).kept


@query
def remove_tag_removed(spark, folder):
    return _removal(spark, folder).removed


@query
def remove_tag_remaining(spark, folder):
    return _removal(spark, folder).remaining


def _published_tags(spark, folder) -> tuple[str, str]:
    """Name and folder of a set of the two tables of tags."""
    name, path = f"tagging_{uuid.uuid4().hex}", _scratch(spark)
    catalog.publish(spark, name, path, links=b.image_links(spark, folder), tags=b.part_tags(spark, folder))
    return name, path


@query
def remove_tag_published(spark, folder):
    name, path = _published_tags(spark, folder)
    links, tags_before = catalog.published(spark, name, "links", "tags")
    kept = mutate.remove_tag(links, tags_before, 7, "ECONOMY").kept
    catalog.publish(spark, name, path, links=kept, tags=tags_before)
    return catalog.published(spark, name, "links")[0]


@query
def retag_all_published(spark, folder):
    name, path = _published_tags(spark, folder)
    changed = mutate.retag_all(b.event_answers(spark, folder), *catalog.published(spark, name, "links", "tags"))
    catalog.publish(spark, name, path, links=changed.links, tags=changed.tags)
    return _named_links(mutate.Tagging(*reversed(catalog.published(spark, name, "links", "tags"))))


@query
def replace_tags(spark, folder):
    items = b.table(spark, folder, "lineitem").filter(F.col("l_returnflag") == "R")
    new_links = items.select(F.col("l_orderkey").alias("image_id"), F.col("l_suppkey").alias("tag_id"))
    return mutate.replace_tags(b.image_links(spark, folder), new_links)


@query
def missing_tags(spark, folder):
    return mutate.missing_tags(b.ordered_tag_names(spark, folder), b.part_tags(spark, folder))


@query
def upsert_tags(spark, folder):
    tags_before = b.part_tags(spark, folder)
    found = mutate.upsert_tags(b.ordered_tag_names(spark, folder), tags_before)
    highest = tags_before.agg(F.max("tag_id")).scalar()
    # Which new text has which new id is not fixed; that ids are new, whole and unique is.
    first = F.count("*").over(Window.partitionBy("tag_id")) == 1
    return found.select(
        "name", F.when(F.col("tag_id") <= highest, F.col("tag_id")).alias("old_id"), first.alias("unique")
    )


@query
def upsert_tag_ids(spark, folder):
    tags_before = b.part_tags(spark, folder)
    found = mutate.upsert_tags(b.ordered_tag_names(spark, folder), tags_before)
    return found.agg(F.count("*").alias("n"), F.countDistinct("tag_id").alias("ids"), F.max("tag_id").alias("highest"))


def _named_links(tagged: mutate.Tagging) -> DataFrame:
    names = tagged.tags.select("tag_id", "name")
    return tagging.join_dealt(tagged.links, names, "tag_id", "image_id").select("image_id", "name")


@query
def tag_answers(spark, folder):
    return _named_links(mutate.tag_answers(
        b.event_answers(spark, folder), b.image_links(spark, folder), b.part_tags(spark, folder)
    ))


@query
def retag_all(spark, folder):
    return _named_links(mutate.retag_all(
        b.event_answers(spark, folder), b.image_links(spark, folder), b.part_tags(spark, folder)
    ))


def _count_by_address(address: str) -> str:
    """A stand-in for a model."""
    return json.dumps({"Deers": len(address) % 3, "total": 9})


@query
def tag_next_batch(spark, folder):
    run = jobs.tag_next_batch(
        b.order_images(spark, folder), b.image_links(spark, folder), b.part_tags(spark, folder), _count_by_address
    )
    return _named_links(run.tables)


@query
def tagging_progress(spark, folder):
    run = jobs.tag_next_batch(
        b.order_images(spark, folder), b.image_links(spark, folder), b.part_tags(spark, folder), _count_by_address
    )
    return run.progress


@query
def retag_images(spark, folder):
    return _named_links(jobs.retag_images(
        b.order_images(spark, folder), b.image_links(spark, folder), b.part_tags(spark, folder), _count_by_address
    ))


@query
def update_images(spark, folder):
    images = b.event_images(spark, folder)
    changes = images.filter(F.col("temperature") == 0).withColumn("temperature", F.lit(1.5))
    return mutate.update_images(images, changes, NOW)


# checks


@query
def duplicate_keys(spark, folder):
    return checks.duplicate_keys(b.document_sequence(spark, folder), ["file_hash"])


@query
def null_violations(spark, folder):
    images = b.event_images(spark, folder)
    return checks.null_violations(images, [*schema.REQUIRED_COLUMNS, "primary_location", "temperature"])


@query
def length_violations(spark, folder):
    limits = {**schema.TEXT_LIMITS, "primary_location": 5, "secondary_location": 4}
    return checks.length_violations(b.event_images(spark, folder), limits)


@query
def orphan_links(spark, folder):
    links = b.image_links(spark, folder)
    images = b.order_images(spark, folder).filter(F.col("capture_time") >= times.moment(LINK_RANGE_START))
    tags_kept = filters.filter_tag_type(b.part_tags(spark, folder), "animal")
    return checks.orphan_links(images, links, tags_kept)


@query
def orphan_tags(spark, folder):
    early = b.table(spark, folder, "lineitem").filter(F.col("l_shipdate") < times.moment("1995-03-01"))
    links = early.select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("tag_id"))
    return checks.orphan_tags(links, b.part_tags(spark, folder))


# ingest


@query
def file_hash(spark, folder):
    documents = b.table(spark, folder, "documents")
    return documents.select("doc_id", text.file_hash(F.col("text").cast("binary")).alias("file_hash"))


@query
def new_captures(spark, folder):
    return ingest.new_captures(b.document_sequence(spark, folder), b.labelled_images(spark, folder))


@query
def dedupe_run(spark, folder):
    return ingest.dedupe_run(b.document_sequence(spark, folder))


@query
def accepted_captures(spark, folder):
    return ingest.accepted(b.document_sequence(spark, folder), b.rejected_images(spark, folder))


@query
def accepted_captures_indexed(spark, folder):
    stored = catalog.add_stored_keys(b.rejected_images(spark, folder), f"keys_{uuid.uuid4().hex}", BUCKETS)
    return ingest.accepted(b.document_sequence(spark, folder), stored)


@query
def take_until_duplicate(spark, folder):
    return ingest.take_until_duplicate(b.document_sequence(spark, folder))


@query
def incremental_batch(spark, folder):
    return ingest.incremental_batch(b.document_sequence(spark, folder), b.rejected_images(spark, folder))


@query
def incremental_batch_bounded(spark, folder):
    return ingest.incremental_batch(
        b.document_sequence(spark, folder), b.labelled_images(spark, folder),
        force=True, max_attempts=MAX_ATTEMPTS, max_records=MAX_RECORDS,
    )


@query
def incremental_batch_forced(spark, folder):
    return ingest.incremental_batch(
        b.document_sequence(spark, folder), b.labelled_images(spark, folder), force=True
    )


@query
def backfill_batch_bounded(spark, folder):
    return ingest.backfill_batch(
        b.document_sequence(spark, folder), b.labelled_images(spark, folder), jump=30, limit=20, max_attempts=MAX_ATTEMPTS
    )


@query
def backfill_batch(spark, folder):
    return ingest.backfill_batch(
        b.document_sequence(spark, folder), b.labelled_images(spark, folder), jump=30
    )


def _ingested(spark, folder):
    shots, readings = b.event_shots(spark, folder), b.event_readings(spark, folder)
    return ingest.ingest_readings(shots, readings, b.stored_events(spark, folder), NOW)


@query
def ingest_captures(spark, folder):
    return _ingested(spark, folder).drop("id")


@query
def ingest_ids(spark, folder):
    return _ingested(spark, folder).agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last")
    )


# sources and sinks, each written to a new folder and read back


@query
def scan_stored_images(spark, folder):
    path = _scratch(spark)
    tables.recreate_images(b.event_images(spark, folder), path)
    return tables.scan_images(spark, path, *RANGE)


@query
def scan_stored_tags(spark, folder):
    path = _scratch(spark)
    tables.write_table(b.part_tags(spark, folder), path)
    return tables.scan_tags(spark, path)


@query
def scan_stored_links(spark, folder):
    path = _scratch(spark)
    tables.write_table(b.image_links(spark, folder), path)
    return tables.scan_image_tags(spark, path)


@query
def append_images(spark, folder):
    path = _scratch(spark)
    tables.recreate_images(b.stored_events(spark, folder), path)
    shots, readings = b.event_shots(spark, folder), b.event_readings(spark, folder)
    rows = ingest.ingest_readings(shots, readings, tables.scan_image_rows(spark, path), NOW)
    tables.append_rows(rows, path)
    return tables.scan_image_rows(spark, path).select("source_id", "file_hash", "temperature", "wind_unit", "capture_time")


@query
def snapshot_round_trip(spark, folder):
    path = _scratch(spark)
    snapshots.export_snapshot(b.event_images(spark, folder), path, "images", "1")
    return snapshots.restore_snapshot(spark, path, "images", "1")


@query
def rejected_media(spark, folder):
    return media.rejected_media(b.document_media(spark, folder))


def _stored_pages(spark, folder) -> str:
    """A folder with a file for each page."""
    path = _scratch(spark)
    html = b.table(spark, folder, "pages").select("page_id", "html").filter(F.col("html") != "")
    files = b.page_files(spark, folder).join(html, "page_id")
    media.store_files(files.select("path", F.col("html").alias("content")), path)
    return path


def _below(path: Column) -> Column:
    return F.regexp_extract(path, "(downloads/[^/]*)$", 1)


@query
def media_files(spark, folder):
    found = media.valid_media(media.scan_media(spark, _stored_pages(spark, folder)))
    return media.hashed_media(found).select(_below(F.col("path")).alias("path"), "length", "file_hash")


@query
def media_manifest(spark, folder):
    found = media.media_manifest(media.scan_media(spark, _stored_pages(spark, folder)))
    return found.select("name", _below(F.col("path")).alias("path"), _below(F.col("shown_path")).alias("shown_path"))


@query
def file_kinds(spark, folder):
    kinds = text.file_kind(F.col("path"), "cam_sync_")
    return b.event_files(spark, folder).select("path", kinds.alias("kind"))


@query
def expired_files(spark, folder):
    return snapshots.expired_files(b.event_files(spark, folder), NOW, "cam_sync_").select("path")


@query
def infer_capture_time(spark, folder):
    return b.event_date_texts(spark, folder).select(
        "id", times.infer_capture_time(F.col("with_gaps"), NOW).alias("capture_time")
    )


@query
def parse_capture_time(spark, folder):
    return b.event_date_texts(spark, folder).select(
        "id", times.parse_capture_time(F.col("with_year"), NOW).alias("capture_time")
    )


@query
def pivot_readings(spark, folder):
    found = ingest.with_defaults(ingest.pivot_readings(b.event_readings(spark, folder)))
    return found.select(
        "source_id", "temperature", "temperature_unit", "wind_speed", "wind_direction", "wind_unit",
        F.col("pressure.value").alias("pressure"), F.col("pressure.unit").alias("pressure_unit"),
        "sun_status", "moon_phase",
    )


@query
def source_id_from_url(spark, folder):
    return b.page_files(spark, folder).select("page_id", text.source_id_from_url(F.col("url")).alias("source_id"))


@query
def publish_url(spark, folder):
    path = F.col("path")
    address = text.publish_url(b.CDN, text.source_id_from_url(F.col("url")), F.col("file_hash"), path)
    return b.page_files(spark, folder).select(
        "page_id", address.alias("cdn_url"), text.mime_type(path).alias("mime_type")
    )


@query
def valid_media(spark, folder):
    return media.valid_media(b.document_media(spark, folder))


@query
def keep_latest(spark, folder):
    images = b.event_images(spark, folder).select("id", "primary_location", "created_at")
    return snapshots.keep_latest(images, "primary_location", "created_at", "id")


@query
def expired_rows(spark, folder):
    return snapshots.expired_rows(b.event_images(spark, folder), "created_at", NOW).select("id", "created_at")


# answers


@query
def tag_counts_from_analysis(spark, folder):
    return answers.tag_counts_from_analysis(b.event_answers(spark, folder))


@query
def tags_unmerged(spark, folder):
    return answers.tags_unmerged(b.event_answers(spark, folder))


@query
def score_images(spark, folder):
    documents = b.table(spark, folder, "documents")
    return scoring.score_images(
        documents,
        predict=lambda content: json.dumps({"Words": len(content.split(" ")), "total": len(content)}),
        id_column="doc_id",
        input_column="text",
    )


def _make_counter() -> Callable[[list], list[str]]:
    """A stand-in for a model that takes long to load and many inputs at once."""
    return lambda contents: [json.dumps({"Words": len(text.split(" ")), "total": len(text)}) for text in contents]


@query
def score_images_batched(spark, folder):
    return scoring.score_images(
        b.table(spark, folder, "documents"), id_column="doc_id", input_column="text",
        make_model=_make_counter, model="counter",
    )


def _words_or_error(content: str) -> str:
    """A stand-in for a model that fails on some inputs."""
    words = len(content.split(" "))
    if words % 7 == 0:
        raise ValueError("no answer")
    return json.dumps({"Words": words})


def _load_or_error(content: str) -> str:
    if len(content) % 5 == 0:
        raise OSError("not found")
    return content


@query
def score_images_failing(spark, folder):
    return scoring.score_images(
        b.table(spark, folder, "documents"), _words_or_error, _load_or_error, "doc_id", "text"
    )


# streams: files arrive in thirds, and each third is polled by a start of its own on one checkpoint


def _arrivals(rows: DataFrame, place: Column, inbox: str, period: int = 1) -> Iterator[None]:
    """Write the rows to the inbox in three steps by their place, a whole number of periods each."""
    span = rows.agg(F.min(place).alias("low"), F.max(place).alias("high")).first()
    step = period * max(1, -(-(span["high"] + 1 - span["low"]) // (3 * period))) if span["low"] is not None else 1
    third = F.floor((place - F.lit(span["low"] or 0)) / F.lit(step))
    for k in range(3):
        rows.filter(third == k).write.mode("append").parquet(inbox)
        yield


def _stored_trends(spark, folder, interval):
    images = b.event_images(spark, folder).drop("id")
    path = _scratch(spark)
    for _ in _arrivals(images, F.unix_date(F.to_date("capture_time")), f"{path}/inbox"):
        inbox = spark.readStream.schema(images.schema).parquet(f"{path}/inbox")
        trends = trend_streams.trends_stream(inbox, interval)
        trend_streams.store_trends(trends, f"{path}/trends", f"{path}/checkpoint").awaitTermination()
    return _rounded(trend_streams.scan_trends(spark, f"{path}/trends"))


@query
def trends_stream_hour(spark, folder):
    return _stored_trends(spark, folder, "hour")


@query
def trends_stream_week(spark, folder):
    return _stored_trends(spark, folder, "week")


@query
def distinct_stream(spark, folder):
    documents = b.document_sequence(spark, folder)
    time = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("pos").cast("decimal(18,6)"))
    rows = documents.select("file_hash", time.alias("capture_time"), "pos")
    path = _scratch(spark)
    for _ in _arrivals(rows, F.col("pos"), f"{path}/inbox"):
        inbox = spark.readStream.schema(rows.schema).parquet(f"{path}/inbox")
        # As long as no copy comes after so many days, each hash passes once.
        found = trend_streams.distinct_stream(inbox, ["file_hash"], delay="100000 days")
        trend_streams.store_rows(found.select("file_hash"), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("file_hash string").parquet(f"{path}/rows")


@query
def ingest_stream(spark, folder):
    captures = b.event_captures(spark, folder).select(ingest_streams.CAPTURES.names)
    path = _scratch(spark)
    tables.recreate_images(b.stored_events(spark, folder), f"{path}/images")
    for _ in _arrivals(captures, F.col("pos"), f"{path}/inbox", b.SHOT_PERIOD):
        inbox = ingest_streams.read_inbox(spark, f"{path}/inbox")
        ingest_streams.ingest_stream(
            inbox, f"{path}/images", f"{path}/checkpoint", lambda: datetime.fromisoformat(NOW)
        ).awaitTermination()
    stored = tables.scan_image_rows(spark, f"{path}/images")
    return stored.select("source_id", "file_hash", "temperature", "wind_unit", "capture_time", "created_at")
