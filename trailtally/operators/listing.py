"""Image listings, pages and lookups."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailtally.functions.params import PAGE_SORT_COLUMNS, SORT_COLUMNS, parse_ids, safe_sort
from trailtally.functions.present import (
    metadata_fields,
    place_label,
    pressure_label,
    temperature_label,
    wind_label,
)
from trailtally.functions.tags import parse_tag
from trailtally.functions.times import capture_label, iso_text
from trailtally.operators.filters import filter_date_range, filter_ids, filter_location, time_predicates
from trailtally.operators.ranges import placed_in_ranges
from trailtally.operators.tagging import ids_having_all_tags, images_with_tags, tags_masked_outside_range

DEFAULT_PAGE_SIZE = 20
# Most (sort column, id) rows each task ranks for a page; deeper pages are found by counting.
MAX_TOP = 10_000


def sort_key(sort_by: str | None, sort_order: str | None, allowed: Iterable[str] = SORT_COLUMNS) -> list[Column]:
    """Order by one allowed column, missing values last going up and first going down, then id.

    The id makes pages stable, and lets a range partitioning split a value most rows share.
    """
    column, descending = safe_sort(sort_by, sort_order, allowed)
    key = F.col(column)
    return [key.desc_nulls_first() if descending else key.asc_nulls_last(), F.col("id")]


def filter_images(
    images: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    location: str | None = None,
) -> DataFrame:
    """Images within the inclusive range and at the place, for whichever are given."""
    return filter_location(filter_date_range(images, start, end), location)


def list_images(
    images: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    location: str | None = None,
    sort_by: str | None = "capture_time",
    sort_order: str | None = "desc",
    allowed: Iterable[str] = SORT_COLUMNS,
) -> DataFrame:
    """Filtered images in order."""
    return filter_images(images, start, end, location).orderBy(*sort_key(sort_by, sort_order, allowed))


def list_tagged_images(
    images: DataFrame,
    links: DataFrame,
    tags: DataFrame,
    ids: str | Iterable[int] | None = None,
    tag_names: str | Iterable[str] | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    location: str | None = None,
    sort_by: str | None = "capture_time",
    sort_order: str | None = "desc",
    mask_outside_range: bool = False,
) -> DataFrame:
    """Listing with tags: the images named by ``ids`` in that order, or a filtered, sorted list.

    One row per image and tag text, as :func:`images_with_tags`, with the tags of an image in
    order. Tags are counted only for images the listing can show. With ``mask_outside_range``
    the dates do not filter a list by tags but take the tags off images outside of them.
    """
    if ids:
        wanted = parse_ids(ids) if isinstance(ids, str) else list(ids)
        own_links = filter_ids(links, wanted, "image_id")
        return _in_requested_order(images_with_tags(filter_ids(images, wanted), own_links, tags), wanted, "tag")
    order = [*sort_key(sort_by, sort_order), F.col("tag")]
    if not tag_names:
        return images_with_tags(filter_images(images, start, end, location), links, tags).orderBy(*order)
    chosen = ids_having_all_tags(links, tags, tag_names).withColumnRenamed("id", "image_id")
    if mask_outside_range:
        in_range = reduce(and_, time_predicates(start, end), F.lit(True))
        placed = filter_location(images, location)
        return tags_masked_outside_range(placed, links, tags, in_range, ids=chosen).orderBy(*order)
    shown = filter_images(images, start, end, location)
    return images_with_tags(shown, links, tags, ids=chosen).orderBy(*order)


def page_images(
    images: DataFrame,
    page: int = 1,
    per_page: int = DEFAULT_PAGE_SIZE,
    sort_by: str | None = "capture_time",
    sort_order: str | None = "desc",
    allowed: Iterable[str] = PAGE_SORT_COLUMNS,
    max_top: int = MAX_TOP,
) -> DataFrame:
    """One page of the ordered images.

    The page's ids are found on the sort column and id alone, and its rows follow by a semi
    join. Each task keeps its best ``page * per_page`` of those narrow rows; from ``max_top`` of
    them on, the places are found by counting the rows of sorted ranges instead.
    """
    order = sort_key(sort_by, sort_order, allowed)
    skipped = (page - 1) * per_page
    column, _ = safe_sort(sort_by, sort_order, allowed)
    keys = images.select(column, "id")
    if skipped + per_page <= max_top:
        wanted = keys.orderBy(*order).offset(skipped).limit(per_page).select("id")
    else:
        wanted = _ids_by_rank(keys, order, skipped, per_page)
    return images.join(wanted, "id", "left_semi").select(images.columns).orderBy(*order)


def _ids_by_rank(keys: DataFrame, order: list[Column], skipped: int, count: int) -> DataFrame:
    """``id`` of ``count`` rows after the first ``skipped`` in the order.

    The sizes of the sorted ranges, one number each, tell which places are wanted. Rows of one
    key value are split by id.
    """
    placed = placed_in_ranges(keys, order).select("id", "range", "place")
    sizes = placed.groupBy("range").count().orderBy("range").collect()
    chosen, before = F.lit(False), 0
    for size in sizes:
        first, last = skipped - before, skipped + count - before
        if first < size["count"] and last > 0:
            within = (F.col("place") >= first) & (F.col("place") < last)
            chosen = chosen | ((F.col("range") == size["range"]) & within)
        before += size["count"]
    return placed.filter(chosen).select("id")


def count_images(images: DataFrame) -> DataFrame:
    return images.agg(F.count("*").alias("count"))


def page_info(images: DataFrame, page: int = 1, per_page: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One row (total, page, per_page, total_pages)."""
    return images.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(page).cast("bigint").alias("page"),
        F.lit(per_page).cast("bigint").alias("per_page"),
        F.floor((F.col("total") + F.lit(per_page - 1)) / per_page).cast("bigint").alias("total_pages"),
    )


def listing_info(
    images: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    location: str | None = None,
    sort_by: str | None = "capture_time",
    sort_order: str | None = "desc",
) -> DataFrame:
    """One row (total_records, sort_by, sort_order) that goes with a listing."""
    column, descending = safe_sort(sort_by, sort_order)
    return filter_images(images, start, end, location).agg(F.count("*").alias("total_records")).select(
        "total_records", F.lit(column).alias("sort_by"), F.lit("desc" if descending else "asc").alias("sort_order")
    )


def image_by_id(images: DataFrame, image_id: int) -> DataFrame:
    """The image with the id, or no row."""
    return images.filter(F.col("id") == image_id)


def id_position(ids: Iterable[int], column: str = "id") -> Column:
    """1-based place of the id in the list, NULL when it is not there."""
    listed = F.array(*[F.lit(i) for i in ids]).cast("array<bigint>")
    return F.nullif(F.array_position(listed, F.col(column)), F.lit(0))


def _in_requested_order(images: DataFrame, ids: list[int], *then: str) -> DataFrame:
    return images.withColumn("position", id_position(ids)).orderBy("position", *then)


def images_by_ids(images: DataFrame, ids: str | Iterable[int]) -> DataFrame:
    """Images of the list in its order with their ``position``; a repeated id gives one row."""
    wanted = parse_ids(ids) if isinstance(ids, str) else list(ids)
    return _in_requested_order(filter_ids(images, wanted), wanted)


def locations(images: DataFrame) -> DataFrame:
    """Distinct places in order."""
    return (
        images.filter(F.col("primary_location").isNotNull())
        .select("primary_location", "secondary_location")
        .distinct()
        .orderBy(F.col("primary_location").asc_nulls_last(), F.col("secondary_location").asc_nulls_last())
    )


def latest_source_id(images: DataFrame) -> DataFrame:
    """Source id of the image created last."""
    return images.orderBy(F.col("created_at").desc_nulls_first(), "id").select("source_id").limit(1)


def all_images_by_created(images: DataFrame) -> DataFrame:
    """(id, cdn_url) of all images, those created last first."""
    return images.orderBy(F.col("created_at").desc_nulls_first(), "id").select("id", "cdn_url")


def image_labels(images: DataFrame) -> DataFrame:
    """Texts a list or detail page shows; values that are missing or zero have no text."""
    meta = F.col("meta")
    return images.withColumn("meta", metadata_fields(F.col("raw_metadata"))).select(
        "id",
        capture_label(F.col("capture_time")).alias("time_label"),
        place_label(F.col("primary_location"), F.col("secondary_location")).alias("place_label"),
        temperature_label(F.col("temperature"), F.col("temperature_unit")).alias("temperature_label"),
        wind_label(F.col("wind_direction"), F.col("wind_speed"), F.col("wind_unit")).alias("wind_label"),
        pressure_label(meta["pressure"]).alias("pressure_label"),
        F.nullif(meta["sun_status"], F.lit("")).alias("sun_label"),
        F.nullif(meta["moon_phase"], F.lit("")).alias("moon_label"),
    )


def image_metadata(images: DataFrame) -> DataFrame:
    """Readings kept only in the raw metadata."""
    meta = F.col("meta")
    return images.withColumn("meta", metadata_fields(F.col("raw_metadata"))).select(
        "id",
        meta["pressure"]["value"].alias("pressure"),
        meta["pressure"]["unit"].alias("pressure_unit"),
        meta["sun_status"].alias("sun_status"),
        meta["moon_phase"].alias("moon_phase"),
    )


def image_documents(images: DataFrame) -> DataFrame:
    """Response form of a listing: times as text, and a tag text as an object."""
    columns = {
        "capture_time_formatted": capture_label(F.col("capture_time")),
        "capture_time": iso_text(F.col("capture_time")),
        "created_at": iso_text(F.col("created_at")),
    }
    if "tag" in images.columns:
        columns["tag"] = parse_tag(F.col("tag"))
    return images.withColumns(columns)
