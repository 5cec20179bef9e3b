"""Tags of images: joins, counts, and the queue of untagged images."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailtally.functions.params import parse_tag_names
from trailtally.functions.tags import json_field

# Names whose bits fit into one number.
NAMES_PER_COLUMN = 62
# Links whose counts and texts one task holds at once.
LINKS_PER_TASK = 1 << 18
# Tasks that the rows of one key are dealt to.
DEALT = 64


def link_parts(*tables: DataFrame) -> int:
    """So many parts that one has about ``LINKS_PER_TASK`` rows of the largest table. Counts rows."""
    return max(1, *[-(-table.count() // LINKS_PER_TASK) for table in tables])


def tag_fields(tags: DataFrame, strict: bool = False) -> DataFrame:
    """Tags with their JSON ``type`` and ``name`` as columns ``tag_type`` and ``tag_name``."""
    return tags.select(
        "tag_id",
        "name",
        json_field(F.col("name"), "type", strict).alias("tag_type"),
        json_field(F.col("name"), "name", strict).alias("tag_name"),
    )


def join_dealt(rows: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of ``rows`` with ``few`` on ``key``, for keys that may have most of the rows.

    The rows of a key are dealt to ``DEALT`` tasks by their column ``by``, and ``few`` follows them
    where they go: once for each key and deal that the rows have, so never more often than rows.
    """
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(by), F.lit(DEALT)))
    met = dealt.select(key, "_deal").distinct().join(few, key)
    return dealt.join(met, [key, "_deal"]).drop("_deal")


def tag_rows(links: DataFrame, tags: DataFrame) -> DataFrame:
    """One row (image_id, tag_id, name) per link whose tag exists."""
    return links.join(tags.select("tag_id", "name"), "tag_id").select("image_id", "tag_id", "name")


def tag_copies(
    links: DataFrame, tags: DataFrame, ids: DataFrame | None = None, parts: int | None = None
) -> DataFrame:
    """One row (image_id, tag, copies) per tagged image and tag text.

    ``copies`` tells how often the image has the text. Links are counted by id before they are
    turned into texts, with partial counts before the shuffle, so neither an image with many
    links nor a common tag gathers them. With ``ids`` (image_id) only for those images. With
    ``parts`` the named counts are dealt by image to so many tasks, which adaptive execution does
    not merge: it goes by compressed sizes, and equal texts are small until they are read.
    """
    if ids is not None:
        links = links.join(ids, "image_id", "left_semi")
    counted = links.groupBy("image_id", "tag_id").agg(F.count("*").alias("copies"))
    named = counted.join(tags.select("tag_id", F.col("name").alias("tag")), "tag_id")
    if parts is not None:
        named = named.repartition(parts, "image_id")
    return named.groupBy("image_id", "tag").agg(F.sum("copies").alias("copies"))


def images_with_tags(
    images: DataFrame, links: DataFrame, tags: DataFrame, ids: DataFrame | None = None, parts: int | None = None
) -> DataFrame:
    """One row per image and tag text with ``tag`` and ``copies``.

    An untagged image has one row, without a tag and with 0 copies. With ``ids`` (image_id),
    which must have tags, only those images. ``parts`` is that of :func:`tag_copies`; bucketed
    tables need none.
    """
    found = tag_copies(links, tags, ids, parts).withColumnRenamed("image_id", "id")
    joined = images.join(found, "id", "left" if ids is None else "inner")
    return joined.withColumn("copies", F.coalesce("copies", F.lit(0).cast("bigint")))


def tags_masked_outside_range(
    images: DataFrame,
    links: DataFrame,
    tags: DataFrame,
    in_range: Column,
    ids: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """As :func:`images_with_tags`, but images outside the range stay without tags.

    With ``ids`` (image_id) only for those images.
    """
    if ids is not None:
        images = images.join(ids.withColumnRenamed("image_id", "id"), "id", "left_semi")
    found = tag_copies(links, tags, ids, parts)
    joined = images.join(found, (F.col("id") == F.col("image_id")) & in_range, "left")
    return joined.drop("image_id").withColumn("copies", F.coalesce("copies", F.lit(0).cast("bigint")))


def matching_tags(tags: DataFrame, names: Iterable[str], kind: str | None = "animal") -> DataFrame:
    """(tag_id, tag_name) of the tags with one of the names."""
    chosen = tag_fields(tags).filter(F.col("tag_name").isin(list(names)))
    if kind is not None:
        chosen = chosen.filter(F.col("tag_type") == kind)
    return chosen.select("tag_id", "tag_name")


def ids_having_all_tags(links: DataFrame, tags: DataFrame, names: str | Iterable[str]) -> DataFrame:
    """``id`` of every image that has animal tags of all the names.

    Names are trimmed, lowercased and de-duplicated. Each name is one bit of an aggregate
    that combines on the map side; further columns take 62 names each.
    """
    wanted = parse_tag_names(names)
    found = links.join(matching_tags(tags, wanted), "tag_id")
    runs = [wanted[first : first + NAMES_PER_COLUMN] for first in range(0, max(1, len(wanted)), NAMES_PER_COLUMN)]
    masks = []
    for run in runs:
        bit = F.lit(0).cast("bigint")
        for place, name in enumerate(run):
            bit = F.when(F.col("tag_name") == name, F.lit(1 << place)).otherwise(bit)
        masks.append(bit.cast("bigint"))
    bits = [f"bits{k}" for k in range(len(runs))]
    kept = (
        found.select("image_id", *[mask.alias(name) for mask, name in zip(masks, bits)])
        .groupBy("image_id")
        .agg(*[F.bit_or(name).alias(name) for name in bits])
    )
    complete = [F.col(name) == (1 << len(run)) - 1 for name, run in zip(bits, runs)]
    return kept.filter(reduce(and_, complete)).select(F.col("image_id").alias("id"))


def images_having_all_tags(
    images: DataFrame, links: DataFrame, tags: DataFrame, names: str | Iterable[str]
) -> DataFrame:
    """Images that have all of the named animals."""
    return images.join(ids_having_all_tags(links, tags, names), "id", "left_semi")


def _tag_keys(tags: DataFrame) -> DataFrame:
    """(tag_id, tag_key): equal texts share the smallest tag id, which stands for the long text."""
    keys = tags.groupBy("name").agg(F.min("tag_id").alias("tag_key"))
    return tags.select("tag_id", "name").join(keys, "name").select("tag_id", "tag_key")


def _images_per_key(links: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct images per tag text. Duplicates go before the shuffle, which is by key and image."""
    keyed = links.join(_tag_keys(tags), "tag_id")
    return keyed.groupBy("tag_key").agg(F.countDistinct("image_id").alias("image_count"))


def tag_image_counts(links: DataFrame, tags: DataFrame) -> DataFrame:
    """Number of images per tag text (name, image_count)."""
    names = tags.select(F.col("tag_id").alias("tag_key"), "name")
    return _images_per_key(links, tags).join(names, "tag_key").select("name", "image_count")


def available_tags(links: DataFrame, tags: DataFrame) -> DataFrame:
    """Animals by number of images, most frequent first.

    Images are counted per tag text, so an image with both "2 deer" and "3 deer" counts twice.
    """
    animals = tag_fields(tags).filter(F.col("tag_type") == "animal")
    names = animals.select(F.col("tag_id").alias("tag_key"), F.col("tag_name").alias("animal_name"))
    return (
        _images_per_key(links, animals)
        .join(names, "tag_key")
        .groupBy("animal_name")
        .agg(F.sum("image_count").alias("total_count"))
        .orderBy(F.col("total_count").desc(), F.col("animal_name").asc_nulls_last())
    )


def untagged_images(images: DataFrame, links: DataFrame) -> DataFrame:
    """Images without links. Repeats of an image go before the shuffle."""
    tagged = links.select(F.col("image_id").alias("id")).distinct()
    return images.join(tagged, "id", "left_anti")


def newest_untagged(images: DataFrame, links: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, cdn_url) of the untagged images: all of them, or the ``limit`` created last, in order."""
    waiting = untagged_images(images, links)
    if limit is None:
        return waiting.select("id", "cdn_url")
    order = [F.col("created_at").desc_nulls_first(), F.col("id")]
    return waiting.orderBy(*order).limit(limit).select("id", "cdn_url")


def count_untagged(images: DataFrame, links: DataFrame) -> DataFrame:
    return untagged_images(images.select("id"), links).agg(F.count("*").alias("count"))


def tagging_progress(untagged: DataFrame, batch: DataFrame) -> DataFrame:
    """One row (found, processed, remaining) after a batch with an ``ok`` column was worked on.

    ``untagged`` is the one-row count from before the batch.
    """
    done = batch.agg(F.count("*").alias("found"), F.count_if("ok").alias("processed"))
    return done.withColumn("remaining", untagged.select("count").scalar() - F.col("processed"))
