"""Changes to the tables, as functions from the old rows to the new ones."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailtally.functions.tags import json_field
from trailtally.functions.times import moment
from trailtally.operators.answers import tag_counts_from_analysis
from trailtally.operators.ranges import numbered_rows
from trailtally.operators.tagging import join_dealt, tag_rows
from trailtally.session import pin


class TagRemoval(NamedTuple):
    kept: DataFrame
    removed: DataFrame
    remaining: DataFrame


def remove_tag(links: DataFrame, tags: DataFrame, image_id: int, name: str) -> TagRemoval:
    """Take a tag name, of whatever type, off one image.

    ``kept`` and ``removed`` split the links; ``remaining`` holds the image's other tag texts.
    Links of other images pass through a plain scan and never enter a join.
    """
    named = tags.filter(json_field(F.col("name"), "name") == name.lower()).select("tag_id")
    own = links.filter(F.col("image_id") == image_id)
    left = own.join(named, "tag_id", "left_anti").select("image_id", "tag_id")
    removed = own.join(named, "tag_id", "left_semi").select("image_id", "tag_id")
    others = links.filter(~F.col("image_id").eqNullSafe(image_id)).select("image_id", "tag_id")
    return TagRemoval(others.unionByName(left), removed, tag_rows(left, tags).select("tag_id", "name"))


def replace_tags(links: DataFrame, new_links: DataFrame) -> DataFrame:
    """Links after all links of the images in ``new_links`` were replaced by the new ones."""
    replaced = new_links.select("image_id").distinct()
    return links.join(replaced, "image_id", "left_anti").select("image_id", "tag_id").unionByName(new_links)


def missing_tags(names: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct tag texts that no tag has yet."""
    known = tags.select("name").distinct()
    return names.select("name").distinct().join(known, "name", "left_anti")


def _added_tags(names: DataFrame, tags: DataFrame) -> DataFrame:
    """The missing tags with ids that follow the highest old one without gaps; found and numbered once."""
    highest = tags.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("highest")).scalar()
    numbered = numbered_rows(missing_tags(names, tags), "_number")
    return numbered.select((highest + F.col("_number")).alias("tag_id"), "name")


def upsert_tags(names: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags with those of ``names`` added that were missing. New ids have no gaps."""
    return tags.select("tag_id", "name").unionByName(_added_tags(names, tags))


class Tagging(NamedTuple):
    tags: DataFrame
    links: DataFrame


def tag_answers(answers: DataFrame, links: DataFrame, tags: DataFrame) -> Tagging:
    """Tables after the answers' tags replaced the old tags of their images.

    Images whose answer gives no tags keep what they have. Answers are parsed once: the texts found
    are pinned, and so are the new tags, so links always refer to the ids that are stored. Old
    tags are looked up for the answers' texts only.
    """
    return link_tags(pin(tag_counts_from_analysis(answers).select("image_id", F.col("tag_json").alias("name"))), links, tags)


def link_tags(found: DataFrame, links: DataFrame, tags: DataFrame) -> Tagging:
    """Tables after the tag texts ``found`` (image_id, name) replaced the tags of their images.

    Answers may hold few texts, so a text's images are dealt to several tasks.
    """
    names = found.select("name").distinct()
    added = _added_tags(names, tags)
    known = tags.join(names, "name", "left_semi").groupBy("name").agg(F.min("tag_id").alias("tag_id"))
    ids = known.select("tag_id", "name").unionByName(added)
    new_links = join_dealt(found, ids, "name", "image_id").select("image_id", "tag_id")
    return Tagging(tags.select("tag_id", "name").unionByName(added), replace_tags(links, new_links))


def clear_tags(links: DataFrame, tags: DataFrame) -> Tagging:
    """Both tables without rows."""
    return Tagging(tags.limit(0), links.limit(0))


def retag_all(answers: DataFrame, links: DataFrame, tags: DataFrame) -> Tagging:
    """Tables rebuilt from answers for every image."""
    empty = clear_tags(links, tags)
    return tag_answers(answers, empty.links, empty.tags)


def update_images(
    images: DataFrame, changes: DataFrame, now: datetime | str, order: str | None = None
) -> DataFrame:
    """Images with the rows of ``changes`` put in by id; only those get a new ``updated_at``.

    Of several changes of one id the one with the highest ``order`` counts; without an order
    they are an error. Images are read and shuffled once.
    """
    fields = F.struct(*[c for c in images.columns if c != "id"]).alias("_new")
    per_id = Window.partitionBy("id")
    if order is None:
        several = F.raise_error(F.lit("several changes of one image and no order")).cast("boolean")
        one = F.when(F.count("*").over(per_id) == 1, F.lit(True)).otherwise(several)
    else:
        one = F.row_number().over(per_id.orderBy(F.col(order).desc_nulls_last())) == 1
    latest = changes.withColumn("_one", one).filter("_one").select("id", fields)
    joined = images.join(latest, "id", "left")
    changed = F.col("_new").isNotNull()

    def value(name: str) -> Column:
        if name == "id":
            return F.col("id")
        new = moment(now) if name == "updated_at" else F.col("_new")[name]
        return F.when(changed, new).otherwise(F.col(name)).alias(name)

    return joined.select(*[value(name) for name in images.columns])
