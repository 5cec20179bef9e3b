"""Tagging runs: choose images, score them, and put their tags into the tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailtally.operators.answers import tag_counts_from_analysis
from trailtally.operators.ingest import next_tagging_batch
from trailtally.operators.mutate import Tagging, link_tags, retag_all
from trailtally.operators.scoring import score_images
from trailtally.operators.tagging import count_untagged, tagging_progress
from trailtally.session import pin


@dataclass(frozen=True)
class TaggingRun:
    """One run: its answers' tags (image_id, name), pinned, and the tables they change."""

    found: DataFrame
    done: DataFrame
    images: DataFrame
    links: DataFrame
    tags: DataFrame

    @cached_property
    def tables(self) -> Tagging:
        """Tables after the run; new tags are numbered when this is first asked for."""
        return link_tags(self.found, self.links, self.tags)

    @cached_property
    def progress(self) -> DataFrame:
        """One row: images found, images that got tags, and untagged images left."""
        return tagging_progress(count_untagged(self.images, self.links), self.done)


def tag_next_batch(
    images: DataFrame,
    links: DataFrame,
    tags: DataFrame,
    predict: Callable[[object], str],
    load: Callable[[object], object] | None = None,
    new_ids: DataFrame | None = None,
    limit: int | None = None,
    partitions: int | None = None,
) -> TaggingRun:
    """Tag the new captures (source_id), or without any all untagged images.

    With ``limit`` only the untagged images created last. Returns the changed tables, and one
    row of progress: images found, images that got tags, and untagged images left if the batch
    came from them. Answers are pinned, since asking the model twice may give two answers, and
    so are the tags they hold, since they are parsed once.
    """
    batch = next_tagging_batch(new_ids, images, links, limit)
    answers = pin(score_images(batch, predict, load, partitions=partitions)).select("image_id", "answer")
    found = pin(tag_counts_from_analysis(answers).select("image_id", F.col("tag_json").alias("name")))
    tagged = found.select("image_id").distinct().withColumn("tagged", F.lit(True))
    done = answers.select("image_id").join(tagged, "image_id", "left").select(
        "image_id", F.coalesce("tagged", F.lit(False)).alias("ok")
    )
    return TaggingRun(found, done, images, links, tags)


def retag_images(
    images: DataFrame,
    links: DataFrame,
    tags: DataFrame,
    predict: Callable[[object], str],
    load: Callable[[object], object] | None = None,
    partitions: int | None = None,
) -> Tagging:
    """Drop all tags and tag every image anew."""
    answers = pin(score_images(images.select("id", "cdn_url"), predict, load, partitions=partitions))
    return retag_all(answers.select("image_id", "answer"), links, tags)
