"""Integrity checks that files do not enforce; each returns the violations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailtally import schema


def duplicate_keys(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Values of the key columns held by more than one row, with their ``count``."""
    return df.groupBy(*columns).count().filter(F.col("count") > 1)


def _per_column(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """(column, violations) for every column whose test is true somewhere, in one pass."""
    counts = df.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
    rows = F.array(*[
        F.struct(F.lit(name).alias("column"), F.col(name).alias("violations")) for name in tests
    ])
    return counts.select(F.inline(rows)).filter(F.col("violations") > 0)


def null_violations(df: DataFrame, columns: Iterable[str] = tuple(schema.REQUIRED_COLUMNS)) -> DataFrame:
    """Number of missing values per required column that has any."""
    return _per_column(df, {c: F.col(c).isNull() for c in columns})


def length_violations(df: DataFrame, limits: Mapping[str, int] = schema.TEXT_LIMITS) -> DataFrame:
    """Number of texts over the limit per column that has any."""
    return _per_column(df, {c: F.char_length(c) > n for c, n in limits.items()})


def orphan_links(images: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """Links without their image or without their tag, and which one is ``missing``."""
    no_image = links.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti")
    no_tag = links.join(tags.select("tag_id"), "tag_id", "left_anti")
    return no_image.select("image_id", "tag_id", F.lit("image").alias("missing")).unionByName(
        no_tag.select("image_id", "tag_id", F.lit("tag").alias("missing"))
    )


def orphan_tags(links: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags no link refers to."""
    return tags.join(links.select("tag_id").distinct(), "tag_id", "left_anti")
