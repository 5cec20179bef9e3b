"""Row filters."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailtally.functions.params import parse_tag_names
from trailtally.functions.tags import json_field
from trailtally.functions.times import moment

def where_all(df: DataFrame, predicates: Iterable[Column | None]) -> DataFrame:
    """Rows meeting every given predicate; all rows when there is none."""
    given = [p for p in predicates if p is not None]
    return df.filter(reduce(and_, given)) if given else df


def time_predicates(
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    before: datetime | str | None = None,
    column: str = "capture_time",
) -> list[Column]:
    """Conditions for a time from ``start`` to ``end``, both included, and earlier than ``before``.

    They are plain comparisons with literals, which reach the file scan.
    """
    time = F.col(column)
    predicates = [time >= moment(start)] if start else []
    predicates += [time <= moment(end)] if end else []
    return predicates + ([time < moment(before)] if before else [])


def filter_times(
    df: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    before: datetime | str | None = None,
    column: str = "capture_time",
) -> DataFrame:
    """Rows meeting :func:`time_predicates`.

    Where the files are split by ``capture_date``, its bounds are added, so other dates' files
    are not listed at all.
    """
    predicates = time_predicates(start, end, before, column)
    if column == "capture_time" and "capture_date" in df.columns:
        date = F.col("capture_date")
        predicates += [date >= F.to_date(moment(start))] if start else []
        predicates += [date <= F.to_date(moment(last)) for last in (end, before) if last]
    return where_all(df, predicates)


def filter_date_range(
    df: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    column: str = "capture_time",
) -> DataFrame:
    """Rows within the inclusive range. An end date without a time means its midnight."""
    return filter_times(df, start, end, column=column)


def location_predicate(location: str | None) -> Column | None:
    if not location:
        return None
    return (F.col("primary_location") == location) | (F.col("secondary_location") == location)


def filter_location(df: DataFrame, location: str | None) -> DataFrame:
    return where_all(df, [location_predicate(location)])


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def filter_ids(df: DataFrame, ids: Iterable[int], column: str = "id") -> DataFrame:
    """Rows whose ``column`` is in the list, which is part of the plan."""
    return df.filter(F.col(column).isin(list(dict.fromkeys(ids))))


def filter_id_table(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose ``column`` is in the column ``id`` of a table of any size."""
    wanted = ids.select(F.col("id").alias(column))
    return df.join(wanted, column, "left_semi").select(df.columns)


def filter_tag_type(tags: DataFrame, kind: str = "animal", strict: bool = False) -> DataFrame:
    return tags.filter(json_field(F.col("name"), "type", strict) == kind)


def filter_tag_names(tags: DataFrame, names: str | Iterable[str]) -> DataFrame:
    """Tags with one of the names; only the request is trimmed and lowercased."""
    return tags.filter(json_field(F.col("name"), "name").isin(parse_tag_names(names)))
