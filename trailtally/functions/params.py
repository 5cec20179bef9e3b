"""Request parameters, checked before a plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a caller may ask for.
SORT_COLUMNS = ("capture_time", "created_at", "temperature", "primary_location")
PAGE_SORT_COLUMNS = ("capture_time", "temperature", "created_at")
INTERVALS = ("hour", "day", "week")


def safe_sort(
    sort_by: str | None, sort_order: str | None, allowed: Iterable[str] = SORT_COLUMNS
) -> tuple[str, bool]:
    """(column, descending): unknown columns become ``capture_time``, unknown orders descending."""
    column = sort_by if sort_by in tuple(allowed) else "capture_time"
    return column, (sort_order or "desc").lower() != "asc"


def safe_interval(interval: str | None) -> str:
    return interval if interval in INTERVALS else "hour"


def parse_ids(text: str) -> list[int]:
    """Comma-separated ids; anything else is an error."""
    try:
        return [int(part.strip()) for part in text.split(",")]
    except ValueError as error:
        raise ValueError("Invalid ID format") from error


def parse_ids_column(text: Column) -> Column:
    """Comma-separated ids of a column as an array; anything else is an error when it is read."""

    def number(part: Column) -> Column:
        found = F.trim(part).try_cast("bigint")
        return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit("Invalid ID format")).cast("bigint"))

    return F.transform(F.split(text, ","), number)


def parse_tag_names(names: str | Iterable[str]) -> list[str]:
    """Trimmed lower-case names in order of appearance, without blanks and repeats."""
    parts = names.split(",") if isinstance(names, str) else names
    return list(dict.fromkeys(part.strip().lower() for part in parts if part.strip()))
