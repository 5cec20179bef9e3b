"""Presentation columns: rounded readings, labels, metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailtally import schema


def truthy(column: Column, text: bool = False) -> Column:
    """Whether a value is shown: not NULL and not zero, or for text not empty."""
    return column.isNotNull() & ((column != "") if text else (column != 0))


def round1(x: Column) -> Column:
    """Round to one decimal by the exact binary value, halves to even.

    ``10 x`` is split into a rounded sum and its exact error, so 0.15, which is stored
    slightly below, goes down to 0.1, and 2.25, which is a true half, to 2.2.
    """
    eight, two = x * 8, x * 2
    total = eight + two
    shift = total - eight
    error = (eight - (total - shift)) + (two - shift)
    low = F.floor(total)
    part = total - low
    step = (
        F.when(part > 0.5, 1)
        .when(part < 0.5, 0)
        .when(error > 0, 1)
        .when(error < 0, 0)
        .otherwise(F.abs(low % 2))
    )
    return F.when(F.abs(x) >= 1e15, x).otherwise((low + step).cast("double") / 10)


def round1_or_null(x: Column) -> Column:
    """Rounded reading; zero is shown as missing."""
    return F.when(x != 0, round1(x))


def metadata_fields(raw: Column) -> Column:
    """Parsed raw metadata."""
    return F.from_json(raw, schema.METADATA_JSON)


def place_label(primary: Column, secondary: Column) -> Column:
    return F.concat(
        F.coalesce(primary, F.lit("")),
        F.when(truthy(secondary, text=True), F.concat(F.lit(" - "), secondary)).otherwise(""),
    )


def temperature_label(value: Column, unit: Column) -> Column:
    return F.when(truthy(value), F.concat(value.cast("string"), F.lit("°"), F.coalesce(unit, F.lit(""))))


def wind_label(direction: Column, speed: Column, unit: Column) -> Column:
    return F.when(truthy(speed), F.concat_ws(" ", direction, speed.cast("string"), unit))


def pressure_label(pressure: Column) -> Column:
    return F.when(
        pressure.isNotNull(), F.concat_ws(" ", pressure["value"].cast("string"), pressure["unit"])
    )
