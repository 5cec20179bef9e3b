"""Time buckets, labels and date texts, all on zone-free timestamps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailtally.functions.text import squash_ws

# Month names as they appear in date texts.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]


def moment(value: datetime | str | Column) -> Column:
    """A zone-free timestamp from a Python value or column; bad text is an error."""
    column = value if isinstance(value, Column) else F.lit(str(value))
    return column.cast("timestamp_ntz")


def instant(time: Column) -> Column:
    """A zone-free time as the instant that UTC clocks show it, whatever the session's time zone."""
    since = time - F.lit("1970-01-01").cast("timestamp_ntz")
    day, hour, minute = (F.extract(F.lit(part), since).cast("bigint") for part in ("DAY", "HOUR", "MINUTE"))
    micros = (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("bigint")
    return F.timestamp_micros(((day * 24 + hour) * 60 + minute) * 60_000_000 + micros)


def from_instant(time: Column) -> Column:
    """What a UTC clock shows at an instant, zone-free."""
    seconds = (F.unix_micros(time) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def bucket_time(time: Column, unit: str) -> Column:
    """Start of the hour, day or Monday-based week."""
    day = F.to_date(time)
    if unit == "week":
        return F.trunc(day, "week").cast("timestamp_ntz")
    if unit == "day":
        return day.cast("timestamp_ntz")
    if unit == "hour":
        return day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(time))
    raise ValueError(f"unknown bucket unit: {unit}")


def start_of_minute(time: Column) -> Column:
    """The minute that date texts show."""
    clock = F.make_dt_interval(hours=F.hour(time), mins=F.minute(time))
    return F.to_date(time).cast("timestamp_ntz") + clock


def iso_seconds(time: Column) -> Column:
    """``2024-01-03T14:05:00``."""
    return F.replace(F.substring(time.cast("string"), 1, 19), F.lit(" "), F.lit("T"))


def iso_text(time: Column) -> Column:
    """As :func:`iso_seconds`, with six fraction digits when the fraction is not zero."""
    fraction = F.split_part(time.cast("string"), F.lit("."), F.lit(2))
    return F.concat(
        iso_seconds(time),
        F.when(fraction != "", F.concat(F.lit("."), F.rpad(fraction, 6, "0"))).otherwise(""),
    )


def _two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def _month_day(time: Column) -> Column:
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(time))
    return F.concat(month, F.lit(" "), _two_digits(F.dayofmonth(time)))


def _clock(time: Column) -> Column:
    hour = F.hour(time)
    return F.concat(
        _two_digits((hour + 11) % 12 + 1),
        F.lit(":"),
        _two_digits(F.minute(time)),
        F.when(hour < 12, " AM").otherwise(" PM"),
    )


def capture_label(time: Column) -> Column:
    """``January 03, 02:05 PM``."""
    return F.concat(_month_day(time), F.lit(", "), _clock(time))


def capture_label_year(time: Column) -> Column:
    """``January 03, 2024 02:05 PM``."""
    year = F.lpad(F.year(time).cast("string"), 4, "0")
    return F.concat(_month_day(time), F.lit(", "), year, F.lit(" "), _clock(time))


def _read_time(text: Column, pattern: str) -> Column:
    """Zone-free time of a text, NULL when it does not fit the pattern.

    The text is read as UTC and counted from the epoch, so no session time zone takes part.
    """
    instant = F.try_to_timestamp(F.concat(text, F.lit(" Z")), F.lit(f"{pattern} X"))
    seconds = F.unix_seconds(instant).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def infer_capture_time(text: Column, now: datetime | str | Column) -> Column:
    """Time of a text without a year, such as ``January 03, 02:05 PM``.

    The year is that of ``now``, or the one before if the result would lie after ``now``.
    Unreadable text gives ``now``. February 29 is accepted when the inferred year has one.
    """
    present = moment(now)
    words = squash_ws(text)

    def in_year(year: Column) -> Column:
        return _read_time(F.concat_ws(" ", year, words), "yyyy MMMM d, h:mm a")

    this_year = in_year(F.year(present))
    last_year = in_year(F.year(present) - 1)
    return F.coalesce(F.when(this_year > present, last_year).otherwise(this_year), present)


def parse_capture_time(text: Column, now: datetime | str | Column) -> Column:
    """Time of a text with a year, such as ``January 03, 2024 02:05 PM``; else ``now``."""
    return F.coalesce(_read_time(squash_ws(text), "MMMM d, yyyy h:mm a"), moment(now))
