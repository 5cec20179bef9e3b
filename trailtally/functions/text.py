"""Text parsing: readings, URLs, file names, model answers."""

from __future__ import annotations

from mimetypes import MimeTypes

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_MIME_TYPE = "application/octet-stream"

# The characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_ws(text: Column) -> Column:
    """Drop white space, line breaks included, at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def squash_ws(text: Column) -> Column:
    """Turn each run of white space into one blank and trim."""
    return F.trim(F.regexp_replace(text, f"[{WHITE_SPACE}]+", " "))


# A number in digits, with sign and exponent if any, and what may stand around it.
_GAP = f"[{WHITE_SPACE}]"
_INK = f"[^{WHITE_SPACE}]"
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_TEMPERATURE = rf"^{_GAP}*({_NUMBER}){_GAP}*°([^°]*)"
_WIND = rf"^{_GAP}*({_INK}+){_GAP}+({_NUMBER})(?:{_GAP}+([\s\S]*))?$"
_PRESSURE = rf"^{_GAP}*({_NUMBER}){_GAP}+({_INK}+)"


def _number(text: Column, pattern: str, group: int) -> Column:
    """The number in a group, NULL when the text does not fit; each use matches the text once."""
    return F.regexp_extract(text, pattern, group).try_cast("double")


def temperature_fields(text: Column) -> tuple[Column, Column]:
    """Value and unit of ``72°F``; the value is NULL when the text has no number or no degree sign."""
    return _number(text, _TEMPERATURE, 1), strip_ws(F.regexp_extract(text, _TEMPERATURE, 2))


def wind_fields(text: Column) -> tuple[Column, Column, Column]:
    """Speed, unit and direction of ``NW 5.2 mph``; the unit is whatever follows the speed."""
    unit = squash_ws(F.regexp_extract(text, _WIND, 3))
    return _number(text, _WIND, 2), unit, F.regexp_extract(text, _WIND, 1)


def pressure_fields(text: Column) -> tuple[Column, Column]:
    """Value and unit of ``30.1 inHg``; the value is NULL when either is missing."""
    return _number(text, _PRESSURE, 1), F.regexp_extract(text, _PRESSURE, 2)


def parse_temperature(text: Column) -> Column:
    """``72°F`` as (value, unit); NULL when the text has no number or no degree sign."""
    value, unit = temperature_fields(text)
    return F.when(value.isNotNull(), F.struct(value.alias("value"), unit.alias("unit")))


def parse_wind(text: Column) -> Column:
    """``NW 5.2 mph`` as (direction, speed, unit); the unit is whatever follows the speed."""
    speed, unit, direction = wind_fields(text)
    return F.when(speed.isNotNull(), F.struct(direction.alias("direction"), speed.alias("speed"), unit.alias("unit")))


def parse_pressure(text: Column) -> Column:
    """``30.1 inHg`` as (value, unit); NULL when either is missing."""
    value, unit = pressure_fields(text)
    return F.when(value.isNotNull(), F.struct(value.alias("value"), unit.alias("unit")))


def moon_text(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def reading_kind(label: Column) -> Column:
    """Which reading a label announces; the first word found decides."""
    # The words and their order.
    name = F.upper(label)
    return (
        F.when(name.contains("TEMP"), "temperature")
        .when(name.contains("WIND"), "wind")
        .when(name.contains("PRESSURE"), "pressure")
        .when(name.contains("SUN"), "sun")
        .when(name.contains("MOON"), "moon")
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def source_id_from_url(url: Column) -> Column:
    """Last path segment without the query, up to its first dot."""
    return F.split_part(base_name(F.split_part(url, F.lit("?"), F.lit(1))), F.lit("."), F.lit(1))


def file_extension(path: Column) -> Column:
    """Extension with its dot, or empty; a leading dot starts a name, not an extension."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def mime_type(path: Column) -> Column:
    """Content type by extension, from the standard table of types."""
    extension = F.lower(file_extension(path))
    types = MimeTypes(filenames=()).types_map[True]
    known = F.str_to_map(F.lit(",".join(f"{end}:{kind}" for end, kind in types.items())), F.lit(","), F.lit(":"))
    return F.coalesce(F.try_element_at(known, extension), F.lit(DEFAULT_MIME_TYPE))


def file_hash(content: Column) -> Column:
    """MD5 of the content, 32 hex digits."""
    return F.md5(content)


def publish_url(base: str, source_id: Column, content_hash: Column, path: Column) -> Column:
    """Public address of a stored picture.

    The content hash makes the name unique, so a repeated upload lands on the same address.
    """
    return F.concat(
        F.lit(f"{base}/images/"), source_id, F.lit("_"), content_hash, file_extension(path)
    )


def is_log(path: Column, prefix: str) -> Column:
    """Whether a file is a log whose name starts with ``prefix``."""
    name = base_name(path)
    return name.startswith(prefix) & name.endswith(".log")


def file_kind(path: Column, log_prefix: str) -> Column:
    """``schema`` or ``data`` for a snapshot file, ``log`` for a log of that prefix, else NULL."""
    name = base_name(path)
    return (
        F.when(name.rlike(r"_schema_.*\.gz$"), "schema")
        .when(name.rlike(r"_data_.*\.gz$"), "data")
        .when(is_log(path, log_prefix), "log")
    )


def normalise_animal(name: Column) -> Column:
    """Lower case without any ``s`` at the end."""
    return F.rtrim(F.lower(name), F.lit("s"))


def capitalize_first(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def strip_fence(text: Column) -> Column:
    """Body of a fenced code block; the last three characters go with the opening fence."""
    body = strip_ws(text)
    size = F.length(body)
    return strip_ws(
        F.when(F.startswith(body, F.lit("```json")), F.substr(body, F.lit(8), F.greatest(size - 10, F.lit(0))))
        .when(F.startswith(body, F.lit("```")), F.substr(body, F.lit(4), F.greatest(size - 6, F.lit(0))))
        .otherwise(body)
    )
