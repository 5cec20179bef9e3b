"""Tag JSON: reading, writing, and the model's answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailtally import schema
from trailtally.functions.text import strip_fence

# Names of the JSON number types.
WHOLE_TYPES = ("BIGINT", "BOOLEAN")
FRACTION_TYPES = ("DOUBLE", "FLOAT")


def json_field(text: Column, name: str, strict: bool = False) -> Column:
    """Text of one JSON field. Malformed JSON gives NULL, or an error when ``strict``."""
    if strict:
        return F.variant_get(F.parse_json(text), f"$.{name}", "string")
    return F.get_json_object(text, f"$.{name}")


def parse_tag(tag: Column) -> Column:
    """A tag text as (type, name, count, display)."""
    return F.from_json(tag, schema.TAG_JSON)


def _unicode_escape(char: Column) -> Column:
    """One character as ``\\uXXXX``, beyond 16 bits as a pair of them."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    code = F.ascii(char).cast("bigint")
    over = code - 0x10000
    high, low = F.floor(over / 1024) + 0xD800, over % 1024 + 0xDC00
    return F.when(code < 0x7F, char).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))


def _quote(text: Column) -> Column:
    """JSON string in ASCII; only texts that need escapes go the long way."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    escaped = F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)
    quoted = F.when(text.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    ascii_only = F.array_join(F.transform(F.split(quoted, ""), _unicode_escape), "")
    return F.when(text.isNull(), "null").when(text.rlike(r"[^\x00-\x7e]"), ascii_only).otherwise(quoted)


def tag_json(kind: Column, name: Column, count: Column, display: Column) -> Column:
    """Canonical text of a tag; this text is the tag's identity.

    ``count`` is the number as it should be printed; NULL becomes ``null``.
    """
    return F.concat(
        F.lit('{"type": '), _quote(kind),
        F.lit(', "name": '), _quote(name),
        F.lit(', "count": '), F.coalesce(count.cast("string"), F.lit("null")),
        F.lit(', "display": '), _quote(display),
        F.lit("}"),
    )


def safe_analysis(answer: Column) -> Column:
    """Model answer as a VARIANT; NULL when it is not JSON."""
    return F.try_parse_json(strip_fence(answer))


def answer_counts(answer: Column) -> Column:
    """Positive numeric counts of an answer as (animal, n, exact), without the total.

    ``exact`` is a whole count in full; it is NULL for a fraction. A count given as text is not a
    number; ``true`` counts as one.
    """
    fields = F.map_entries(F.try_variant_get(safe_analysis(answer), "$", "map<string,variant>"))

    def typed(field: Column) -> Column:
        kind = F.schema_of_variant(field["value"])
        # A whole number beyond 64 bits is a decimal without places.
        whole = kind.isin(*WHOLE_TYPES) | kind.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$")
        number = whole | kind.isin(*FRACTION_TYPES) | kind.startswith("DECIMAL")
        return F.struct(
            field["key"].alias("animal"),
            F.when(number, F.try_variant_get(field["value"], "$", "double")).alias("n"),
            F.when(whole, F.try_variant_get(field["value"], "$", "decimal(38,0)")).alias("exact"),
        )

    return F.filter(F.transform(fields, typed), lambda e: (e["n"] > 0) & (F.lower(e["animal"]) != "total"))


def float_text(n: Column) -> Column:
    """A fraction as JSON has it: plain from 0.0001 up to 1e16, else like ``1e+20``."""
    text = n.cast("string")
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    wide = F.call_function("rpad", digits, F.greatest(power + 1, F.length(digits)), F.lit("0"))
    rest = F.substr(wide, power + 2)
    large = F.concat(F.substr(wide, F.lit(1), power + 1), F.lit("."), F.when(rest == "", "0").otherwise(rest))
    small = F.concat(F.lit("0."), F.call_function("repeat", F.lit("0"), -power - 1), digits)
    sign = F.when(power < 0, "e-").otherwise("e+")
    size = F.abs(power).cast("string")
    size = F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size)
    return (
        F.when(~text.contains("E"), text)
        .when((power >= 0) & (power < 16), large)
        .when((power < 0) & (power >= -4), small)
        .otherwise(F.concat(mantissa, sign, size))
    )


def count_text(n: Column, exact: Column) -> Column:
    """Count as printed in a tag: whole numbers in full, without a decimal point."""
    return F.coalesce(exact.cast("string"), float_text(n))
