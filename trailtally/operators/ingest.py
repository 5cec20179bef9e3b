"""Incremental ingest: readings to columns, duplicates, and which captures a run takes.

A sequence has the columns ``pos`` (unique, in the order of looking at the rows), ``source_id``
and ``file_hash``, and whatever else describes a capture. Where positions are counted, in
batches, ``pos`` is a number from 0.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailtally import schema
from trailtally.functions.text import moon_text, pressure_fields, reading_kind, temperature_fields, wind_fields
from trailtally.functions.times import capture_label_year, infer_capture_time, moment, start_of_minute
from trailtally.operators.filters import filter_ids
from trailtally.operators.ranges import numbered_rows
from trailtally.operators.tagging import newest_untagged
from trailtally.session import pin

# Texts stored for a reading or place that is missing.
DEFAULTS = {
    "primary_location": "",
    "secondary_location": "",
    "temperature_unit": "F",
    "wind_direction": "",
    "wind_unit": "mph",
}

# Beyond every position.
END = (1 << 63) - 1

# A repeated source id is passed over whether or not its first row was kept, so it comes first.
CAPTURE_KEYS = ("source_id", "file_hash")


def _parsed(readings: DataFrame) -> DataFrame:
    """(source_id, pos, kind, number, unit, word): what each text says, NULL where it is unreadable.

    The fields come out of a generator, so that each text is parsed once however often they are used.
    """
    kind, value = reading_kind(F.col("label")), F.col("value")
    parsers = {"temperature": temperature_fields(value), "wind": wind_fields(value), "pressure": pressure_fields(value)}

    def field(place: int) -> Column:
        chosen = [(name, fields[place]) for name, fields in parsers.items() if place < len(fields)]
        return reduce(lambda when, pair: when.when(F.col("kind") == pair[0], pair[1]), chosen, F)

    word = field(2).when(F.col("kind").isin("sun", "moon"), value)
    fields = F.struct(field(0).alias("number"), field(1).alias("unit"), word.alias("word"))
    kinds = readings.select("source_id", "pos", kind.alias("kind"), "value")
    return kinds.select("source_id", "pos", "kind", F.inline(F.array(fields)))


def pivot_readings(readings: DataFrame) -> DataFrame:
    """One row per capture from labelled texts (source_id, pos, label, value).

    Each text is parsed once, on its own, and the last readable one of a kind counts; of equal
    positions the smallest. Missing readings are NULL. Readings are read once, and a capture's
    combine before the one shuffle.
    """
    fields = F.struct(-F.col("pos"), "number", "unit", "word")

    def last(kind: str) -> Column:
        readable = F.col("number").isNotNull() if kind in ("temperature", "wind", "pressure") else F.col("word").isNotNull()
        return F.min(F.when((F.col("kind") == kind) & readable, fields)).alias(kind)

    kinds = ("temperature", "wind", "pressure", "sun", "moon")
    found = _parsed(readings).groupBy("source_id").agg(*[last(kind) for kind in kinds])
    pressure = F.struct(F.col("pressure.number").alias("value"), F.col("pressure.unit").alias("unit"))
    return found.select(
        "source_id",
        F.col("temperature.number").alias("temperature"),
        F.col("temperature.unit").alias("temperature_unit"),
        F.col("wind.number").alias("wind_speed"),
        F.col("wind.word").alias("wind_direction"),
        F.col("wind.unit").alias("wind_unit"),
        F.when(F.col("pressure").isNotNull(), pressure).alias("pressure"),
        F.col("sun.word").alias("sun_status"),
        moon_text(F.col("moon.word")).alias("moon_phase"),
    )


def with_defaults(captures: DataFrame) -> DataFrame:
    """Missing texts replaced by the stored defaults; missing numbers stay NULL."""
    return captures.fillna({c: text for c, text in DEFAULTS.items() if c in captures.columns})


def captures_from_readings(shots: DataFrame, readings: DataFrame, now: datetime | str) -> DataFrame:
    """Rows for the image table, without ids, from scraped texts.

    ``shots`` has pos, source_id, file_hash, cdn_url, taken_text and places (array of labels).
    A place needs both labels. Times have minute precision, as the texts do.
    """
    weather = pivot_readings(readings)
    inferred = F.when(F.col("taken_text").isNotNull(), infer_capture_time(F.col("taken_text"), now))
    # Out of a generator, so that the text is read once for both its uses.
    timed = shots.select("*", F.inline(F.array(F.struct(inferred.alias("_taken")))))
    both = F.size("places") >= 2
    temperature = F.struct(F.col("temperature").alias("value"), F.col("temperature_unit").alias("unit"))
    wind = F.struct(
        F.col("wind_direction").alias("direction"),
        F.col("wind_speed").alias("speed"),
        F.col("wind_unit").alias("unit"),
    )
    joined = (
        timed.join(weather, "source_id", "left")
        .withColumn("timestamp", capture_label_year(F.col("_taken")))
        .withColumn("primary_location", F.when(both, F.get("places", F.lit(0))))
        .withColumn("secondary_location", F.when(both, F.get("places", F.lit(1))))
    )
    metadata = F.struct(
        "timestamp",
        F.when(
            both,
            F.struct(
                F.col("primary_location").alias("primary"), F.col("secondary_location").alias("secondary")
            ),
        ).alias("location"),
        F.when(F.col("temperature").isNotNull(), temperature).alias("temperature"),
        F.when(F.col("wind_speed").isNotNull(), wind).alias("wind"),
        "pressure",
        "sun_status",
        "moon_phase",
    )
    captures = joined.withColumns({
        "raw_metadata": F.to_json(metadata),
        "capture_time": F.coalesce(start_of_minute(F.col("_taken")), moment(now)),
    })
    columns = [c for c in schema.LISTING_COLUMNS if c not in ("id", "created_at")]
    return with_defaults(captures.select("pos", "file_hash", *columns))


def first_by(seq: DataFrame, key: str) -> DataFrame:
    """The first row of each key in sequence order.

    Positions alone are combined by hash before the shuffle; the rows that hold them follow
    by a semi join, since positions are unique.
    """
    first = seq.groupBy(key).agg(F.min("pos").alias("pos"))
    return seq.join(first, [key, "pos"], "left_semi").select(seq.columns)


def dedupe_run(seq: DataFrame) -> DataFrame:
    """The first appearance of each source id."""
    return first_by(seq, "source_id")


class StoredKeys(NamedTuple):
    """Stored images by their keys alone: a table for each key, best one that is bucketed by it."""

    source_id: DataFrame
    file_hash: DataFrame


def _stored_keys(seq: DataFrame, images: DataFrame | StoredKeys, key: str) -> DataFrame:
    """Keys of stored images.

    Of a table of images only those that the sequence has, distinct, no more than its own keys. A
    table of keys is taken as it is, so that its buckets stay in place.
    """
    if isinstance(images, StoredKeys):
        return getattr(images, key)
    return images.select(key).join(seq.select(key), key, "left_semi").distinct()


def new_captures(candidates: DataFrame, images: DataFrame | StoredKeys) -> DataFrame:
    """Candidates stored neither under their hash nor under their source id."""
    fresh = candidates
    for key in CAPTURE_KEYS:
        fresh = fresh.join(_stored_keys(candidates, images, key), key, "left_anti")
    return fresh.select(candidates.columns)


def _accepted_keys(keys: DataFrame, images: DataFrame | StoredKeys) -> DataFrame:
    """The rows (pos, source_id, file_hash) that storing a sequence one by one would keep."""
    kept = keys
    for key in CAPTURE_KEYS:
        first = kept.groupBy(key).agg(F.min("pos").alias("pos")).select(key, "pos")
        kept = kept.join(first, [key, "pos"], "left_semi").join(_stored_keys(keys, images, key), key, "left_anti")
    return kept.select(keys.columns)


def accepted(seq: DataFrame, images: DataFrame | StoredKeys) -> DataFrame:
    """What storing a sequence one by one would keep: unseen, and no copy of a kept row.

    The choice is made on the keys alone; what else a row holds is shuffled once at most.
    """
    kept = _accepted_keys(seq.select("pos", *CAPTURE_KEYS), images)
    if set(seq.columns) == set(kept.columns):
        return kept.select(seq.columns)
    return seq.join(kept.select("pos"), "pos", "left_semi").select(seq.columns)


def _first_repeat(seq: DataFrame, key: str) -> DataFrame:
    """Smallest ``pos`` that is not the first of its key; each task passes on two rows per key."""
    order = Window.partitionBy(key).orderBy("pos")
    ranked = seq.select(key, "pos").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= 2)
    return ranked.agg(F.min(F.when(F.col("nth") == 2, F.col("pos"))).alias("pos"))


def first_duplicate(seq: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One row with the smallest ``pos`` that repeats an earlier row or a stored image."""
    found = [_first_repeat(seq, key) for key in CAPTURE_KEYS]
    if images is not None:
        for key in CAPTURE_KEYS:
            stored = seq.join(_stored_keys(seq, images, key), key, "left_semi")
            found.append(stored.agg(F.min("pos").alias("pos")))
    return reduce(DataFrame.unionByName, found).agg(F.min("pos").alias("pos"))


def take_until_duplicate(seq: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Rows before the first duplicate, or all rows if there is none.

    The bound is one number that reaches the file scan.
    """
    stop = first_duplicate(seq, images).select(F.coalesce("pos", F.lit(END)))
    return seq.filter(F.col("pos") < stop.scalar())


def _attempts(seq: DataFrame, first: int, count: int | None) -> DataFrame:
    """The rows a run looks at: from position ``first`` on, all or ``count`` positions."""
    if count is None:
        return seq.filter(F.col("pos") >= first)
    return seq.filter(F.col("pos").between(first, first + count - 1))


def _at_most(rows: DataFrame, count: int | None) -> DataFrame:
    """All rows, or the first ``count`` in sequence order where the caller sets a bound."""
    return rows if count is None else rows.orderBy("pos").limit(count)


def incremental_batch(
    seq: DataFrame,
    images: DataFrame,
    force: bool = False,
    max_attempts: int | None = None,
    max_records: int | None = None,
) -> DataFrame:
    """Captures one run stores.

    The run ends at the first duplicate, or with ``force`` skips duplicates instead. With
    ``max_attempts`` it looks at the first row and that many more, and with ``max_records`` it
    stores no more than so many.
    """
    tried = _attempts(seq, 0, None if max_attempts is None else max_attempts + 1)
    taken = accepted(tried, images) if force else take_until_duplicate(tried, images)
    return _at_most(taken, max_records)


def backfill_batch(
    seq: DataFrame, images: DataFrame, jump: int, limit: int | None = None, max_attempts: int | None = None
) -> DataFrame:
    """New captures after skipping ``jump + 1`` rows, of all or the next ``max_attempts`` rows.

    With ``limit`` no more than so many.
    """
    return _at_most(accepted(_attempts(seq, jump + 1, max_attempts), images), limit)


def _chosen(seq: DataFrame, images: DataFrame) -> DataFrame:
    """(pos, source_id, file_hash, id) of the rows to store; ids follow the highest stored one.

    Keys are read once and pinned, and so are those that are kept, with their ids.
    """
    keys = pin(seq.select("pos", *CAPTURE_KEYS))
    highest = images.agg(F.coalesce(F.max("id"), F.lit(0)).alias("highest")).scalar()
    numbered = numbered_rows(_accepted_keys(keys, images), "_number")
    return numbered.select("pos", *CAPTURE_KEYS, (highest + F.col("_number")).alias("id"))


def _stamped(rows: DataFrame, now: datetime | str) -> DataFrame:
    """Rows with ids and the missing columns of the image table: defaults and times."""
    stamps = {"created_at": moment(now), "updated_at": moment(now)}
    return with_defaults(rows).withColumns(stamps).select(schema.IMAGES.names)


def ingest_captures(captures: DataFrame, images: DataFrame, now: datetime | str) -> DataFrame:
    """Rows to append to the image table for the captures that are new.

    Ids follow the highest stored one without gaps. The choice and the ids are made on the keys and
    pinned; what else a capture holds is worked out once, when the rows are read.
    """
    ids = _chosen(captures, images).select("pos", "id")
    return _stamped(captures.join(ids, "pos"), now)


def ingest_readings(shots: DataFrame, readings: DataFrame, images: DataFrame, now: datetime | str) -> DataFrame:
    """Rows to append to the image table from scraped texts, as :func:`captures_from_readings` takes them.

    Captures are chosen before any text is parsed, and only their readings are.
    """
    chosen = pin(_chosen(shots, images))
    wanted = readings.join(chosen.select("source_id"), "source_id", "left_semi")
    taken = shots.join(chosen.select("pos"), "pos", "left_semi")
    rows = captures_from_readings(taken, wanted, now).join(chosen.select("pos", "id"), "pos")
    return _stamped(rows, now)


def next_tagging_batch(
    new_ids: DataFrame | None, images: DataFrame, links: DataFrame, limit: int | None = None
) -> DataFrame:
    """(id, cdn_url) to analyse next: the new captures (source_id), else all untagged images.

    Which of the two is decided by the plan, not by a job of its own. ``limit`` keeps the
    newest of the untagged.
    """
    waiting = newest_untagged(images, links, limit)
    if new_ids is None:
        return waiting
    ids = new_ids.select("source_id").distinct()
    chosen = images.join(ids, "source_id", "left_semi").select("id", "cdn_url")
    none_new = ids.agg(F.count("*").alias("n")).scalar() == 0
    return chosen.unionByName(waiting.filter(none_new))


def specific_images(images: DataFrame, ids: list[int]) -> DataFrame:
    """(id, cdn_url) of the listed images."""
    return filter_ids(images, ids).select("id", "cdn_url")
