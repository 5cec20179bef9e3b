"""The given tables seen as images, tags, links, sequences, readings and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailtally import schema
from trailtally.functions.tags import tag_json
from trailtally.functions.times import capture_label

CDN = "https://cdn.example.com"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _picked(choice: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (choice % len(values) + 1).cast("int"))


def event_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images over events, with missing and zero readings mixed in."""
    event_id, user_id = F.col("event_id"), F.col("user_id")
    source_id = F.concat(F.lit("cam"), event_id.cast("string"))
    return table(spark, folder, "events").select(
        event_id.alias("id"),
        source_id.alias("source_id"),
        F.concat(F.lit(f"{CDN}/images/"), source_id, F.lit(".jpg")).alias("cdn_url"),
        F.col("ts").alias("capture_time"),
        F.when(event_id % 23 != 0, F.col("event_type")).alias("primary_location"),
        F.concat(F.lit("zone"), (user_id % 7).cast("string")).alias("secondary_location"),
        F.when(event_id % 17 != 0, F.when(event_id % 19 == 0, 0.0).otherwise(F.col("value"))).alias("temperature"),
        F.when(user_id % 3 == 0, "C").otherwise("F").alias("temperature_unit"),
        F.when(event_id % 13 != 0, F.get_json_object("props", "$.k").cast("double")).alias("wind_speed"),
        _picked(user_id, "N", "E", "S", "W").alias("wind_direction"),
        F.lit("mph").alias("wind_unit"),
        F.col("props").alias("raw_metadata"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        F.md5(source_id.cast("binary")).alias("file_hash"),
    )


def event_images_with_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`event_images`, with pressure, sun and moon in the raw metadata."""
    event_id, user_id = F.col("id"), F.substring("secondary_location", 5, 1).cast("bigint")
    pressure = F.struct(F.col("wind_speed").alias("value"), F.lit("inHg").alias("unit"))
    metadata = F.struct(
        F.when(F.col("wind_speed").isNotNull(), pressure).alias("pressure"),
        _picked(event_id, "Sunny", "Cloudy", "").alias("sun_status"),
        F.when(user_id != 0, F.concat(F.lit("Phase "), user_id.cast("string"))).alias("moon_phase"),
    )
    return event_images(spark, folder).withColumn("raw_metadata", F.to_json(metadata))


def order_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images over orders, for the tag tables below."""
    key = F.col("o_orderkey").cast("string")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("order"), key).alias("source_id"),
        F.concat(F.lit(f"{CDN}/images/order"), key, F.lit(".jpg")).alias("cdn_url"),
        F.col("o_orderdate").alias("capture_time"),
        F.col("o_orderdate").alias("created_at"),
    )


def image_links(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("tag_id")
    )


def _part_tag(kind: Column, name: Column, count: Column) -> Column:
    text = count.cast("string")
    return tag_json(kind, F.lower(name), text, F.concat(name, F.lit(" "), text))


def part_tags(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 10 == 0, "object").otherwise("animal")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("tag_id"), _part_tag(kind, F.col("p_type"), size).alias("name")
    )


def ordered_tag_names(spark: SparkSession, folder: str) -> DataFrame:
    """Tag texts wanted by line items: the part's type with the quantity as count."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    items = table(spark, folder, "lineitem").select("l_partkey", F.col("l_quantity").cast("bigint").alias("count"))
    return items.join(parts, "l_partkey").select("p_type", "count").distinct().select(
        _part_tag(F.lit("animal"), F.col("p_type"), F.col("count")).alias("name")
    )


def document_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """Captures over documents in order of their ids; equal texts are copies.

    The hash is taken first, so texts are never shuffled.
    """
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("pos"),
        F.concat(F.col("source"), F.lit("-"), F.col("n_chars").cast("string")).alias("source_id"),
        F.md5(F.col("text").cast("binary")).alias("file_hash"),
    )


def _stored(spark: SparkSession, folder: str, labels: DataFrame) -> DataFrame:
    ids = labels.select(F.col("doc_id").alias("pos"))
    stored = document_sequence(spark, folder).join(ids, "pos", "left_semi")
    return stored.select(F.col("pos").alias("id"), "source_id", "file_hash")


def labelled_images(spark: SparkSession, folder: str) -> DataFrame:
    """Stored images: the documents that have a label."""
    return _stored(spark, folder, table(spark, folder, "labels"))


def rejected_images(spark: SparkSession, folder: str) -> DataFrame:
    """Stored images: the documents labelled toxic and of low quality."""
    labels = table(spark, folder, "labels")
    return _stored(spark, folder, labels.filter((F.col("toxic") == 1) & (F.col("quality") == 0)))


def document_media(spark: SparkSession, folder: str) -> DataFrame:
    """Picture files over documents: the language chooses the extension, 1000 bytes a character."""
    extension = (
        F.when(F.col("lang") == "en", ".jpg")
        .when(F.col("lang") == "fr", ".PNG")
        .when(F.col("lang") == "de", ".gif")
        .otherwise(".Jpeg")
    )
    return table(spark, folder, "documents").select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), extension).alias("path"),
        (F.col("n_chars") * 1000).alias("length"),
    )


def event_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled texts (source_id, pos, label, value) over events, some of them unreadable."""
    images = event_images(spark, folder)
    temperature = F.when(F.col("temperature") == 0, F.lit("n/a")).otherwise(
        F.concat(F.col("temperature").cast("string"), F.lit("° "), F.col("temperature_unit"))
    )
    wind = F.concat(F.col("wind_direction"), F.lit("  "), F.col("wind_speed").cast("string"), F.lit(" mi per h"))
    pressure = F.concat(F.col("wind_speed").cast("string"), F.lit(" inHg"))
    texts = [
        ("Temp.", temperature),
        ("wind", wind),
        ("Pressure", pressure),
        ("Sun status", F.col("primary_location")),
        ("MOON PHASE", F.concat(F.lit("Phase\n"), F.col("wind_direction"))),
        ("temperature, again", F.when(F.col("wind_direction") == "N", F.lit("1.5°K"))),
        ("battery", F.lit("full")),
    ]
    rows = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(label).alias("label"), value.alias("value"))
        for i, (label, value) in enumerate(texts)
    ])
    return images.select("source_id", F.inline(rows)).filter(F.col("value").isNotNull())


def _shot_keys(event_id: Column) -> tuple[Column, Column]:
    """Source id and hash of a shot; some repeat those of one up to five events before."""
    source = F.when(event_id % 9 == 5, event_id - 5).otherwise(event_id).cast("string")
    key = F.when(event_id % 7 == 3, event_id - 1).otherwise(event_id).cast("string")
    return F.concat(F.lit("cam"), source), F.md5(F.concat(F.lit("hash"), key).cast("binary"))


# Events between which no shot repeats an earlier one.
SHOT_PERIOD = 63


def event_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Captures over events with the keys of their shots, in order of their ids."""
    source_id, file_hash = _shot_keys(F.col("id"))
    images = event_images(spark, folder).withColumns({"source_id": source_id, "file_hash": file_hash})
    return images.withColumn("pos", F.col("id")).drop("id", "created_at", "updated_at")


def event_shots(spark: SparkSession, folder: str) -> DataFrame:
    """Scraped shots over events, in order of their ids; some repeat a hash or a source id."""
    event_id = F.col("event_id")
    source_id, file_hash = _shot_keys(event_id)
    place = F.when(event_id % 23 != 0, F.array(F.col("event_type"), F.concat(F.lit("zone"), (F.col("user_id") % 7).cast("string"))))
    return (
        table(spark, folder, "events")
        .select(
            event_id.alias("pos"),
            source_id.alias("source_id"),
            file_hash.alias("file_hash"),
            F.concat(F.lit(f"{CDN}/images/cam"), event_id.cast("string"), F.lit(".jpg")).alias("cdn_url"),
            place.alias("places"),
            event_id.alias("id"),
        )
        .join(event_date_texts(spark, folder).select("id", F.col("with_gaps").alias("taken_text")), "id")
        .drop("id")
    )


def stored_events(spark: SparkSession, folder: str) -> DataFrame:
    """Stored images: every fourth event, under the hash its shot has."""
    stored = event_images(spark, folder).filter(F.col("id") % 4 == 0)
    return stored.withColumn("file_hash", F.md5(F.concat(F.lit("hash"), F.col("id").cast("string")).cast("binary")))


def event_files(spark: SparkSession, folder: str) -> DataFrame:
    """Log and snapshot files (path, modificationTime) over events."""
    kind = F.element_at(
        F.array(*[F.lit(x) for x in ("cam_sync_%.log", "other_sync_%.log", "db_schema_%.gz", "db_data_%.gz", "cam_sync_%.txt")]),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    path = F.concat(F.lit("/var/"), F.replace(kind, F.lit("%"), F.col("event_id").cast("string")))
    return table(spark, folder, "events").select(path.alias("path"), F.col("ts").cast("timestamp").alias("modificationTime"))


def event_date_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Date texts over events: (id, with_gaps, with_year)."""
    time, year = F.col("ts"), F.year("ts").cast("string")
    label = capture_label(time)
    month_day, clock = (F.split_part(label, F.lit(","), F.lit(i)) for i in (1, 2))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 11 == 0, "junk").otherwise(
            F.concat(F.lit("\n "), F.replace(label, F.lit(" "), F.lit("  ")), F.lit(" "))
        ).alias("with_gaps"),
        F.when(F.col("event_id") % 11 == 0, "junk").otherwise(
            F.concat(month_day, F.lit(", "), year, clock)
        ).alias("with_year"),
    )


def event_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers (image_id, answer) over events: fenced, plain, empty and unreadable ones."""
    event_id = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    user = F.col("user_id")
    body = F.concat(
        F.lit('{"Deer": '), k,
        F.lit(', "Bucks": '), (user % 3).cast("string"),
        F.lit(', "'), F.initcap("event_type"), F.lit('s": '), (user % 5).cast("string"),
        F.lit(', "gray fox": "2", "total": 99}'),
    )
    answer = (
        F.when(event_id % 10 == 0, "no animals here")
        .when(event_id % 10 == 1, "{}")
        .when(event_id % 10 == 2, F.concat(F.lit("```\n"), body, F.lit("\n```\n")))
        .when(event_id % 10 == 3, body)
        .otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    )
    return table(spark, folder, "events").select(event_id.alias("image_id"), answer.alias("answer"))


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """Downloaded files over pages: (page_id, url, path, file_hash)."""
    extension = _picked(F.col("page_id"), ".jpg", ".JPEG", ".png", ".gif", "")
    return table(spark, folder, "pages").select(
        "page_id",
        "url",
        F.concat(F.lit("downloads/"), F.col("page_id").cast("string"), extension).alias("path"),
        F.md5(F.col("html").cast("binary")).alias("file_hash"),
    )


def image_columns_filled(images: DataFrame) -> DataFrame:
    """Images with every listing column, missing ones as NULL."""
    types = {f.name: f.dataType for f in schema.IMAGES.fields}
    return images.select(*[
        F.col(c) if c in images.columns else F.lit(None).cast(types[c]).alias(c) for c in schema.LISTING_COLUMNS
    ])
