"""Operators on hand-made rows."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trailtally import schema
from trailtally.operators import answers, checks, filters, ingest, listing, mutate, scoring, tagging, weather
from trailtally.plans import jobs
from trailtally.sources.seed import seed_images
from trailtally.sources.snapshots import expired_files, keep_latest

BLANK = {
    "cdn_url": "u", "primary_location": "p", "secondary_location": "s", "temperature": None,
    "temperature_unit": None, "wind_speed": None, "wind_direction": None, "wind_unit": None,
    "raw_metadata": None, "updated_at": None, "created_at": None,
}


def images(spark, *rows):
    full = []
    for i, row in enumerate(rows, start=1):
        time = datetime.fromisoformat(row.get("capture_time", "2024-01-01 00:00:00"))
        values = {**BLANK, "id": i, "source_id": f"s{i}", "file_hash": f"h{i}", **row, "capture_time": time}
        full.append(tuple(values[n] for n in schema.IMAGES.names))
    return spark.createDataFrame(full, schema.IMAGES)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def links_of(spark, pairs):
    return spark.createDataFrame(pairs, schema.IMAGE_TAGS)


def tag(name, count, kind="animal"):
    return f'{{"type": "{kind}", "name": "{name}", "count": {count}, "display": "{name.capitalize()} {count}"}}'


TAGS = [(1, tag("deer", 2)), (2, tag("deer", 3)), (3, tag("fox", 1)), (4, tag("feeder", 1, "object"))]


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame(TAGS, schema.TAGS)


# weather


def test_seed_records(spark):
    seed = seed_images(spark)
    assert rows(weather.coldest_day(seed), "day", "avg_temp") == [(datetime(2024, 1, 3), 65.2)]
    assert rows(weather.hottest_day(seed), "day", "avg_temp") == [(datetime(2024, 1, 1), 72.5)]
    assert rows(weather.windiest_day(seed), "day", "avg_wind") == [(datetime(2024, 1, 3), 7.8)]
    week = weather.weather_trends(seed, "week").first()
    assert week["interval_start"] == datetime(2024, 1, 1)
    assert week["avg_temp"] == pytest.approx(68.5666666)
    assert week["common_wind_dir"] == "E"
    records = {r["record"]: r["day"].day for r in weather.weather_records(seed).collect()}
    assert records == {"coldest_day": 3, "hottest_day": 1, "windiest_day": 3}


def test_modes(spark):
    readings = ["b", "a", "a", "b", None, None, None]
    df = images(spark, *[{"temperature_unit": u, "wind_speed": 0.0} for u in readings])
    found = weather.weather_trends(df, "day").first()
    assert found["temp_unit"] == "a"
    assert found["wind_unit"] is None
    assert found["avg_temp"] is None and found["avg_wind"] == 0.0
    assert found["reading_count"] == 7


def test_record_days_count_their_own_readings(spark):
    df = images(
        spark,
        {"capture_time": "2024-01-01 08:00:00", "temperature": 5.0, "wind_speed": 1.0},
        {"capture_time": "2024-01-01 09:00:00", "wind_speed": 9.0},
        {"capture_time": "2024-01-02 08:00:00", "temperature": 4.0},
        {"capture_time": "2024-01-02 07:00:00"},
        {"capture_time": "2024-01-03 08:00:00", "temperature": 4.0, "wind_speed": 5.0},
    )
    coldest = weather.coldest_day(df)
    assert rows(coldest, "day") == [(datetime(2024, 1, 2),)]
    # The picture without a temperature is listed, and lists are in time order.
    assert [r["image"]["id"] for r in weather.day_images(df, coldest).collect()] == [4, 3]
    assert rows(weather.windiest_day(df), "day", "avg_wind") == [(datetime(2024, 1, 1), 5.0)]
    assert {(r["record"], r["day"].day) for r in weather.weather_records(df).collect()} == {
        ("coldest_day", 2), ("hottest_day", 1), ("windiest_day", 1)
    }
    assert rows(weather.daily_temps(df).orderBy("day"), "avg_wind") == [(1.0,), (None,), (5.0,)]


def test_record_documents_have_a_row_per_capture(spark):
    df = images(spark, *[
        {"capture_time": f"2024-01-01 0{(i * 7) % 5}:00:00", "temperature": 1.0, "wind_speed": 1.0} for i in range(20)
    ])
    expected = sorted(range(1, 21), key=lambda i: (((i - 1) * 7) % 5, i))
    assert [r["image"]["id"] for r in weather.day_images(df, datetime(2024, 1, 1)).collect()] == expected
    assert [r["image"]["id"] for r in weather.day_images(df, weather.coldest_day(df)).collect()] == expected
    found = weather.record_documents(df).collect()
    for record in ("coldest_day", "hottest_day", "windiest_day"):
        assert sorted(r["image"]["id"] for r in found if r["record"] == record) == list(range(1, 21))
    assert min(r["image"]["capture_time"] for r in found) == "2024-01-01T00:00:00"
    assert rows(weather.trends_info(df, "hour")) == [("hour", 5)] and rows(weather.trends_info(df, "x")) == [("hour", 5)]


def test_equal_averages_do_not_depend_on_the_last_bit(spark):
    # Three tenths summed in either order differ in the last bit.
    first = [{"capture_time": "2024-01-02 00:00:00", "temperature": t} for t in (0.1, 0.2, 0.3)]
    second = [{"capture_time": "2024-01-01 00:00:00", "temperature": t} for t in (0.3, 0.2, 0.1)]
    df = images(spark, *first, *second).coalesce(1)
    assert rows(weather.coldest_day(df), "day") == rows(weather.hottest_day(df), "day") == [(datetime(2024, 1, 1),)]


def test_no_readings_no_records(spark):
    df = images(spark, {}, {})
    assert weather.weather_records(df).count() == 0
    assert weather.coldest_day(df).count() == 0
    assert weather.day_images(df, weather.coldest_day(df)).count() == 0
    some = weather.record_documents(images(spark, {"temperature": 1.0, "wind_speed": 1.0}))
    assert weather.record_documents(df).schema.names == some.schema.names
    assert weather.record_documents(df).count() == 0


def test_range_ends_at_midnight(spark):
    df = images(
        spark, {"capture_time": "2024-01-07 00:00:00"}, {"capture_time": "2024-01-07 00:00:01"},
        {"capture_time": "2024-01-01 00:00:00"},
    )
    assert {r[0] for r in rows(filters.filter_date_range(df, "2024-01-01", "2024-01-07"), "id")} == {1, 3}
    assert filters.filter_date_range(df).count() == 3
    assert weather.weather_trends(df, "day", "2024-01-07").count() == 1
    with pytest.raises(Exception):
        filters.filter_date_range(df, "2024-13-01").collect()


def test_weather_documents(spark):
    df = images(spark, {"temperature": 0.0, "wind_speed": 2.25, "wind_unit": "mph"})
    found = weather.weather_documents(weather.weather_trends(df, "day")).first()
    assert found["timestamp"] == "2024-01-01T00:00:00"
    assert found["temperature"]["average"] is None
    assert found["wind"]["max"] == 2.2 and found["wind"]["unit"] == "mph"
    assert found["reading_count"] == 1
    record = weather.weather_documents(weather.weather_records(df), "day").first()
    assert record["record"] == "coldest_day"


# listing


def test_sort_puts_missing_values_last_going_up_and_first_going_down(spark):
    df = images(spark, {"temperature": 5.0}, {}, {"temperature": 3.0}, {"temperature": 5.0})
    assert [r[0] for r in rows(listing.list_images(df, sort_by="temperature", sort_order="asc"), "id")] == [3, 1, 4, 2]
    assert [r[0] for r in rows(listing.list_images(df, sort_by="temperature"), "id")] == [2, 1, 4, 3]


@pytest.mark.parametrize("max_top", [100, 1])
def test_pages_are_the_sorted_list(spark, max_top):
    df = images(spark, *[{"temperature": float(i % 3) if i % 5 else None} for i in range(41)])
    everything = [r[0] for r in rows(listing.list_images(df, sort_by="temperature"), "id")]
    pages = []
    for page in range(1, 5):
        found = listing.page_images(df, page, 20, sort_by="temperature", max_top=max_top)
        pages.append([r[0] for r in rows(found, "id")])
    assert [len(p) for p in pages] == [20, 20, 1, 0]
    assert sum(pages, []) == everything
    assert rows(listing.page_info(df)) == [(41, 1, 20, 3)]
    assert rows(listing.page_info(df.limit(0))) == [(0, 1, 20, 0)]


def test_locations_and_lookups(spark):
    df = images(
        spark, {"primary_location": None}, {"secondary_location": None}, {}, {}, {"primary_location": ""},
    )
    assert rows(listing.locations(df)) == [("", "s"), ("p", "s"), ("p", None)]
    assert filters.filter_location(df, "s").count() == 4
    assert filters.filter_location(df, None).count() == 5
    assert listing.image_by_id(df, 99).count() == 0
    assert rows(listing.images_by_ids(df, "5,3,9,3"), "id", "position") == [(5, 1), (3, 2)]
    many = [5, *range(1000, 3000), 3]
    assert rows(listing.images_by_ids(df, many), "id", "position") == [(5, 1), (3, 2002)]
    assert filters.filter_ids(df, many).count() == 2 and filters.filter_ids(df, many).columns == df.columns
    listed = spark.createDataFrame([(i,) for i in many], "id long")
    turned = df.select("source_id", "id")
    assert sorted(rows(filters.filter_id_table(turned, listed))) == [("s3", 3), ("s5", 5)]
    assert rows(listing.listing_info(df, location="s", sort_by="x", sort_order="ASC")) == [(4, "capture_time", "asc")]


def test_latest(spark):
    day = datetime(2024, 1, 1)
    df = images(spark, {"created_at": day}, {"created_at": day.replace(hour=5)}, {"created_at": day.replace(hour=5)})
    assert rows(listing.latest_source_id(df)) == [("s2",)]
    assert [r[0] for r in rows(listing.all_images_by_created(df), "id")] == [2, 3, 1]


def test_labels_and_documents(spark):
    seed = seed_images(spark)
    labels = listing.image_labels(seed).orderBy("id").first()
    assert labels["time_label"] == "January 01, 12:00 PM"
    assert labels["place_label"] == "North Trail - Cabin"
    assert labels["pressure_label"] == "30.1 inHg"
    assert (labels["sun_label"], labels["moon_label"]) == ("Sunny", "Full Moon")
    assert rows(listing.image_metadata(seed).orderBy("id"), "pressure", "pressure_unit", "sun_status")[1] == (
        29.9, "inHg", "Partly Cloudy"
    )
    tagged = seed.withColumn("tag", F.lit(tag("deer", 2)))
    document = listing.image_documents(tagged).orderBy("id").first()
    assert document["capture_time"] == "2024-01-01T12:00:00"
    assert document["tag"]["name"] == "deer"


# tags


def test_tags_keep_repeats_and_fill_blanks(spark, tags):
    df = images(spark, {}, {}, {})
    links = links_of(spark, [(1, 1), (1, 1), (2, 3), (2, 99)])
    found = sorted(rows(tagging.images_with_tags(df, links, tags), "id", "tag", "copies"), key=str)
    assert found == [(1, TAGS[0][1], 2), (2, TAGS[2][1], 1), (3, None, 0)]
    assert tagging.tag_image_counts(links, tags).filter(F.col("name") == TAGS[0][1]).first()["image_count"] == 1


def test_one_shape_for_any_number_of_links(spark, tags):
    pairs = [(1, 1)] * 57 + [(1, 2)] * 3 + [(1, 3), (2, 3), (2, 4)] + [(3, i % 4 + 1) for i in range(40)]
    same_text = tags.unionByName(spark.createDataFrame([(9, TAGS[0][1])], schema.TAGS))
    found = tagging.tag_copies(links_of(spark, [*pairs, (2, 9), (1, 9)]), same_text).collect()
    assert {(r["image_id"], r["tag"]): r["copies"] for r in found} == {
        (1, TAGS[0][1]): 58, (1, TAGS[1][1]): 3, (1, TAGS[2][1]): 1, (2, TAGS[0][1]): 1, (2, TAGS[2][1]): 1,
        (2, TAGS[3][1]): 1, **{(3, text): 10 for _, text in TAGS},
    }
    assert len(found) == 10


def test_all_names_are_required(spark, tags):
    df = images(spark, {}, {}, {}, {})
    links = links_of(spark, [(1, 1), (1, 3), (2, 1), (2, 2), (3, 3), (4, 1), (4, 4)])
    assert rows(tagging.images_having_all_tags(df, links, tags, " Deer ,FOX,deer,"), "id") == [(1,)]
    assert {r[0] for r in rows(tagging.images_having_all_tags(df, links, tags, "deer"), "id")} == {1, 2, 4}
    assert tagging.images_having_all_tags(df, links, tags, "feeder").count() == 0
    assert tagging.ids_having_all_tags(links, tags, [f"x{i}" for i in range(70)]).count() == 0
    many = [(100 + i, tag(f"x{i}", 1)) for i in range(70)]
    wide = tags.unionByName(spark.createDataFrame(many, schema.TAGS))
    worn = links_of(spark, [(i, t) for i in (1, 2) for t, _ in many if (i, t) != (2, 165)])
    assert rows(tagging.ids_having_all_tags(worn, wide, [f"x{i}" for i in range(70)])) == [(1,)]
    found = listing.list_tagged_images(df, links, tags, tag_names="deer,fox")
    assert rows(found, "id", "tag") == [(1, TAGS[0][1]), (1, TAGS[2][1])]
    by_id = listing.list_tagged_images(df, links, tags, ids="3,1")
    assert rows(by_id, "id", "tag") == [(3, TAGS[2][1]), (1, TAGS[0][1]), (1, TAGS[2][1])]
    with pytest.raises(ValueError):
        listing.list_tagged_images(df, links, tags, ids="3,x")


def test_two_counts_of_one_animal_count_twice(spark, tags):
    links = links_of(spark, [(1, 1), (1, 2), (2, 1), (2, 1), (3, 3), (3, 4)])
    assert rows(tagging.available_tags(links, tags)) == [("deer", 3), ("fox", 1)]
    same_text = tags.unionByName(spark.createDataFrame([(9, TAGS[0][1])], schema.TAGS))
    assert rows(tagging.available_tags(links_of(spark, [(1, 1), (1, 9)]), same_text)) == [("deer", 1)]


def test_images_outside_the_range_lose_their_tags(spark, tags):
    df = images(spark, {"capture_time": "2024-01-01 00:00:00"}, {"capture_time": "2024-02-01 00:00:00"})
    links = links_of(spark, [(1, 1), (2, 1)])
    found = tagging.tags_masked_outside_range(df, links, tags, F.col("capture_time") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    assert {r["id"]: r["copies"] for r in found.collect()} == {1: 0, 2: 1}
    listed = listing.list_tagged_images(df, links, tags, tag_names="deer", start="2024-01-15", mask_outside_range=True)
    assert rows(listed, "id", "copies") == [(2, 1), (1, 0)]
    assert listing.list_tagged_images(df, links, tags, tag_names="deer", start="2024-01-15").count() == 1
    assert listing.list_tagged_images(df, links, tags, tag_names=" , ").count() == 0


def test_untagged_queue(spark, tags):
    df = images(spark, *[{"created_at": datetime(2024, 1, 1 + i % 3)} for i in range(6)])
    links = links_of(spark, [(3, 1), (3, 1)])
    assert [r[0] for r in rows(tagging.newest_untagged(df, links, 3), "id")] == [6, 2, 5]
    before = tagging.count_untagged(df, links)
    assert rows(before) == [(5,)]
    batch = tagging.newest_untagged(df, links, 3).withColumn("ok", F.col("id") != 2)
    assert rows(tagging.tagging_progress(before, batch)) == [(3, 2, 3)]
    none_new = spark.createDataFrame([], "source_id string")
    assert rows(ingest.next_tagging_batch(none_new, df, links, 2), "id") == [(6,), (2,)]
    new = spark.createDataFrame([("s3",), ("s3",)], "source_id string")
    assert rows(ingest.next_tagging_batch(new, df, links), "id") == [(3,)]
    assert {r[0] for r in rows(ingest.next_tagging_batch(None, df, links), "id")} == {1, 2, 4, 5, 6}
    assert {r[0] for r in rows(ingest.specific_images(df, [1, 4, 44]), "id")} == {1, 4}


def test_tag_filters(spark, tags):
    assert filters.filter_tag_type(tags, "animal").count() == 3
    assert filters.filter_tag_names(tags, " FOX ,").count() == 1


# answers


def analysed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts, start=1)), "image_id long, answer string")
    return sorted(rows(answers.tag_counts_from_analysis(df), "image_id", "name", "count", "display"))


def test_answers(spark):
    assert analysed(
        spark,
        '```json\n{"Deer":3,"Bucks":1,"Rabbits":2,"total":6}\n```',
        '{"Foxes":1,"Glass":1}',
        '{"Deer":"2"}', "{}", "not json", None, "[1]",
        '{"gray fox":1}',
        '{"Deer": 1.5, "deer": 1}',
        '```\n{"Fox": 2, "foxs": 3}\n```',
    ) == [
        (1, "deer", 4.0, "Deer 4"), (1, "rabbit", 2.0, "Rabbit 2"),
        (2, "foxe", 1.0, "Foxe 1"), (2, "gla", 1.0, "Gla 1"),
        (8, "gray fox", 1.0, "Gray fox 1"),
        (9, "deer", 2.5, "Deer 2.5"),
        (10, "fox", 5.0, "Fox 5"),
    ]


def test_counts_are_printed_in_full(spark):
    df = spark.createDataFrame(
        [(1, '{"a": 9007199254740993, "b": 1e20, "c": 12345678.5, "d": 0.00001, "e": 3.0, "f": 99999999999999999999}'),
         (2, '{"a": 9007199254740993, "As": 1}'), (3, '{"a": 1, "As": 0.5}'), (4, '{"a": 0.0005, "b": 1e15, "total": 3, "c": 0}')],
        "image_id long, answer string",
    )
    found = {(r["image_id"], r["name"]): r["display"].split(" ")[1] for r in answers.tag_counts_from_analysis(df).collect()}
    assert found == {
        (1, "a"): "9007199254740993", (1, "b"): "1e+20", (1, "c"): "12345678.5", (1, "d"): "1e-05", (1, "e"): "3.0",
        (1, "f"): "99999999999999999999", (2, "a"): "9007199254740994", (3, "a"): "1.5",
        (4, "a"): "0.0005", (4, "b"): "1000000000000000.0",
    }


def test_unmerged_answers(spark):
    df = spark.createDataFrame([(1, '{"Deer":3,"Bucks":1,"total":4}')], "image_id long, answer string")
    assert sorted(rows(answers.tags_unmerged(df), "name", "count", "display")) == [
        ("buck", None, "Buck"), ("bucks", 1.0, "Bucks 1"), ("deer", 3.0, "Deer 3")
    ]
    text = answers.tags_unmerged(df).filter("name = 'deer'").first()["tag_json"]
    assert text == '{"type": "animal", "name": "deer", "count": 3, "display": "Deer 3"}'


# changes


def test_remove_tag(spark, tags):
    links = links_of(spark, [(1, 1), (1, 1), (1, 3), (2, 1), (1, 4)])
    found = mutate.remove_tag(links, tags, 1, "DEER")
    assert rows(found.removed) == [(1, 1), (1, 1)]
    assert sorted(rows(found.kept)) == [(1, 3), (1, 4), (2, 1)]
    assert sorted(rows(found.remaining, "tag_id")) == [(3,), (4,)]
    assert sorted(rows(found.kept.unionByName(found.removed))) == sorted(rows(links))
    assert rows(mutate.remove_tag(links, tags, 1, "feeder").removed) == [(1, 4)]
    loose = spark.createDataFrame([(None, 1), (1, 1), (2, None)], "image_id long, tag_id long")
    assert sorted(rows(mutate.remove_tag(loose, tags, 1, "deer").kept), key=str) == [(2, None), (None, 1)]


def test_replace_tags_is_idempotent(spark):
    links = links_of(spark, [(1, 1), (1, 2), (2, 1)])
    new = links_of(spark, [(1, 3)])
    once = mutate.replace_tags(links, new)
    assert sorted(rows(once)) == [(1, 3), (2, 1)]
    assert sorted(rows(mutate.replace_tags(once, new))) == [(1, 3), (2, 1)]
    assert sorted(rows(mutate.replace_tags(links, new.limit(0)))) == sorted(rows(links))


def test_upsert_tags(spark, tags):
    names = spark.createDataFrame([(TAGS[0][1],), ("new",), ("new",), ("newer",)], "name string")
    found = mutate.upsert_tags(names, tags).collect()
    assert sorted(r["name"] for r in found) == sorted([t for _, t in TAGS] + ["new", "newer"])
    assert len({r["tag_id"] for r in found}) == 6
    assert sorted(r["tag_id"] for r in found) == [1, 2, 3, 4, 5, 6]
    assert sorted(rows(mutate.upsert_tags(names.repartition(5), tags))) == sorted(tuple(r) for r in found)
    first = mutate.upsert_tags(names, tags.limit(0)).collect()
    assert sorted(r["tag_id"] for r in first) == [1, 2, 3]


def test_tag_answers(spark, tags):
    df = spark.createDataFrame(
        [(1, '{"Deer": 2}'), (2, "{}"), (4, '{"Owls": 1}')], "image_id long, answer string"
    )
    links = links_of(spark, [(1, 3), (1, 4), (2, 3), (3, 1)])
    found = mutate.tag_answers(df, links, tags)
    named = sorted(rows(tagging.tag_rows(found.links, found.tags), "image_id", "name"))
    assert named == sorted([(1, TAGS[0][1]), (2, TAGS[2][1]), (3, TAGS[0][1]), (4, tag("owl", 1))])
    assert (1, 1) in rows(found.links)
    again = mutate.retag_all(df, links, tags)
    assert sorted(rows(tagging.tag_rows(again.links, again.tags), "image_id", "name")) == [
        (1, TAGS[0][1]), (4, tag("owl", 1))
    ]


def test_update_images(spark):
    df = images(spark, {"temperature": 1.0}, {"temperature": 2.0})
    changes = df.filter("id = 2").withColumn("temperature", F.lit(9.0))
    unknown = changes.withColumn("id", F.lit(77).cast("long"))
    found = mutate.update_images(df, changes.unionByName(unknown), "2024-05-05")
    assert sorted(rows(found, "id", "temperature", "updated_at")) == [(1, 1.0, None), (2, 9.0, datetime(2024, 5, 5))]
    assert found.columns == df.columns
    twice = changes.unionByName(changes.withColumn("temperature", F.lit(8.0)))
    with pytest.raises(Exception, match="several changes"):
        mutate.update_images(df, twice, "2024-05-05").collect()
    assert sorted(rows(mutate.update_images(df, twice, "2024-05-05", "temperature"), "id", "temperature")) == [
        (1, 1.0), (2, 9.0)
    ]


# checks


def test_checks(spark, tags):
    df = images(spark, {}, {"file_hash": "h1", "wind_unit": "elevenchars"}, {"wind_unit": "tencharact"})
    assert rows(checks.duplicate_keys(df, ["file_hash"])) == [("h1", 2)]
    assert checks.duplicate_keys(df, ["id"]).count() == 0
    assert checks.null_violations(df).count() == 0
    assert rows(checks.null_violations(df, ["id", "temperature"])) == [("temperature", 3)]
    assert rows(checks.length_violations(df)) == [("wind_unit", 1)]
    links = links_of(spark, [(1, 1), (9, 1), (2, 77), (8, 88)])
    assert sorted(rows(checks.orphan_links(df, links, tags))) == [
        (2, 77, "tag"), (8, 88, "image"), (8, 88, "tag"), (9, 1, "image")
    ]
    assert sorted(rows(checks.orphan_tags(links, tags), "tag_id")) == [(2,), (3,), (4,)]


# ingest


def sequence(spark, pairs):
    return spark.createDataFrame([(i, s, h) for i, (s, h) in enumerate(pairs)], "pos long, source_id string, file_hash string")


def positions(df):
    return sorted(r["pos"] for r in df.collect())


@pytest.fixture
def stored(spark):
    return images(spark, {"source_id": "known", "file_hash": "seen"})


def test_known_by_hash_or_id(spark, stored):
    seq = sequence(spark, [("a", "seen"), ("known", "b"), ("c", "d"), ("known", "seen")])
    assert positions(ingest.new_captures(seq, stored)) == [2]
    assert positions(ingest.new_captures(ingest.new_captures(seq, stored), stored)) == [2]


def one_by_one(pairs, known_ids, known_hashes, force):
    """The rows kept when captures are looked at one after the other."""
    ids, hashes, seen, kept = set(known_ids), set(known_hashes), set(), []
    for pos, (source_id, content) in enumerate(pairs):
        duplicate = source_id in seen or source_id in ids or content in hashes
        seen.add(source_id)
        if not duplicate:
            kept.append(pos)
            ids.add(source_id)
            hashes.add(content)
        elif not force:
            break
    return kept


CHAINS = [
    [("a", "1"), ("a", "2"), ("b", "2"), ("c", "1"), ("known", "3"), ("d", "3")],
    [("a", "1"), ("b", "2"), ("known", "9"), ("c", "3")],
    [("a", "seen"), ("a", "1"), ("b", "1")],
    [("a", "1"), ("b", "1"), ("c", "2")],
    [("a", "1"), ("b", "2"), ("c", "3")],
]


@pytest.mark.parametrize("pairs", CHAINS)
def test_batches_match_one_by_one(spark, stored, pairs):
    seq = sequence(spark, pairs)
    kept = one_by_one(pairs, {"known"}, {"seen"}, force=True)
    assert positions(ingest.incremental_batch(seq, stored, force=True)) == kept
    assert positions(ingest.accepted(seq, stored)) == kept
    first = one_by_one(pairs, {"known"}, {"seen"}, force=False)
    assert positions(ingest.incremental_batch(seq, stored)) == first
    assert positions(ingest.take_until_duplicate(seq, stored)) == first


def test_random_sequences_match_one_by_one(spark, stored):
    rng = random.Random(11)
    for size in (12, 30, 60):
        pairs = [
            (rng.choice([f"i{rng.randrange(size)}", "known"] if rng.random() < 0.2 else [f"i{rng.randrange(size)}"]),
             rng.choice([f"h{rng.randrange(size)}", "seen"] if rng.random() < 0.2 else [f"h{rng.randrange(size)}"]))
            for _ in range(size)
        ]
        seq = sequence(spark, pairs)
        assert positions(ingest.accepted(seq, stored)) == one_by_one(pairs, {"known"}, {"seen"}, force=True)
        assert positions(ingest.take_until_duplicate(seq, stored)) == one_by_one(pairs, {"known"}, {"seen"}, False)


def test_take_until_duplicate(spark):
    seq = sequence(spark, [("a", "1"), ("b", "2"), ("a", "3"), ("d", "4")])
    assert positions(ingest.take_until_duplicate(seq)) == [0, 1]
    assert positions(ingest.take_until_duplicate(seq.filter("pos <> 2"))) == [0, 1, 3]


def test_bounds_are_the_callers(spark, stored):
    seq = sequence(spark, [(f"n{i}", f"m{i}") for i in range(400)])
    assert positions(ingest.incremental_batch(seq, stored)) == list(range(400))
    assert positions(ingest.incremental_batch(seq, stored, max_attempts=200)) == list(range(201))
    assert positions(ingest.incremental_batch(seq, stored, max_records=5)) == list(range(5))
    assert positions(ingest.backfill_batch(seq, stored, jump=2, limit=1)) == [3]
    assert positions(ingest.backfill_batch(seq, stored, jump=0)) == list(range(1, 400))
    assert positions(ingest.backfill_batch(seq, stored, jump=0, max_attempts=200)) == list(range(1, 201))
    some = sequence(spark, [("known", "0"), ("x", "1"), ("known", "2"), ("y", "1"), ("z", "3")])
    assert positions(ingest.backfill_batch(some, stored, jump=0, limit=2)) == [1, 4]


def test_dedupe_keeps_the_first(spark):
    seq = sequence(spark, [("a", "1"), ("b", "2"), ("a", "3"), ("b", "4"), ("c", "5")])
    assert sorted(rows(ingest.dedupe_run(seq))) == [(0, "a", "1"), (1, "b", "2"), (4, "c", "5")]


def test_readings(spark):
    data = [
        ("a", 0, "Temperature", "72°F"), ("a", 1, "Wind", "NW 5.2 mi per h"), ("a", 2, "Pressure", "30.1 inHg"),
        ("a", 3, "Sun", "Sunny"), ("a", 4, "Moon phase", "Full\nMoon"),
        ("b", 0, "TEMP", "1°C"), ("b", 1, "temp", "2°C"), ("b", 2, "temp", "bad"),
        ("c", 0, "battery", "full"),
        ("d", 0, "temp", "72f°F"), ("d", 1, "wind", "NW 5d mph"), ("d", 2, "pressure", "30f inHg"),
        ("e", 0, "temp", " +1.5e1 °F"), ("e", 1, "temp", None), ("e", 2, "wind", "N .5 x"), ("f", 0, None, "1°F"),
    ]
    readings = spark.createDataFrame(data, "source_id string, pos long, label string, value string")
    found = {r["source_id"]: r for r in ingest.pivot_readings(readings).collect()}
    assert (found["a"]["temperature"], found["a"]["temperature_unit"]) == (72.0, "F")
    assert (found["a"]["wind_direction"], found["a"]["wind_speed"], found["a"]["wind_unit"]) == ("NW", 5.2, "mi per h")
    assert tuple(found["a"]["pressure"]) == (30.1, "inHg")
    assert found["a"]["moon_phase"] == "Full Moon"
    assert found["b"]["temperature"] == 2.0
    assert set(found) == set("abcdef") and tuple(found["d"])[1:] == tuple(found["c"])[1:] == (None,) * 8
    assert (found["e"]["temperature"], found["e"]["wind_speed"]) == (15.0, 0.5)
    shots = spark.createDataFrame(
        [
            (0, "a", "ha", "u", "January 03,  02:05 PM", ["P", "S"]),
            (1, "z", "hz", "u", "junk", ["P"]),
            (2, "y", "hy", "u", None, None),
        ],
        "pos long, source_id string, file_hash string, cdn_url string, taken_text string, places array<string>",
    )
    now = datetime(2024, 3, 1, 10, 20, 30)
    captures = {r["source_id"]: r for r in ingest.captures_from_readings(shots, readings, now).collect()}
    assert captures["a"]["capture_time"] == datetime(2024, 1, 3, 14, 5)
    assert captures["z"]["capture_time"] == datetime(2024, 3, 1, 10, 20)
    assert captures["y"]["capture_time"] == now
    assert (captures["a"]["primary_location"], captures["a"]["secondary_location"]) == ("P", "S")
    assert captures["z"]["primary_location"] == "" and captures["z"]["wind_direction"] == ""
    assert (captures["z"]["temperature"], captures["z"]["temperature_unit"], captures["z"]["wind_unit"]) == (None, "F", "mph")
    assert captures["a"]["raw_metadata"] == (
        '{"timestamp":"January 03, 2024 02:05 PM","location":{"primary":"P","secondary":"S"},'
        '"temperature":{"value":72.0,"unit":"F"},"wind":{"direction":"NW","speed":5.2,"unit":"mi per h"},'
        '"pressure":{"value":30.1,"unit":"inHg"},"sun_status":"Sunny","moon_phase":"Full Moon"}'
    )
    assert captures["y"]["raw_metadata"] == "{}"


def test_ingest_sets_ids_and_times(spark, stored):
    seq = sequence(spark, [("a", "1"), ("b", "1"), ("known", "2"), ("c", "3")]).withColumns({
        "cdn_url": F.lit("u"), "capture_time": F.lit("2024-01-01").cast("timestamp_ntz"),
        **{c: F.lit(None).cast("string") for c in (
            "primary_location", "secondary_location", "temperature_unit", "wind_direction", "wind_unit", "raw_metadata"
        )},
        "temperature": F.lit(None).cast("double"), "wind_speed": F.lit(None).cast("double"),
    })
    found = ingest.ingest_captures(seq, stored, "2024-02-02").collect()
    assert sorted(r["source_id"] for r in found) == ["a", "c"]
    assert sorted(r["id"] for r in found) == [2, 3]
    assert {r["created_at"] for r in found} == {datetime(2024, 2, 2)}
    assert found[0]["temperature_unit"] == "F" and found[0]["primary_location"] == ""


# scoring and retention


def test_scoring_survives_errors(spark):
    df = spark.createDataFrame([(1, "good"), (2, "flaky"), (3, "gone"), (4, "odd")], "id long, cdn_url string")

    def load(url, state={}):
        state[url] = state.get(url, 0) + 1
        if url == "gone" or (url == "flaky" and state[url] < 3):
            raise OSError("no answer")
        return url

    def predict(content):
        if content == "odd":
            raise ValueError("unreadable")
        return f'{{"{content}": 1}}'

    found = {r["image_id"]: tuple(r)[1:] for r in scoring.score_images(df, predict, load, partitions=2).collect()}
    assert found == {
        1: ('{"good": 1}', True, None),
        2: ('{"flaky": 1}', True, None),
        3: (None, False, "no answer"),
        4: ("{}", False, "unreadable"),
    }


def test_batches_are_scored_at_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, cdn_url string").coalesce(1)

    def load(url):
        if url == "b":
            raise OSError("gone")
        return url

    found = scoring.score_images(df, load=load, predict_batch=lambda urls: ["+".join(urls)] * len(urls)).collect()
    assert {r["image_id"]: tuple(r)[1:] for r in found} == {
        1: ("a+c", True, None), 2: (None, False, "gone"), 3: ("a+c", True, None)
    }
    short = scoring.score_images(df, predict_batch=lambda urls: 1 / 0).collect()
    assert [tuple(r)[1:] for r in short] == [("{}", False, "division by zero")] * 3


def test_tagging_run(spark, tags):
    df = images(spark, *[{"cdn_url": u, "created_at": datetime(2024, 1, i + 1)} for i, u in enumerate("abcd")])
    links = links_of(spark, [(4, 1)])
    answer = {"a": '{"Deer": 2}', "b": "{}", "c": "```json\n{\"Foxs\": 1}\n```", "d": '{"Owls": 7}'}.get
    run = jobs.tag_next_batch(df, links, tags, answer, limit=2)
    assert sorted(rows(run.tables.links)) == [(3, 3), (4, 1)]
    assert rows(run.progress) == [(2, 1, 2)]
    new = spark.createDataFrame([("s1",), ("s4",)], "source_id string")
    again = jobs.tag_next_batch(df, links, tags, answer, new_ids=new, partitions=2)
    assert sorted(rows(tagging.tag_rows(again.tables.links, again.tables.tags), "image_id", "name")) == [
        (1, TAGS[0][1]), (4, tag("owl", 7))
    ]
    rebuilt = jobs.retag_images(df, links, tags, answer)
    assert sorted(rows(tagging.tag_rows(rebuilt.links, rebuilt.tags), "image_id", "name")) == [
        (1, TAGS[0][1]), (3, TAGS[2][1]), (4, tag("owl", 7))
    ]
    assert rebuilt.tags.count() == 3


def test_retention(spark):
    files = spark.createDataFrame(
        [(f"/b/db_{k}_{i}.gz", k, datetime(2024, 1, i)) for k in ("schema", "data") for i in range(1, 10)],
        "path string, kind string, time timestamp_ntz",
    )
    kept = keep_latest(files, "kind", "time", "path").collect()
    assert len(kept) == 14
    assert min(r["time"] for r in kept) == datetime(2024, 1, 3)
    logs = spark.createDataFrame(
        [("/l/cam_sync_1.log", datetime(2024, 1, 1)), ("/l/cam_sync_2.log", datetime(2024, 1, 9)), ("/l/x.log", datetime(2020, 1, 1)),
         ("/l/other_cam_sync_3.log", datetime(2020, 1, 1))],
        "path string, modificationTime timestamp",
    )
    assert rows(expired_files(logs, "2024-01-10", "cam_sync_"), "path") == [("/l/cam_sync_1.log",)]
