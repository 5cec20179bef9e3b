"""Physical plans: no products, no Python outside scoring, filters in the scan."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trailtally.operators import ingest, listing, mutate, tagging, weather
from trailtally.plans import bindings as b
from trailtally.plans.queries import QUERIES
from trailtally.sources import catalog, tables
from trailtally.sources.snapshots import keep_latest
from trailtally.sources.tables import write_bucketed


def plan(df):
    return df._jdf.queryExecution().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_and_no_python(spark, data, name):
    text = executed(QUERIES[name](spark, data))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    if name not in ("score_images", "score_images_batched", "score_images_failing", "tag_next_batch", "retag_images"):
        assert "Python" not in text and "InPandas" not in text


def test_range_reaches_the_scan(spark, data):
    text = executed(listing.list_images(b.order_images(spark, data), "1998-01-01", "1998-02-01", sort_by="created_at"))
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)" in text
    assert "LessThanOrEqual(o_orderdate,1998-02-01T00:00)" in text
    assert "o_totalprice" not in text


def test_record_images_scan_one_day(spark, data):
    images = b.event_images(spark, data)
    text = executed(weather.images_on_day(images, weather.coldest_day(images)))
    assert text.count("Subquery") >= 2
    given = executed(weather.images_on_day(images, datetime(2024, 1, 5)))
    assert "GreaterThanOrEqual(ts," in given and "LessThan(ts," in given


def test_trends_combine_before_the_shuffle(spark, data):
    text = executed(weather.weather_by_bucket(b.event_images(spark, data), "hour"))
    scan_to_shuffle = text[text.rindex("Exchange hashpartitioning"):]
    assert "HashAggregate" in scan_to_shuffle and "SortAggregate" not in scan_to_shuffle
    assert "event_id" in scan_to_shuffle


def test_pages_are_top_k(spark, data):
    text = executed(listing.page_images(b.event_images(spark, data), 3))
    assert "TakeOrderedAndProject" in text and "LeftSemi" in text


def test_latest_rows_are_limited_before_the_shuffle(spark, data):
    text = executed(keep_latest(b.event_images(spark, data), "primary_location", "created_at", "id"))
    assert text.rindex("WindowGroupLimit") > text.index("Exchange hashpartitioning")


def test_repeats_are_limited_before_the_shuffle(spark, data):
    text = executed(ingest.first_duplicate(b.document_sequence(spark, data)))
    assert text.rindex("WindowGroupLimit") > text.index("Exchange hashpartitioning")


def test_shuffled_joins_when_nothing_fits_a_broadcast(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        images, links = b.order_images(spark, data), b.image_links(spark, data)
        text = executed(tagging.untagged_images(images, links))
        assert "LeftAnti" in text and "SortMergeJoin" in text
        seq, stored = b.document_sequence(spark, data), b.labelled_images(spark, data)
        text = executed(ingest.new_captures(seq, stored))
        assert text.count("LeftAnti") == 2 and "NestedLoop" not in text and "Broadcast" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_tables_are_joined_in_place(spark, data):
    images = write_bucketed(b.order_images(spark, data), "bucketed_images", "id", 4)
    links = write_bucketed(b.image_links(spark, data), "bucketed_links", "image_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = tagging.untagged_images(images, links)
        text = executed(found)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert found.count() == tagging.untagged_images(b.order_images(spark, data), b.image_links(spark, data)).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_images")
        spark.sql("DROP TABLE bucketed_links")


def test_one_pass_for_all_records(spark, data):
    assert executed(weather.weather_records(b.event_images(spark, data))).count("FileScan") == 1


def test_tag_filter_uses_semi_joins(spark, data):
    found = tagging.images_having_all_tags(
        b.order_images(spark, data), b.image_links(spark, data), b.part_tags(spark, data), "promo,small"
    )
    assert "LeftSemi" in executed(found.select(F.col("id")))


def test_no_sort_before_the_shuffle(spark, data):
    assert "SortAggregate" not in executed(ingest.dedupe_run(b.document_sequence(spark, data)))
    seq = b.document_sequence(spark, data)
    assert "SortAggregate" not in executed(ingest.accepted(seq, b.labelled_images(spark, data)))


def test_readings_are_read_and_parsed_once(spark, data):
    text = executed(ingest.pivot_readings(b.event_readings(spark, data)))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    # A capture's readings combine before the shuffle, and each field is taken out of a text once.
    assert text.rindex("SortAggregate") > text.index("Exchange")
    assert text.count("regexp_extract") == 7 and text.index("regexp_extract") > text.index("Generate inline")


def test_ids_evaluate_their_rows_once(spark, data):
    before = b.part_tags(spark, data)
    text = executed(mutate.upsert_tags(b.ordered_tag_names(spark, data), before))
    # What was missing is a pinned table; the tags themselves and their highest id are scanned.
    assert "lineitem" not in text and "Scan ExistingRDD" in text
    assert "Sort [" not in text.split("Window")[0]


def test_tagging_parses_answers_once(spark, data):
    tagged = mutate.tag_answers(b.event_answers(spark, data), b.image_links(spark, data), b.part_tags(spark, data))
    for df in tagged:
        assert "try_parse_json" not in executed(df) and "events" not in executed(df)


def test_stored_keys_stay_in_their_buckets(spark, data):
    stored = catalog.add_stored_keys(b.rejected_images(spark, data), "plan_keys", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = executed(ingest.new_captures(b.document_sequence(spark, data), stored))
        scans = [k for k, line in enumerate(text.splitlines()) if "plan_keys" in line]
        assert len(scans) == 2
        for k in scans:
            above = text.splitlines()[max(0, k - 3) : k]
            assert not any("Exchange" in line for line in above if line.index("+-") >= text.splitlines()[k].index("+-") - 9)
        assert sum("Bucketed: true" in line for line in text.splitlines()) == 2
        assert "LeftAnti" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE plan_keys_source_id")
        spark.sql("DROP TABLE plan_keys_file_hash")


def test_record_day_reads_one_date(spark, data, tmp_path):
    tables.recreate_images(b.event_images(spark, data), str(tmp_path / "images"))
    images = tables.scan_image_rows(spark, str(tmp_path / "images"))
    found = weather.images_on_day(images, weather.coldest_day(images)).select("id", "capture_time")
    assert {r.capture_time.date() for r in found.collect()} == {weather.coldest_day(images).first()["day"].date()}
    scan = next(line for line in executed(found).splitlines() if "FileScan parquet [id#" in line)
    filters = scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]
    assert "capture_date" in filters and "subquery" in filters.lower()


def test_bucketed_images_and_links_do_not_move(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = executed(QUERIES["images_with_tags_bucketed"](spark, data)).splitlines()
        assert sum("Bucketed: true" in line for line in lines) == 2
        for k, line in enumerate(lines):
            if "Bucketed: true" in line:
                # Between the scan and the first join or aggregate nothing is shuffled.
                above = []
                for up in reversed(lines[:k]):
                    above.append(up)
                    if "Join" in up or "Aggregate" in up:
                        break
                assert not any("Exchange" in up for up in above)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_early_pages_rank_narrow_rows(spark, data):
    text = executed(listing.page_images(b.event_images(spark, data), 3))
    ranked = next(line for line in text.splitlines() if "TakeOrderedAndProject" in line)
    assert "raw_metadata" not in ranked and "cdn_url" not in ranked


def test_buckets_and_parts_follow_the_number_of_links(spark, data, monkeypatch):
    images, links = b.order_images(spark, data), b.image_links(spark, data)
    monkeypatch.setattr(tagging, "LINKS_PER_TASK", links.count() // 30)
    parts = tagging.link_parts(images, links)
    assert 30 <= parts <= 31
    for name in ("images_with_tags", "tags_masked_outside_range"):
        dealt = [line for line in executed(QUERIES[name](spark, data)).splitlines() if "REPARTITION_BY_NUM" in line]
        assert any("hashpartitioning(image_id" in line and f", {parts})" in line for line in dealt)
    lines = executed(QUERIES["images_with_tags_bucketed"](spark, data)).splitlines()
    assert sum(f"out of {parts}" in line for line in lines) == 2


def test_one_text_for_all_images_is_dealt_to_many_tasks(spark):
    found = spark.range(4000).select(F.col("id").alias("image_id"), F.lit("deer").alias("name"))
    none = spark.createDataFrame([], "image_id long, tag_id long"), spark.createDataFrame([], "tag_id long, name string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        ids = spark.createDataFrame([(1, "deer"), (2, "fox"), (3, None)], "tag_id long, name string")
        joined = tagging.join_dealt(found.unionByName(found.limit(1)).unionByName(
            spark.createDataFrame([(1, None), (None, "fox")], "image_id long, name string")), ids, "name", "image_id")
        sizes = [len(part) for part in joined.rdd.glom().collect()]
        assert sum(sizes) == 4002 and max(sizes) < 2000
        links = mutate.link_tags(found, *none).links
        sizes = [len(part) for part in links.rdd.glom().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_retagging_does_not_sort(spark, data):
    assert "rangepartitioning" not in plan(QUERIES["retag_images"](spark, data))
