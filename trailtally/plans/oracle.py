"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

_IMAGES = """
images AS (
  SELECT event_id AS id,
         'cam' || event_id AS source_id,
         'https://cdn.example.com/images/cam' || event_id || '.jpg' AS cdn_url,
         ts AS capture_time,
         CASE WHEN event_id % 23 <> 0 THEN event_type END AS primary_location,
         'zone' || (user_id % 7) AS secondary_location,
         CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 0.0::DOUBLE ELSE value END AS temperature,
         CASE WHEN user_id % 3 = 0 THEN 'C' ELSE 'F' END AS temperature_unit,
         CASE WHEN event_id % 13 <> 0 THEN CAST(props ->> '$.k' AS DOUBLE) END AS wind_speed,
         CASE user_id % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'E' WHEN 2 THEN 'S' ELSE 'W' END AS wind_direction,
         'mph' AS wind_unit,
         props AS raw_metadata,
         ts AS created_at,
         ts AS updated_at,
         md5('cam' || event_id) AS file_hash,
         user_id
  FROM events
)"""

_ALL_COLUMNS = """id, source_id, cdn_url, capture_time, primary_location, secondary_location, temperature,
       temperature_unit, wind_speed, wind_direction, wind_unit, raw_metadata, created_at, updated_at, file_hash"""

_LISTING = """id, source_id, cdn_url, capture_time, primary_location, secondary_location, temperature,
       temperature_unit, wind_speed, wind_direction, wind_unit, raw_metadata, created_at"""

_PART_TAG = """'{"type": "' || %s || '", "name": "' || lower(p_type) || '", "count": ' || %s
         || ', "display": "' || p_type || ' ' || %s || '"}'"""

_DEER_TAG = """'{"type": "animal", "name": "deer", "count": ' || (length(cdn_url) % 3)
         || ', "display": "Deer ' || (length(cdn_url) % 3) || '"}'"""

_TAGS = f"""
images AS (
  SELECT o_orderkey AS id, 'order' || o_orderkey AS source_id,
         'https://cdn.example.com/images/order' || o_orderkey || '.jpg' AS cdn_url,
         o_orderdate AS capture_time, o_orderdate AS created_at
  FROM orders
),
links AS (SELECT l_orderkey AS image_id, l_partkey AS tag_id FROM lineitem),
tags AS (
  SELECT p_partkey AS tag_id,
         {_PART_TAG % ("CASE WHEN p_size % 10 = 0 THEN 'object' ELSE 'animal' END", "p_size", "p_size")} AS name
  FROM part
),
tag_fields AS (
  SELECT tag_id, name, name::JSON ->> '$.type' AS tag_type, name::JSON ->> '$.name' AS tag_name FROM tags
),
tag_copies AS (
  SELECT image_id, name AS tag, count(*) AS copies FROM links JOIN tags USING (tag_id) GROUP BY ALL
),
having_all AS (
  SELECT image_id AS id
  FROM links JOIN tag_fields USING (tag_id)
  WHERE tag_type = 'animal' AND tag_name IN ('promo', 'small')
  GROUP BY image_id HAVING count(DISTINCT tag_name) = 2
),
untagged AS (
  SELECT i.* FROM images i LEFT JOIN links l ON i.id = l.image_id WHERE l.image_id IS NULL
)"""

_SEQUENCE = """
seq AS (
  SELECT doc_id AS pos, source || '-' || n_chars AS source_id, md5(text) AS file_hash FROM documents
),
labelled AS (SELECT * FROM seq WHERE pos IN (SELECT doc_id FROM labels)),
rejected AS (SELECT * FROM seq WHERE pos IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0))"""

_ANSWERS = """
bodies AS (
  SELECT event_id,
         '{"Deer": ' || (props ->> '$.k') || ', "Bucks": ' || (user_id % 3) || ', "'
           || upper(event_type[1]) || event_type[2:] || 's": ' || (user_id % 5)
           || ', "gray fox": "2", "total": 99}' AS body
  FROM events
),
fields AS (
  SELECT event_id AS image_id, unnest(json_keys(body)) AS animal, body FROM bodies WHERE event_id % 10 >= 2
),
counts AS (
  SELECT image_id, animal, CAST(body::JSON ->> ('$."' || animal || '"') AS BIGINT) AS n
  FROM fields
  WHERE json_type(body::JSON, '$."' || animal || '"') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
    AND lower(animal) <> 'total'
),
positive AS (SELECT * FROM counts WHERE n > 0),
merged AS (
  SELECT image_id,
         CASE WHEN rtrim(lower(animal), 's') = 'buck' THEN 'deer' ELSE rtrim(lower(animal), 's') END AS name,
         CAST(sum(n) AS BIGINT) AS n
  FROM positive GROUP BY ALL
),
answer_tags AS (
  SELECT image_id, 'animal' AS type, name, CAST(n AS DOUBLE) AS count,
         upper(name[1]) || name[2:] || ' ' || n AS display,
         '{"type": "animal", "name": "' || name || '", "count": ' || n || ', "display": "'
           || upper(name[1]) || name[2:] || ' ' || n || '"}' AS tag_json
  FROM merged
)"""

_MODES = """mode() WITHIN GROUP (ORDER BY temperature_unit) AS temp_unit,
       mode() WITHIN GROUP (ORDER BY wind_unit) AS wind_unit,
       mode() WITHIN GROUP (ORDER BY wind_direction) AS common_wind_dir"""

_STATISTICS = f"""round(avg(temperature), 6) AS avg_temp, min(temperature) AS min_temp, max(temperature) AS max_temp,
       round(avg(wind_speed), 6) AS avg_wind, min(wind_speed) AS min_wind, max(wind_speed) AS max_wind,
       {_MODES}"""

_RANGE = "capture_time >= TIMESTAMP '2024-01-08' AND capture_time <= TIMESTAMP '2024-01-21 12:00:00'"
_PLACE = "(primary_location = 'zone3' OR secondary_location = 'zone3')"
_NOW = "TIMESTAMP '2024-01-20 10:30:00'"
_LINK_START = "TIMESTAMP '1998-01-01'"


def _trends(unit: str, where: str = "TRUE") -> str:
    return f"""WITH {_IMAGES}
SELECT date_trunc('{unit}', capture_time)::TIMESTAMP AS interval_start, {_STATISTICS}, count(*) AS reading_count
FROM images WHERE {where} GROUP BY 1"""


def _daily(column: str) -> str:
    return f"""SELECT date_trunc('day', capture_time)::TIMESTAMP AS day, {_STATISTICS}
  FROM images WHERE {column} IS NOT NULL GROUP BY 1"""


def _ranked(column: str, order: str) -> str:
    """The best day by the average to nine decimals, the earliest of equals."""
    return f"""SELECT * EXCLUDE (rank) FROM (
    SELECT *, (SELECT round(avg({column}), 9) FROM images WHERE date_trunc('day', capture_time) = daily.day) AS rank
    FROM ({_daily(column)}) daily
  ) ORDER BY rank {order}, day LIMIT 1"""


def _record(column: str, order: str) -> str:
    return f"WITH {_IMAGES}\n{_ranked(column, order)}"


_RECORDS = f"""
records AS (
  SELECT * FROM (SELECT 'coldest_day' AS record, * FROM ({_ranked('temperature', 'ASC')}))
  UNION ALL BY NAME SELECT * FROM (SELECT 'hottest_day' AS record, * FROM ({_ranked('temperature', 'DESC')}))
  UNION ALL BY NAME SELECT * FROM (SELECT 'windiest_day' AS record, * FROM ({_ranked('wind_speed', 'DESC')}))
)"""


def _shown(name: str, value: str | None = None) -> str:
    value = value or name
    return f"CASE WHEN {value} <> 0 THEN format('{{:.1f}}', {value})::DOUBLE END AS {name}"


_DOCUMENT = f"""{_shown('avg_temp')}, {_shown('min_temp')}, {_shown('max_temp')}, temp_unit,
       {_shown('avg_wind')}, {_shown('min_wind')}, {_shown('max_wind')}, wind_unit, common_wind_dir"""

# Averages as they are shown.
_EXACT = f"""round(avg(temperature), 9) AS avg_temp, min(temperature) AS min_temp, max(temperature) AS max_temp,
       round(avg(wind_speed), 9) AS avg_wind, min(wind_speed) AS min_wind, max(wind_speed) AS max_wind,
       {_MODES}"""


def _bounded(stored: str, first: int, last: int) -> str:
    """The rows that storing positions ``first`` to ``last`` one by one would keep."""
    return f"""
tried AS (SELECT * FROM seq WHERE pos BETWEEN {first} AND {last}),
first_ids AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY pos) = 1),
fresh AS (
  SELECT * FROM first_ids
  WHERE source_id NOT IN (SELECT source_id FROM {stored}) AND file_hash NOT IN (SELECT file_hash FROM {stored})
),
kept AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY pos) = 1)"""


def _until_duplicate(last: int, stored: str | None = None) -> str:
    known = (
        f"OR source_id IN (SELECT source_id FROM {stored}) OR file_hash IN (SELECT file_hash FROM {stored})"
        if stored
        else ""
    )
    return f"""WITH {_SEQUENCE},
tried AS (SELECT * FROM seq WHERE pos <= {last}),
marked AS (
  SELECT *,
         row_number() OVER (PARTITION BY source_id ORDER BY pos) > 1
         OR row_number() OVER (PARTITION BY file_hash ORDER BY pos) > 1 {known} AS dup
  FROM tried
)
SELECT pos, source_id, file_hash FROM marked
WHERE pos < coalesce((SELECT min(pos) FROM marked WHERE dup), {last} + 1)"""


_WHOLE = 9223372036854775806

_FILES = """
files AS (
  SELECT event_id, ts, '/var/' || CASE event_id % 5 WHEN 0 THEN 'cam_sync_' WHEN 1 THEN 'other_sync_' WHEN 2 THEN 'db_schema_'
           WHEN 3 THEN 'db_data_' ELSE 'cam_sync_' END || event_id
           || CASE event_id % 5 WHEN 0 THEN '.log' WHEN 1 THEN '.log' WHEN 4 THEN '.txt' ELSE '.gz' END AS path
  FROM events
)"""

_PAGE_FILES = """
files AS (
  SELECT page_id, html, 'downloads/' || page_id AS path,
         ['.jpg', '.JPEG', '.png', '.gif', ''][page_id % 5 + 1] AS extension
  FROM pages WHERE html <> ''
)"""

# Captures made from scraped texts, and those of them that storing one by one would keep.
_SHOTS = f"""
inferred AS (
  SELECT event_id AS pos,
         CASE WHEN event_id % 11 = 0 THEN {_NOW}
              WHEN date_trunc('minute', ts) > {_NOW} THEN date_trunc('minute', ts) - INTERVAL 1 YEAR
              ELSE date_trunc('minute', ts) END::TIMESTAMP AS taken
  FROM events
),
shots AS (
  SELECT id AS pos, 'cam' || CASE WHEN id % 9 = 5 THEN id - 5 ELSE id END AS source_id,
         md5('hash' || CASE WHEN id % 7 = 3 THEN id - 1 ELSE id END) AS file_hash, cdn_url,
         primary_location, secondary_location
  FROM images
),
first_ids AS (SELECT * FROM shots QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY pos) = 1),
fresh AS (
  SELECT * FROM first_ids
  WHERE source_id NOT IN (SELECT source_id FROM images WHERE id % 4 = 0)
    AND file_hash NOT IN (SELECT md5('hash' || id) FROM images WHERE id % 4 = 0)
),
kept AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY pos) = 1),
read AS (
  SELECT source_id,
         CASE WHEN wind_direction = 'N' THEN 1.5::DOUBLE WHEN temperature <> 0 THEN temperature END AS temperature,
         CASE WHEN wind_direction = 'N' THEN 'K' WHEN temperature <> 0 THEN temperature_unit END AS temperature_unit,
         wind_speed, CASE WHEN wind_speed IS NOT NULL THEN wind_direction END AS wind_direction,
         primary_location AS sun_status, 'Phase ' || wind_direction AS moon_phase
  FROM images
),
parts AS (
  SELECT k.pos, k.source_id, k.file_hash, k.cdn_url, taken, strftime(taken, '%B %d, %Y %I:%M %p') AS stamp,
         k.primary_location IS NOT NULL AS placed, k.primary_location, k.secondary_location,
         r.temperature, r.temperature_unit, r.wind_speed, r.wind_direction, r.sun_status, r.moon_phase
  FROM kept k JOIN inferred USING (pos) JOIN read r ON r.source_id = k.source_id
),
taken AS (
  SELECT pos, source_id, cdn_url, taken AS capture_time,
         CASE WHEN placed THEN primary_location ELSE '' END AS primary_location,
         CASE WHEN placed THEN secondary_location ELSE '' END AS secondary_location,
         temperature, coalesce(temperature_unit, 'F') AS temperature_unit, wind_speed,
         coalesce(wind_direction, '') AS wind_direction,
         CASE WHEN wind_speed IS NOT NULL THEN 'mi per h' ELSE 'mph' END AS wind_unit,
         '{{"timestamp":"' || stamp || '"'
           || CASE WHEN placed THEN ',"location":{{"primary":"' || primary_location || '","secondary":"' || secondary_location || '"}}' ELSE '' END
           || CASE WHEN temperature IS NOT NULL THEN ',"temperature":{{"value":' || temperature || ',"unit":"' || temperature_unit || '"}}' ELSE '' END
           || CASE WHEN wind_speed IS NOT NULL THEN ',"wind":{{"direction":"' || wind_direction || '","speed":' || wind_speed || ',"unit":"mi per h"}}' ELSE '' END
           || CASE WHEN wind_speed IS NOT NULL THEN ',"pressure":{{"value":' || wind_speed || ',"unit":"inHg"}}' ELSE '' END
           || CASE WHEN sun_status IS NOT NULL THEN ',"sun_status":"' || sun_status || '"' ELSE '' END
           || ',"moon_phase":"' || moon_phase || '"}}' AS raw_metadata,
         {_NOW} AS created_at, {_NOW} AS updated_at, file_hash
  FROM parts
)"""

ORACLE_SQL: dict[str, str] = {
    # weather
    "weather_trends_hour": _trends("hour"),
    "weather_trends_day": _trends("day"),
    "weather_trends_week": _trends("week"),
    "weather_trends_range": _trends("hour", _RANGE),
    "coldest_day": _record("temperature", "ASC"),
    "hottest_day": _record("temperature", "DESC"),
    "windiest_day": _record("wind_speed", "DESC"),
    "daily_temps": f"WITH {_IMAGES} {_daily('temperature')}",
    "daily_winds": f"WITH {_IMAGES} {_daily('wind_speed')}",
    "weather_records": f"WITH {_IMAGES}, {_RECORDS} SELECT * FROM records",
    "record_documents": f"""WITH {_IMAGES}, {_RECORDS},
days AS (SELECT record, day, strftime(day, '%Y-%m-%dT%H:%M:%S') AS timestamp, {_DOCUMENT} FROM records)
SELECT d.* EXCLUDE (day), id, cdn_url, strftime(capture_time, '%Y-%m-%dT%H:%M:%S') AS capture_time
FROM days d JOIN images ON date_trunc('day', capture_time) = day""",
    "coldest_day_images": f"""WITH {_IMAGES}, coldest AS ({_ranked('temperature', 'ASC')})
SELECT c.day, id, cdn_url, strftime(capture_time, '%Y-%m-%dT%H:%M:%S') AS capture_time
FROM images JOIN coldest c ON date_trunc('day', capture_time) = c.day""",
    "weather_documents": f"""WITH {_IMAGES}, hourly AS (
  SELECT date_trunc('hour', capture_time)::TIMESTAMP AS t, {_EXACT}, count(*) AS reading_count
  FROM images GROUP BY 1
)
SELECT strftime(t, '%Y-%m-%dT%H:%M:%S') AS timestamp, {_DOCUMENT}, reading_count
FROM hourly""",
    "trends_info": f"""WITH {_IMAGES}
SELECT 'day' AS interval, count(DISTINCT date_trunc('day', capture_time)) AS total_intervals FROM images WHERE {_RANGE}""",
    # listing
    "scan_images": f"WITH {_IMAGES} SELECT {_LISTING} FROM images",
    "list_images_filtered": f"""WITH {_IMAGES}
SELECT {_LISTING} FROM images WHERE {_RANGE} AND {_PLACE}
ORDER BY temperature ASC NULLS LAST, id""",
    "page_images": f"""WITH {_IMAGES}
SELECT {_LISTING} FROM images ORDER BY temperature DESC NULLS FIRST, id LIMIT 20 OFFSET 20""",
    "page_images_deep": f"""WITH {_IMAGES}
SELECT {_LISTING} FROM images ORDER BY capture_time ASC NULLS LAST, id LIMIT 1000 OFFSET 6000""",
    "list_images_fallback": f"""WITH {_IMAGES}
SELECT {_LISTING} FROM images WHERE {_RANGE} ORDER BY capture_time, id""",
    "listing_info": f"""WITH {_IMAGES}
SELECT count(*) AS total_records, 'temperature' AS sort_by, 'desc' AS sort_order
FROM images WHERE {_RANGE} AND {_PLACE}""",
    "page_info": f"""WITH {_IMAGES}
SELECT count(*) AS total, 2::BIGINT AS page, 20::BIGINT AS per_page, ceil(count(*) / 20.0)::BIGINT AS total_pages
FROM images WHERE {_RANGE} AND {_PLACE}""",
    "count_images": "SELECT count(*) AS count FROM events",
    "image_by_id": f"WITH {_IMAGES} SELECT {_LISTING} FROM images WHERE id = 57",
    "images_by_ids": f"""WITH {_IMAGES}
SELECT {_LISTING}, list_position([53, 3, 9, 3, -1]::BIGINT[], id)::BIGINT AS position
FROM images WHERE id IN (53, 3, 9, 3, -1) ORDER BY position""",
    "locations": f"""WITH {_IMAGES}
SELECT DISTINCT primary_location, secondary_location FROM images WHERE primary_location IS NOT NULL""",
    "latest_source_id": f"""WITH {_IMAGES}
SELECT source_id FROM images ORDER BY created_at DESC NULLS FIRST, id LIMIT 1""",
    "all_images_by_created": f"WITH {_IMAGES} SELECT id, cdn_url FROM images ORDER BY created_at DESC, id",
    "not_null_temperature": f"WITH {_IMAGES} SELECT id, temperature FROM images WHERE temperature IS NOT NULL",
    "metadata_fields": f"""WITH {_IMAGES}
SELECT id, wind_speed AS pressure, CASE WHEN wind_speed IS NOT NULL THEN 'inHg' END AS pressure_unit,
       CASE id % 3 WHEN 0 THEN 'Sunny' WHEN 1 THEN 'Cloudy' ELSE '' END AS sun_status,
       CASE WHEN user_id % 7 <> 0 THEN 'Phase ' || (user_id % 7) END AS moon_phase
FROM images""",
    "image_labels": f"""WITH {_IMAGES}
SELECT id, strftime(capture_time, '%B %d, %I:%M %p') AS time_label,
       coalesce(primary_location, '') || ' - ' || secondary_location AS place_label,
       CASE WHEN temperature <> 0 THEN temperature || '°' || temperature_unit END AS temperature_label,
       CASE WHEN wind_speed <> 0 THEN wind_direction || ' ' || wind_speed || ' mph' END AS wind_label,
       CASE WHEN wind_speed IS NOT NULL THEN wind_speed || ' inHg' END AS pressure_label,
       CASE id % 3 WHEN 0 THEN 'Sunny' WHEN 1 THEN 'Cloudy' END AS sun_label,
       CASE WHEN user_id % 7 <> 0 THEN 'Phase ' || (user_id % 7) END AS moon_label
FROM images""",
    "image_documents": f"""WITH {_IMAGES}
SELECT {_LISTING.replace('capture_time, ', '').replace(', created_at', '')}, strftime(capture_time, '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN strftime(capture_time, '%f') <> '000000' THEN strftime(capture_time, '.%f') ELSE '' END AS capture_time,
       strftime(capture_time, '%B %d, %I:%M %p') AS capture_time_formatted,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN strftime(created_at, '%f') <> '000000' THEN strftime(created_at, '.%f') ELSE '' END AS created_at
FROM images""",
    "time_labels_with_year": f"""WITH {_IMAGES}
SELECT id, strftime(capture_time, '%B %d, %Y %I:%M %p') AS label FROM images""",
    "ids_from_texts": """
SELECT o_orderkey AS id, unnest([0, 1])::INTEGER AS place, unnest([o_orderkey, o_custkey]) AS listed FROM orders""",
    "images_in_id_table": f"""WITH {_IMAGES}
SELECT {_LISTING} FROM images WHERE id IN (SELECT doc_id FROM labels)""",
    "rounded_readings": f"""WITH {_IMAGES}
SELECT id, CASE WHEN temperature <> 0 THEN format('{{:.1f}}', temperature)::DOUBLE END AS temperature,
       CASE WHEN wind_speed <> 0 THEN format('{{:.1f}}', wind_speed)::DOUBLE END AS wind_speed
FROM images""",
    # tags
    "images_with_tags": f"""WITH {_TAGS}
SELECT id, source_id, capture_time, tag, coalesce(copies, 0) AS copies
FROM images LEFT JOIN tag_copies ON id = image_id""",
    "list_tagged_images": f"""WITH {_TAGS}
SELECT id, source_id, capture_time, tag, coalesce(copies, 0) AS copies
FROM images JOIN having_all USING (id) LEFT JOIN tag_copies ON id = image_id
WHERE capture_time >= {_LINK_START} ORDER BY created_at, id, tag""",
    "list_tagged_images_masked": f"""WITH {_TAGS}
SELECT id, capture_time, tag, coalesce(copies, 0) AS copies
FROM images JOIN having_all USING (id) LEFT JOIN tag_copies ON id = image_id AND capture_time >= {_LINK_START}""",
    "images_having_all_tags": f"WITH {_TAGS} SELECT i.* FROM images i WHERE id IN (SELECT id FROM having_all)",
    "tags_masked_outside_range": f"""WITH {_TAGS}
SELECT id, tag, coalesce(copies, 0) AS copies
FROM images LEFT JOIN tag_copies ON id = image_id AND capture_time >= {_LINK_START}""",
    "tag_rows": f"WITH {_TAGS} SELECT image_id, tag_id, name FROM links JOIN tags USING (tag_id)",
    "filter_tag_type": f"WITH {_TAGS} SELECT tag_id, name FROM tag_fields WHERE tag_type = 'animal'",
    "filter_tag_names": f"WITH {_TAGS} SELECT tag_id, name FROM tag_fields WHERE tag_name IN ('promo', 'small')",
    "tag_image_counts": f"""WITH {_TAGS}
SELECT name, count(DISTINCT image_id) AS image_count FROM links JOIN tags USING (tag_id) GROUP BY name""",
    "available_tags": f"""WITH {_TAGS},
per_text AS (
  SELECT name, any_value(tag_name) AS animal_name, count(DISTINCT image_id) AS image_count
  FROM links JOIN tag_fields USING (tag_id) WHERE tag_type = 'animal' GROUP BY name
)
SELECT animal_name, sum(image_count)::BIGINT AS total_count FROM per_text GROUP BY 1
ORDER BY total_count DESC, animal_name""",
    "tags_parsed": f"""WITH {_TAGS}
SELECT image_id, tag_type AS type, tag_name AS name, CAST(name::JSON ->> '$.count' AS DOUBLE) AS count,
       name::JSON ->> '$.display' AS display
FROM links JOIN tag_fields USING (tag_id)""",
    "untagged_images": f"""WITH {_TAGS}
SELECT id, cdn_url FROM untagged ORDER BY created_at DESC NULLS FIRST, id LIMIT 20""",
    "all_untagged_images": f"WITH {_TAGS} SELECT * FROM untagged",
    "count_untagged": f"WITH {_TAGS} SELECT count(*) AS count FROM untagged",
    "tagging_progress": f"""WITH {_TAGS},
batch AS (SELECT id, cdn_url FROM untagged)
SELECT count(*) AS found, count(*) FILTER (WHERE length(cdn_url) % 3 > 0) AS processed,
       (SELECT count(*) FROM untagged) - count(*) FILTER (WHERE length(cdn_url) % 3 > 0) AS remaining
FROM batch""",
    "next_tagging_batch": f"""WITH {_TAGS}
SELECT id, cdn_url FROM untagged""",
    "next_tagging_batch_new": f"""WITH {_TAGS}
SELECT id, cdn_url FROM images WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    # changes
    "remove_tag_kept": f"""WITH {_TAGS}
SELECT image_id, tag_id FROM links
WHERE NOT (image_id = 7 AND tag_id IN (SELECT tag_id FROM tag_fields WHERE tag_name = 'economy'))""",
    "remove_tag_removed": f"""WITH {_TAGS}
SELECT image_id, tag_id FROM links
WHERE image_id = 7 AND tag_id IN (SELECT tag_id FROM tag_fields WHERE tag_name = 'economy')""",
    "remove_tag_remaining": f"""WITH {_TAGS}
SELECT tag_id, name FROM links JOIN tag_fields USING (tag_id) WHERE image_id = 7 AND tag_name <> 'economy'""",
    "replace_tags": f"""WITH {_TAGS},
new_links AS (SELECT l_orderkey AS image_id, l_suppkey AS tag_id FROM lineitem WHERE l_returnflag = 'R')
SELECT image_id, tag_id FROM links WHERE image_id NOT IN (SELECT image_id FROM new_links)
UNION ALL SELECT image_id, tag_id FROM new_links""",
    "missing_tags": f"""WITH {_TAGS},
wanted AS (
  SELECT DISTINCT {_PART_TAG % ("'animal'", "l_quantity::BIGINT", "l_quantity::BIGINT")} AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey
)
SELECT name FROM wanted WHERE name NOT IN (SELECT name FROM tags)""",
    "upsert_tags": f"""WITH {_TAGS},
wanted AS (
  SELECT DISTINCT {_PART_TAG % ("'animal'", "l_quantity::BIGINT", "l_quantity::BIGINT")} AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey
)
SELECT name, tag_id AS old_id, TRUE AS "unique" FROM tags
UNION ALL SELECT name, NULL, TRUE FROM wanted WHERE name NOT IN (SELECT name FROM tags)""",
    "upsert_tag_ids": f"""WITH {_TAGS},
wanted AS (
  SELECT DISTINCT {_PART_TAG % ("'animal'", "l_quantity::BIGINT", "l_quantity::BIGINT")} AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
added AS (SELECT count(*) AS n FROM wanted WHERE name NOT IN (SELECT name FROM tags))
SELECT count(*) + any_value(n) AS n, count(DISTINCT tag_id) + any_value(n) AS ids, max(tag_id) + any_value(n) AS highest
FROM tags, added""",
    "tag_answers": f"""WITH {_TAGS}, {_ANSWERS}
SELECT image_id, name FROM links JOIN tags USING (tag_id)
WHERE image_id NOT IN (SELECT image_id FROM answer_tags)
UNION ALL SELECT image_id, tag_json AS name FROM answer_tags""",
    "retag_all": f"WITH {_ANSWERS} SELECT image_id, tag_json AS name FROM answer_tags",
    "tag_next_batch": f"""WITH {_TAGS},
batch AS (SELECT id, cdn_url FROM untagged)
SELECT image_id, name FROM links JOIN tags USING (tag_id)
UNION ALL
SELECT id, {_DEER_TAG} FROM batch WHERE length(cdn_url) % 3 > 0""",
    "retag_images": f"""WITH {_TAGS}
SELECT id AS image_id, {_DEER_TAG} AS name FROM images WHERE length(cdn_url) % 3 > 0""",
    "update_images": f"""WITH {_IMAGES}
SELECT {_ALL_COLUMNS.replace(' temperature,', '').replace(', updated_at', '')},
       CASE WHEN temperature = 0 THEN 1.5::DOUBLE ELSE temperature END AS temperature,
       CASE WHEN temperature = 0 THEN {_NOW} ELSE created_at END AS updated_at
FROM images""",
    # checks
    "duplicate_keys": f"""WITH {_SEQUENCE}
SELECT file_hash, count(*) AS count FROM seq GROUP BY 1 HAVING count(*) > 1""",
    "null_violations": f"""WITH {_IMAGES}
SELECT 'primary_location' AS "column", count(*) AS violations FROM images WHERE primary_location IS NULL
UNION ALL SELECT 'temperature', count(*) FROM images WHERE temperature IS NULL""",
    "length_violations": f"""WITH {_IMAGES}
SELECT 'primary_location' AS "column", count(*) AS violations FROM images WHERE length(primary_location) > 5
UNION ALL SELECT 'secondary_location', count(*) FROM images WHERE length(secondary_location) > 4""",
    "orphan_links": f"""WITH {_TAGS}
SELECT image_id, tag_id, 'image' AS missing FROM links
WHERE image_id NOT IN (SELECT id FROM images WHERE capture_time >= {_LINK_START})
UNION ALL
SELECT image_id, tag_id, 'tag' FROM links WHERE tag_id NOT IN (SELECT tag_id FROM tag_fields WHERE tag_type = 'animal')""",
    "orphan_tags": f"""WITH {_TAGS}
SELECT tag_id, name FROM tags
WHERE tag_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-03-01')""",
    # ingest
    "file_hash": "SELECT doc_id, md5(text) AS file_hash FROM documents",
    "new_captures": f"""WITH {_SEQUENCE}
SELECT pos, source_id, file_hash FROM seq
WHERE source_id NOT IN (SELECT source_id FROM labelled) AND file_hash NOT IN (SELECT file_hash FROM labelled)""",
    "dedupe_run": f"""WITH {_SEQUENCE}
SELECT * FROM seq QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY pos) = 1""",
    "accepted_captures": f"WITH {_SEQUENCE}, {_bounded('rejected', 0, _WHOLE)} SELECT * FROM kept",
    "take_until_duplicate": _until_duplicate(_WHOLE),
    "incremental_batch": _until_duplicate(_WHOLE, "rejected"),
    "incremental_batch_forced": f"WITH {_SEQUENCE}, {_bounded('labelled', 0, _WHOLE)} SELECT * FROM kept",
    "backfill_batch": f"WITH {_SEQUENCE}, {_bounded('labelled', 31, _WHOLE)} SELECT * FROM kept",
    "ingest_captures": f"""WITH {_IMAGES}, {_SHOTS}
SELECT * EXCLUDE (pos) FROM taken""",
    "ingest_ids": f"""WITH {_IMAGES}, {_SHOTS},
highest AS (SELECT max(id) AS id FROM images WHERE id % 4 = 0)
SELECT count(*) AS n, count(*) AS ids, any_value(highest.id) + 1 AS first, any_value(highest.id) + count(*) AS last
FROM taken, highest""",
    # sources and sinks
    "scan_stored_images": f"WITH {_IMAGES} SELECT {_LISTING} FROM images WHERE {_RANGE}",
    "scan_stored_tags": f"WITH {_TAGS} SELECT tag_id, name FROM tags",
    "scan_stored_links": f"WITH {_TAGS} SELECT image_id, tag_id FROM links",
    "append_images": f"""WITH {_IMAGES}, {_SHOTS}
SELECT source_id, md5('hash' || id) AS file_hash, temperature, wind_unit, capture_time FROM images WHERE id % 4 = 0
UNION ALL BY NAME SELECT source_id, file_hash, temperature, wind_unit, capture_time FROM taken""",
    "snapshot_round_trip": f"WITH {_IMAGES} SELECT {_ALL_COLUMNS} FROM images",
    "rejected_media": """
SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.jpg' WHEN 'fr' THEN '.PNG' WHEN 'de' THEN '.gif' ELSE '.Jpeg' END
         AS path,
       n_chars * 1000 AS length,
       CASE WHEN n_chars * 1000 > 10485760 THEN 'too large' ELSE 'not a picture type' END AS reason
FROM documents WHERE lang = 'de' OR n_chars * 1000 > 10485760""",
    "file_kinds": f"""WITH {_FILES}
SELECT path, CASE event_id % 5 WHEN 0 THEN 'log' WHEN 2 THEN 'schema' WHEN 3 THEN 'data' END AS kind FROM files""",
    "expired_files": f"""WITH {_FILES}
SELECT path FROM files WHERE event_id % 5 = 0 AND ts < {_NOW} - INTERVAL 7 DAY""",
    "infer_capture_time": f"""
SELECT event_id AS id,
       CASE WHEN event_id % 11 = 0 THEN {_NOW}
            WHEN date_trunc('minute', ts) > {_NOW} THEN date_trunc('minute', ts) - INTERVAL 1 YEAR
            ELSE date_trunc('minute', ts) END::TIMESTAMP AS capture_time
FROM events""",
    "parse_capture_time": f"""
SELECT event_id AS id,
       CASE WHEN event_id % 11 = 0 THEN {_NOW}
            ELSE strptime(strftime(ts, '%B %d, %Y %I:%M %p'), '%B %d, %Y %I:%M %p') END::TIMESTAMP AS capture_time
FROM events""",
    "pivot_readings": f"""WITH {_IMAGES}
SELECT source_id,
       CASE WHEN wind_direction = 'N' THEN 1.5::DOUBLE WHEN temperature <> 0 THEN temperature END AS temperature,
       CASE WHEN wind_direction = 'N' THEN 'K' WHEN temperature <> 0 THEN temperature_unit ELSE 'F' END AS temperature_unit,
       wind_speed,
       CASE WHEN wind_speed IS NOT NULL THEN wind_direction ELSE '' END AS wind_direction,
       CASE WHEN wind_speed IS NOT NULL THEN 'mi per h' ELSE 'mph' END AS wind_unit,
       wind_speed AS pressure, CASE WHEN wind_speed IS NOT NULL THEN 'inHg' END AS pressure_unit,
       primary_location AS sun_status, 'Phase ' || wind_direction AS moon_phase
FROM images""",
    "source_id_from_url": """
SELECT page_id, split_part(split_part(split_part(url, '?', 1), '/', -1), '.', 1) AS source_id FROM pages""",
    "publish_url": """
WITH files AS (
  SELECT page_id, url, md5(html) AS file_hash, ['.jpg', '.JPEG', '.png', '.gif', ''][page_id % 5 + 1] AS extension
  FROM pages
)
SELECT page_id,
       'https://cdn.example.com/images/' || split_part(split_part(split_part(url, '?', 1), '/', -1), '.', 1)
         || '_' || file_hash || extension AS cdn_url,
       CASE lower(extension) WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png'
         WHEN '.gif' THEN 'image/gif' ELSE 'application/octet-stream' END AS mime_type
FROM files""",
    "valid_media": """
SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.jpg' WHEN 'fr' THEN '.PNG' ELSE '.Jpeg' END AS path,
       n_chars * 1000 AS length
FROM documents WHERE lang <> 'de' AND n_chars * 1000 <= 10485760""",
    "keep_latest": f"""WITH {_IMAGES}
SELECT id, primary_location, created_at FROM images
QUALIFY row_number() OVER (PARTITION BY primary_location ORDER BY created_at DESC NULLS FIRST, id) <= 7""",
    "expired_rows": f"""WITH {_IMAGES}
SELECT id, created_at FROM images WHERE created_at < {_NOW} - INTERVAL 7 DAY""",
    # answers
    "tag_counts_from_analysis": f"WITH {_ANSWERS} SELECT * FROM answer_tags",
    "tags_unmerged": f"""WITH {_ANSWERS}
SELECT image_id, 'animal' AS type, lower(animal) AS name, CAST(n AS DOUBLE) AS count, animal || ' ' || n AS display,
       '{{"type": "animal", "name": "' || lower(animal) || '", "count": ' || n || ', "display": "' || animal || ' ' || n || '"}}' AS tag_json
FROM positive
UNION ALL
SELECT image_id, 'animal', 'buck', NULL, 'Buck', '{{"type": "animal", "name": "buck", "count": null, "display": "Buck"}}'
FROM positive WHERE lower(animal) = 'deer'""",
    "score_images": """
SELECT doc_id AS image_id,
       '{"Words": ' || len(string_split(text, ' ')) || ', "total": ' || length(text) || '}' AS answer,
       TRUE AS ok, CAST(NULL AS VARCHAR) AS error
FROM documents""",
    "score_images_failing": """
WITH counted AS (SELECT doc_id, length(text) % 5 = 0 AS gone, len(string_split(text, ' ')) AS words FROM documents)
SELECT doc_id AS image_id,
       CASE WHEN gone THEN NULL WHEN words % 7 = 0 THEN '{}' ELSE '{"Words": ' || words || '}' END AS answer,
       NOT gone AND words % 7 <> 0 AS ok,
       CASE WHEN gone THEN 'not found' WHEN words % 7 = 0 THEN 'no answer' END AS error
FROM counted""",
    # streams
    "trends_stream_hour": _trends("hour"),
    "trends_stream_week": _trends("week"),
    "distinct_stream": "SELECT DISTINCT md5(text) AS file_hash FROM documents",
    "ingest_stream": f"""WITH {_IMAGES}, {_SHOTS}
SELECT source_id, md5('hash' || id) AS file_hash, temperature, wind_unit, capture_time, created_at
FROM images WHERE id % 4 = 0
UNION ALL BY NAME
SELECT k.source_id, k.file_hash, i.temperature, i.wind_unit, i.capture_time, {_NOW} AS created_at
FROM kept k JOIN images i ON i.id = k.pos""",
    # files
    "media_files": f"""WITH {_PAGE_FILES}
SELECT path || extension AS path, octet_length(encode(html)) AS length, md5(html) AS file_hash
FROM files WHERE extension IN ('.jpg', '.JPEG', '.png')""",
    "media_manifest": f"""WITH {_PAGE_FILES}
SELECT page_id || extension AS name, path || extension AS path, path || extension AS shown_path
FROM files WHERE extension <> ''""",
    # runs with bounds
    "incremental_batch_bounded": f"""WITH {_SEQUENCE}, {_bounded('labelled', 0, 200)}
SELECT * FROM kept ORDER BY pos LIMIT 300""",
    "backfill_batch_bounded": f"""WITH {_SEQUENCE}, {_bounded('labelled', 31, 230)}
SELECT * FROM kept ORDER BY pos LIMIT 20""",
}

# The same rows from tables stored in another way.
ORACLE_SQL |= {
    stored: ORACLE_SQL[plain]
    for stored, plain in {
        "coldest_day_images_stored": "coldest_day_images",
        "images_with_tags_bucketed": "images_with_tags",
        "remove_tag_published": "remove_tag_kept",
        "retag_all_published": "retag_all",
        "accepted_captures_indexed": "accepted_captures",
        "score_images_batched": "score_images",
    }.items()
}
