"""Line dedup: drop lines that repeat across documents, DataFrame functions only.

Hashes of line keys are range-partitioned by (hash, document), sorted by position within, and
streamed: the first occurrence in each document counts that document once. A hash in a third of
all documents spans several ranges, so no task gathers it; what leaves a range is one
row per hash. The result is a compressed bitmap per document, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailtally.llm.common import LOWER, SPACE, UPPER, keep

MIN_CHARS = 40
MIN_DOCS = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lower(key: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the shorter way."""
    ascii_only = F.octet_length(key) == F.char_length(key)
    return F.when(ascii_only, F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """Names a row by id and text, so rows that repeat an id keep their own lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t1"), F.xxhash64(text, F.lit(1)).alias("_t2")]


def line_occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(_id, _t1, _t2, pos, _h1, _h2) of every line whose key is long enough."""
    lines = docs.select(*_row_key(id_col, text_col), F.posexplode(_lines(F.col(text_col))).alias("pos", "_line"))
    key = F.trim(F.col("_line"), F.lit(SPACE))
    long_enough = lines.withColumn("_key", key).filter(F.char_length("_key") >= min_chars)
    low = long_enough.withColumn("_key", _lower(F.col("_key")))
    return low.select(
        "_id", "_t1", "_t2", "pos", F.xxhash64("_key").alias("_h1"), F.xxhash64("_key", F.lit(1)).alias("_h2")
    )


def repeated_lines(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """(_h1, _h2, _keeper) of the hashes in at least ``min_docs`` documents; the largest id keeps."""
    place = Window.partitionBy("_h1", "_h2", "_id").orderBy("pos")
    streamed = (
        occurrences.select("_h1", "_h2", "_id", "pos")
        .repartitionByRange("_h1", "_h2", "_id")
        .withColumn("_nth", F.row_number().over(place))
    )
    return (
        streamed.groupBy("_h1", "_h2")
        .agg(F.count_if(F.col("_nth") == 1).alias("_docs"), F.max("_id").alias("_keeper"))
        .filter(F.col("_docs") >= min_docs)
        .select("_h1", "_h2", "_keeper")
    )


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """One row (_id, _t1, _t2, keep_bitmap, n_dropped) per document that loses lines.

    ``keep_bitmap`` maps a word number to 64 bits, one per line, set where the line stays;
    words without a dropped line are left out. Rows are named by id and two hashes of the text.
    Rows that share an id are one document for counting and each keeps its own lines. A null id
    is a document of its own, smaller than all others. Empty tables give no rows.
    """
    occurrences = keep(line_occurrences(docs, id_col, text_col, min_chars))
    # Stored, so that a line of very many documents is split among tasks where the two are joined.
    repeated = keep(repeated_lines(occurrences, min_docs))
    dropped = occurrences.join(repeated, ["_h1", "_h2"]).filter(~F.col("_id").eqNullSafe(F.col("_keeper")))
    word = F.floor(F.col("pos") / 64).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos") % 64)
    words = (
        dropped.select("_id", "_t1", "_t2", word.alias("_word"), bit.alias("_bit"))
        .groupBy("_id", "_t1", "_t2", "_word")
        .agg(F.bit_or("_bit").alias("_bits"))
    )
    return words.groupBy("_id", "_t1", "_t2").agg(
        F.map_from_entries(F.collect_list(F.struct("_word", F.bitwise_not("_bits")))).alias("keep_bitmap"),
        F.sum(F.bit_count("_bits")).cast("bigint").alias("n_dropped"),
    )


def _stays(bitmap: Column, pos: Column) -> Column:
    bits = F.try_element_at(bitmap, F.floor(pos / 64).cast("int"))
    return F.coalesce(F.call_function("shiftright", bits, pos % 64).bitwiseAND(F.lit(1).cast("bigint")) == 1, F.lit(True))


def _cleaned(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(_doc, _text, _n_lines, _n_dropped): each row as one struct, so no name of it can clash."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    found = bitmaps.select(
        F.col("_id").alias("_bid"), F.col("_t1").alias("_b1"), F.col("_t2").alias("_b2"),
        "keep_bitmap", F.col("n_dropped").alias("_lost"),
    )
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), *_row_key(id_col, text_col))
    same = F.col("_id").eqNullSafe(F.col("_bid")) & (F.col("_t1") == F.col("_b1")) & (F.col("_t2") == F.col("_b2"))
    joined = rows.join(found, same, "left")
    lines = _lines(F.col(f"_doc.{text_col}"))
    kept = F.array_join(F.filter(lines, lambda line, pos: _stays(F.col("keep_bitmap"), pos)), "\n")
    whole = F.coalesce(F.col(f"_doc.{text_col}"), F.lit(""))
    text = F.when(F.col("keep_bitmap").isNull(), whole).otherwise(kept)
    return joined.select(
        "_doc",
        text.alias("_text"),
        F.size(lines).cast("bigint").alias("_n_lines"),
        F.coalesce("_lost", F.lit(0)).cast("bigint").alias("_n_dropped"),
    )


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``docs`` with the lines that stay as text, and ``n_lines`` and ``n_dropped`` as new columns.

    Columns of those names are replaced. A null text is one empty line and comes back empty.
    """
    new = {text_col: "_text", "n_lines": "_n_lines", "n_dropped": "_n_dropped"}
    old = [F.col("_doc")[name].alias(name) for name in docs.columns if name not in new]
    found = _cleaned(docs, id_col, text_col, min_chars, min_docs)
    return found.select(*old, *[F.col(made).alias(name) for name, made in new.items()])


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that stays."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return drop_repeated_lines(slim).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """Documents without their repeated lines, with their own columns and a new ``n_chars``.

    Every row stays, repeated ones too; one that loses all lines has an empty text, and so has
    one whose text is null. Other columns keep name, place and value, whatever they are called,
    and nulls in them say nothing. An empty table stays empty.
    """
    made = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("bigint")}
    found = _cleaned(docs, "doc_id", "text", MIN_CHARS, MIN_DOCS)
    return found.select(*[made.get(name, F.col("_doc")[name]).alias(name) for name in docs.columns])


LINE_DEDUP_SQL = """
WITH doc_lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM doc_lines
), repeated AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
    SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS dropped
    FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
