"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the forms they stand for.

Of two words that differ by one edit, one contributes two disjoint chunks, its halves, and the
other its positional grams of those lengths. One edit leaves one of the chunks whole, and moves it
by no more than one place: by as much as the words differ in length. So words join on the text of
a chunk with a shift within one, and what the chunk leaves of both words is one edit apart.

A chunk that many words share would meet all its grams. Such words are not paired: what is left
of them is divided into two chunks and grams again, as often as needed, so that there are never
more pairs than a fixed multiple of the rows. What remains is verified on whole words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailtally.llm.common import keep, table
from trailtally.session import pin

MIN_CHARS = 6
MIN_COUNT = 5
# A word is a variant of a near word that occurs so many times as often.
DOMINANCE = 5
# One in so many runs loses a code point.
SLIP = 199
# More pairs of a key than so many for each of its rows are divided further.
PAIRS_PER_ROW = 16
# Words that a task counts before it passes them on.
COUNTED = 400_000

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def runs_of(name: bytes, text: bytes) -> Iterator[tuple[str, int]]:
    """(word, times) of the distinct runs of a text; some lose a code point by the hash of ``name`` and run.

    Bytes lower-case A-Z only, as the contract wants.
    """
    start = crc32(name + b":")
    for run, times in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
        h = crc32(run.encode(), start)
        if h % SLIP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, times


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n): occurrences of words of at least ``min_chars`` code points in (doc_id, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            words = pa.array(list(found), pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return made

        for batch in batches:
            names, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            for name, text in zip(names, texts):
                for word, times in runs_of((name.as_py() or "").encode(), text.as_py() or b""):
                    if len(word) >= min_chars:
                        found[word] += times
                if len(found) >= COUNTED:
                    yield passed_on()
        yield passed_on()

    slim = docs.select(F.col("doc_id").cast("string").alias("name"), "text")
    return slim.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _head(text: Column, size: Column) -> Column:
    return F.substring(text, F.lit(1), size)


def _tail(text: Column, start: Column) -> Column:
    """``text`` from the 0-based place ``start`` on."""
    return F.substring(text, start + 1, F.char_length(text))


def _chunked(rows: DataFrame) -> DataFrame:
    """(key, word, n, rest, shift) after taking each of the two chunks out of ``rest``.

    ``shift`` is null on the side of the chunks, and on the side of the grams tells by how much a
    word is longer than those it is to meet. A gram lies where a whole chunk would: at the front, or
    moved by the shift at the back.
    """
    longer = F.coalesce("shift", F.lit(0))
    size = F.char_length("rest") - longer
    half = F.floor(size / 2).cast("int")
    back = half + longer
    front_key = F.xxhash64("key", size, F.lit(0), _head(F.col("rest"), half))
    back_key = F.xxhash64("key", size, F.lit(1), _tail(F.col("rest"), back))
    parts = F.array(
        F.struct(front_key.alias("key"), _tail(F.col("rest"), half).alias("rest")),
        F.struct(back_key.alias("key"), _head(F.col("rest"), back).alias("rest")),
    )
    return rows.select("word", "n", "shift", F.inline(parts)).select("key", "word", "n", "rest", "shift")


def _paired(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of the chunks and grams that meet under the keys of ``sizes``."""
    here = rows.join(sizes.select("key"), "key", "left_semi")
    chunks = here.filter(F.col("shift").isNull()).select("key", "word", "n", F.col("rest").alias("_rest"))
    grams = here.filter(F.col("shift").isNotNull()).select(
        "key", F.col("word").alias("other"), F.col("n").alias("other_n"), "rest", "shift"
    )
    # Words of one length meet both ways, so one way is enough.
    once = (F.col("shift") == 1) | (F.col("word") < F.col("other"))
    one_edit = F.levenshtein("_rest", "rest", 1) == 1
    return chunks.join(grams, "key").filter(once & one_edit).select("word", "n", "other", "other_n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways, of all words (word, n) that are one edit apart."""
    length = F.char_length("word")
    sides = F.array(*[F.lit(x).cast("int") for x in (None, 0, 1)])
    rows = words.select("word", "n", F.col("word").alias("rest"), F.explode(sides).alias("shift"))
    # Words longer by one meet those of their length less one.
    rows = rows.withColumn("key", (length - F.coalesce("shift", F.lit(0))).cast("bigint"))
    found = None
    while True:
        rows = keep(_chunked(rows))
        chunks, grams = F.count_if(F.col("shift").isNull()), F.count_if(F.col("shift").isNotNull())
        left = F.max(F.when(F.col("shift").isNull(), F.char_length("rest")))
        sizes = rows.groupBy("key").agg(chunks.alias("c"), grams.alias("g"), left.alias("left"))
        sizes = keep(sizes.filter((F.col("c") > 0) & (F.col("c") + F.col("g") > 2)))
        # What is left of one character or less has no more words than there are letters.
        crowded = (F.col("c") * F.col("g") > PAIRS_PER_ROW * (F.col("c") + F.col("g"))) & (F.col("left") > 1)
        pairs = _paired(rows, sizes.filter(~crowded))
        found = pairs if found is None else found.unionByName(pairs)
        again = sizes.filter(crowded)
        if again.isEmpty():
            break
        rows = rows.join(again.select("key"), "key", "left_semi")
    links = found.distinct().filter(F.levenshtein("word", "other", 1) == 1)
    back = links.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")
    )
    return links.unionByName(back)


def _roots(words: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form) that have a form: the end of the chain of forms.

    Each round doubles the steps taken. A form is so much more frequent than its word that a chain
    is no longer than the logarithm of the highest count.
    """
    current = pin(words.select("word", F.col("form").alias("root"), F.lit(False).alias("done")))
    while not current.filter(~F.col("done")).isEmpty():
        further = current.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        current = pin(
            current.join(further, "root", "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNull().alias("done")
            )
        )
    return current.select("word", "root")


def variant_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    dominance: int = DOMINANCE,
) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) per word of at least ``min_chars`` and ``min_count``.

    ``n_near`` counts the words one edit away; ``form`` is the most frequent of them, of equals the
    smallest in code-point order, where it occurs ``dominance`` times as often as the word, else
    null; ``root`` is where forms of forms end, or the word itself. A null or empty text has no
    words, a null id counts as an empty one, and repeated rows count again. An empty
    table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words = keep(word_counts(slim, min_chars).filter(F.col("n") >= min_count))
    best = F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), "other"))
    nears = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    dominant = F.col("_best.other_n") >= dominance * F.col("n")
    formed = keep(
        words.join(nears, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(dominant, F.col("_best.other")).alias("form"),
            F.when(dominant, F.col("_best.other_n")).alias("form_n"),
        )
    )
    roots = _roots(formed.filter(F.col("form").isNotNull()).select("word", "form"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(spark, folder: str) -> DataFrame:
    return variant_groups(table(spark, folder, "documents"))


# Fixed values stand in the text: 6 code points, 5 occurrences, one slip in 199, and a form 5 times as frequent.
SPELLING_SQL = r"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents
), counted AS (
    SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS spelled
    FROM runs GROUP BY ALL
), hashed AS (
    SELECT run, times,
           xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(range(1, len(spelled), 2),
                   lambda i: 16 * (instr('0123456789ABCDEF', spelled[i]) - 1) + instr('0123456789ABCDEF', spelled[i + 1]) - 1)),
               lambda crc, byte: list_reduce(
                   list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                   lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))
           ), 4294967295::BIGINT) AS h
    FROM counted
), slipped AS (
    SELECT CASE WHEN h % 199 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, times FROM hashed
), words AS (
    SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE len(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), gaps AS (
    SELECT word, n, unnest(range(0, len(word))) AS place FROM words
), cuts AS (
    SELECT word, n, place, word[:place] || ' ' || word[place + 2:] AS hole, word[:place] || word[place + 2:] AS cut FROM gaps
), links AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.hole = b.hole AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
    UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n
    FROM links GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
           CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n
    FROM words w LEFT JOIN best b USING (word)
), steps AS (
    SELECT word, word AS root, form AS ahead FROM formed
    UNION ALL
    SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON f.word = s.ahead
)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM formed f JOIN steps s ON s.word = f.word AND s.ahead IS NULL
"""
