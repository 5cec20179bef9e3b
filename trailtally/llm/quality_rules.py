"""Quality rules: base counts, and bands of n-gram perplexity per language.

The language model is a modified Kneser-Ney model of the bytes of running text, in which one space
stands between words, so the first characters of a word are judged after the end of the word before.
All bytes are told apart, as contexts and as what follows them. A byte is found in two steps of 64
ways each: its class after the three bytes before it, and its place in the class after these bytes
and the class; letters a-z and the space are classes of their own and take one step. A code names a
step's context and its way, so codes of one context are 64 in a row.

Texts are read once. What later steps need is stored by blocks of documents of one task: the base
counts, words as numbers, the block's words, and the block's codes with their counts. Spark counts the
codes of all blocks and works out the levels of the model by joins, so no task, and not the driver,
holds a model: a block gets the costs of its own codes. Only the first two bytes of a word depend
on the word before, and they on its last two: what follows is worked out once for each word of a
block, and these once for each meeting of ends and beginnings.

A document's measure is its mean cost per word in bits, the logarithm of its perplexity per word.
Documents outside their language's band around the median are rejected; the band is wider for short
documents, whose means scatter more. Every language has one, drawn towards that of all documents by
how few documents it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, ByteType, LongType, StringType, StructField, StructType

from trailtally.llm.common import BoundedCache, keep, table
from trailtally.llm.words import WordRows, coded_word_groups, hash64, mix64, sums_between

ORDER = 4
SYMBOLS = 64
END = ord(" ")
# Stands before the first word; no word has this byte.
START = ord("\n")
# Bits of a way, and of a class with the way: a code is the bytes before, 0 or the class plus 1, and the way.
WAY = 6
STEP = 13
# Bytes of a word whose 4-gram reaches into the word before.
JOINED = 2
# Different words and joints, and words in all, that a block has before it ends; languages whose
# costs a task holds.
MOST_WORDS = 500_000
MOST_JOINTS = 1 << 20
MOST_TEXT = 1 << 24
MOST_LANGUAGES = 32

# The base rules of the query.
MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PERCENT = 30
SYMBOL_BYTES = b"#*$%&|<>"

# Half the width of a band: so many deviations of one word's cost over the root of the word
# count, and so many bits besides.
DEVIATIONS = 5.0
BITS = 0.3
# The figures of all documents count as much as so many of a language's own.
POOLED_DOCS = 50
BIN = 0.02

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Whether a byte begins a character, and whether it is one of the symbols.
_CHARS = (np.arange(256) < 0x80) | (np.arange(256) >= 0xC0)
_RARE = np.isin(np.arange(256), list(SYMBOL_BYTES))

# Kinds of stored rows.
WORDS, TEXTS, DOC, GRAM = range(4)


def _alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte, its place in the class, and whether others are in it.

    Classes are the space, letters a-z, one for A-Z, one for digits, and others by their remainder.
    """
    classes = np.zeros(256, np.int64)
    for byte in range(256):
        char = chr(byte)
        if char == " ":
            classes[byte] = 1
        elif "a" <= char <= "z":
            classes[byte] = 2 + byte - ord("a")
        elif "A" <= char <= "Z":
            classes[byte] = 28
        elif "0" <= char <= "9":
            classes[byte] = 29
        elif byte < 0x80:
            classes[byte] = 30 + byte % 17
        else:
            classes[byte] = 47 + byte % 17
    places = np.array([np.count_nonzero(classes[:byte] == classes[byte]) for byte in range(256)], np.int64)
    return classes, places, np.bincount(classes, minlength=SYMBOLS)[classes] > 1


_CLASSES, _PLACES, _SHARED = _alphabet()


def step_codes(before: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of bytes after the three before them, and the borders of each byte's codes."""
    borders = np.append(0, np.cumsum(1 + _SHARED[found]))
    codes = np.repeat(before << STEP, np.diff(borders))
    codes[borders[:-1]] |= _CLASSES[found]
    shared = found[_SHARED[found]]
    codes[borders[:-1][_SHARED[found]] + 1] |= ((1 + _CLASSES[shared]) << WAY) | _PLACES[shared]
    return codes, borders


def shortened(codes: np.ndarray | Column, size: int) -> np.ndarray | Column:
    """The codes of the same steps after all but the last ``size - 1`` bytes are forgotten."""
    kept = (1 << (STEP + 8 * (size - 1))) - 1
    return codes.bitwiseAND(F.lit(kept).cast("bigint")) if isinstance(codes, Column) else codes & kept


def _line(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a running text after ORDER - 1 that stand before it, and words' borders in it."""
    borders = np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))
    text = bytes([START] * (ORDER - 2) + [END]) + b" ".join(words) + b" " * bool(words)
    return np.frombuffer(text, np.uint8).astype(np.int64), borders


def word_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a running text, one or two for each byte and space, and words' borders.

    Each word is followed by a space, and the first one also comes after a space.
    """
    line, borders = _line(words)
    codes, starts = step_codes(line[:-3] << 16 | line[1:-2] << 8 | line[2:-1], line[3:])
    return codes, starts[borders]


def inner_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of words that hold whatever word stands before, and words' borders."""
    line, borders = _line(words)
    inner = np.ones(borders[-1], bool)
    for k in range(JOINED):
        inner[borders[:-1] + k] = False
    before = line[:-3] << 16 | line[1:-2] << 8 | line[2:-1]
    codes, starts = step_codes(before[inner], line[3:][inner])
    return codes, starts[borders - JOINED * np.arange(len(borders))]


def word_ends(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last two bytes of words as numbers; a word of one byte has a space there."""
    line, borders = _line(words)
    pairs = (line[:-1] << 8 | line[1:]).astype(np.uint16)
    # The pair that begins with a word's first byte, and the one before its space.
    return pairs[borders[:-1] + ORDER - 1], pairs[borders[1:] + ORDER - 4]


def joints(words: np.ndarray, borders: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """For each word of texts the end of the word before, START at a text's beginning, and its own beginning."""
    before = np.zeros(len(words), np.int64)
    before[1:] = tails[words[:-1]]
    before[borders[:-1][borders[:-1] < len(words)]] = START << 8 | START
    return before << 16 | heads[words]


def joint_codes(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the first and the second byte after joints, and the borders of each joint's codes."""
    before, first, second = found >> 16, found >> 8 & 255, found & 255
    contexts = np.stack([before << 8 | END, (before & 255) << 16 | END << 8 | first], axis=1)
    codes, borders = step_codes(contexts.ravel(), np.stack([first, second], axis=1).ravel())
    return codes, borders[::JOINED]


class Level(NamedTuple):
    """Sorted codes of one order with probabilities, and sorted contexts with back-off weights."""

    codes: np.ndarray
    chances: np.ndarray
    contexts: np.ndarray
    backoffs: np.ndarray


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], missing)


def _level(codes: np.ndarray, counts: np.ndarray, lower: list[Level], size: int) -> Level:
    """Interpolated chances of one order, with Chen and Goodman's three discounts."""
    n1, n2, n3, n4 = (max(1, int(np.count_nonzero(counts == k))) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    discounts = np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0, [0, 0.95, 1.95, 2.95])
    taken = np.minimum(counts, discounts[np.minimum(counts, 3)])
    contexts, owner = np.unique(codes >> WAY, return_inverse=True)
    totals = np.bincount(owner, counts, minlength=len(contexts))
    freed = np.bincount(owner, taken, minlength=len(contexts)) / totals
    below = chances(lower, shortened(codes, size - 1) if size > 1 else codes)
    return Level(codes, (counts - taken) / totals[owner] + freed[owner] * below, contexts, freed)


def chances(levels: list[Level], codes: np.ndarray) -> np.ndarray:
    """Chance of each code's way given its context."""
    codes = np.asarray(codes, np.int64)
    found = np.full(len(codes), 1.0 / SYMBOLS)
    for size, level in enumerate(levels, 1):
        part = shortened(codes, size)
        backed_off = found * _find(level.contexts, level.backoffs, part >> WAY, 1.0)
        found = _find(level.codes, level.chances, part, -1.0)
        found = np.where(found < 0, backed_off, found)
    return found


def kneser_ney(codes: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels of a model, shortest first, from the counts of all codes (sorted): what ``costs`` is, in one place."""
    by_order = {ORDER: (codes, counts)}
    for size in range(ORDER - 1, 0, -1):
        by_order[size] = np.unique(shortened(by_order[size + 1][0], size), return_counts=True)
    levels: list[Level] = []
    for size in range(1, ORDER + 1):
        levels.append(_level(*by_order[size], levels, size))
    return levels


def _language(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit(""))


def _packed(values: np.ndarray) -> bytes:
    """Numbers under 2**32 by planes of their bytes, compressed."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * size, "zstd"), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def read_texts(docs: DataFrame, kept: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Stored rows of what the texts say, by blocks of documents of a task.

    A block has a row for each document, with its base counts and in ``doc`` the columns ``kept``; for
    each group of texts, with their words as numbers; for the words themselves; and for each code of a
    language, with how often it occurs.
    """
    slim = docs.select(F.struct(*kept).alias("doc"), F.col(text_col).alias("text"), _language(lang_col).alias("lang"))
    schema = StructType([
        StructField("doc", slim.schema["doc"].dataType),
        StructField("kind", ByteType()),
        *[StructField(c, LongType()) for c in ("block", "row")],
        StructField("lang", StringType()),
        *[StructField(c, LongType()) for c in (*MEASURES, "code", "n", "size")],
        *[StructField(c, BinaryType()) for c in ("packed", "sizes")],
        StructField("langs", ArrayType(StringType())),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(words: list[bytes]) -> tuple[np.ndarray, ...]:
            hashes = np.fromiter(map(hash64, words), np.uint64, len(words))
            line, borders = _line(words)
            # Each word's space is a character too.
            chars, symbols = (sums_between(kind[line[ORDER - 1 :]].astype(np.int64), borders) for kind in (_CHARS, _RARE))
            return hashes, chars - 1, symbols, *word_ends(words)

        known = WordRows(make, 2 * MOST_WORDS)
        spelled: dict[str, np.ndarray] = {}
        # Joints by number of the language, which the upper bits hold, and how often each occurs.
        numbers: dict[str, int] = {}
        met, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        block, row, held = TaskContext.get().partitionId() << 32, 0, 0
        types: dict[str, pa.DataType] = {}

        def rows(size: int, /, **columns) -> pa.RecordBatch:
            made = []
            for name, kind in types.items():
                value = columns.get(name)
                if isinstance(value, pa.Array):
                    made.append(value)
                elif value is None:
                    made.append(pa.nulls(size, kind))
                else:
                    made.append(pa.array(np.full(size, value) if np.isscalar(value) else value, kind))
            return pa.RecordBatch.from_arrays(made, list(types))

        def flush() -> Iterator[pa.RecordBatch]:
            """The words and codes of the block, which ends."""
            words = list(known)
            codes, borders = inner_codes(words)
            for lang, uses in spelled.items():
                weights = np.repeat(np.pad(uses, (0, len(words) - len(uses))), np.diff(borders))
                number = numbers[lang]
                mine = slice(*np.searchsorted(met, [number << 32, (number + 1) << 32]))
                joined, edges = joint_codes(met[mine] & ((1 << 32) - 1))
                found, owner = np.unique(np.append(codes[weights > 0], joined), return_inverse=True)
                weights = np.append(weights[weights > 0], np.repeat(times[mine], np.diff(edges)))
                n = np.bincount(owner, weights, minlength=len(found)).astype(np.int64)
                yield rows(len(found), kind=GRAM, block=block, lang=pa.array([lang] * len(found), pa.string()), code=found, n=n)
            if words:
                text = b" ".join(words)
                yield rows(1, kind=WORDS, block=block, size=len(text), packed=[pa.compress(text, "zstd", asbytes=True)])
            known.clear()
            known.used, known.new = 0, []
            spelled.clear()
            numbers.clear()

        for batch in batches:
            types = {
                "doc": batch.schema.field(0).type, "kind": pa.int8(), "block": pa.int64(), "row": pa.int64(), "lang": pa.string(),
                **dict.fromkeys((*MEASURES, "code", "n", "size"), pa.int64()),
                "packed": pa.binary(), "sizes": pa.binary(), "langs": pa.list_(pa.string()),
            }
            langs = np.array(batch.column(2).to_pylist(), dtype=object)
            texts = batch.column(1).cast(pa.large_binary())
            for part, words, borders in coded_word_groups(batch.column(1), known):
                hashes, chars, symbols, *ends = known.columns
                size = part.stop - part.start
                counts = (
                    np.diff(borders),
                    sums_between(chars[words], borders),
                    sums_between(symbols[words], borders),
                    np.array([_repeated_lines(value.as_py() or b"") for value in texts[part]], np.int64),
                    _repeated(hashes[words], borders),
                )
                yield rows(
                    size, kind=DOC, block=block, row=np.arange(row, row + size), doc=batch.column(0)[part],
                    lang=batch.column(2)[part], **dict(zip(MEASURES, counts)),
                )
                yield rows(
                    1, kind=TEXTS, block=block, row=row, size=len(words), packed=[_packed(words)],
                    sizes=[_packed(np.diff(borders))], langs=[langs[part].tolist()],
                )
                row, held = row + size, held + len(words)
                names, owner = np.unique(langs[part], return_inverse=True)
                owner = np.repeat(owner, np.diff(borders))
                joined = joints(words, borders, *ends)
                for k, lang in enumerate(names):
                    mine = np.flatnonzero(owner == k)
                    uses = np.bincount(words[mine], minlength=len(known))
                    before = spelled.get(lang, np.zeros(0, np.int64))
                    uses[: len(before)] += before
                    spelled[lang] = uses
                    joined[mine] += numbers.setdefault(lang, len(numbers)) << 32
                found, n = np.unique(joined, return_counts=True)
                met, places = np.unique(np.append(met, found), return_inverse=True)
                times = np.bincount(places, np.append(times, n), minlength=len(met)).astype(np.int64)
                if len(met) > MOST_JOINTS or len(known) > MOST_WORDS or held > MOST_TEXT:
                    yield from flush()
                    met, times = met[:0], times[:0]
                    block, row, held = block + 1, 0, 0
        yield from flush()

    return keep(slim.mapInArrow(work, schema), "block")


def _grams(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("kind") == GRAM).select("block", "lang", "code", "n")


def count_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, code, n) over all texts; a block sends a code of a language once."""
    return _grams(read_texts(docs, [lang_col], text_col, lang_col)).groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Models:
    """A model per language as stored counts of codes, and the stored rows that these come from."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.counts = keep(_grams(rows).groupBy("lang", "code").agg(F.sum("n").alias("n")))

    def __getitem__(self, lang: str) -> list[Level]:
        """One language's levels as arrays on the driver, to look at; no operator needs them."""
        found = self.counts.filter(F.col("lang") == lang).orderBy("code").toPandas()
        return kneser_ney(found["code"].to_numpy(np.int64), found["n"].to_numpy(np.int64))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Models:
    """A model per language, which stays in the shared folder."""
    return Models(read_texts(docs, [lang_col], text_col, lang_col))


def _discounts(level: DataFrame) -> DataFrame:
    """Chen and Goodman's three discounts of each language that has counts, a few numbers each."""
    seen = level.filter("n > 0").groupBy("lang").agg(*[
        F.greatest(F.lit(1.0), F.count_if(F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)
    ])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    return seen.select("lang", *[
        F.least(F.lit(k - 0.05), F.greatest(F.lit(0.0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))).alias(f"d{k}")
        for k in (1, 2, 3)
    ])


def costs(models: Models, rows: DataFrame) -> DataFrame:
    """(lang, code, cost): bits of every code of ``rows`` in its language's model, by joins of the levels.

    Codes that the model does not have are counted 0 times and so back off to shorter contexts. A
    language without a model has none.
    """
    counted = models.counts
    if rows is not models.rows:
        asked = _grams(rows).select("lang", "code", F.lit(0).cast("bigint").alias("n")).distinct()
        counted = counted.union(asked).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    levels = {ORDER: counted}
    for size in range(ORDER - 1, 0, -1):
        levels[size] = levels[size + 1].groupBy("lang", shortened(F.col("code"), size).alias("code")).agg(
            F.count_if(F.col("n") > 0).alias("n")
        )
    n = F.col("n")
    taken = F.when(n >= 3, F.col("d3")).when(n == 2, F.col("d2")).when(n == 1, F.col("d1")).otherwise(0.0)
    one_context = Window.partitionBy("lang", "_context")
    found = None
    for size in range(1, ORDER + 1):
        # One row for each language, as many as its bands have.
        level = levels[size].join(F.broadcast(_discounts(levels[size])), "lang").select(
            "lang", "code", n, taken.alias("taken"), F.shiftright("code", WAY).alias("_context")
        )
        level = level.select("*", F.sum("n").over(one_context).alias("total"), F.sum("taken").over(one_context).alias("freed"))
        below = F.lit(1.0 / SYMBOLS)
        if found is not None:
            level = level.withColumn("_short", shortened(F.col("code"), size - 1)).join(
                found.select("lang", F.col("code").alias("_short"), F.col("chance").alias("below")), ["lang", "_short"]
            )
            below = F.col("below")
        chance = F.when(F.col("total") > 0, (n - F.col("taken") + F.col("freed") * below) / F.col("total")).otherwise(below)
        found = level.select("lang", "code", chance.alias("chance"))
    return found.select("lang", "code", (-F.log2(F.greatest("chance", F.lit(1e-300)))).cast("float").alias("cost"))


def _scores(rows: DataFrame, models: Models) -> DataFrame:
    """(block, row, bits) of the documents of ``rows`` that have words and a model.

    A block's words and texts come to the task that has the costs of its codes.
    """
    sent = _grams(rows).join(costs(models, rows), ["lang", "code"]).select(F.col("block").alias("of"), "lang", "code", "cost")
    texts = rows.filter(F.col("kind").isin(WORDS, TEXTS)).select("block", "kind", "row", "size", "packed", "sizes", "langs")

    def work(key: tuple[pa.Scalar], texts: pa.Table, sent: pa.Table) -> pa.Table:
        groups = texts.to_pylist()
        spelling = [
            word
            for group in groups
            if group["kind"] == WORDS
            for word in pa.decompress(group["packed"], group["size"], "zstd", asbytes=True).split()
        ]
        heads, tails = word_ends(spelling)
        inner, borders = inner_codes(spelling)
        named = sent["lang"].combine_chunks().dictionary_encode()
        spoken, codes, found = named.indices.to_numpy(), sent["code"].to_numpy(), sent["cost"].to_numpy()
        numbers = {lang: number for number, lang in enumerate(named.dictionary.to_pylist())}

        def language(lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Sorted codes and their costs, and what each word costs after its joint, as far as asked for."""
            mine = np.flatnonzero(spoken == numbers[lang])
            mine = mine[np.argsort(codes[mine])]
            return codes[mine], found[mine].astype(np.float64), np.full(len(spelling), -1.0)

        known = BoundedCache(language, MOST_LANGUAGES)

        def costs_of(lang: str, wanted: np.ndarray) -> np.ndarray:
            codes, found, _ = known[lang]
            place = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
            if (codes[place] != wanted).any():
                raise ValueError(f"block {key[0]} has codes without a cost")
            return found[place]

        def word_costs(lang: str, words: np.ndarray, joined: np.ndarray) -> np.ndarray:
            of_words = known[lang][2]
            todo = np.unique(words[of_words[words] < 0])
            if len(todo):
                sizes = borders[todo + 1] - borders[todo]
                ends = np.append(0, np.cumsum(sizes))
                places = np.arange(ends[-1]) + np.repeat(borders[todo] - ends[:-1], sizes)
                of_words[todo] = sums_between(costs_of(lang, inner[places]), ends)
            distinct, owner = np.unique(joined, return_inverse=True)
            wanted, ends = joint_codes(distinct)
            return of_words[words] + sums_between(costs_of(lang, wanted), ends)[owner]

        scored = [(np.zeros(0, np.int64), np.zeros(0))]
        for group in groups:
            if group["kind"] != TEXTS:
                continue
            langs = group["langs"]
            words, counts = _unpacked(group["packed"], group["size"]), _unpacked(group["sizes"], len(langs))
            edges = np.append(0, np.cumsum(counts))
            joined = joints(words, edges, heads, tails)
            total = np.zeros(len(words))
            names, of_text = np.unique(np.array(langs, dtype=object), return_inverse=True)
            owner = np.repeat(of_text, counts)
            for k, lang in enumerate(names):
                mine = np.flatnonzero(owner == k)
                if lang in numbers and len(mine):
                    total[mine] = word_costs(lang, words[mine], joined[mine])
            judged = np.flatnonzero((counts > 0) & np.isin(of_text, [k for k, lang in enumerate(names) if lang in numbers]))
            scored.append((group["row"] + judged, sums_between(total, edges)[judged] / counts[judged]))
        row, bits = (np.concatenate(parts) for parts in zip(*scored))
        return pa.table({"block": pa.array(np.full(len(row), key[0].as_py()), pa.int64()), "row": row, "bits": bits})

    both = texts.groupBy("block").cogroup(sent.groupBy("of"))
    return both.applyInArrow(work, "block long, row long, bits double")


def _repeated(hashes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Words of each text in windows that occur twice or more in it."""
    count = len(hashes) - WINDOW + 1
    twice = np.zeros(len(hashes) + 1, np.int64)
    if count > 1:
        windows = np.zeros(count, np.uint64)
        for k in range(WINDOW):
            windows = mix64(windows, k) ^ hashes[k : k + count]
        owner = np.repeat(np.arange(len(borders) - 1, dtype=np.uint64), np.diff(borders))
        inside = np.flatnonzero(owner[:count] == owner[WINDOW - 1 :])
        windows = windows[inside] ^ mix64(owner[inside], WINDOW)
        order = np.argsort(windows)
        same = windows[order[1:]] == windows[order[:-1]]
        found = inside[order[np.append(same, False) | np.append(False, same)]] if len(order) else inside
        twice[found] += 1
        twice[found + WINDOW] -= 1
    return sums_between((np.cumsum(twice)[:-1] > 0).astype(np.int64), borders)


def _repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _measured(rows: DataFrame, models: Models) -> DataFrame:
    """(block, row, doc, _lang) of all documents with the base counts and ``bits``."""
    docs = rows.filter(F.col("kind") == DOC).select("block", "row", "doc", F.col("lang").alias("_lang"), *MEASURES)
    return docs.join(_scores(rows, models), ["block", "row"], "left")


def measure(docs: DataFrame, models: Models, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with the base counts and ``bits``, the mean cost of a word (null without words).

    Columns of those names are replaced. A language without a model has null bits.
    """
    kept = [c for c in docs.columns if c not in (*MEASURES, "bits", "_lang")]
    return _measured(read_texts(docs, kept, text_col, lang_col), models).select("doc.*", "_lang", *MEASURES, "bits")


class Band(NamedTuple):
    """Middle costs that a language's documents are compared with from below and above, and the deviation."""

    low: float
    high: float
    deviation: float


def bands(measured: DataFrame) -> dict[str, Band]:
    """Per language the median of ``bits`` and the deviation of one word's cost, robustly.

    Both come from a histogram by bits and word count, of bounded size, over all documents that
    the base rules pass, and both are drawn towards the figures of all languages together, the
    more the fewer documents a language has. A model of few texts knows them by heart, so texts
    are not too cheap when they cost as much as their own language's median.
    """
    width = F.round(F.log2(F.col("n_words")) * 2).cast("int")
    usable = measured.filter(F.col("bits").isNotNull() & ~base_failed())
    cells = usable.groupBy("_lang", F.round(F.col("bits") / BIN).cast("int").alias("_bin"), width.alias("_width")).count()
    cells = cells.toPandas()
    if cells.empty:
        return {}

    def figures(rows: pd.DataFrame) -> tuple[int, float, float]:
        weights, bits = rows["count"].to_numpy(np.int64), rows["_bin"].to_numpy() * BIN
        middle = _median(bits, weights)
        scaled = np.abs(bits - middle) * np.sqrt(2.0 ** (rows["_width"].to_numpy() / 2))
        return int(weights.sum()), middle, 1.4826 * _median(scaled, weights)

    _, all_middle, all_deviation = figures(cells)
    found = {}
    for lang, rows in cells.groupby("_lang"):
        n, middle, deviation = figures(rows)
        own = n / (n + POOLED_DOCS)
        drawn = own * middle + (1 - own) * all_middle
        found[lang] = Band(min(middle, drawn), drawn, max(1.0, own * deviation + (1 - own) * all_deviation))
    return found


def _median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values)
    summed = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(summed, summed[-1] / 2)])


def base_failed() -> Column:
    repeated = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    return (F.col("n_words") < MIN_WORDS) | repeated


def in_band(limits: dict[str, Band]) -> Column:
    """Whether a measured document lies in its language's band; one without bits does."""
    if not limits:
        return F.lit(True)
    known = F.create_map(*[
        F.lit(x) for lang, band in limits.items() for x in (lang, [float(value) for value in band])
    ])[F.col("_lang")]
    # Spark may work this out for documents without words too, before the base rules reject them.
    room = BITS + DEVIATIONS * known[2] / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    return F.coalesce((F.col("bits") >= known[0] - room) & (F.col("bits") <= known[1] + room), F.lit(True))


def quality_verdicts(spark, folder: str) -> DataFrame:
    """One row per document with its counts and verdict.

    A null or empty text has no words and fails; rows that share an id are judged each for itself, and
    equal ones alike. An empty table gives no rows.
    """
    rows = read_texts(table(spark, folder, "documents"), ["doc_id"])
    measured = keep(_measured(rows, Models(rows)))
    failed = base_failed()
    return measured.select(
        "doc.doc_id", *MEASURES, failed.alias("base_failed"), (~failed & in_band(bands(measured))).alias("kept"), "bits"
    )


def keep_by_rules(docs: DataFrame) -> DataFrame:
    """Documents that the rules pass, with their own columns, whatever they are called.

    A null or empty text has no words and goes, a null language is one of its own, repeated rows stay
    or go together, and an empty table stays empty.
    Texts are read once and stored with what they say; documents follow by their block and row.
    """
    rows = read_texts(docs, docs.columns)
    measured = keep(_measured(rows, Models(rows)).drop("doc"))
    passed = measured.filter(~base_failed() & in_band(bands(measured))).select("block", "row")
    return rows.filter(F.col("kind") == DOC).join(passed, ["block", "row"], "left_semi").select("doc.*")
