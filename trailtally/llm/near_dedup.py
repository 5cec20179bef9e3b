"""MinHash near-dedup: ProbMinHash sketches of weighted shingles, banding and verification.

Every distinct shingle of a document arrives again and again at the times of a Poisson process
whose rate is its weight, each time at a random register; a register remembers the first
shingle to reach it. A shingle is given up as soon as it is later than every register of its
document. Two documents agree in a register with the chance of their probability Jaccard
similarity, which is the plain one where all weights are equal. Registers are grouped into bands;
documents that share a band are candidates, and candidates are verified on their shingles.

A bucket of many near copies is not compared in pairs: its members are compared with a few
pivots, which joins most of them. Then members of one bucket whose components still differ are
compared in full, a block of them with another at a time, so no link between components is lost
and pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailtally.llm.common import SPACE, keep, table
from trailtally.llm.components import components
from trailtally.llm.words import MIX, WordRows, hash64, mix64, word_groups
from trailtally.session import pin

SIZE = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
PIVOTS = 4
GROUP = 400_000
# Shingles of a block in bytes, and columns of a matrix at a time, where blocks are compared.
BLOCK_BYTES = 1 << 19
COLUMNS = 8192


def shingles(
    hashes: np.ndarray, borders: np.ndarray, size: int, weights: str = "one"
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles of a group of texts.

    A shingle weighs ``one``, or as often as it occurs with ``count``. A text of fewer words than
    ``size`` has one shingle of all its words; one of none has none.
    """
    lengths = np.diff(borders)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(hashes)) - borders[owner]
    first = place <= np.maximum(0, lengths - size)[owner]
    starts = np.flatnonzero(first)
    left = (borders[1:][owner] - np.arange(len(hashes)))[starts]
    mixed = np.zeros(len(starts), np.uint64)
    factor = 1
    for k in range(size):
        there = left > k
        with np.errstate(over="ignore"):
            mixed[there] += hashes[starts[there] + k] * np.uint64(factor)
        factor = factor * MIX[0] % 2**64
    mixed = mix64(mixed, size)
    own = owner[starts]
    order = np.lexsort((mixed, own))
    own, mixed = own[order], mixed[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (mixed[1:] != mixed[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(own)))
    return own[at], mixed[at], counts if weights == "count" else np.ones_like(counts)


def prob_min_hash(own: np.ndarray, items: np.ndarray, weights: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """First arrivals (texts x registers) of weighted items; texts without items stay 0."""
    times = np.full(texts * registers, np.inf)
    winners = np.zeros(texts * registers, np.uint64)
    latest = np.full(texts, np.inf)
    clock, rates, step = np.zeros(len(items)), weights.astype(np.float64), 0
    while len(items):
        step += 1
        draw = mix64(items, 2 * step)
        clock = clock - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rates
        alive = clock < latest[own]
        own, items, clock, rates = own[alive], items[alive], clock[alive], rates[alive]
        place = (mix64(items, 2 * step + 1) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
        place = own * registers + place.astype(np.int64)
        np.minimum.at(times, place, clock)
        won = times[place] == clock
        winners[place[won]] = items[won]
        touched = np.unique(own[won])
        latest[touched] = times.reshape(texts, registers)[touched].max(axis=1)
    return winners.reshape(texts, registers)


def band_hashes(winners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for the registers of each band."""
    found = np.zeros((len(winners), bands), np.uint64)
    for k in range(rows):
        with np.errstate(over="ignore"):
            found = mix64(found + winners[:, k * bands : (k + 1) * bands], k)
    with np.errstate(over="ignore"):
        return mix64(found + np.arange(bands, dtype=np.uint64) * np.uint64(MIX[3]), rows)


def _word_hashes() -> WordRows:
    return WordRows(lambda words: (np.array([hash64(word) for word in words], np.uint64),))


def sketch(
    docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SIZE, weights: str = "one"
) -> DataFrame:
    """(doc_id, r1, r2, row, k1, k2, bands) of documents (doc_id, text, r1, r2).

    ``k1`` and ``k2`` are two hashes of the sequence of words; they and the bands are null without
    words. ``row`` is a number of its own for every row, the same ever after once it is stored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_hashes()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, words, borders in word_groups(batch.column(1), known, lower=True, most=GROUP):
                hashes, texts = known.columns[0][words], len(borders) - 1
                own, items, counts = shingles(hashes, borders, size, weights)
                found = band_hashes(prob_min_hash(own, items, counts, texts, bands * rows), bands, rows)
                empty = np.diff(borders) == 0
                keys = [
                    pa.array(
                        [hash64(hashes[a:b].tobytes() + salt) for a, b in zip(borders[:-1], borders[1:])],
                        pa.uint64(),
                    ).to_numpy(zero_copy_only=False).view(np.int64)
                    for salt in (b"", b"\x01")
                ]
                offsets = pa.array(np.arange(texts + 1, dtype=np.int32) * bands)
                lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel().view(np.int64)), mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(k).slice(part.start, texts) for k in (0, 2, 3)],
                        pa.array(np.arange(row, row + texts)),
                        *[pa.array(key, mask=empty) for key in keys],
                        lists,
                    ],
                    names=["doc_id", "r1", "r2", "row", "k1", "k2", "bands"],
                )
                row += texts

    schema = "doc_id long, r1 long, r2 long, row long, k1 long, k2 long, bands array<long>"
    return docs.mapInArrow(work, schema)


def _shingle_table(docs: DataFrame, size: int, weights: str) -> DataFrame:
    """(node, items, counts): sorted shingles and their counts as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_hashes()
        for batch in batches:
            for part, words, borders in word_groups(batch.column(1), known, lower=True, most=GROUP):
                texts = len(borders) - 1
                own, items, counts = shingles(known.columns[0][words], borders, size, weights)
                cuts = np.searchsorted(own, np.arange(texts + 1))
                counts = counts.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, texts),
                        pa.array([items[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                        pa.array([counts[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                    ],
                    names=["node", "items", "counts"],
                )

    return docs.mapInArrow(work, "node long, items binary, counts binary")


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two weighted sets (sorted items and weights)."""
    if not len(a) or not len(b):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if (x == x[0]).all() and (y == y[0]).all():
        return len(i) / (len(a) + len(b) - len(i))
    p, q = x[i].astype(np.float64), y[j].astype(np.float64)
    only_a, only_b = x.sum() - p.sum(), y.sum() - q.sum()
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    above = np.cumsum(p[::-1])[::-1] + only_a
    below = np.concatenate([[0.0], np.cumsum(q)[:-1]]) + only_b
    return float(np.sum(1.0 / (above / p + below / q)))


def _verified(pairs: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar enough. The shingles of each side come by a join."""
    left = table.select(F.col("node").alias("a"), F.col("items").alias("_ai"), F.col("counts").alias("_ac"))
    right = table.select(F.col("node").alias("b"), F.col("items").alias("_bi"), F.col("counts").alias("_bc"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "_ai", "_ac", "_bi", "_bc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for row in zip(*[column.to_pylist() for column in batch.columns[2:]]):
                ai, bi = np.frombuffer(row[0], np.uint64), np.frombuffer(row[2], np.uint64)
                ac, bc = np.frombuffer(row[1], np.uint32), np.frombuffer(row[3], np.uint32)
                linked.append(probability_jaccard(ai, ac, bi, bc) >= similarity)
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(mask)

    return rows.mapInArrow(work, "a long, b long")


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """Each member with each of its bucket's pivots, the smallest nodes by PIVOTS orders.

    A node exclusive-or a constant is a number of fixed width that gives the node back, so the
    pivots of a bucket combine by hash before the shuffle.
    """
    salts = [MIX[k % len(MIX)] >> (k + 1) for k in range(PIVOTS)]
    least = [F.min(F.col("node").bitwiseXOR(F.lit(salt))).bitwiseXOR(F.lit(salt)) for salt in salts]
    chosen = members.groupBy("bucket").agg(F.array_distinct(F.array(*least)).alias("_pivots"))
    pairs = members.join(chosen, "bucket").select(F.col("node").alias("a"), F.explode("_pivots").alias("b"))
    return _ordered(pairs.filter(F.col("a") != F.col("b")))


def _unjoined(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, node, component) of the buckets that hold several components.

    Two nodes alone in a bucket were each other's pivots and are done.
    """
    named = members.join(classes, "node", "left").select(
        "bucket", "node", F.coalesce("component", F.col("node")).alias("component")
    )
    several = (
        named.groupBy("bucket")
        .agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_n"))
        .filter((F.col("_low") < F.col("_high")) & (F.col("_n") > 2))
    )
    return named.join(several.select("bucket"), "bucket", "left_semi")


def _blocks(apart: DataFrame, spelled: DataFrame) -> DataFrame:
    """(bucket, main, block, members): each bucket's nodes in blocks of about BLOCK_BYTES.

    ``main`` marks the nodes of the bucket's largest component, which have blocks of their own.
    """
    sizes = apart.groupBy("bucket", "component").agg(F.count("*").alias("_n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("component", "_n").alias("_main"))
    marked = apart.join(largest, "bucket").withColumn("main", F.col("component") == F.col("_main")).drop("_main")
    full = marked.join(spelled, "node")
    size = F.octet_length("items") + F.octet_length("counts")
    parts = marked.join(spelled.select("node", size.alias("_size")), "node").groupBy("bucket", "main").agg(
        F.ceil(F.sum("_size") / BLOCK_BYTES).alias("_parts")
    )
    block = F.pmod(F.xxhash64("node"), F.greatest(F.col("_parts"), F.lit(1))).alias("block")
    member = F.struct("node", "component", "items", "counts")
    return (
        full.join(parts, ["bucket", "main"])
        .select("bucket", "main", block, member.alias("_member"))
        .groupBy("bucket", "main", "block")
        .agg(F.collect_list("_member").alias("members"))
    )


def _remaining_links(apart: DataFrame, spelled: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different components of one bucket, found block against block.

    The largest component is not compared with itself. A pair of blocks gives no more links
    than connect what its links connect.
    """
    blocks = keep(_blocks(apart, spelled))
    numbers = blocks.select("bucket", "main", "block")
    left, right = numbers.filter(~F.col("main")), numbers
    # Numbers of a bucket meet under its key. Each block is then fetched where it is wanted, so the
    # blocks of one bucket are compared in as many tasks as it has blocks.
    pairs = (
        left.select("bucket", F.col("block").alias("_i"))
        .join(right.select("bucket", F.col("main").alias("_main"), F.col("block").alias("_j")), "bucket")
        .filter(F.col("_main") | (F.col("_i") <= F.col("_j")))
    )
    own = blocks.filter(~F.col("main")).select("bucket", F.col("block").alias("_i"), F.col("members").alias("_a"))
    other = blocks.select(
        "bucket", F.col("main").alias("_main"), F.col("block").alias("_j"), F.col("members").alias("_b")
    )
    meet = pairs.join(own, ["bucket", "_i"]).join(other, ["bucket", "_main", "_j"]).select("_a", "_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*[column for column in batch.columns]):
                links = block_links(Block.of(a.as_py()), Block.of(b.as_py()), similarity)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())],
                    names=["a", "b"],
                )

    return meet.mapInArrow(work, "a long, b long")


class Block(NamedTuple):
    """Members of a block: nodes, components, and their shingles one after the other."""

    nodes: list[int]
    components: np.ndarray
    owners: np.ndarray
    items: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(members: list[dict]) -> Block:
        items = [np.frombuffer(member["items"], np.uint64) for member in members]
        counts = [np.frombuffer(member["counts"], np.uint32) for member in members]
        return Block(
            [member["node"] for member in members],
            np.array([member["component"] for member in members], np.int64),
            np.repeat(np.arange(len(members)), [len(x) for x in items]),
            np.concatenate(items),
            np.concatenate(counts),
        )

    def member(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        first, last = np.searchsorted(self.owners, [k, k + 1])
        return self.items[first:last], self.counts[first:last]


def shared_sums(a: Block, b: Block, a_values: np.ndarray, b_values: np.ndarray) -> np.ndarray:
    """For each pair of members the sum of products over their common shingles."""
    common = np.intersect1d(a.items, b.items)
    total = np.zeros((len(a.nodes), len(b.nodes)))
    sides = []
    for block, values in ((a, a_values), (b, b_values)):
        place = np.minimum(np.searchsorted(common, block.items), max(0, len(common) - 1))
        here = common[place] == block.items if len(common) else np.zeros(len(block.items), bool)
        sides.append((block.owners[here], place[here], values[here]))
    for first in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - first)
        dense = []
        for (owners, places, values), block in zip(sides, (a, b)):
            inside = (places >= first) & (places < first + width)
            matrix = np.zeros((len(block.nodes), width), np.float32)
            matrix[owners[inside], places[inside] - first] = values[inside]
            dense.append(matrix)
        total += dense[0] @ dense[1].T
    return total


def block_links(a: Block, b: Block, similarity: float) -> list[tuple[int, int]]:
    """Links between members of two blocks whose components differ, as many as connect them.

    Similarity is at most the share of either side's weight in common shingles; pairs that pass
    this are compared exactly.
    """
    shares = []
    for block in (a, b):
        weight = np.bincount(block.owners, block.counts, minlength=len(block.nodes))
        shares.append(block.counts / weight[block.owners])
    ones = [np.ones(len(block.items)) for block in (a, b)]
    bound = np.minimum(shared_sums(a, b, shares[0], ones[1]), shared_sums(a, b, ones[0], shares[1]))
    near = (bound >= similarity - 1e-3) & (a.components[:, None] != b.components[None, :])
    parent: dict[int, int] = {}

    def root(component: int) -> int:
        while parent.setdefault(component, component) != component:
            component = parent[component]
        return component

    links = []
    for i, j in zip(*np.nonzero(near)):
        x, y = root(int(a.components[i])), root(int(b.components[j]))
        if x != y and probability_jaccard(*a.member(i), *b.member(j)) >= similarity:
            parent[max(x, y)] = min(x, y)
            links.append((a.nodes[i], b.nodes[j]))
    return links


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _row_names(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes of a row's id and text; only rows equal in both share them."""
    return F.xxhash64(doc_id, text).alias("r1"), F.xxhash64(F.lit(1), text, doc_id).alias("r2")


def _classed(
    docs: DataFrame, similarity: float, size: int, bands: int, rows: int, weights: str
) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) with words as (doc_id, r1, r2, component, class_id), and the rest.

    The nodes that are linked are texts, each named by the number of one of its rows. The rest has
    (doc_id, r1, r2).
    """
    slim = docs.select("doc_id", "text", *_row_names(F.col("doc_id"), F.col("text")))
    sketched = keep(sketch(slim, bands, rows, size, weights))
    worded = sketched.filter(F.col("k1").isNotNull())
    nodes = pin(worded.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("doc_id").alias("_id")))
    members = (
        worded.join(nodes.select("k1", "k2", "node"), ["k1", "k2"])
        .filter(F.col("row") == F.col("node"))
        .select("node", "r1", "r2", F.explode("bands").alias("bucket"))
    )
    shared = (
        members.groupBy("bucket")
        .agg(F.min("node").alias("_low"), F.max("node").alias("_high"))
        .filter(F.col("_low") < F.col("_high"))
    )
    members = keep(members.join(shared.select("bucket"), "bucket", "left_semi").distinct())
    candidates = members.select("node", "r1", "r2").distinct()
    members = members.select("node", "bucket")
    spelled = slim.join(candidates, ["r1", "r2"]).select("node", "text").dropDuplicates(["node"])
    spelled = keep(_shingle_table(spelled, size, weights))
    links = _verified(_pivot_pairs(members), spelled, similarity)
    classes = pin(components(links, "a", "b"))
    apart = pin(_unjoined(members, classes))
    if not apart.isEmpty():
        found = pin(_remaining_links(apart, spelled, similarity))
        if not found.isEmpty():
            # The new links join whole components.
            names = apart.select("node", "component").distinct()
            a = names.select(F.col("node").alias("a"), F.col("component").alias("_a"))
            b = names.select(F.col("node").alias("b"), F.col("component").alias("_b"))
            joined = components(found.join(a, "a").join(b, "b"), "_a", "_b")
            larger = joined.select(F.col("node").alias("_c"), F.col("component").alias("_whole"))
            every = classes.unionByName(apart.select("node", "component")).distinct()
            classes = every.join(larger, F.col("component") == F.col("_c"), "left").select(
                "node", F.coalesce("_whole", "component").alias("component")
            )
    named = nodes.join(classes, "node", "left").withColumn("component", F.coalesce("component", F.col("node")))
    least = named.groupBy("component").agg(F.min("_id").alias("class_id"))
    named = pin(named.join(least, "component").select("k1", "k2", "component", "class_id"))
    found = worded.select("doc_id", "r1", "r2", "k1", "k2").join(named, ["k1", "k2"]).drop("k1", "k2")
    return found, sketched.filter(F.col("k1").isNull()).select("doc_id", "r1", "r2")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    size: int = SIZE,
    bands: int = BANDS,
    rows: int = ROWS,
    weights: str = "one",
) -> DataFrame:
    """One row (doc_id, class_id) per document; a class is named by its smallest id.

    ``weights`` is ``one`` for each distinct shingle, which makes the similarity plain Jaccard, or
    ``count``, which compares how a text's shingles are distributed.

    Words are divided at ASCII white space with A-Z lower-cased. Documents of equal words are of
    one class, and so are those joined by a chain of verified links. A pair at the threshold is
    missed by all bands with a chance of 5 in 100,000, and a closer one less often. A document
    without words (null, empty, blank) is alone in its class. Rows are classed by their texts:
    those that share an id but have different texts are of different classes, which may have that
    id for a name. A row without an id takes the class of its near copies, null where none has one.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found, alone = _classed(slim, similarity, size, bands, rows, weights)
    return found.select("doc_id", "class_id").unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id")))


def near_duplicate_classes(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """A document of each class, with its own columns, whatever they are called: that of the smallest id.

    Rows equal in id and text are one. An empty table stays empty. Texts of one id are chosen from by their hashes, as are those of a class without ids. Documents
    without words stay, once for each id, and all of them that have none.
    """
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text")
    slim = docs.select(doc_id.alias("doc_id"), "text")
    found, alone = _classed(slim, SIMILARITY, SIZE, BANDS, ROWS, "one")
    name = F.min(F.struct("r1", "r2")).alias("_name")
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("component").agg(name)
    blank = alone.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(name)
    chosen = first.select("_name.*").unionByName(blank.select("_name.*"))
    row = F.struct(*docs.columns).alias("_doc")
    nameless = doc_id.isNull() & (F.translate(F.coalesce(text, F.lit("")), SPACE, "") == "")
    r1, r2 = _row_names(doc_id, text)
    kept = docs.filter(~nameless).select(row, r1.alias("_r1"), r2.alias("_r2"))
    kept = kept.join(chosen.toDF("_r1", "_r2"), ["_r1", "_r2"], "left_semi").dropDuplicates(["_r1", "_r2"])
    return kept.select("_doc.*").unionByName(docs.filter(nameless))
