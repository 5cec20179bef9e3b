"""Conversation prefix trie by whole-sequence collapse.

Identical conversations become one sequence with a weight, a smallest member and a digest of the
list of conversations that end with it. Only a sequence's prefixes are expanded, once for all its
conversations, and added up by weight. Sequences that are a proper prefix of another are found by an
anti join; what remains are the leaves.

A prefix is named by its depth and two running exclusive-ors of 64-bit hashes of its turns, each
hashed with its place, so texts are read once and never shuffled. Whatever runs along a conversation
runs along segments of bounded length, after one row per segment has told what comes before; a
conversation of any length is spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailtally.llm.common import keep, table

# Fixed values of the contract: conversations that share a base, and most turns that they take of it.
FAMILY = 20
HEADS = 4
# Turns of a segment, and bytes of a piece of an end list.
SEGMENT = 1024
PIECE_BYTES = 1 << 16

NODE = ["depth", "k1", "k2"]
_WORD = r"[^\x20\x09-\x0D]+"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _earlier(order: Column) -> Window:
    return Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def numbered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, segment, pos, n, t1, t2, words): each turn's place, and hashes and words of its text."""
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.xxhash64(who, said).alias("t1"),
        F.xxhash64(F.lit(1), said, who).alias("t2"),
        F.regexp_count(said, F.lit(_WORD)).cast("bigint").alias("words"),
    )
    rows = rows.withColumn("segment", F.floor(F.coalesce("turn", F.lit(-(1 << 63))) / SEGMENT))
    sizes = rows.groupBy("conv_id", "segment").agg(F.count("*").alias("_size"))
    whole = Window.partitionBy("conv_id")
    segments = sizes.select(
        "conv_id",
        "segment",
        F.coalesce(F.sum("_size").over(_earlier(F.col("segment"))), F.lit(0)).alias("_before"),
        F.sum("_size").over(whole).alias("n"),
    )
    place = Window.partitionBy("conv_id", "segment").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2")
    return rows.join(segments, ["conv_id", "segment"]).select(
        "conv_id", "segment", (F.col("_before") + F.row_number().over(place) - 1).alias("pos"), "n", "t1", "t2", "words"
    )


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: turns (conv_id, at, length, t1, t2, words), and (conv_id, length) of all."""
    heads = (
        turns.filter((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("pos") < HEADS - 1))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "words"))).alias("_head"))
        .select(F.col("conv_id").alias("_base"), "_head")
    )
    segments = turns.groupBy("conv_id", "segment").agg(F.max("n").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    bases = (
        segments.groupBy("conv_id")
        .agg(F.max("n").alias("n"))
        .withColumns({"_h": h, "_base": F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))})
        .join(heads, "_base", "left")
        .withColumn("_lent", F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.array()))
        .withColumn("_taken", F.size("_lent"))
        .withColumn("length", F.col("_taken") + F.greatest(F.col("n") - F.col("_h"), F.lit(0)))
    )
    bases = keep(bases.select("conv_id", "_h", "_taken", "length", "_lent"))
    known = segments.select("conv_id", "segment").join(bases.drop("_lent"), "conv_id")
    own = turns.join(known, ["conv_id", "segment"]).filter(F.col("pos") >= F.col("_h"))
    own = own.withColumn("at", F.col("pos") - F.col("_h") + F.col("_taken"))
    lent = bases.select("conv_id", "length", F.inline("_lent")).withColumnRenamed("pos", "at")
    columns = ["conv_id", "at", "length", "t1", "t2", "words"]
    return own.select(columns).unionByName(lent.select(columns)), bases.select("conv_id", "length")


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, length): every turn as the end of a prefix, whose name is
    (depth, k1, k2), and that of the prefix before it."""
    turns = rebuilt.select(
        "conv_id",
        F.floor(F.col("at") / SEGMENT).alias("segment"),
        (F.col("at") + 1).alias("depth"),
        F.xxhash64("at", "t1", "t2").alias("e1"),
        F.xxhash64("t2", "at", "t1").alias("e2"),
        "words",
        "length",
    )
    sums = turns.groupBy("conv_id", "segment").agg(F.bit_xor("e1").alias("_x1"), F.bit_xor("e2").alias("_x2"))
    none = F.lit(0).cast("bigint")
    before = sums.select(
        "conv_id",
        "segment",
        *[F.coalesce(F.bit_xor(f"_x{i}").over(_earlier(F.col("segment"))), none).alias(f"_b{i}") for i in (1, 2)],
    )
    upto = Window.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    named = turns.join(before, ["conv_id", "segment"]).withColumns({
        f"k{i}": F.col(f"_b{i}").bitwiseXOR(F.bit_xor(f"e{i}").over(upto)) for i in (1, 2)
    })
    parents = [F.col(f"k{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (1, 2)]
    return named.select("conv_id", *NODE, *parents, "words", "length")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ends as rows (depth, k1, k2, first, ids): comma-joined ids of bounded length."""
    node, first, ids, size = None, None, [], 0
    for batch in batches:
        made = []
        for depth, k1, k2, conv in zip(*[column.to_pylist() for column in batch.columns]):
            if ids and ((depth, k1, k2) != node or size > PIECE_BYTES):
                made.append((*node, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                node, first = (depth, k1, k2), conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if made:
            yield _batch(made, [*NODE, "first", "ids"])
    if ids:
        yield _batch([(*node, first, ",".join(ids))], [*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as rows (depth, k1, k2, ends_sha256); a list is never held whole."""
    node, digest = None, None
    for batch in batches:
        made = []
        for depth, k1, k2, ids in zip(*[column.to_pylist() for column in batch.columns]):
            if (depth, k1, k2) != node:
                if node is not None:
                    made.append((*node, digest.hexdigest()))
                node, digest = (depth, k1, k2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if made:
            yield _batch(made, [*NODE, "ends_sha256"])
    if node is not None:
        yield _batch([(*node, digest.hexdigest())], [*NODE, "ends_sha256"])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if name in ("ids", "ends_sha256") else pa.int64() for name in names]
    return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds)], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the conversations (conv_id) that end at each node.

    A digest takes its ids in order, so the pieces of one list meet in one task; they are made in
    many, and read one after the other.
    """
    nodes = "depth long, k1 long, k2 long"
    pieces = (
        ends.select(*NODE, "conv_id")
        .repartitionByRange(*NODE, "conv_id")
        .sortWithinPartitions(*NODE, "conv_id")
        .mapInArrow(_pieces, f"{nodes}, first long, ids string")
    )
    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").drop("first")
    return ordered.mapInArrow(_digests, f"{nodes}, ends_sha256 string")


def _along(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """(depth, k1, k2, saved, leaf): for each row what is saved from its depth on, along its sequence."""
    rows = rows.withColumn("segment", F.floor(F.col("depth") / SEGMENT))
    later = Window.partitionBy("conv_id").orderBy(F.col("segment").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "segment").agg(F.sum("saved").alias("_sum"))
    after = sums.select(
        "conv_id", "segment", F.coalesce(F.sum("_sum").over(later), F.lit(0)).alias("_after")
    ).join(leaves.select("conv_id", F.lit(1).alias("leaf")), "conv_id", "left")
    down = (
        Window.partitionBy("conv_id", "segment")
        .orderBy(F.col("depth").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = rows.join(after, ["conv_id", "segment"])
    return joined.select(*NODE, (F.col("_after") + F.sum("saved").over(down)).alias("saved"), "leaf")


def prefix_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Columns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens, and ends_sha256, the digest of the members that end there.
    Turns are in order of their number, null first; turns of one number are in the order of their
    hashes, and repeated rows are turns of their own. A null role or text is an empty one, a turn
    without conv_id belongs to none, and an empty table has no nodes.
    """
    turns = keep(numbered_turns(conversations, conv, turn, role, text))
    rebuilt, lengths = rebuilt_turns(turns)
    paths = keep(prefixes(rebuilt))
    root = [F.lit(0).cast("bigint").alias(c) for c in NODE]
    last = paths.filter(F.col("depth") == F.col("length")).select("conv_id", *NODE)
    ends = keep(last.unionByName(lengths.filter(F.col("length") == 0).select("conv_id", *root)))
    # Identical conversations are one sequence, named by the smallest.
    sequences = keep(
        ends.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"))
    )
    weights = sequences.select("conv_id", "weight")
    empty = F.lit(None).cast("bigint")
    steps = paths.join(weights, "conv_id").unionByName(
        sequences.select(
            "conv_id", *root, empty.alias("p1"), empty.alias("p2"), F.lit(0).cast("bigint").alias("words"),
            F.col("depth").alias("length"), "weight",
        )
    )
    steps = keep(steps)
    nodes = keep(
        steps.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.max("p1").alias("p1"),
            F.max("p2").alias("p2"),
        )
    )
    proper = steps.filter(F.col("depth") < F.col("length")).select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti")
    # A node's savings count once, on the path of its smallest member.
    first = nodes.select("conv_id", "depth", "n_convs")
    saved = F.coalesce((F.col("n_convs") - 1) * F.col("words"), F.lit(0))
    counted = steps.join(first, ["conv_id", "depth"], "left").withColumn("saved", saved)
    totals = _along(counted.select("conv_id", *NODE, "saved"), leaves).groupBy(*NODE).agg(
        F.sum("saved").alias("saved_tokens"), F.count("leaf").alias("n_leaves")
    )
    children = (
        nodes.filter(F.col("depth") > 0)
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
        .agg(F.count("*").alias("n_children"))
    )
    top = nodes.filter(F.col("depth") == 0).agg(F.min("conv_id").alias("conv_id")).scalar()
    near_top = nodes.filter(F.col("depth") <= 1).withColumn("parent_conv_id", F.when(F.col("depth") == 1, top))
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    deeper = nodes.filter(F.col("depth") > 1).join(above, ["depth", "p1", "p2"])
    parents = near_top.unionByName(deeper).select(*NODE, "conv_id", "n_convs", "parent_conv_id")
    return (
        parents.join(totals, NODE)
        .join(children, NODE, "left")
        .join(end_digests(ends), NODE, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
        )
    )


def conversation_trie(spark, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


PREFIX_TRIE_SQL = r"""
WITH said AS (
    SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
    SELECT conv_id, count(*) AS n FROM said GROUP BY conv_id
), hashed AS (
    SELECT conv_id, n, conv_id - conv_id % 20 AS base,
           xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda crc, byte: list_reduce(
                   list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                   lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))
           ), 4294967295::BIGINT) % 4 AS h
    FROM sizes
), bases AS (
    SELECT a.conv_id, a.base, a.h, least(a.h, coalesce(b.n, 0)) AS taken
    FROM hashed a LEFT JOIN sizes b ON b.conv_id = a.base
), rebuilt AS (
    SELECT b.conv_id, s.pos AS at, s.said FROM bases b JOIN said s ON s.conv_id = b.base AND s.pos < b.h
    UNION ALL
    SELECT b.conv_id, s.pos - b.h + b.taken, s.said FROM bases b JOIN said s ON s.conv_id = b.conv_id AND s.pos >= b.h
), sequences AS (
    SELECT b.conv_id, coalesce(list(r.said ORDER BY r.at) FILTER (r.said IS NOT NULL), []) AS path
    FROM bases b LEFT JOIN rebuilt r USING (conv_id) GROUP BY b.conv_id
), steps AS (
    SELECT conv_id, len(path) AS length, path, unnest(range(0, len(path) + 1)) AS depth FROM sequences
), nodes AS (
    SELECT list_slice(path, 1, depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
    FROM steps GROUP BY ALL
), children AS (
    SELECT list_slice(node, 1, depth - 1) AS node, depth - 1 AS depth, count(*) AS n_children
    FROM nodes WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children,
           CASE WHEN n.depth = 0 THEN 0
                ELSE (n.n_convs - 1) * len(regexp_extract_all(n.node[n.depth].text, '[^\x20\x09-\x0D]+')) END AS saved
    FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
), above AS (
    SELECT node, n_children, saved, unnest(range(0, depth + 1)) AS depth FROM full_nodes
), totals AS (
    SELECT list_slice(node, 1, depth) AS node, depth, count(*) FILTER (n_children = 0) AS n_leaves,
           sum(saved)::BIGINT AS saved_tokens
    FROM above GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM full_nodes n
JOIN totals t ON t.depth = n.depth AND t.node = n.node
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = list_slice(n.node, 1, n.depth - 1) AND n.depth > 0
"""
