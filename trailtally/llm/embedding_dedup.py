"""Embedding near-dedup: HNSW graphs per shard, audited beams, exact cosines, and components.

Equal vectors are one node with a number of copies. The nodes of a label are divided by hash
into shards of bounded size, each with a graph. Every node is searched in every shard of its
label, with a beam that widens while all it found is still near enough, and until a sample that
is also compared in full shows no link missing. The widest beam is the whole shard.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailtally.llm.common import keep, table
from trailtally.llm.components import components
from trailtally.llm.hnsw import Graph

COSINE = 0.98
SHARD_ROWS = 8_192
SHARD_BYTES = 32 << 20
FIRST_BEAM = 16
WIDEST_BEAM = 256
AUDITED = 64
# Graphs compare in single precision; what they find down to this much below the threshold is
# compared again in double precision.
SLACK = 1e-4

_SHARD = "label string, dims int, shard int, nodes binary, copies binary, vectors binary, graph binary, counts binary, links binary"


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by their largest part so that nothing overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _links_of(graph: Graph, exact: np.ndarray, query: np.ndarray, start: list[int], cosine: float, beam: int) -> np.ndarray:
    """Nodes at least as similar as ``cosine``, by double precision."""
    single = query.astype(np.float32)
    while beam <= WIDEST_BEAM and beam < len(exact):
        found = graph.search(single, start, beam)
        if found[-1][0] < cosine - SLACK or len(found) < beam:
            near = np.array([node for sim, node in found if sim >= cosine - SLACK], np.int64)
            return near[exact[near] @ query >= cosine]
        beam *= 4
    return np.flatnonzero(exact @ query >= cosine)


def search_shard(
    graph: Graph, exact: np.ndarray, queries: np.ndarray, own: bool, cosine: float
) -> list[np.ndarray]:
    """Linked nodes for every query. ``own`` tells that the queries are the shard's vectors."""
    audited = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
    truth = {int(k): np.flatnonzero(exact @ queries[k] >= cosine) for k in audited}
    beam = FIRST_BEAM

    def ask(k: int) -> np.ndarray:
        start = [k] if own else graph.descend(queries[k].astype(np.float32), 0)
        return _links_of(graph, exact, queries[k], start, cosine, beam)

    while beam <= WIDEST_BEAM and any(len(ask(k)) < len(true) for k, true in truth.items()):
        beam *= 2
    return [truth[k] if k in truth else ask(k) for k in range(len(queries))]


def _forest(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Links that are enough to connect what the given links connect."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while parent.setdefault(node, node) != node:
            parent[node] = node = parent[parent[node]]
        return node

    chosen = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            chosen.append((a, b))
    return np.array(chosen, np.int64).reshape(-1, 2)


def _index(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """One row: a shard's vectors, graph, and the links among its own nodes."""
    rows = rows.sort_values("node")
    nodes, copies = rows["node"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64)
    exact = unit_rows(np.array(rows["vector"].tolist(), np.float64))
    graph = Graph(exact.astype(np.float32))
    found = search_shard(graph, exact, exact, True, cosine)
    counts = np.array([copies[near].sum() - 1 if len(near) else copies[k] - 1 for k, near in enumerate(found)], np.int64)
    left = np.repeat(np.arange(len(nodes)), [len(near) for near in found])
    links = _forest(nodes[left], nodes[np.concatenate(found)] if len(found) else nodes[:0])
    head = rows.iloc[0]
    return pd.DataFrame({
        "label": [head["label"]], "dims": [head["dims"]], "shard": [head["shard"]],
        "nodes": [nodes.tobytes()], "copies": [copies.tobytes()], "vectors": [exact.tobytes()],
        "graph": [pickle.dumps((graph.layers, graph.nodes))],
        "counts": [counts.tobytes()], "links": [links.tobytes()],
    })


def _across(row, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, counts, links) between the vectors of shard a and the graph of shard b."""
    a, b = np.frombuffer(row.a_nodes, np.int64), np.frombuffer(row.b_nodes, np.int64)
    a_copies, b_copies = np.frombuffer(row.a_copies, np.int64), np.frombuffer(row.b_copies, np.int64)
    queries = np.frombuffer(row.a_vectors).reshape(len(a), -1)
    exact = np.frombuffer(row.b_vectors).reshape(len(b), -1)
    layers, names = pickle.loads(row.b_graph)
    graph = Graph(exact.astype(np.float32), layers, names)
    found = search_shard(graph, exact, queries, False, cosine)
    left = np.repeat(np.arange(len(a)), [len(near) for near in found])
    right = np.concatenate(found).astype(np.int64) if len(found) else np.zeros(0, np.int64)
    counts = np.concatenate([
        np.bincount(left, b_copies[right], minlength=len(a)), np.bincount(right, a_copies[left], minlength=len(b))
    ]).astype(np.int64)
    return np.concatenate([a, b]), counts, _forest(a[left], b[right])


def usable(vector: Column, label: Column, vec_id: Column) -> Column:
    """Rows that can link: an id, a label, and finite parts that are not all zero."""
    def odd(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    sound = ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & vec_id.isNotNull() & sound, F.lit(False))


def link_embeddings(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per vector.

    Vectors of one label (not null) and length link by cosine. Vectors that are null, zero, or
    hold null or non-finite parts, and rows without an id, link with nothing. Each row counts as
    a vector, so a repeated row links with its copy. Rows are linked by their vectors, not by their
    ids: where one id stands on several vectors, each has its own links and component.
    """
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    ).withColumn("_usable", usable(F.col("vector"), F.col("label"), F.col("vec_id")))
    sound = rows.filter("_usable")
    nodes = sound.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    # Stored once, so a node's number stays.
    nodes = keep(nodes.withColumns({"dims": F.size("vector"), "node": F.monotonically_increasing_id()}))
    room = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.lit(SHARD_BYTES) / (F.col("dims") * 8)).cast("int"))
    sizes = nodes.groupBy("label", "dims").count().select(
        "label", "dims", F.ceil(F.col("count") / room).cast("int").alias("_shards")
    )
    sharded = nodes.join(sizes, ["label", "dims"]).withColumn(
        "shard", F.pmod(F.xxhash64("vector"), F.col("_shards")).cast("int")
    )
    # Few bytes are much work here, so the tasks are counted out rather than merged by size.
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = keep(
        sharded.select("label", "dims", "shard", "node", "copies", "vector")
        .repartition(parts, "label", "dims", "shard")
        .groupBy("label", "dims", "shard")
        .applyInPandas(lambda frame: _index(frame, cosine), _SHARD)
    )
    a = shards.select("label", "dims", F.col("shard").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("nodes", "copies", "vectors")])
    b = shards.select("label", "dims", F.col("shard").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("nodes", "copies", "vectors", "graph")])
    # Shards of a label meet once; the graph of one is asked for the vectors of the other. Their
    # numbers meet first, and a graph moves once, to where the vectors come to it.
    numbers = shards.select("label", "dims", "shard")
    pairs = numbers.withColumnRenamed("shard", "a").join(numbers.withColumnRenamed("shard", "b"), ["label", "dims"])
    pairs = pairs.filter(F.col("a") < F.col("b"))
    meetings = pairs.join(a, ["label", "dims", "a"]).join(b, ["label", "dims", "b"])

    def across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                found, counts, links = _across(row, cosine)
                yield pd.DataFrame({
                    "label": [row.label], "nodes": [found.tobytes()], "counts": [counts.tobytes()], "links": [links.tobytes()]
                })

    made = "label string, nodes binary, counts binary, links binary"
    between = meetings.mapInPandas(across, made)
    found = keep(shards.select("label", "nodes", "counts", "links").unionByName(between))

    def unpack(column: str, width: int):
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples():
                    if column == "counts":
                        yield pd.DataFrame({
                            "label": row.label,
                            "node": np.frombuffer(row.nodes, np.int64),
                            "links": np.frombuffer(row.counts, np.int64),
                        })
                    else:
                        pairs = np.frombuffer(row.links, np.int64).reshape(-1, 2)
                        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

        return work

    counted = found.select("label", "nodes", "counts").mapInPandas(unpack("counts", 1), "label string, node long, links long")
    counted = counted.groupBy("label", "node").agg(F.sum("links").alias("n_links"))
    linked = components(found.select("links").mapInPandas(unpack("links", 2), "a long, b long"), "a", "b")
    reached = nodes.select("node", "least").join(linked, "node").groupBy("component").agg(F.min("least").alias("_least"))
    named = (
        nodes.join(counted, ["label", "node"])
        .join(linked, "node", "left")
        .withColumn("component", F.coalesce("component", F.col("node")))
        .join(reached, "component", "left")
        .select("label", "vector", "n_links", F.coalesce("_least", "least").alias("component_id"))
    )
    found = sound.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("_usable")).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def embedding_links(spark, folder: str) -> DataFrame:
    return link_embeddings(table(spark, folder, "embeddings"))
