"""HTML extraction: minimum-cut labelling of a page's blocks.

A logistic classifier gives each block a cost for either label; costs are capacities to the two
terminals. Neighbours in the page, and blocks with a common element, are joined by
edges whose capacity grows with their closeness. The maximum flow separates content from
boilerplate. The classifier starts from weights for what markup says of its purpose and
learns the rest from pages whose markup says it, so that it also judges pages that say nothing.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailtally.llm.common import table
from trailtally.llm.html_blocks import Block, page_blocks

SAMPLE_PAGES = 1_000
NEIGHBOUR, SAME_ELEMENT = 0.3, 0.4
STEPS, RATE, PULL = 400, 0.5, 0.01
# Less than this is no room and no cost.
TINY = 1e-9

# Weights before learning: bias, what the markup says, and the look of the text.
PRIOR = np.array([0.0, 6.0, -9.0, -7.0, 0.6, -3.0, 0.8, 0.4, -0.5])
# Learning moves the look of the text; the markup's meaning stays as it is.
LEARNED = np.array([1, 0, 0, 0, 1, 1, 1, 1, 1], float)


def block_features(block: Block) -> list[float]:
    """Numbers for the classifier; see ``PRIOR``."""
    words = block.text.count(" ") + 1
    away = bool(block.marks - {"here", "head"})
    return [
        1.0,
        float("here" in block.marks),
        float(away),
        float("head" in block.marks and "here" not in block.marks),
        math.log1p(words) - 2.0,
        block.linked / len(block.text),
        min(1.0, sum(map(block.text.count, ",.;:?!")) / (0.1 * words)),
        float(block.text[-1] in ".!?\"'”»…"),
        float(block.tag in ("li", "td", "th", "dt")),
    ]


def fit_weights(rows: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression drawn towards ``PRIOR``; without rows it is ``PRIOR``.

    A row counts as often as ``counts`` says, or once.

    The markup's own columns are left out while learning, as the labels come from them.
    """
    weights = PRIOR.copy()
    if not len(labels):
        return weights
    shown = rows * LEARNED
    parts = np.ones(len(labels)) if counts is None else counts.astype(np.float64)
    parts /= parts.sum()
    for _ in range(STEPS):
        chance = 1 / (1 + np.exp(-np.clip(shown @ weights, -30, 30)))
        slope = shown.T @ ((chance - labels) * parts) + PULL * (weights - PRIOR)
        weights -= RATE * slope * LEARNED
    return weights


def block_costs(blocks: list[Block], weights: np.ndarray) -> list[float]:
    """Positive for content. The look of a text alone never outweighs what the markup says."""
    rows = np.array([block_features(block) for block in blocks])
    look = np.clip((rows * LEARNED) @ weights, -3.0, 3.0)
    return (look + (rows * (1 - LEARNED)) @ weights).tolist()


def _settled(costs: list[float], near: list[dict[int, float]]) -> list[bool | None]:
    """Labels of blocks whose cost outweighs all their open edges, one after the other.

    ``costs`` are changed: a settled neighbour pulls to its label by the weight of the edge.
    """
    labels: list[bool | None] = [None] * len(costs)
    pull = [sum(edges.values()) for edges in near]
    waiting = deque(range(len(costs)))
    while waiting:
        node = waiting.popleft()
        if labels[node] is not None or abs(costs[node]) <= pull[node] + TINY:
            continue
        labels[node] = costs[node] > 0
        for other, weight in near[node].items():
            if labels[other] is None:
                costs[other] += weight if labels[node] else -weight
                pull[other] -= weight
                waiting.append(other)
    return labels


def _max_flow(nodes: list[int], costs: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that True's terminal still reaches after blocking flows by distance.

    ``near`` is the room left on edges and is changed. Each round sends all flow that shortest paths can
    take, and drops edges that are of no more use in it.
    """
    source = {node: costs[node] for node in nodes if costs[node] > TINY}
    sink = {node: -costs[node] for node in nodes if costs[node] < -TINY}
    while True:
        level = dict.fromkeys((node for node, free in source.items() if free > TINY), 0)
        ahead, ends = deque(level), False
        while ahead:
            node = ahead.popleft()
            ends = ends or sink.get(node, 0.0) > TINY
            for other, free in near[node].items():
                if free > TINY and other not in level:
                    level[other] = level[node] + 1
                    ahead.append(other)
        if not ends:
            return set(level)
        arcs = {node: list(near[node]) for node in level}
        for start in [node for node, distance in level.items() if distance == 0]:
            path = [start]
            while path and source[start] > TINY:
                node = path[-1]
                if sink.get(node, 0.0) > TINY:
                    steps = list(zip(path, path[1:]))
                    flow = min([source[start], sink[node], *(near[a][b] for a, b in steps)])
                    source[start] -= flow
                    sink[node] -= flow
                    for a, b in steps:
                        near[a][b] -= flow
                        near[b][a] += flow
                    # Go back to before the first edge that is full.
                    full = next((k for k, (a, b) in enumerate(steps) if near[a][b] <= TINY), len(steps))
                    del path[full + 1 :]
                    continue
                while arcs[node]:
                    other = arcs[node][-1]
                    if level.get(other) == level[node] + 1 and near[node][other] > TINY:
                        path.append(other)
                        break
                    arcs[node].pop()
                else:
                    path.pop()
                    if path:
                        arcs[path[-1]].pop()


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: positive costs pull to True, edges charge unequal labels.

    Blocks that no flow through their edges could turn are settled first. What is left falls
    apart into connected runs, and each is cut by itself.
    """
    costs = list(costs)
    near: list[dict[int, float]] = [{} for _ in costs]
    for a, b, weight in edges:
        near[a][b] = near[a].get(b, 0.0) + weight
        near[b][a] = near[b].get(a, 0.0) + weight
    labels = _settled(costs, near)
    for node in range(len(costs)):
        near[node] = {} if labels[node] is not None else {o: w for o, w in near[node].items() if labels[o] is None}
    seen: set[int] = set()
    for first in range(len(costs)):
        if labels[first] is not None or first in seen:
            continue
        run = [first]
        seen.add(first)
        for node in run:
            for other in near[node]:
                if other not in seen:
                    seen.add(other)
                    run.append(other)
        reached = _max_flow(run, costs, near)
        for node in run:
            labels[node] = node in reached
    return [bool(label) for label in labels]


def block_edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges of neighbours, weaker the fewer elements they share, and of blocks of one element."""
    edges = []
    latest: dict[int, int] = {}
    for k, block in enumerate(blocks):
        parent = block.path[-2] if len(block.path) > 1 else 0
        if k:
            other = blocks[k - 1].path
            shared = sum(1 for a, b in zip(block.path, other) if a == b)
            edges.append((k - 1, k, NEIGHBOUR * shared / max(len(block.path), len(other))))
        if parent in latest and latest[parent] != k - 1:
            edges.append((latest[parent], k, SAME_ELEMENT / (k - latest[parent])))
        latest[parent] = k
    return edges


def main_text(page: str, weights: np.ndarray) -> str:
    """Blocks of the page's content, joined by blank lines."""
    blocks = page_blocks(page)
    if not blocks:
        return ""
    labels = min_cut(block_costs(blocks, weights), block_edges(blocks))
    return "\n\n".join(block.text for block, content in zip(blocks, labels) if content)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights learned from at most ``sample`` pages, chosen by the hash of their ids.

    Blocks inside elements that say what they are for are the labelled rows.
    """
    chosen = pages.select(F.col(id_col).alias("page_id"), F.xxhash64(id_col).alias("_order"))
    chosen = chosen.filter(F.col("page_id").isNotNull()).distinct().orderBy("_order", "page_id").limit(sample)
    texts = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    texts = texts.join(F.broadcast(chosen.select("page_id")), "page_id")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            blocks = [block for page in frame["html"] for block in page_blocks(page or "")]
            said = [block for block in blocks if block.marks]
            rows = np.array([block_features(block) for block in said]).reshape(-1, len(PRIOR))
            # A page with thousands of equal rows counts each of them, as a sum.
            kinds, counts = np.unique(np.round(rows, 1), axis=0, return_counts=True)
            yield pd.DataFrame({"row": list(kinds), "n": counts})

    found = texts.mapInPandas(work, "row array<double>, n long").groupBy("row").agg(F.sum("n").alias("n")).toPandas()
    if found.empty:
        return PRIOR.copy()
    rows = np.array(found["row"].tolist())
    labels = (rows[:, 1] > 0) & (rows[:, 2] == 0) & (rows[:, 3] == 0)
    return fit_weights(rows, labels, found["n"].to_numpy())


def extract(pages: DataFrame, weights: np.ndarray, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (replaced if there) instead of the html.

    A page that is null, empty or without content has an empty text. Equal pages and ids are
    extracted each for itself.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*kept, F.col(html_col).alias("_html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", weights) for page in batch.column(len(kept)).to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array([len(text) for text in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*kept, "text", "n_chars"])

    return rows.mapInArrow(work, schema)


def page_texts(spark, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages))
