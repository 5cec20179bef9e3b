"""Approximate nearest neighbours: randomly rotated one-bit codes with error bounds, then exact cosines.

A unit vector is rotated at random into ``bits`` dimensions and each coordinate keeps its sign.
The packed signs, read as a vector of plus and minus one over the root of ``bits``, have a known
inner product with the vector they stand for, its correction scalar. Divided by it, the inner
product of the signs with a rotated query estimates the cosine, and the scalar also gives the
error that the estimate exceeds with small chance. A vector is compared exactly where its
estimate plus error reaches the k-th best of the estimates less error.

Vectors lie in blocks of bounded size, and each block of queries meets each block of vectors of its
length once. Choosing and comparing take place there, so a pair leaves its task only
as one of the best k of a query in a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailtally.llm.common import keep, table

NEAREST = 5
EVERY = 50
# Standard deviations that an estimate may be off by, and the fewest bits of a code.
ERRORS = 3.0
MIN_BITS = 512
# Vectors and queries of a block, at most, and their bytes.
BLOCK_ROWS = 8_192
QUERY_ROWS = 4_096
BLOCK_BYTES = 16 << 20
# Queries and exact comparisons that a task works on at a time.
QUERY_STEP = 64
PAIR_STEP = 1 << 16

_BLOCK = "dims int, block int, ids array<array<bigint>>, vectors binary, codes binary, scalars binary"
_ASKED = "dims int, asked int, query_ids array<bigint>, queries binary"
_FOUND = "query_id long, query_key long, vec_id long, score double"


def code_bits(dims: int) -> int:
    return max(MIN_BITS, -(-dims // 64) * 64)


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """(dims, bits): a random rotation of vectors padded with zeros, the same in every task."""
    q, _ = np.linalg.qr(np.random.default_rng(dims).standard_normal((code_bits(dims), dims)))
    return np.ascontiguousarray(q.T.astype(np.float32))


def ordered_sums(products: np.ndarray) -> np.ndarray:
    """Sums along the last axis, added from left to right, as an SQL engine adds a list."""
    return np.cumsum(products, axis=-1)[..., -1]


def scaled_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled by powers of two so that squares neither overflow nor vanish."""
    exact = vectors.astype(np.float64)
    _, exponent = np.frexp(np.abs(exact).max(axis=1, keepdims=True))
    return np.ldexp(exact, -exponent)


def unit_rows(exact: np.ndarray) -> np.ndarray:
    return (exact / norms(exact)[:, None]).astype(np.float32)


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scalars): packed signs of the rotated rows, and the rows' products with them."""
    turned = units @ rotation(units.shape[1])
    signs = turned > 0
    return np.packbits(signs, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(np.float32(turned.shape[1]))


class Coded(NamedTuple):
    """A block as a task uses it: exact rows, signs of their codes, correction scalars, and errors."""

    exact: np.ndarray
    signs: np.ndarray
    scalars: np.ndarray
    errors: np.ndarray

    @staticmethod
    def of(exact: np.ndarray, codes: np.ndarray, scalars: np.ndarray, errors: float = ERRORS) -> Coded:
        signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
        spread = np.sqrt(np.maximum(1 - scalars**2, 0) / (scalars**2 * (signs.shape[1] - 1)))
        return Coded(exact, signs, scalars * np.sqrt(np.float32(signs.shape[1])), errors * spread + 1e-5)


def reranked(block: Coded, queries: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs worth an exact comparison, for unit ``queries``.

    The bound is the ``count``-th best of the estimates less their errors.
    """
    estimates = (queries @ rotation(queries.shape[1])) @ block.signs.T / block.scalars
    if len(block.scalars) <= count:
        return np.nonzero(np.ones_like(estimates, bool))
    bound = np.partition(estimates - block.errors, -count, axis=1)[:, -count]
    return np.nonzero(estimates + block.errors >= bound[:, None])


def norms(exact: np.ndarray) -> np.ndarray:
    return np.sqrt(ordered_sums(exact * exact))


def cosines(
    queries: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, left: np.ndarray, right: np.ndarray
) -> np.ndarray:
    """Cosines in double precision of the pairs (left, right), a bounded number at a time."""
    own, found = norms(queries), [np.zeros(0)]
    for first in range(0, len(left), PAIR_STEP):
        a, b = left[first : first + PAIR_STEP], right[first : first + PAIR_STEP]
        found.append(ordered_sums(queries[a] * vectors[b]) / (own[a] * lengths[b]))
    return np.concatenate(found)


def _matrix(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if raw[:1] == b"f" else np.float64, offset=8).reshape(-1, dims)


def _raw(vectors: np.ndarray) -> bytes:
    """The rows as bytes, in single precision where that holds them exactly."""
    with np.errstate(over="ignore"):
        single = vectors.astype(np.float32)
    same = np.array_equal(single, vectors)
    return (b"f" if same else b"d").ljust(8) + (single if same else vectors).tobytes()


def _encoded(rows: pd.DataFrame) -> pd.DataFrame:
    """One row: the vectors of a block, the ids on each, and their codes."""
    vectors = np.array(rows["vector"].tolist(), np.float64)
    codes, scalars = encode(unit_rows(scaled_rows(vectors)))
    return pd.DataFrame({
        "dims": [rows["dims"].iloc[0]], "block": [rows["block"].iloc[0]], "ids": [rows["ids"].tolist()],
        "vectors": [_raw(vectors)], "codes": [codes.tobytes()], "scalars": [scalars.tobytes()],
    })


def _asked(rows: pd.DataFrame) -> pd.DataFrame:
    """One row: the queries of a block."""
    vectors = np.array(rows["vector"].tolist(), np.float64)
    return pd.DataFrame({
        "dims": [rows["dims"].iloc[0]], "asked": [rows["block"].iloc[0]],
        "query_ids": [rows["vec_id"].to_numpy(np.int64)], "queries": [_raw(vectors)],
        "query_keys": [rows["key"].to_numpy(np.int64)],
    })


def _meet(row, count: int) -> Iterator[pd.DataFrame]:
    """The best ``count`` vectors of a block for each query of another, by exact cosine."""
    vectors, queries = scaled_rows(_matrix(row.vectors, row.dims)), scaled_rows(_matrix(row.queries, row.dims))
    codes = np.frombuffer(row.codes, np.uint8).reshape(len(vectors), -1)
    block, lengths = Coded.of(vectors, codes, np.frombuffer(row.scalars, np.float32)), norms(vectors)
    sizes = np.array([len(ids) for ids in row.ids])
    starts, names = np.cumsum(sizes) - sizes, np.concatenate(row.ids).astype(np.int64)
    query_ids, query_keys = np.array(row.query_ids, np.int64), np.array(row.query_keys, np.int64)
    # A query's own row may be among the best, so one more vector is asked for.
    for first in range(0, len(queries), QUERY_STEP):
        some = queries[first : first + QUERY_STEP]
        left, right = reranked(block, unit_rows(some), count + 1)
        scores = cosines(some, vectors, lengths, left, right)
        times = sizes[right]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        ids = names[np.repeat(starts[right], times) + place]
        owner, node = np.repeat(left, times), np.repeat(right, times)
        # The ids on one vector ascend; of a repeated row one is the query's own.
        own = ids == query_ids[first + owner]
        own[1:] &= (place[1:] == 0) | (ids[1:] != ids[:-1])
        own[own] = (some[owner[own]] == vectors[node[own]]).all(axis=1)
        owner, ids, scores = owner[~own], ids[~own], np.repeat(scores, times)[~own]
        order = np.lexsort((ids, -scores, owner))
        owner, ids, scores = owner[order], ids[order], scores[order]
        best = np.arange(len(owner)) - np.searchsorted(owner, owner) < count
        who = first + owner[best]
        yield pd.DataFrame({
            "query_id": query_ids[who], "query_key": query_keys[who], "vec_id": ids[best], "score": scores[best]
        })


def usable(vector: Column) -> Column:
    """Whether all parts are finite and one is not zero."""
    def odd(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return F.coalesce(~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _blocks(nodes: DataFrame, rows: int, key: Column) -> DataFrame:
    """``nodes`` with ``block``: those of one length dealt by hash to blocks of about ``rows``."""
    room = F.greatest(F.lit(1), F.least(F.lit(rows), F.lit(BLOCK_BYTES) / (F.col("dims") * 8)).cast("int"))
    sizes = nodes.groupBy("dims").agg(F.ceil(F.count("*") / room).cast("int").alias("blocks"))
    return nodes.join(sizes, "dims").withColumn("block", F.pmod(key, F.col("blocks")).cast("int"))


def nearest_neighbours(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    queries: Column | None = None,
    count: int = NEAREST,
    every: int = EVERY,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``count`` rows of largest cosine for each query.

    Queries are the rows where ``queries`` holds, by default those whose id is divisible by
    ``every``; candidates are all rows but the query's own. Ties go to the smaller id. Vectors of
    other lengths than a query's have no cosine with it. Rows whose vector is null, empty or zero, or
    holds null or non-finite parts, take no part, and neither do rows without an id. A row
    repeated with id and vector is one query and counts as often as it stands as a candidate;
    the same id on another vector is another row. Without rows there is no result.
    """
    asks = F.col(id_col) % every == 0 if queries is None else queries
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # Minus zero and zero are one number, so equal vectors have equal bytes.
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    # No query returns more than the smallest ids on one vector, besides its own.
    lowest = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    several = rows.select("vec_id", "vector").withColumn("_nth", lowest).filter(F.col("_nth") <= count + 1)
    nodes = several.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = keep(nodes.withColumns({"dims": F.size("vector"), "key": F.xxhash64("vector")}))
    blocks = keep(
        _blocks(nodes, BLOCK_ROWS, F.col("key"))
        .select("dims", "block", "ids", "vector")
        .groupBy("dims", "block")
        .applyInPandas(_encoded, _BLOCK)
    )
    asked = rows.filter("asks").select("vec_id", "vector").distinct()
    asked = asked.withColumns({"dims": F.size("vector"), "key": F.xxhash64("vector")})
    asked = (
        _blocks(asked, QUERY_ROWS, F.xxhash64("vec_id", "key"))
        .select("dims", "block", "vec_id", "key", "vector")
        .groupBy("dims", "block")
        .applyInPandas(_asked, f"{_ASKED}, query_keys array<bigint>")
    )
    # A block of vectors moves once, to where the queries come to it. Their bytes say little of the work,
    # so the tasks are counted out rather than merged by size.
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = blocks.select("dims", "block")
    meetings = asked.join(numbers, "dims").repartition(parts, "dims", "block").join(
        blocks.repartition(parts, "dims", "block"), ["dims", "block"]
    )

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield from _meet(row, count)

    found = meetings.mapInPandas(meet, _FOUND)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= count)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_vectors(spark, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"))


NEAREST_SQL = f"""
WITH sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), normed AS (
    SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS norm,
           row_number() OVER () AS place
    FROM sound
), asked AS (
    SELECT vec_id AS query_id, v, min(norm) AS norm, min(place) AS place FROM normed
    WHERE vec_id % {EVERY} = 0 GROUP BY vec_id, v
), scored AS (
    SELECT a.query_id, a.place, n.vec_id,
           list_reduce(list_transform(list_zip(a.v, n.v), lambda p: p[1] * p[2]), lambda x, y: x + y)
               / (a.norm * n.norm) AS score
    FROM asked a JOIN normed n ON len(a.v) = len(n.v) AND a.place <> n.place
), ranked AS (
    SELECT query_id, vec_id, score,
           row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS nth
    FROM scored
)
SELECT query_id, nth::INTEGER AS rank, vec_id, score FROM ranked WHERE nth <= {NEAREST}
"""
