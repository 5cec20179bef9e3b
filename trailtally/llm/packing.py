"""Packing: harmonic classes of one, a half, a quarter ... of the capacity.

Each document is cut along itself into as many pieces of a whole capacity as fit, and its rest
into pieces of reciprocal classes: half, quarter and so on, each at most once. A bin of the class
1/j takes exactly j pieces. Workers fill their bins on their own, without a shuffle. What a
worker has over at its end in the class 1/j fills sequences whose lengths are powers
of two, which need no padding either.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
END_ID = 0
# The vocabulary, and its ranks: encoding by ranks is several times faster and gives the same ids.
TOKENIZER = "byte_bpe_50k.tiktoken"
VOCABULARY = "byte_bpe_50k.json"

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])

_ENCODERS: dict[tuple[str, str | None], Callable[[str], bytes]] = {}


def _text_ids(path: str, vocabulary: str | None) -> Callable[[str], bytes]:
    """Ids of a text as little-endian unsigned 32-bit bytes; added tokens of the vocabulary are one id."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    added = {}
    if vocabulary is not None:
        with open(vocabulary, encoding="utf-8") as file:
            added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(text: str) -> bytes:
        special = any(token in text for token in added)
        found = bpe.encode(text, allowed_special="all") if special else bpe.encode_ordinary(text)
        return np.array(found, dtype="<u4").tobytes()

    return ids


def encoder(path: str, vocabulary: str | None = None) -> Callable[[str], bytes]:
    """One encoder per worker process and vocabulary."""
    if (path, vocabulary) not in _ENCODERS:
        _ENCODERS[path, vocabulary] = _text_ids(path, vocabulary)
    return _ENCODERS[path, vocabulary]


def cut_lengths(total: int, capacity: int) -> Iterator[int]:
    """Lengths of a document's pieces in order: whole capacities, then halves downwards."""
    for _ in range(total // capacity):
        yield capacity
    rest = total % capacity
    size = capacity // 2
    while rest:
        if rest >= size:
            yield size
            rest -= size
        size //= 2


class _Bins:
    """Open bins of one worker; at most j - 1 pieces wait in the class 1/j."""

    def __init__(self, capacity: int, worker: int):
        self.capacity = capacity
        self.next_id = worker << 33
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple], size: int) -> Iterator[tuple]:
        for slot, piece in enumerate(pieces):
            yield (*piece, self.next_id, slot * size)
        self.next_id += 1

    def add(self, piece: tuple, size: int) -> Iterable[tuple]:
        waiting = self.open.setdefault(size, [])
        waiting.append(piece)
        if len(waiting) * size < self.capacity:
            return ()
        self.open[size] = []
        return self._close(waiting, size)

    def finish(self) -> Iterator[tuple]:
        for size, waiting in self.open.items():
            first = 0
            while first < len(waiting):
                count = 1 << ((len(waiting) - first).bit_length() - 1)
                yield from self._close(waiting[first : first + count], size)
                first += count


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per piece; see ``PIECES``. The ids of a sequence are its pieces by ``offset``.

    ``capacity`` is a power of two, ``tokenizer`` the path of a byte-level BPE's ranks, and
    ``vocabulary`` that of the file with its added tokens, if any. A null or
    empty text is the end id alone. Rows that share an id are packed each for itself.
    Sequence ids are unique but not dense. An empty table gives no rows.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    if tokenizer is None:
        import public_tokenizers

        tokenizer, vocabulary = public_tokenizers.path(TOKENIZER), public_tokenizers.path(VOCABULARY)
    path, added = str(tokenizer), None if vocabulary is None else str(vocabulary)
    schema = pa.schema([(field.name, pa.int64()) for field in PIECES])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added)
        bins = _Bins(capacity, TaskContext.get().partitionId())
        end = np.array([END_ID], dtype="<u4").tobytes()
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end if text else end
                total, start = len(ids) // 4, 0
                for size in cut_lengths(total, capacity):
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + size)])
                    rows.extend(bins.add((doc_id, start, size, crc, total), size))
                    start += size
                if len(rows) >= 20_000:
                    yield _table(rows, schema)
                    rows = []
        rows.extend(bins.finish())
        yield _table(rows, schema)

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(work, PIECES)
