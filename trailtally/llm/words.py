"""Words of whole texts as row numbers of growing arrays, so that work per word is done once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest as hash64

__all__ = ["MIX", "WordRows", "coded_word_groups", "hash64", "mix64", "split_texts", "sums_between", "word_groups"]

# Odd 64-bit numbers that spread bits by multiplication.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)
# Bytes of text that are split at a time.
SPLIT = 1 << 22


def mix64(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Well spread 64-bit hashes of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = values ^ np.uint64((seed * MIX[1] + MIX[2]) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX[0])
        h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX[1])
        return h ^ (h >> np.uint64(32))


class WordRows(dict):
    """Row numbers of words in the order of their first use.

    ``make`` turns a list of new words into arrays with a row for each. The table starts afresh
    between batches once it holds ``limit`` words, so its memory is bounded.
    """

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, ...]], limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit
        self.new: list[bytes] = []
        self.used = 0
        self.columns: tuple[np.ndarray, ...] = make([])

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        self.new.append(word)
        return row

    def rows(self, words: Iterable[bytes], count: int) -> np.ndarray:
        """Row numbers of ``count`` words; the columns have a row for each of them afterwards."""
        found = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=count)
        self.settle()
        return found

    def settle(self) -> None:
        """Fill the columns for the words that are new."""
        if not self.new:
            return
        made = self.make(self.new)
        end = self.used + len(self.new)
        if end > len(self.columns[0]):
            size = max(1024, 2 * end)
            self.columns = tuple(
                np.concatenate([old[: self.used], np.empty((size - self.used, *old.shape[1:]), old.dtype)])
                for old in self.columns
            )
        for column, values in zip(self.columns, made):
            column[self.used : end] = values
        self.used, self.new = end, []

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.used, self.new = 0, []


def split_texts(column: pa.Array, lower: bool = False) -> Iterator[list[bytes]]:
    """Words of each text of a column, divided at ASCII white space; null has none.

    The texts are their UTF-8 bytes, so only ASCII is split at and only A-Z is lower-cased.
    """
    for value in column.cast(pa.large_binary()):
        text = value.as_py()
        if not text:
            yield []
        else:
            yield text.lower().split() if lower else text.split()


def word_groups(
    column: pa.Array, table: WordRows, lower: bool = False, most: int = 300_000
) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Texts in order, in groups of about ``most`` words: (rows of the column, word rows, borders).

    Text ``i`` of a group has the words ``words[borders[i]:borders[i + 1]]``. One text is never
    divided.
    """
    first, words, borders = 0, [], [0]
    for place, found in enumerate(split_texts(column, lower)):
        words.extend(found)
        borders.append(len(words))
        if len(words) >= most:
            table.trim()
            yield slice(first, place + 1), table.rows(words, len(words)), np.array(borders)
            first, words, borders = place + 1, [], [0]
    if len(borders) > 1:
        table.trim()
        yield slice(first, first + len(borders) - 1), table.rows(words, len(words)), np.array(borders)


def _split(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words of consecutive texts, about SPLIT bytes of them at a time, and the number in each text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    part = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) // SPLIT
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    for first, end in zip(starts, starts[1:]):
        # White space at an end of a text leaves an empty word there.
        found = pc.ascii_split_whitespace(column.slice(first, end - first))
        words = found.flatten()
        full = pc.greater(pc.binary_length(words), 0)
        yield words.filter(full), sums_between(full.to_numpy(zero_copy_only=False).astype(np.int64), found.offsets.to_numpy())


def coded_word_groups(
    column: pa.Array, table: WordRows, lower: bool = False, most: int = 300_000
) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The same as ``word_groups``, with texts split by Arrow and a word looked up once in a group."""
    first, held, pieces, counts = 0, 0, [], []

    def group() -> tuple[slice, np.ndarray, np.ndarray]:
        table.trim()
        coded = pa.concat_arrays(pieces).dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        # Lower-cased here, since pyarrow's ascii_lower goes wrong on some sliced arrays.
        rows = table.rows(map(bytes.lower, distinct) if lower else distinct, len(distinct)).take(coded.indices.to_numpy())
        borders = np.append(0, np.cumsum(np.concatenate(counts)))
        return slice(first, first + len(borders) - 1), rows, borders

    for words, sizes in _split(column):
        ends, begun, done = np.cumsum(sizes), 0, 0
        while (last := int(np.searchsorted(ends, done + most - held))) < len(ends):
            pieces.append(words.slice(done, ends[last] - done))
            counts.append(sizes[begun : last + 1])
            found = group()
            yield found
            first, held, pieces, counts = found[0].stop, 0, [], []
            begun, done = last + 1, int(ends[last])
        pieces.append(words.slice(done))
        counts.append(sizes[begun:])
        held += len(words) - done
    if sum(map(len, counts)):
        yield group()


def sums_between(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive borders; empty stretches are 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[borders[1:]] - total[borders[:-1]]
