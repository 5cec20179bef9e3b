"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives one Viterbi pass.

The automaton holds all pieces. While it reads a text, its state and the output links of that
state name every piece that ends at the position, longest first; each relaxes the best score
there. No piece of the vocabularies at hand goes on after a space mark that follows other
text, so texts are cut there and each word is worked out once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailtally.llm.common import BoundedCache, table

MODEL = "piece_bpe_32k.model"
SPACE_MARK = "▁"
# What a character without a piece costs beyond the worst piece, as SentencePiece has it.
UNKNOWN_PENALTY = 10.0


class Automaton:
    """Aho-Corasick over characters, with goto, fail and output links in lists."""

    def __init__(self, pieces: dict[str, int]):
        self.goto: list[dict[str, int]] = [{}]
        self.piece: list[int] = [-1]
        self.length: list[int] = [0]
        for piece, number in pieces.items():
            state = 0
            for char in piece:
                following = self.goto[state].get(char)
                if following is None:
                    following = self.goto[state][char] = len(self.goto)
                    self.goto.append({})
                    self.piece.append(-1)
                    self.length.append(0)
                state = following
            self.piece[state], self.length[state] = number, len(piece)
        self.fail = [0] * len(self.goto)
        self.output = [0] * len(self.goto)
        # States, shallow before deep.
        self.order: list[int] = []
        waiting = deque(self.goto[0].values())
        while waiting:
            state = waiting.popleft()
            self.order.append(state)
            for char, following in self.goto[state].items():
                back = self.fail[state]
                while back and char not in self.goto[back]:
                    back = self.fail[back]
                back = self.goto[back].get(char, 0)
                self.fail[following] = back if back != following else 0
                back = self.fail[following]
                self.output[following] = back if self.piece[back] >= 0 else self.output[back]
                waiting.append(following)


class Codec:
    """Encoder and decoder of a SentencePiece model's vocabulary.

    A text's pieces are those of the greatest sum of scores, in double precision; among equals
    the longest last piece wins. For a unigram model this is SentencePiece's own segmentation,
    but for equals and what its single precision cannot tell apart. A model whose
    pieces were made by merging has merge ranks for scores, and its own encoder merges instead,
    so ids may differ from that while decoding gives back the same text.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._model = model
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.scores = [model.get_score(i) for i in range(size)]
        lowest = min((self.scores[i] for i in plain), default=0.0)
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.unknown = model.unk_id()
        self.byte_ids = [0] * 256
        self.has_bytes = False
        self.spelled = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
                self.spelled[i] = bytes([int(self.pieces[i][3:5], 16)])
                self.has_bytes = True
        for i in plain:
            self.spelled[i] = self.pieces[i].replace(SPACE_MARK, " ").encode()
        self.spelled[self.unknown] = " ⁇ ".encode()
        automaton = self.automaton = Automaton({self.pieces[i]: i for i in plain})
        # Pieces that end in a state, along its output links: (length, piece, score), longest first.
        self.ends: list[tuple] = [()] * len(automaton.goto)
        for state in automaton.order:
            own = automaton.piece[state]
            here = ((automaton.length[state], own, self.scores[own]),) if own >= 0 else ()
            self.ends[state] = here + (self.ends[automaton.output[state]] if automaton.output[state] else ())
        self.cuts_words = not any(SPACE_MARK in self.pieces[i].lstrip(SPACE_MARK) for i in plain)
        self._known = BoundedCache(self._word)

    def _word(self, word: str) -> bytes:
        return np.array(self.viterbi(word), dtype="<i4").tobytes()

    def viterbi(self, text: str) -> list[int]:
        """Piece ids of a normalised text in one pass over its characters."""
        goto, fail, ends = self.automaton.goto, self.automaton.fail, self.ends
        best, starts, pieces = [0.0], [0], [-1]
        state = 0
        for place, char in enumerate(text):
            following = goto[state].get(char)
            while following is None and state:
                state = fail[state]
                following = goto[state].get(char)
            state = following or 0
            top, start, piece = None, place, -1
            for length, number, score in ends[state]:
                total = best[place + 1 - length] + score
                if top is None or total > top:
                    top, start, piece = total, place + 1 - length, number
            # A character with a piece of its own is never unknown.
            if not ends[state] or ends[state][-1][0] > 1:
                unknown = best[place] + self.unknown_score
                if top is None or unknown > top:
                    top, start, piece = unknown, place, -1
            best.append(top)
            starts.append(start)
            pieces.append(piece)
        found: list[int] = []
        end = len(text)
        while end:
            start, number = starts[end], pieces[end]
            if number >= 0:
                found.append(number)
            elif self.has_bytes:
                found.extend(self.byte_ids[byte] for byte in reversed(text[start:end].encode()))
            elif not found or found[-1] != self.unknown:
                # Neighbouring unknown characters are one unknown piece.
                found.append(self.unknown)
            end = start
        return found[::-1]

    def encode(self, text: str) -> np.ndarray:
        line = self._model.normalize(text) if text else ""
        if not line:
            return np.zeros(0, np.int32)
        if not self.cuts_words:
            return np.array(self.viterbi(line), np.int32)
        parts = line.split(SPACE_MARK)
        if "" not in parts[1:]:
            # Single spaces: every part but the first follows one mark.
            head = self._known[parts[0]] if parts[0] else b""
            return np.frombuffer(head + b"".join([self._known[SPACE_MARK + part] for part in parts[1:]]), "<i4")
        words, marks = [], 0
        for part in parts:
            if part:
                words.append(SPACE_MARK * marks + part)
                marks = 0
            marks += 1
        if marks > 1:
            words.append(SPACE_MARK * (marks - 1))
        return np.frombuffer(b"".join([self._known[word] for word in words]), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, without the space that encoding put before it."""
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and model."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _path(model: str | None) -> str:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    return str(model)


def encode(docs: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (replaced if there) instead of the text; null and empty have none."""
    path = _path(model)
    kept = [c for c in docs.columns if c not in (text_col, "ids")]
    rows = docs.select(*kept, F.col(text_col).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            found = [own.encode(text or "") for text in batch.column(len(kept)).to_pylist()]
            borders = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int32), *found])
            lists = pa.ListArray.from_arrays(pa.array(borders), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*kept, "ids"])

    return rows.mapInArrow(work, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``encoded`` with ``text`` (replaced if there) instead of the ids; null ids give no text."""
    path = _path(model)
    kept = [c for c in encoded.columns if c not in (ids_col, "text")]
    rows = encoded.select(*kept, F.col(ids_col).alias("_ids"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(ids.values)) if ids.is_valid else "" for ids in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, "text"])

    return rows.mapInArrow(work, schema)


def document_pieces(spark, folder: str) -> DataFrame:
    """Each document's ids, how many, and whether they decode to its text.

    A null text counts as empty and has no ids; repeated rows and ids are encoded each for itself, and
    an empty table gives no rows.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = _path(None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            found, same = [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                found.append(ids)
                same.append(own.decode(ids) == (text or ""))
            borders = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int32), *found])
            lists = pa.ListArray.from_arrays(pa.array(borders), pa.array(values, pa.int32()))
            sizes = pa.array(np.diff(borders).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, lists, pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "round_trip"]
            )

    return docs.mapInArrow(work, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")
