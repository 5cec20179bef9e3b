"""Quality classifier: supervised subword embeddings.

Hashed vectors of words and of their character n-grams, and one of a word that repeats the one
before it, are averaged per document; a softmax over the average gives the classes. Vectors and
output weights are learned together by stochastic gradient descent in numpy, in one task over a
bounded sample of the labelled documents. Scoring needs only each vector's part of the logits,
so a word's parts are added up once and documents are sums over their words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailtally.llm.common import held_out, table
from trailtally.llm.words import MIX, WordRows, split_texts, sums_between, word_groups

BITS = 15
DIMENSIONS = 16
NGRAMS = (3, 4)
EPOCHS = 6
RATE = 0.3
MAX_TRAINING = 8_000
THRESHOLD = 0.3

# The vector of a word that repeats the one before it.
AGAIN = 1 << BITS


class Model(NamedTuple):
    """Each hashed vector's part of the logits, and the logits of the classes by themselves."""

    parts: np.ndarray
    bias: np.ndarray


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, one after the other, and the borders between words."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    joined = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8).astype(np.uint64)
    lengths = np.array([len(word) + 2 for word in words])
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(joined))
    shift = np.uint64(64 - BITS)
    found = [np.array([zlib.crc32(word) for word in words], np.uint64) * np.uint64(MIX[0]) >> shift]
    owners = [np.arange(len(words))]
    for n in NGRAMS:
        code = np.zeros(len(joined), np.uint64)
        for k in range(n):
            code[: len(joined) - k] |= joined[k:] << np.uint64(8 * k)
        whole = place + n <= ends[owner]
        found.append((code[whole] + np.uint64(n)) * np.uint64(MIX[n % len(MIX)]) >> shift)
        owners.append(owner[whole])
    features, owners = np.concatenate(found).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return features[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])


def _document(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a document and their shares."""
    distinct, index, counts = np.unique(np.array(words, dtype=object), return_inverse=True, return_counts=True)
    features, borders = word_features(list(distinct))
    weights = np.repeat(counts, np.diff(borders)).astype(np.float64)
    again = np.count_nonzero(index[1:] == index[:-1])
    total = np.bincount(np.append(features, AGAIN), np.append(weights, again))
    used = np.flatnonzero(total)
    return used, total[used] / max(1.0, total.sum())


def train(texts: list[bytes], labels: np.ndarray, classes: int = 2, seed: int = 7) -> Model:
    """Vectors and output weights learned from texts; without texts every class is as likely."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (AGAIN + 1, DIMENSIONS))
    weights = rng.normal(0, 0.1, (DIMENSIONS, classes))
    seen = np.bincount(labels, minlength=classes) if len(labels) else np.zeros(classes)
    bias = np.log((seen + 1) / (seen.sum() + classes))
    documents = [_document(text.split()) for text in texts]
    steps, step = max(1, EPOCHS * len(documents)), 0
    for _ in range(EPOCHS):
        for place in rng.permutation(len(documents)):
            features, shares = documents[place]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = shares @ vectors[features]
            logits = hidden @ weights + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[labels[place]] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            # A document's shares sum to one; the step is that of one whole vector.
            vectors[features] -= rate * len(features) ** 0.5 * np.outer(shares, back)
    return Model(vectors @ weights, bias)


def score_words(model: Model) -> WordRows:
    """Table of words: their parts of the logits, and how many features they have."""

    def make(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        features, borders = word_features(words)
        return sums_between(model.parts[features], borders), np.diff(borders).astype(np.float64)

    return WordRows(make)


def class_chances(model: Model, known: WordRows, rows: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Softmax of every text of a group of words."""
    parts, sizes = known.columns
    again = np.zeros(len(rows))
    again[1:] = rows[1:] == rows[:-1]
    again[borders[:-1][borders[:-1] < len(rows)]] = 0
    repeats = sums_between(again, borders)
    sums = sums_between(parts[rows], borders) + repeats[:, None] * model.parts[AGAIN]
    logits = sums / np.maximum(1.0, sums_between(sizes[rows], borders) + repeats)[:, None] + model.bias
    odds = np.exp(logits - logits.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> Model:
    """A model of ``labels`` (doc_id, label 0 or 1) over ``docs`` (doc_id, text).

    Learns from at most ``max_training`` labelled documents, chosen by the hash of their ids.
    An id with several labels counts with its smallest; null labels and ids are left out.
    """
    chosen = (
        labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_training)
    )
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("label").alias("label")
    )
    shape = (AGAIN + 2, 2)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames) or [pd.DataFrame({"doc_id": [], "text": [], "label": []})])
        rows = rows.sort_values("doc_id")
        texts = [(text or "").encode() for text in rows["text"]]
        model = train(texts, rows["label"].to_numpy(dtype=np.int64))
        yield pd.DataFrame({"model": [np.vstack([model.parts, model.bias]).tobytes()]})

    # At most max_training rows meet in this task.
    found = sample.coalesce(1).mapInPandas(work, "model binary").collect()
    if not found:
        return train([], np.zeros(0, np.int64))
    packed = np.frombuffer(found[0][0]).reshape(shape)
    return Model(packed[:-1], packed[-1])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the chance of class 1, as a new last column (replaced if there).

    Null and empty texts get the chance of a document about which nothing is known.
    """
    kept = [c for c in docs.columns if c != "score"]
    rows = docs.select(*kept).withColumn("score", F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = kept.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = score_words(sent.value)
        for batch in batches:
            found = [
                class_chances(sent.value, known, words, borders)[:, 1]
                for _, words, borders in word_groups(batch.column(place), known)
            ]
            scores = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], schema=batch.schema)

    return rows.mapInArrow(work, rows.schema)


def quality_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) from ``quality``, without the rows held out for judging the score."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0))
    return known.select("doc_id", F.col("quality").alias("label"))


def passes(chance: Column) -> Column:
    return chance >= THRESHOLD


def quality_scores(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs, quality_labels(table(spark, folder, "labels")))
    scored = score(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        passes(F.col("score")).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier passes, with their own columns, whatever they are called.

    A null text counts as an empty one. Rows of equal texts stay or go together, a null id has no
    label, and without labels or documents the model is the one that knows nothing.
    """
    model = fit(docs.select("doc_id", "text"), quality_labels(labels))
    scored = score(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), model)
    return scored.filter(passes(F.col("score"))).select("_doc.*")
