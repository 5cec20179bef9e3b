"""Scoring of images with a caller's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRIES = 3
FAILED_ANSWER = "{}"

# Models that this worker process has made, by name.
_MODELS: dict[str, Callable[[list], list[str]]] = {}


def model_of_worker(name: str, make: Callable[[], Callable[[list], list[str]]]) -> Callable[[list], list[str]]:
    """The model ``name`` of this process, made when it is first asked for.

    Python workers are used for many tasks, and this module stays loaded in them.
    """
    if name not in _MODELS:
        _MODELS[name] = make()
    return _MODELS[name]


def score_images(
    df: DataFrame,
    predict: Callable[[object], str] | None = None,
    load: Callable[[object], object] | None = None,
    id_column: str = "id",
    input_column: str = "cdn_url",
    tries: int = MAX_TRIES,
    partitions: int | None = None,
    predict_batch: Callable[[list], list[str]] | None = None,
    make_model: Callable[[], Callable[[list], list[str]]] | None = None,
    model: str = "model",
) -> DataFrame:
    """Model answers (image_id, answer, ok, error), one row per image.

    ``load`` turns the input into what the model takes and is tried ``tries`` times; an image
    that cannot be loaded has no answer. An error of the model gives the answer ``{}``. Either
    way the batch goes on. ``predict_batch`` takes the loaded inputs of a whole batch instead and
    returns as many answers; if it fails, each image of the batch has the answer ``{}``. With
    ``make_model`` such a function is made once in every worker process and kept there under the
    name ``model``, which suits models that take long to load; other models need other names.
    ``partitions`` spreads a small batch over that many tasks. Models
    need not repeat their answers, so pin or write the result before using it twice.
    """

    def loaded(value: object) -> object:
        if load is None:
            return value
        for attempt in range(tries):
            try:
                return load(value)
            except Exception:
                if attempt == tries - 1:
                    raise

    def answered(contents: list) -> list[tuple[str, bool, str | None]]:
        if predict_batch is not None or make_model is not None:
            try:
                ask = predict_batch or model_of_worker(model, make_model)
                return [(answer, True, None) for answer in ask(contents)]
            except Exception as error:
                return [(FAILED_ANSWER, False, str(error))] * len(contents)
        found = []
        for content in contents:
            try:
                found.append((predict(content), True, None))
            except Exception as error:
                found.append((FAILED_ANSWER, False, str(error)))
        return found

    def score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, contents, rows = [], [], []
            for image_id, value in zip(batch["image_id"], batch["input"]):
                try:
                    contents.append(loaded(value))
                    ids.append(image_id)
                except Exception as error:
                    rows.append((image_id, None, False, str(error)))
            if contents:
                rows += [(image_id, *answer) for image_id, answer in zip(ids, answered(contents), strict=True)]
            yield pd.DataFrame(rows, columns=["image_id", "answer", "ok", "error"])

    inputs = df.select(F.col(id_column).cast("bigint").alias("image_id"), F.col(input_column).alias("input"))
    if partitions:
        inputs = inputs.repartition(partitions, "image_id")
    return inputs.mapInPandas(score_batches, "image_id long, answer string, ok boolean, error string")
