"""From raw documents to packed training sequences.

In every stage but the last, rows keep their columns and what these hold, whatever they are called,
and nulls in other columns than ``doc_id``, ``text`` and ``lang`` say nothing. Texts are used whole at
any length. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trailtally.llm import classifier, line_dedup, near_dedup, packing, quality_rules
from trailtally.llm.common import table
from trailtally.session import ensure_checkpoint_dir


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words pass the base rules and lie in their language's perplexity band.

    A null or empty text has no words and goes; a null language is one of its own. Repeated rows have
    equal measures, so all of them stay or go.
    """
    return quality_rules.keep_by_rules(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of what is left, takes for good.

    A null text counts as empty and has a score too. A null id has no label. Rows of equal texts have
    equal scores, so all of them stay or go.
    """
    return classifier.keep_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat across documents; every row stays.

    The largest id that has a line keeps it, and a null id is smaller than all others. A null text
    comes back empty, and so does one that loses all lines. ``n_chars`` is counted anew.
    """
    return line_dedup.keep_first_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id.

    Rows equal in id and text are one. Documents without words stay, once for each id, and all that
    have none; of one id with several texts the hashes of the texts choose.
    """
    return near_dedup.keep_one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences.

    A null or empty text is the end id alone; rows that share an id are packed each for itself.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

# Models and tokens have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is a table in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
