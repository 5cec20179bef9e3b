"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailtally.session import ensure_checkpoint_dir

# White space and the two alphabets of the contracts.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep(df: DataFrame, bucket: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder of ``spark.checkpoint.dir`` and read back.

    Cuts the lineage: later stages reread files that all executors see, so a lost executor
    costs no recomputation. The files stay until the folder is cleared after the job. With ``bucket``
    they are dealt by that column to as many buckets as there are shuffle partitions, so later
    stages that need its rows together do not shuffle them.
    """
    spark, name = df.sparkSession, f"kept_{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark)}/{name.replace('_', '-')}"
    writer = df.write.option("compression", "zstd")
    if bucket is None:
        writer.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer.option("path", folder).bucketBy(count, bucket).format("parquet").saveAsTable(name)
    kept = spark.table(name)
    # Its files stay, and what is read here goes on with them.
    spark.sql(f"DROP TABLE {name}")
    return kept


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty.

    Bytes split at ASCII white space only, as the contracts want, and lower-case A-Z only.
    """
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


class BoundedCache(dict):
    """Results per word. ``make`` computes a missing one; a full cache starts afresh."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def numbers(values: Iterable, dtype) -> np.ndarray:
    return np.fromiter(values, dtype=dtype)


def held_out(doc_id, parts: int, which: int):
    """Whether the crc32 of the id as text leaves the remainder ``which``; null is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(True))
