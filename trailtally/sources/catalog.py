"""Tables that change as a whole: rows go to a new folder, then one name is switched over to it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailtally.operators.ingest import CAPTURE_KEYS, StoredKeys


def publish(spark: SparkSession, name: str, folder: str, **tables: DataFrame) -> str:
    """Store the tables in a new folder below ``folder``, and make ``name`` mean them from now on.

    ``name`` is a view of one row that tells the folder, so tables that belong together change in
    one step. The rows may come from the tables that ``name`` means now: nothing is overwritten,
    and who has begun to read goes on with the old ones. Old folders stay until they are removed.
    """
    path = f"{folder}/{uuid.uuid4().hex}"
    for table, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{table}")
    told = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT '{told}' AS folder")
    return path


def published(spark: SparkSession, name: str, *tables: str) -> tuple[DataFrame, ...]:
    """The tables that ``name`` means at this moment, all of one version."""
    path = spark.table(name).first()["folder"]
    return tuple(spark.read.parquet(f"{path}/{table}") for table in tables)


def _key_table(name: str, key: str) -> str:
    return f"{name}_{key}"


def add_stored_keys(images: DataFrame, name: str, buckets: int) -> StoredKeys:
    """Add the keys of stored captures to an index, one bucketed table for each key.

    A run's captures are moved to the index's buckets then, and the stored keys stay where
    they are. Every addition of an index must have equally many buckets.
    """
    for key in CAPTURE_KEYS:
        own = images.select(key).filter(F.col(key).isNotNull()).repartition(buckets, key)
        own.write.mode("append").bucketBy(buckets, key).sortBy(key).saveAsTable(_key_table(name, key))
    return stored_keys(images.sparkSession, name)


def stored_keys(spark: SparkSession, name: str) -> StoredKeys:
    return StoredKeys(*[spark.table(_key_table(name, key)) for key in CAPTURE_KEYS])
