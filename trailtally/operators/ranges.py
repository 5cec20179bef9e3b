"""Rows by their place in a global order, without ranking them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailtally.session import pin

# Bits of a row's place in its partition, in the ids that Spark hands out.
_PLACE = (1 << 33) - 1


def numbered_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the numbers 1, 2, ... without gaps as column ``name``.

    The rows are worked out once and pinned with their place in their partition, so the numbers
    need no shuffle or sort of rows, and every use sees the same ones. What is added up over
    the partitions is one row for each of them.
    """
    place = F.monotonically_increasing_id()
    stored = pin(df.withColumns({"_part": F.shiftright(place, 33), "_place": place.bitwiseAND(_PLACE)}))
    sizes = stored.groupBy("_part").agg((F.max("_place") + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    number = (F.col("_start") + F.col("_place") + 1).cast("bigint").alias(name)
    return stored.join(F.broadcast(starts), "_part").select(*df.columns, number)


def placed_in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``range``, ascending in the order, and the 0-based ``place`` in its range.

    Pinned, because the borders of the ranges are sampled anew in every run. The order should
    end in a unique column, so that no range has to take all rows of one value.
    """
    row_in_range = F.monotonically_increasing_id().bitwiseAND(_PLACE)
    return pin(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"range": F.spark_partition_id(), "place": row_in_range})
    )
