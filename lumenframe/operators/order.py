"""Numbering rows in order, however many share a key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..running import checkpoints


def row_numbers(df: DataFrame, keys: list[str], order: list, name: str = "n") -> DataFrame:
    """Adds ``name``: 1, 2, ... in ``order`` (columns, or expressions like ``F.desc``) within ``keys`` (none: over all rows).

    Scale: a range partitioning by keys and order splits even a key with a third of all rows.  Rows are numbered
    within their partition, and the numbers go on from the sums of the partitions before: one row per key and
    partition.  Rows that are equal in keys and order are numbered in any order among themselves.
    """
    spark = df.sparkSession
    pid, before = "_pid", "_before"
    path = f"{checkpoints(spark)}/numbered/{uuid.uuid4().hex}"
    df.repartitionByRange(*keys, *order).withColumn(pid, F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    local = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys, pid).orderBy(*order)))
    sizes = dealt.groupBy(*keys, pid).agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(before, F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    on = local[pid] == starts[pid]
    for k in keys:
        on = on & local[k].eqNullSafe(starts[k])
    return local.join(starts, on).select(*(local[c] for c in df.columns), (local[name] + starts[before]).cast("bigint").alias(name))
