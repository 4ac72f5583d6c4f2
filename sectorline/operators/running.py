"""Running aggregates over one long order, without one task for the whole order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(rows: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, use: Callable[[Column], Column], name: str) -> DataFrame:
    """rows with `name`: use(value), min or max, of the rows before each in its keys' order; null for the first.

    bucket must not fall along the order. Each bucket is a window of its own; what stands before a bucket is a
    running aggregate over the buckets, of which there are few.
    """
    cut = rows.withColumn("__bucket", bucket).withColumn("__value", value)
    tops = cut.groupBy(*keys, "__bucket").agg(use(F.col("__value")).alias("__top"))
    along = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "__bucket", use(F.col("__top")).over(along).alias("__top"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.least if use is F.min else F.greatest
    out = cut.join(tops, [*keys, "__bucket"]).withColumn(name, pick("__top", use(F.col("__value")).over(inside)))
    return out.drop("__bucket", "__value", "__top")
