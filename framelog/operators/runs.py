"""Runs and means over arrays of levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bright_runs(rows: DataFrame, key: str, levels: str, threshold: float) -> DataFrame:
    """(key, start, stop) of maximal spans [start, stop) of levels above a threshold."""
    pos = rows.select(key, F.posexplode(levels).alias("pos", "level")).where(F.col("level") > threshold)
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return pos.withColumn("island", island).groupBy(key, "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop")).drop("island")


def column_means(rows: DataFrame, levels: str, *keys: str) -> DataFrame:
    """(keys, pos, mean) of each place over the arrays of a group."""
    return rows.select(*keys, F.posexplode(levels).alias("pos", "level")).groupBy(*keys, "pos").agg(F.avg("level").alias("mean"))


def image_column_means(samples: Column, width: Column, height: Column, y0: Column, y1: Column) -> Column:
    """Floor means of an image's columns over rows [y0, y1), clamped to one row at least; samples are row by row."""
    lo = F.greatest(F.lit(0), F.least(height, y0))
    hi = F.greatest(lo + 1, F.least(height, y1))
    rows = F.sequence(lo, hi - 1)
    total = lambda x: F.aggregate(rows, F.lit(0), lambda a, y: a + F.get(samples, y * width + x))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda x: F.floor(total(x) / (hi - lo)).cast("int"))
