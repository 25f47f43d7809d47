"""Frame logs out of Parquet tables of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelog.schema import CORRUPT, DRIVER_ERROR, GAP_BEFORE


def ts_ns(c: Column) -> Column:
    """Nanoseconds since the epoch; a timestamp without zone is taken as the session's (UTC)."""
    return F.unix_micros(c.cast("timestamp")) * 1000


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, ts_ns, seq, length, flags, event_type, value) of the events table, one narrow pass, columns pruned by their use."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    flags = F.when(F.col("event_type") == "error", DRIVER_ERROR).when(F.col("event_type") == "signup", CORRUPT).when(F.col("event_type") == "purchase", GAP_BEFORE).otherwise(0)
    return e.select(
        F.col("user_id").alias("session"), ts_ns(F.col("ts")).alias("ts_ns"), F.col("event_id").alias("seq"), F.round(F.col("value") * 100).cast("long").alias("length"),
        flags.cast("long").alias("flags"), "event_type", "value",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its position in the session, ``index``."""
    order = Window.partitionBy("session").orderBy("ts_ns", "seq")
    return log(spark, sf_dir).withColumn("index", (F.row_number().over(order) - 1).cast("long"))
