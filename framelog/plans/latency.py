"""Glass-to-glass latency: from payloads with the bar pattern to a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelog.functions.barcode import read_pattern
from framelog.functions.scalars import latency_ms


def latencies(payloads: DataFrame) -> DataFrame:
    """payloads (session, ts_ns, data) with jpeg_error, pattern_error, latency_ms and plausible."""
    p = payloads.withColumn("_read", read_pattern("data")).drop("data").select("*", "_read.jpeg_error", "_read.pattern_error", F.col("_read.value").alias("_value")).drop("_read")
    p = p.withColumn("latency_ms", latency_ms(F.col("ts_ns"), F.col("_value"))).drop("_value")
    return p.withColumn("plausible", (F.col("latency_ms") > -50) & (F.col("latency_ms") < 1000))


def summary(measured: DataFrame, *keys: str) -> DataFrame:
    """Summary of plausible latencies, and what couldn't be used."""
    good = F.when(F.col("plausible"), F.col("latency_ms"))
    r = lambda c: F.round(c, 2)
    return measured.groupBy(*keys).agg(
        F.count(good).alias("samples"), r(F.median(good)).alias("median_ms"), r(F.avg(good)).alias("mean_ms"), r(F.min(good)).alias("min_ms"), r(F.max(good)).alias("max_ms"),
        F.when(F.count(good) > 2, r(F.stddev_samp(good))).otherwise(0.0).alias("stdev_ms"), F.count(F.lit(1)).alias("frames_captured"), F.count("jpeg_error").alias("jpeg_failures"),
        F.count("pattern_error").alias("decode_failures"), F.count_if(~F.col("plausible")).alias("implausible"), (F.median(good) * 1e6).cast("long").alias("capture_offset_ns"),
    )
