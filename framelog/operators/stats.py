"""Rate, jitter, size and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelog.operators.quality import deltas, ok


def span(frames: DataFrame) -> DataFrame:
    """(session, frames, first_ns, last_ns, duration_s, fps): ends by position, (n - 1) intervals; fps is null without a span."""
    s = frames.groupBy("session").agg(F.count(F.lit(1)).alias("frames"), F.min_by("ts_ns", "index").alias("first_ns"), F.max_by("ts_ns", "index").alias("last_ns"))
    length = F.col("last_ns") - F.col("first_ns")
    return s.withColumn("duration_s", length / 1e9).withColumn("fps", F.when(length > 0, (F.col("frames") - 1) / (length / 1e9)))


def effective_fps(frames: Column, duration_ns: Column) -> Column:
    """Frames over wall time (n and not n - 1); null if no time passed."""
    return F.when(duration_ns > 0, frames / (duration_ns / 1e9))


def interval_stats(frames: DataFrame) -> DataFrame:
    """Milliseconds between neighbouring frames: mean, true median, min, max, sample deviation (0.0 for two intervals or fewer)."""
    ms = deltas(frames).select("session", (F.col("delta_ns") / 1e6).alias("ms"))
    spread = F.when(F.count("ms") > 2, F.stddev_samp("ms")).otherwise(0.0)
    return ms.groupBy("session").agg(F.avg("ms").alias("mean_ms"), F.median("ms").alias("median_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), spread.alias("stdev_ms"))


def size_stats(frames: DataFrame) -> DataFrame:
    return frames.groupBy("session").agg(F.avg("length").alias("mean_bytes"), F.min("length").alias("min_bytes"), F.max("length").alias("max_bytes"))


def measured(frames: DataFrame) -> DataFrame:
    """Capability of each session as measured: rate, jitter, sizes, losses; usable with two frames or more."""
    lost = frames.groupBy("session").agg(F.sum("dropped_before").alias("driver_dropped"), F.count_if(F.col("flags").bitwiseAND(1) != 0).alias("driver_errors"), F.count_if(F.col("flags").bitwiseAND(2) != 0).alias("corrupt"))
    out = span(frames).join(interval_stats(frames), "session", "left").join(size_stats(frames), "session").join(lost, "session")
    return out.withColumn("usable", F.col("frames") > 1)


def baseline(frames: DataFrame, first: int = 60) -> DataFrame:
    """(session, mean, sd) of the sizes of the first ``first`` ok frames; without spread, or for two of them or fewer, sd is a hundredth of the
    mean and 1 at least."""
    rank = F.row_number().over(Window.partitionBy("session").orderBy("index"))
    rest = frames.where(ok(F.col("flags"))).withColumn("_rank", rank).where(F.col("_rank") <= first)
    s = rest.groupBy("session").agg(F.avg("length").alias("mean"), F.stddev_samp("length").alias("_sd"), F.count(F.lit(1)).alias("_n"))
    return s.select("session", "mean", deviation(F.col("mean"), F.col("_sd"), F.col("_n")).alias("sd"))


def deviation(mean: Column, sd: Column, n: Column) -> Column:
    """The deviation of a baseline: without spread, or out of two frames or fewer, a hundredth of the mean and 1 at least."""
    return F.when((n > 2) & (sd > 0), sd).otherwise(F.greatest(F.lit(1.0), mean * 0.01))


def latency_summary(latencies: DataFrame, *keys: str) -> DataFrame:
    """Summary of latency_ms values, rounded to hundredths, and the capture offset in ns (median, truncated)."""
    r = lambda c: F.round(c, 2)
    spread = F.when(F.count("latency_ms") > 2, r(F.stddev_samp("latency_ms"))).otherwise(0.0)
    return latencies.groupBy(*keys).agg(
        F.count("latency_ms").alias("samples"), r(F.median("latency_ms")).alias("median_ms"), r(F.avg("latency_ms")).alias("mean_ms"), r(F.min("latency_ms")).alias("min_ms"),
        r(F.max("latency_ms")).alias("max_ms"), spread.alias("stdev_ms"), (F.median("latency_ms") * 1e6).cast("long").alias("capture_offset_ns"),
    )


def plausible(latencies: DataFrame) -> DataFrame:
    """Latencies strictly between -50 and 1000 ms; others come from misread patterns."""
    return latencies.where("latency_ms > -50 and latency_ms < 1000")


def best_mode(modes: DataFrame, *keys: str) -> DataFrame:
    """The mode with the most pixels, then the highest rate, of each group, and how many there are."""
    best = F.max(F.struct((F.col("width") * F.col("height")).alias("pixels"), F.col("rate").alias("rate"))).alias("b")
    return modes.groupBy(*keys).agg(F.count(F.lit(1)).alias("modes"), best).select(*keys, "modes", "b.pixels", "b.rate")


def high_water(rows: DataFrame, depth: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(depth).alias("high_water"))
