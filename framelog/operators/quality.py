"""Data quality of frame logs: predicates, gaps, regressions, samples and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framelog.schema import CORRUPT, DRIVER_ERROR, GAP_BEFORE, NOT_OK


def _by_index() -> WindowSpec:
    """Neighbours in a session, in order of arrival."""
    return Window.partitionBy("session").orderBy("index")


def ok(flags: Column) -> Column:
    """Whole and without driver error; a gap before a frame doesn't make it bad."""
    return flags.bitwiseAND(NOT_OK) == 0


def flagged(frames: DataFrame) -> DataFrame:
    return frames.where("flags <> 0")


def entry(frames: DataFrame, at: int) -> DataFrame:
    """The frame at a position of each session, from the end if negative; sessions that are too short have none."""
    if at >= 0:
        return frames.where(F.col("index") == at)
    n = frames.groupBy("session").agg(F.max("index").alias("_top"))
    return frames.join(n, "session").where(F.col("index") == F.col("_top") + 1 + at).drop("_top")


def stride(frames: DataFrame, k: int) -> DataFrame:
    return frames.where(F.col("index") % k == 0)


def limited(frames: DataFrame, *, count: int | None = None, seconds: float | None = None) -> DataFrame:
    """The first frames of each session: ``count`` of them, or those less than ``seconds`` after the first, or both."""
    out = frames if count is None else frames.where(F.col("index") < count)
    if seconds is None:
        return out
    begin = frames.groupBy("session").agg(F.min_by("ts_ns", "index").alias("_begin"))
    return out.join(begin, "session").where(F.col("ts_ns") < F.col("_begin") + int(seconds * 1e9)).drop("_begin")


def sampled(frames: DataFrame, target: int = 200) -> DataFrame:
    """First, last and evenly spaced frames of each session, some ``target`` of them; the same ones each time."""
    n = frames.groupBy("session").agg((F.max("index") + 1).alias("_n"))
    step = F.expr(f"greatest(1, _n div {target})")
    return frames.join(n, "session").where((F.col("index") == 0) | (F.col("index") == F.col("_n") - 1) | (F.col("index") % step == 0)).drop("_n")


def sequence_gaps(frames: DataFrame) -> DataFrame:
    """dropped_before from sequence numbers in order of arrival, and the flags with GAP_BEFORE where something was dropped."""
    lost = F.greatest(F.lit(0).cast("long"), F.col("seq") - F.lag("seq").over(_by_index()) - 1)
    return frames.withColumn("dropped_before", lost).withColumn("flags", F.when(F.col("dropped_before") > 0, F.col("flags").bitwiseOR(GAP_BEFORE)).otherwise(F.col("flags")))


def deltas(frames: DataFrame) -> DataFrame:
    """(session, index, from_ns, to_ns, delta_ns) of neighbouring frames; index is the earlier one's."""
    to = F.lead("ts_ns").over(_by_index())
    d = frames.select("session", "index", F.col("ts_ns").alias("from_ns"), to.alias("to_ns")).where("to_ns is not null")
    return d.withColumn("delta_ns", F.col("to_ns") - F.col("from_ns"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, upper_median): element n div 2 of the sorted values; not ``median``, which takes the mean of the middle two."""
    order = Window.partitionBy(key).orderBy(value)
    ranked = rows.select(key, value, (F.row_number().over(order) - 1).alias("_r"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
    return ranked.where("_r = n div 2").select(key, "n", F.col(value).alias("upper_median"))


def gaps(frames: DataFrame, factor: float = 1.5) -> DataFrame:
    """(session, index, from_ns, to_ns) of intervals longer than ``factor`` upper medians; none below three frames."""
    d = deltas(frames)
    usual = upper_median(d, "session", "delta_ns").where("n >= 2 and upper_median > 0")
    return d.join(usual, "session").where(F.col("delta_ns") > factor * F.col("upper_median")).select("session", "index", "from_ns", "to_ns")


def regressions(frames: DataFrame) -> DataFrame:
    """(session, regressions, first_regression): how often time runs backwards, and where first."""
    back = F.col("ts_ns") < F.col("_previous")
    seen = frames.withColumn("_previous", F.lag("ts_ns").over(_by_index()))
    return seen.groupBy("session").agg(F.count_if(back).alias("regressions"), F.min(F.when(back, F.col("index"))).alias("first_regression"))


def flag_summary(frames: DataFrame) -> DataFrame:
    bit = lambda b: F.count_if(F.col("flags").bitwiseAND(b) != 0)
    return frames.groupBy("session").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("length").alias("bytes"), F.count_if(F.col("flags") != 0).alias("flagged"),
        bit(DRIVER_ERROR).alias("driver_error"), bit(CORRUPT).alias("corrupt"), bit(GAP_BEFORE).alias("gap_before"),
    )


def verify(frames: DataFrame, checks: DataFrame | None = None, manifests: DataFrame | None = None) -> DataFrame:
    """A verdict per session from one windowed pass over the index.

    ``checks`` (session, checked, unreadable, incomplete_jpeg, wrong_size, first_wrong_size) comes from a pass over sampled payloads
    (``plans.verify.payload_checks``); ``manifests`` (session, monotonic, ended, granted) from the manifests. Without them nothing is
    held against a session. Sessions of the manifests without frames are reported and not usable.
    """
    back = F.col("ts_ns") < F.col("_previous")
    seen = frames.withColumn("_previous", F.lag("ts_ns").over(_by_index()))
    dropped = F.sum(F.when(F.col("flags") != 0, F.col("dropped_before")).otherwise(0))
    bit = lambda b: F.count_if(F.col("flags").bitwiseAND(b) != 0)
    out = seen.groupBy("session").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(back).alias("timestamp_regressions"), F.min(F.when(back, F.col("index"))).alias("first_regression"),
        F.count_if(F.col("flags") != 0).alias("flagged"), bit(DRIVER_ERROR).alias("driver_error"), bit(CORRUPT).alias("corrupt"), bit(GAP_BEFORE).alias("gap_before"),
        dropped.alias("driver_dropped_total"), (F.max_by("ts_ns", "index") - F.min_by("ts_ns", "index")).alias("_span"),
    )
    out = out.withColumn("duration_s", F.col("_span") / 1e9).withColumn("measured_fps", F.when(F.col("_span") > 0, (F.col("frames") - 1) / (F.col("_span") / 1e9))).drop("_span")
    if manifests is not None:
        out = manifests.select("session", "monotonic", "ended").join(out, "session", "left").withColumn("frames", F.coalesce("frames", F.lit(0)))
    else:
        out = out.withColumn("monotonic", F.lit(True)).withColumn("ended", F.lit(True))
    names = ("checked", "unreadable", "incomplete_jpeg", "wrong_size")
    if checks is not None:
        out = out.join(checks.select("session", *names), "session", "left")
    for c in names:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast("long")) if checks is not None else F.lit(0).cast("long"))
    out = out.withColumn("timestamp_regressions", F.coalesce("timestamp_regressions", F.lit(0)))
    usable = F.col("monotonic") & (F.col("frames") > 0) & (F.col("timestamp_regressions") == 0) & (F.col("unreadable") == 0)
    say = lambda when, *text: F.when(when, F.format_string(*text))
    problems = F.array_compact(F.array(
        say(F.col("unreadable") > 0, "%d frame(s) could not be read: the stream is truncated", F.col("unreadable")),
        say(~F.col("monotonic"), "frame timestamps are not on the monotonic clock"),
        say(~F.col("ended"), "no end record: the session was not closed; frames before the cut are valid"),
        say(F.col("frames") == 0, "no frames"),
        say(F.col("timestamp_regressions") > 0, "%d timestamp regression(s), first at frame %d", F.col("timestamp_regressions"), F.col("first_regression")),
        say(F.col("wrong_size") > 0, "%d frame(s) have another geometry than granted", F.col("wrong_size")),
    ))
    return out.withColumn("problems", problems).withColumn("usable", usable)
