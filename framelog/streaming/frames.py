"""Structured Streaming forms of the log operators. Streams have the columns of frames (session, ts_ns, seq, length, flags).

Delivery is lossless by replay from checkpoints, and back-pressure is the source's rate limit (for files ``maxFilesPerTrigger``): nothing is
ever dropped because a queue is full. Decoding payloads belongs in a query behind the one that ingests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelog.schema import GAP_BEFORE
from framelog.sources import events


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Frames out of Parquet files of events that arrive in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    flags = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 4).otherwise(0)
    return e.select(
        F.col("user_id").alias("session"), events.ts_ns(F.col("ts")).alias("ts_ns"), F.col("event_id").alias("seq"), F.round(F.col("value") * 100).cast("long").alias("length"), flags.cast("long").alias("flags")
    )


def ingest(frames: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to Parquet files by session, exactly once: what a failed batch wrote is not listed and is written again from the
    source's offsets. Nothing is decoded here; other queries read the files."""
    out = frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("session").outputMode("append")
    return out.trigger(**(trigger or {"processingTime": "1 second"})).start()


def counters(frames: DataFrame) -> DataFrame:
    """Running frames, driver errors and corrupt frames of each session; update mode."""
    bit = lambda b: F.count_if(F.col("flags").bitwiseAND(b) != 0)
    return frames.groupBy("session").agg(F.count(F.lit(1)).alias("frames"), bit(1).alias("driver_errors"), bit(2).alias("corrupt"))


def latest(frames: DataFrame) -> DataFrame:
    """The newest frame of each session, how many there were (generation) and how many of them it replaced; update mode, or a batch."""
    newest = F.max_by(F.struct("ts_ns", "seq", "length", "flags"), F.struct("ts_ns", "seq")).alias("n")
    out = frames.groupBy("session").agg(newest, F.count(F.lit(1)).alias("generation"))
    return out.select("session", "n.*", "generation", (F.col("generation") - 1).alias("overwritten"))


def newer_than(slots: DataFrame, since: DataFrame) -> DataFrame:
    """Slots whose generation is above the consumer's (session, since); sessions it hasn't seen count as 0."""
    return slots.join(since, "session", "left").where(F.col("generation") > F.coalesce("since", F.lit(0))).drop("since")


def sequence_gaps(frames: DataFrame) -> DataFrame:
    """dropped_before and the GAP_BEFORE flag across micro-batches; append mode. Order is that of arrival, by time within a batch."""
    schema = "session long, ts_ns long, seq long, length long, flags long, dropped_before long"

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(["ts_ns", "seq"])
        last = state.get[0] if state.exists else None
        before = pdf["seq"].shift(fill_value=pdf["seq"].iloc[0] - 1 if last is None else last)
        lost = (pdf["seq"] - before - 1).clip(lower=0)
        state.update((int(pdf["seq"].iloc[-1]),))
        yield pdf.assign(dropped_before=lost, flags=pdf["flags"].where(lost == 0, pdf["flags"] | GAP_BEFORE))[["session", "ts_ns", "seq", "length", "flags", "dropped_before"]]

    return frames.groupBy("session").applyInPandasWithState(follow, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def silences(frames: DataFrame, patience_ms: int) -> DataFrame:
    """(session, last_ts_ns) of sessions from which nothing came for ``patience_ms`` of processing time; each frame resets the clock."""

    def watch(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "last_ts_ns": [last]})
            return
        newest = max(int(p["ts_ns"].max()) for p in parts)
        state.update((max(newest, state.get[0]) if state.exists else newest,))
        state.setTimeoutDuration(patience_ms)

    return frames.groupBy("session").applyInPandasWithState(watch, "session long, last_ts_ns long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def changes(frames: DataFrame, *, sigmas: float = 6.0, learn: int = 60, settle_ns: int = 250_000_000) -> DataFrame:
    """(session, ts_ns, seq, length, delta): size changes found online, debounced by the frames' own time; append mode.

    The state of a session is what its first ``learn`` ok frames taught (count, mean, sum of squares), the last size and the mute.
    """
    schema = "session long, ts_ns long, seq long, length long, delta long"
    state_schema = "n long, mean double, squares double, previous long, muted_until long"

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(["ts_ns", "seq"])
        n, mean, squares, previous, muted = state.get if state.exists else (0, 0.0, 0.0, -1, -(1 << 62))
        out = []
        for r in pdf[(pdf["flags"] & 3) == 0].itertuples():
            if n < learn:
                n += 1
                step = r.length - mean
                mean += step / n
                squares += step * (r.length - mean)
                continue
            sd = (squares / (n - 1)) ** 0.5 if n > 2 else 0.0
            limit = sigmas * (sd if sd > 0 else max(1.0, mean * 0.01))
            delta = abs(r.length - previous)
            if previous >= 0 and delta > limit and r.ts_ns >= muted:
                out.append((r.session, r.ts_ns, r.seq, r.length, delta))
                muted = r.ts_ns + settle_ns
            previous = r.length
        state.update((n, mean, squares, int(previous), int(muted)))
        yield pd.DataFrame(out, columns=["session", "ts_ns", "seq", "length", "delta"])

    return frames.groupBy("session").applyInPandasWithState(follow, schema, state_schema, "append", GroupStateTimeout.NoTimeout)
