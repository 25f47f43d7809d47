"""Segments of a recording: rollover, statistics, offsets and global positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rollover(frames: DataFrame, limit: int) -> DataFrame:
    """frames (session, index, length, ...) with segment and byte_offset: a new segment starts where offset + length would pass ``limit``.

    0 turns it off. A first frame larger than the limit leaves segment 0 empty. The fold is greedy, so it has no window form; sessions are
    sorted by the shuffle and streamed, never gathered. Rows without a session are one session; a null length is 0.
    """
    schema = frames.select("session", "index", "length").withColumn("segment", F.lit(0)).withColumn("byte_offset", F.lit(0).cast("long")).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, segment, offset = object(), 0, 0
        for b in batches:
            key, length = b.column(0), pc.fill_null(b.column(2), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = pc.fill_null(key.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            segments, offsets = np.empty(len(length), np.int32), np.empty(len(length), np.int64)
            starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else codes
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)], strict=True) if len(codes) else ():
                if key[lo].as_py() != session:
                    session, segment, offset = key[lo].as_py(), 0, 0
                total = np.cumsum(length[lo:hi])
                at = 0
                while at < hi - lo:  # once for each segment, not for each frame
                    before = int(total[at - 1]) if at else 0
                    stop = int(np.searchsorted(total, limit - offset + before, "right")) if limit else hi - lo
                    if stop <= at:  # the next frame doesn't fit: it opens a segment, however large it is
                        segment, offset, stop = segment + 1, 0, at + 1
                    segments[lo + at : lo + stop] = segment
                    offsets[lo + at : lo + stop] = offset + total[at:stop] - length[lo + at : lo + stop] - before
                    offset += int(total[stop - 1]) - before
                    at = stop
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segments), pa.array(offsets)], names=["session", "index", "length", "segment", "byte_offset"])

    rows = frames.select("session", "index", "length").repartition("session").sortWithinPartitions("session", "index")
    return rows.mapInArrow(fold, schema)


def segment_stats(frames: DataFrame) -> DataFrame:
    """frames, bytes, first and last time by position of each segment."""
    return frames.groupBy("session", "segment").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("length").alias("bytes"), F.min_by("ts_ns", "index").alias("first_ts_ns"), F.max_by("ts_ns", "index").alias("last_ts_ns")
    )


def offsets(frames: DataFrame) -> DataFrame:
    """byte_offset as the sum of the lengths before in the segment."""
    before = Window.partitionBy("session", "segment").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("byte_offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def segment_starts(counts: DataFrame) -> DataFrame:
    """(session, segment, frames) with the session-wide position of each segment's first frame."""
    before = Window.partitionBy("session").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("segment_start", F.coalesce(F.sum("frames").over(before), F.lit(0)))


def global_index(frames: DataFrame) -> DataFrame:
    """frames (session, segment, local_index, ...) with index, counted through the session: one row per segment is summed, not frames."""
    counts = frames.groupBy("session", "segment").agg(F.count(F.lit(1)).alias("frames"))
    starts = segment_starts(counts).select("session", "segment", "segment_start")
    return frames.join(starts, ["session", "segment"]).withColumn("index", F.col("segment_start") + F.col("local_index")).drop("segment_start")
