"""Change detection in payload sizes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelog.operators.quality import ok
from framelog.operators.stats import deviation


def size_changes(frames: DataFrame, *, sigmas: float = 6.0, learn: int = 60) -> DataFrame:
    """(session, index, ts_ns, seq, length, delta, limit) of ok frames whose size differs from the previous ok frame's by more than ``sigmas``
    deviations of the first ``learn`` ok frames. Those frames only teach; the comparison starts after them."""
    whole = Window.partitionBy("session")
    order = whole.orderBy("index")
    good = frames.where(ok(F.col("flags"))).select("session", "index", "ts_ns", "seq", "length", F.row_number().over(order).alias("_rank"), F.lag("length").over(order).alias("_previous"))
    # baseline and comparison in one order of the session: no join
    taught = F.when(F.col("_rank") <= learn, F.col("length"))
    good = good.withColumns({"_mean": F.avg(taught).over(whole), "_sd": F.stddev_samp(taught).over(whole), "_n": F.count(F.when(F.col("_rank") <= learn, 1)).over(whole)})
    good = good.where(F.col("_rank") > learn + 1).withColumn("delta", F.abs(F.col("length") - F.col("_previous")))
    good = good.withColumn("limit", deviation(F.col("_mean"), F.col("_sd"), F.col("_n")) * sigmas)
    return good.where("delta > limit").select("session", "index", "ts_ns", "seq", "length", "delta", "limit")


def debounced(changes: DataFrame, *, settle_ns: int = 250_000_000, count: int | None = 5) -> DataFrame:
    """Changes of each session without those within ``settle_ns`` after the last reported one, at most ``count`` (the feature's own limit).

    What is muted depends on what was reported before, so it is a fold in order; it streams over the few rows that changed,
    sorted by the shuffle. Rows without a session are one session. Time is the frames' own.
    """

    at = [changes.columns.index(c) for c in ("session", "ts_ns")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, until, reported = object(), None, 0
        for b in batches:
            keep = []
            for s, t in zip(*(b.column(c).to_pylist() for c in at), strict=True):
                if s != session:
                    session, until, reported = s, None, 0
                good = (until is None or t >= until) and (count is None or reported < count)
                if good:
                    until, reported = t + settle_ns, reported + 1
                keep.append(good)
            yield b.filter(pa.array(keep, pa.bool_()))

    return changes.repartition("session").sortWithinPartitions("session", "index").mapInArrow(fold, changes.schema)
