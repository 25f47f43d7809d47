"""As-of lookup: for each probe the last frame at or before it, or the nearest one.

Both sides are stacked and one window per key carries frames to probes: linear work, one shuffle, no range join. Ties follow the
binary search over a log: the last of several frames at one time is the backward match; of two equally near the earlier one wins;
the frame after a probe is the first of its time; before all frames the nearest is the first, after all the last.

A key may hold a large share of all rows. With ``bucket_ns`` the windows run within (key, bucket of time) and every bucket learns the last
frame before it and the first after it from one row per bucket, so that no task sorts a whole key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _carried(stacked: DataFrame, key: list[str], order_back: list, order_ahead: list) -> DataFrame:
    back = Window.partitionBy(*key).orderBy(*order_back).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy(*order_ahead).rowsBetween(0, Window.unboundedFollowing)
    return stacked.withColumn("_before", F.last("_frame", ignorenulls=True).over(back)).withColumn("_after", F.first("_frame", ignorenulls=True).over(ahead))


def candidates(probes: DataFrame, frames: DataFrame, key: str = "session", *, bucket_ns: int | None = None) -> DataFrame:
    """Every probe (key, t_ns, ...) with _before and _after, structs of the frame columns (ts_ns, index, ...) or null.

    _before is the last frame with ts_ns <= t_ns, _after the first with ts_ns > t_ns. Null keys match each other; a null t_ns matches nothing.
    """
    extra = [c for c in probes.columns if c not in (key, "t_ns")]
    side = [c for c in frames.columns if c != key]
    payload = F.struct(*extra) if extra else F.struct(F.lit(0).alias("_"))
    p = probes.select(F.col(key), F.col("t_ns").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_i"), payload.alias("_probe"))
    f = frames.select(F.col(key), F.col("ts_ns").alias("_t"), F.lit(0).alias("_side"), F.col("index").alias("_i"), F.struct("ts_ns", "index", *[c for c in side if c not in ("ts_ns", "index")]).alias("_frame"))
    stacked = p.unionByName(f, allowMissingColumns=True)
    order = ["_t", "_side", "_i"]  # frames before probes at one time, so the last of them is the match
    if bucket_ns is None:
        out = _carried(stacked, [key], order, order)
    else:
        stacked = stacked.withColumn("_bucket", F.expr(f"_t div {bucket_ns}"))
        out = _carried(stacked, [key, "_bucket"], order, order)
        ends = stacked.groupBy(key, "_bucket").agg(F.max("_frame").alias("_last"), F.min("_frame").alias("_first"))
        by = Window.partitionBy(key).orderBy("_bucket")
        ends = ends.select(
            F.col(key).alias("_key"), F.col("_bucket").alias("_at"),
            F.last("_last", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
            F.first("_first", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("_next"),
        )
        out = out.join(ends, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_at")), "left")
        out = out.withColumn("_before", F.coalesce("_before", "_carry")).withColumn("_after", F.coalesce("_after", "_next"))
    out = out.where("_side = 1")
    timed = F.col("_t").isNotNull()
    return out.select(key, F.col("_t").alias("t_ns"), *[F.col(f"_probe.{c}").alias(c) for c in extra], F.when(timed, F.col("_before")).alias("_before"), F.when(timed, F.col("_after")).alias("_after"))


def _fields(c: DataFrame, left: list[str], match: str) -> DataFrame:
    """The columns ``left`` and those of the matched frame; one whose name a probe's column has, too, is called frame_<name>."""
    taken = set(left)
    return c.select(*left, *[F.col(f"{match}.{x}").alias(f"frame_{x}" if x in taken else x) for x in c.schema[match].dataType.names])


def backward(probes: DataFrame, frames: DataFrame, key: str = "session", *, bucket_ns: int | None = None) -> DataFrame:
    """Each probe with the frame columns of its backward match; null before all frames (index -1 in the log's own terms)."""
    c = candidates(probes, frames, key, bucket_ns=bucket_ns)
    return _fields(c, [x for x in c.columns if x not in ("_before", "_after")], "_before")


def nearest(probes: DataFrame, frames: DataFrame, key: str = "session", *, tolerance_ns: int | None, bucket_ns: int | None = None) -> DataFrame:
    """Each probe with the frame columns of its nearest frame and gap_ns >= 0.

    ``tolerance_ns`` must be given: beyond it (exclusive) the match is null; None sets no bound.
    """
    # with several frames at the backward match's time the last is before, which an equal distance prefers
    c = candidates(probes, frames, key, bucket_ns=bucket_ns)
    us, ns = F.col("t_ns") - F.col("_before.ts_ns"), F.col("_after.ts_ns") - F.col("t_ns")
    best = F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after").isNull() | (us <= ns), F.col("_before")).otherwise(F.col("_after"))
    gap = F.abs(F.col("t_ns") - F.col("_best.ts_ns"))
    c = c.withColumn("_best", best).withColumn("gap_ns", gap)
    if tolerance_ns is not None:
        near = F.col("gap_ns") <= tolerance_ns
        c = c.withColumn("_best", F.when(near, F.col("_best"))).withColumn("gap_ns", F.when(near, F.col("gap_ns")))
    return _fields(c, [x for x in c.columns if x not in ("_before", "_after", "_best")], "_best")


def paired(controls: DataFrame, frames: DataFrame, key: str = "session", *, tolerance_ns: int | None, bucket_ns: int | None = None) -> DataFrame:
    """Controls with their nearest frame; those without one in tolerance go, and then those whose frame is not ok: a bad
    frame is not replaced by the next good one."""
    return nearest(controls, frames, key, tolerance_ns=tolerance_ns, bucket_ns=bucket_ns).where("index is not null and (flags & 3) = 0")
