"""Verification of recordings: index and sampled payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelog.functions.jpeg_dc import jpeg_dimensions
from framelog.functions.scalars import looks_like_jpeg
from framelog.operators.quality import sampled


def to_check(frames: DataFrame, *, deep: bool = False, sample: int = 200) -> DataFrame:
    """The frames whose payloads are read: all, or the fixed sample."""
    return frames if deep else sampled(frames, sample)


def payload_checks(payloads: DataFrame, granted: DataFrame) -> DataFrame:
    """(session, checked, unreadable, incomplete_jpeg, wrong_size, first_wrong_size) of payloads (session, index, data; null: unreadable), or of
    what ``recording.inspected`` says of them, against granted (session, pixelformat, width, height)."""
    p = payloads.join(granted, "session", "left")
    jpeg = F.col("pixelformat") == "MJPG"
    if "data" in payloads.columns:
        p = p.withColumns({"whole": F.coalesce(looks_like_jpeg(F.col("data")), F.lit(False)), "readable": F.col("data").isNotNull(), "_dims": jpeg_dimensions("data")})
        p = p.withColumns({"found_width": F.col("_dims.width"), "found_height": F.col("_dims.height")})
    p, whole = p.withColumn("_readable", F.col("readable")), F.col("whole")
    other = F.col("_readable") & jpeg & whole & (F.col("width") > 0) & ((F.col("found_width") != F.col("width")) | (F.col("found_height") != F.col("height")))
    # ten a session, by rank and not out of a list of all
    bad = p.where(~F.col("_readable")).withColumn("_rank", F.row_number().over(Window.partitionBy("session").orderBy("index"))).where("_rank <= 10")
    bad = bad.groupBy("session").agg(F.sort_array(F.collect_list("index")).alias("first_unreadable"))
    out = p.groupBy("session").agg(
        F.count_if("_readable").alias("checked"), F.count_if(~F.col("_readable")).alias("unreadable"), F.count_if(F.col("_readable") & jpeg & ~whole).alias("incomplete_jpeg"),
        F.count_if(other).alias("wrong_size"), F.min(F.when(other, F.col("index"))).alias("first_wrong_size"),
    )
    return out.join(bad, "session", "left").withColumn("first_unreadable", F.coalesce("first_unreadable", F.array().cast("array<long>")))
