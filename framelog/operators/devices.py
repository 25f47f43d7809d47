"""Tables of devices and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bit of a device's capabilities that says it captures (fixed value).
CAPTURE = 1


def capture_only(devices: DataFrame) -> DataFrame:
    """Devices (caps, ...) that capture and are not metadata nodes."""
    return devices.where(F.col("caps").bitwiseAND(CAPTURE) != 0)


def node_key(node: Column) -> list[Column]:
    """Sort keys of a node's path: its trailing number (0 without one), then the path."""
    return [F.coalesce(F.try_to_number(F.regexp_extract(node, r"(\d+)$", 1), F.lit("9999999999")), F.lit(0)), node]


def find(devices: DataFrame, hint: str | None = None) -> DataFrame:
    """The device (path, card, ...) whose path or card contains the hint in any case; without a hint the only one. None or several is an error."""
    text = hint.lower() if hint else ""
    named = F.contains(F.lower("path"), F.lit(text)) | F.contains(F.lower("card"), F.lit(text))
    matched = devices.where(named) if hint else devices
    n = matched.agg(F.count(F.lit(1)).alias("_n"), F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("_paths"))
    checked = n.select(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("the hint names "), F.col("_n").cast("string"), F.lit(" devices: "), F.col("_paths"))).cast("boolean")).alias("_ok"))
    return checked.join(matched, F.col("_ok"), "left").drop("_ok")


def pick_external(outputs: DataFrame, *keys: str, hint: str | None = None) -> DataFrame:
    """(keys, name): of outputs (name, primary) the one that the hint names (the least of several), else the only one that isn't
    primary, else null."""
    if hint:
        hit = F.when(F.contains(F.lower("name"), F.lit(hint.lower())), F.col("name"))
        return outputs.groupBy(*keys).agg(F.min(hit).alias("name"))
    other = F.when(~F.col("primary"), F.col("name"))
    return outputs.groupBy(*keys).agg(F.when(F.count(other) == 1, F.min(other)).alias("name"))
