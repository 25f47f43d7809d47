"""Fixed-width index files as a Spark data source, and the same in plain SQL expressions.

``spark.read.format("framelog_index").option("path", ...)`` reads segment files of 32-byte records in parallel ranges. A torn tail of fewer
than 32 bytes is ignored and an empty file has no rows. A path is a file, or a folder whose ``*.idx`` files are the segments in the
order of their names. It opens files from the executors, so they must see the path; ``decoded`` does the same through Spark's own
file reader, for paths that only Spark can open.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framelog.schema import INDEX, RECORD_BYTES, RECORD_FIELDS

#: Records that one task reads, unless the option ``records_per_partition`` says otherwise.
RECORDS_PER_PARTITION = 1 << 22
#: Records turned into one Arrow batch.
BATCH = 1 << 16
_KINDS = {4: "<u4", 8: "<u8"}
RECORD = np.dtype({"names": [n for n, _, _ in RECORD_FIELDS], "formats": [_KINDS[w] for _, _, w in RECORD_FIELDS], "offsets": [o for _, o, _ in RECORD_FIELDS], "itemsize": RECORD_BYTES})


class Range(InputPartition):
    def __init__(self, path: str, session: str, segment: int, first: int, count: int):
        self.path, self.session, self.segment, self.first, self.count = path, session, segment, first, count


class IndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per = options["path"], int(options.get("records_per_partition", RECORDS_PER_PARTITION))
        self.session = options.get("session")

    def partitions(self) -> list[Range]:
        top = Path(self.path)
        files = sorted(top.glob("*.idx")) if top.is_dir() else [top]
        session = self.session or (top.name if top.is_dir() else top.stem)
        out = []
        for k, f in enumerate(files):
            records = os.path.getsize(f) // RECORD_BYTES
            out += [Range(str(f), session, k, lo, min(self.per, records - lo)) for lo in range(0, records, self.per)]
        return out or [Range("", session, 0, 0, 0)]  # without a partition Spark would read all the same

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p = partition
        for lo in range(0, p.count, BATCH):
            n = min(BATCH, p.count - lo)
            r = np.fromfile(p.path, RECORD, n, offset=(p.first + lo) * RECORD_BYTES)
            index = np.arange(p.first + lo, p.first + lo + len(r))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p.session] * len(r), pa.string()), pa.array(np.full(len(r), p.segment, np.int32)), pa.array(index, pa.int64()),
                    pa.array(r["byte_offset"]).cast(pa.decimal128(20, 0)), pa.array(r["length"].astype(np.int64)), pa.array(r["ts_ns"].astype(np.int64)),
                    *(pa.array(r[c].astype(np.int64)) for c in ("seq", "flags", "dropped_before")),
                ],
                names=[f.split()[0] for f in INDEX.split(", ")],
            )


class IndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framelog_index"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> IndexReader:  # noqa: ANN001
        return IndexReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IndexSource)


def little_endian(record: Column, first: int, width: int) -> Column:
    """Unsigned little-endian integer out of a binary column: decimal for 8 bytes, long for fewer."""
    digits = F.concat(*[F.hex(F.substring(record, first + k, 1)) for k in reversed(range(1, width + 1))])
    number = F.conv(digits, 16, 10)
    return number.cast("decimal(20,0)") if width == 8 else number.cast("long")


def unpacked(record: Column) -> list[Column]:
    """The fields of a 32-byte record."""
    out = [little_endian(record, first, width).alias(name) for name, first, width in RECORD_FIELDS]
    return [c.cast("long").alias("ts_ns") if name == "ts_ns" else c for c, (name, _, _) in zip(out, RECORD_FIELDS, strict=True)]


def packed(byte_offset: Column, length: Column, ts_ns: Column, seq: Column, flags: Column, dropped_before: Column) -> Column:
    """A 32-byte record of the fields."""
    parts = []
    for value, (_, _, width) in zip((byte_offset, length, ts_ns, seq, flags, dropped_before), RECORD_FIELDS, strict=True):
        digits = F.lpad(F.conv(value.cast("decimal(20,0)").cast("string"), 10, 16), 2 * width, "0")
        parts += [F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))]
    return F.unhex(F.concat(*parts))


def decoded(files: DataFrame) -> DataFrame:
    """(path, local_index, fields) of index files read by Spark's binaryFile source (path, content)."""
    n = F.expr(f"cast(length(content) div {RECORD_BYTES} as int)")
    rows = files.withColumn("_n", n).where("_n > 0").select("path", "content", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("local_index"))
    record = F.substring("content", F.col("local_index") * RECORD_BYTES + 1, F.lit(RECORD_BYTES))
    rows = rows.select("path", F.col("local_index").cast("long").alias("local_index"), record.alias("_record"))
    return rows.select("path", "local_index", *unpacked(F.col("_record")))


def torn_bytes(files: DataFrame) -> DataFrame:
    """(path, frames, truncated_bytes) of index files read as binaryFile, which has no row for an empty file."""
    return files.select("path", F.expr(f"length(content) div {RECORD_BYTES}").cast("long").alias("frames"), F.expr(f"cast(length(content) % {RECORD_BYTES} as long)").alias("truncated_bytes"))
