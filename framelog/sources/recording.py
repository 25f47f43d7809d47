"""Recordings: manifests, and the segments they list as one sequence of frames with payloads."""

from __future__ import annotations

import contextlib
import functools
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelog.functions.jpeg_dc import dimensions
from framelog.operators.segments import segment_starts
from framelog.schema import FORMAT_VERSION, MANIFEST, RECORD_BYTES
from framelog.sources import index

#: Payloads that are handed on at a time, in bytes.
PAYLOAD_BYTES = 32 << 20


@functools.lru_cache(maxsize=64)
def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _reachable(spark: SparkSession, folder: str) -> str | None:
    """The URI of a folder that workers open through Arrow; none for a pattern or a store that only Spark's readers open."""
    if re.search(r"[*?\[{\\]", folder):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toUri().toString()
    uri = re.sub("^file:/+", "file:///", uri)
    try:
        _opened(uri)
    except (OSError, ValueError, NotImplementedError):
        return None
    return uri


def _dealt(spark: SparkSession, rows: RDD, schema: str) -> DataFrame:
    """Rows dealt to tasks by their text. An RDD, as Spark takes its size as unknown: files that are read from a few rows would
    count as small and be broadcast."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.map(lambda r: (tuple(r), None)).partitionBy(parts, lambda r: zlib.crc32(repr(r).encode("utf-8", "surrogatepass"))).keys()
    return spark.createDataFrame(dealt, schema)


def _subfolders(uri: str) -> Iterator[tuple[str]]:
    system, place = _opened(uri)
    return ((f"{uri}/{quote(i.base_name)}",) for i in system.get_file_info(fs.FileSelector(place)) if i.type == fs.FileType.Directory)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(folder, text) of the manifests in folders that have one."""
    for b in batches:
        uris, texts, size = [], [], 0
        for uri in b.column(0).to_pylist():
            system, place = _opened(uri)
            with contextlib.suppress(FileNotFoundError), system.open_input_stream(f"{place}/manifest.json") as f:
                texts.append(f.read())
                uris.append(uri)
                size += len(texts[-1])
            if size >= PAYLOAD_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(texts, pa.binary())], names=["folder", "text"])
                uris, texts, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(texts, pa.binary())], names=["folder", "text"])


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest, with its folder. A format version above the known one is an error; a missing one is accepted.

    A path ``<folder>/**/manifest.json`` is listed and read by the workers, so that there may be any number of sessions; other patterns, and stores
    that only Spark opens, are listed by the driver.
    """
    folder = path.removesuffix("/**/manifest.json")
    top = _reachable(spark, folder) if folder != path else None
    if top is None:
        m = spark.read.schema(MANIFEST).option("multiLine", True).json(path).withColumn("folder", F.regexp_replace(F.input_file_name(), "/[^/]*$", ""))
    else:
        folders = _dealt(spark, spark.sparkContext.parallelize([top], 1).flatMap(_subfolders), "folder string")
        m = folders.mapInArrow(_texts, "folder string, text binary").select(F.from_json(F.col("text").cast("string"), MANIFEST).alias("m"), "folder").select("m.*", "folder")
    known = F.coalesce("format_version", F.lit(FORMAT_VERSION)) <= FORMAT_VERSION
    return m.withColumn("format_version", F.when(known, F.col("format_version")).otherwise(F.raise_error(F.concat(F.lit("manifest of a later format: "), F.col("format_version").cast("string"))).cast("int")))


def segments(m: DataFrame) -> DataFrame:
    """(session, folder, segment, stream, index_file, frames, ...) of manifests, in their order."""
    s = m.select("session", "folder", F.posexplode("segments").alias("segment", "s"))
    return s.select("session", "folder", "segment", F.col("s.stream").alias("stream"), F.col("s.index").alias("index_file"), "s.frames", "s.bytes", "s.first_ts_mono_ns", "s.last_ts_mono_ns")


def _read(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content", F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.regexp_replace("path", "/[^/]*$", "").alias("at"))


def _place(c):  # noqa: ANN001, ANN202
    """A path without its scheme, as different readers write it differently."""
    return F.regexp_replace(c, "^[a-z]+:/+", "/")


def recording(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all recordings below ``folder`` (session, segment, local_index, index, fields): a session is one sequence, with positions
    counted through. Segments that are listed but have no index file are passed over.

    Workers open the index files that manifests list, in ranges; the driver lists nothing. Where only Spark's readers open the folder, they do.
    """
    if "*" not in folder and _reachable(spark, folder):
        listed = manifests(spark, f"{folder}/**/manifest.json").where("session is not null").select("session", "folder", "segments.index")
        return _dealt(spark, listed.mapInArrow(_ranges, _RANGE).rdd, _RANGE).mapInArrow(_records, f"{index.INDEX}, index long")
    s = segments(manifests(spark, f"{folder}/**/manifest.json" if "*" not in folder else folder))
    files = _read(spark, folder, "*.idx").select("path", F.col("file").alias("index_file"), _place(F.col("at")).alias("_at"))
    known = s.withColumn("_at", _place(F.col("folder"))).join(files, ["_at", "index_file"]).select("session", "segment", "path")
    rows = index.decoded(_read(spark, folder, "*.idx")).join(known, "path")
    counts = rows.groupBy("session", "segment").agg(F.count(F.lit(1)).alias("frames"))
    starts = segment_starts(counts).select("session", "segment", "segment_start")
    return rows.join(starts, ["session", "segment"]).withColumn("index", F.col("segment_start") + F.col("local_index")).drop("path", "segment_start")


_RANGE = "session string, segment int, folder string, file string, start long, first long, count long"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of the index files of each manifest (session, folder, names of index files); start is the position of a segment's first frame."""
    names = [f.split()[0] for f in _RANGE.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 3]
    for b in batches:
        out = []
        for session, folder, files in zip(*(c.to_pylist() for c in b.columns), strict=True):
            (system, place), start = _opened(folder), 0
            for k, file in enumerate(files or ()):
                info = file and system.get_file_info(f"{place}/{file}")
                n = info.size // RECORD_BYTES if info and info.type == fs.FileType.File else 0
                out += [(session, k, folder, file, start, lo, min(index.RECORDS_PER_PARTITION, n - lo)) for lo in range(0, n, index.RECORDS_PER_PARTITION)]
                start += n
            if len(out) >= index.BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names=names)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames of ranges, those of short files together."""
    for b in batches:
        held, n = [], 0
        for session, segment, folder, file, start, first, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
            system, place = _opened(folder)
            with system.open_input_file(f"{place}/{file}") as f:
                for lo in range(first, first + count, index.BATCH):
                    most = min(index.BATCH, first + count - lo)
                    f.seek(lo * RECORD_BYTES)
                    r = np.frombuffer(f.read(most * RECORD_BYTES), index.RECORD, most)  # an error, if the file has become shorter
                    held.append((session, segment, start, lo, r))
                    n += most
                    if n >= index.BATCH:
                        yield _frames(held)
                        held, n = [], 0
        if held:
            yield _frames(held)


def _frames(held: list[tuple]) -> pa.RecordBatch:
    sessions, numbers, starts, firsts, parts = zip(*held, strict=True)
    sizes, r = np.array([len(p) for p in parts]), np.concatenate(parts)
    local = np.arange(len(r)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(np.array(firsts, np.int64), sizes)
    long = lambda c: pa.array(np.ascontiguousarray(r[c])).cast(pa.int64())
    columns = [
        pa.array(sessions, pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(np.repeat(np.array(numbers, np.int32), sizes)), pa.array(local),
        pa.array(np.ascontiguousarray(r["byte_offset"])).cast(pa.decimal128(20, 0)), *map(long, ("length", "ts_ns", "seq", "flags", "dropped_before")), pa.array(local + np.repeat(np.array(starts, np.int64), sizes)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[*(f.split()[0] for f in index.INDEX.split(", ")), "index"])


def _placed(spark: SparkSession, folder: str, frames: DataFrame) -> DataFrame:
    """frames with the path of their stream, in the order of the files; ranges of one file go to several tasks."""
    s = segments(manifests(spark, f"{folder}/**/manifest.json")).select("session", "segment", F.concat("folder", F.lit("/"), "stream").alias("_stream"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, or else few rows with large payloads end up in one task
    return frames.join(s, ["session", "segment"], "left").repartitionByRange(parts, "_stream", "byte_offset").sortWithinPartitions("_stream", "byte_offset")


def payloads(spark: SparkSession, folder: str, frames: DataFrame) -> DataFrame:
    """``frames`` of ``recording`` with ``data``, read from the streams; where a stream ends too early data is null and error says so.

    Filter frames first: only what is left is read, a range for each frame, in the order of the files, so a stream may have any length and is
    read by several tasks. Workers open streams through Arrow's file systems (local, hdfs, s3, ...).
    """
    met = _placed(spark, folder, frames)
    kept = [c for c in met.columns if c != "_stream"]
    schema = met.select(*kept, F.lit(None).cast("binary").alias("data"), F.lit(None).cast("string").alias("error")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = _Streams()
        for b in batches:
            data, at, size = [], 0, 0
            for k, d in enumerate(streams.of(b)):
                data.append(d)
                size += len(d or b"")
                if size >= PAYLOAD_BYTES or k == b.num_rows - 1:  # no more than that in memory
                    part = b.slice(at, k + 1 - at).select(kept)
                    errors = [None if d is not None else "the stream is truncated" for d in data]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary()), pa.array(errors, pa.string())], names=[*kept, "data", "error"])
                    data, at, size = [], k + 1, 0

    return met.mapInArrow(read, schema)


def inspected(spark: SparkSession, folder: str, frames: DataFrame) -> DataFrame:
    """(session, index, readable, whole, found_width, found_height) of frames: their payloads are read as in ``payloads`` but don't leave the
    worker. ``whole`` is whether both markers of a JPEG are there, the size is the frame header's."""
    met = _placed(spark, folder, frames).select("session", "index", "_stream", "byte_offset", "length")
    schema = met.select("session", "index").schema.simpleString()[len("struct<") : -1] + ",readable:boolean,whole:boolean,found_width:int,found_height:int"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = _Streams()
        for b in batches:
            rows = []
            for d in streams.of(b):
                whole = d is not None and len(d) >= 4 and d[:2] == b"\xff\xd8" and d[-2:] == b"\xff\xd9"
                rows.append((d is not None, whole, *(dimensions(d) or (None, None))))
            facts = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 4, (pa.bool_(), pa.bool_(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *facts], names=["session", "index", "readable", "whole", "found_width", "found_height"])

    return met.mapInArrow(read, schema)


class _Streams:
    """Ranges of files; the last file stays open, as ranges come in order."""

    def __init__(self) -> None:
        self.path, self.file = None, None

    def of(self, batch: pa.RecordBatch) -> Iterator[bytes | None]:
        """The payload of each row (_stream, byte_offset, length, ...)."""
        for stream, offset, n in zip(*(batch.column(c).to_pylist() for c in ("_stream", "byte_offset", "length")), strict=True):
            yield self.read(stream, int(offset or 0), n or 0)

    def read(self, path: str | None, offset: int, n: int) -> bytes | None:
        """The range, or null if the file is missing or ends before."""
        if path != self.path:
            if self.file:
                self.file.close()
            self.path, self.file = path, None
            if path is not None:
                with contextlib.suppress(FileNotFoundError):
                    system, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                    self.file = system.open_input_file(unquote(place))
        if self.file is None or offset + n > self.file.size():
            return None
        self.file.seek(offset)
        return self.file.read(n)
