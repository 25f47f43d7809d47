"""Sinks: CSV sidecars, extracted frames, manifests and JSON reports."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelog.functions.scalars import to_realtime_ns
from framelog.operators.segments import rollover
from framelog.operators.stats import effective_fps
from framelog.schema import FORMAT_VERSION, RECORD_FIELDS
from framelog.sources.index import RECORD


def sidecar(frames: DataFrame, clock_pairs: DataFrame | None = None) -> DataFrame:
    """index, ts_mono_ns, ts_realtime_ns, seq, flags, dropped_before, with session; realtime is null without a clock pair
    (session, monotonic_ns, realtime_ns)."""
    f = frames.join(clock_pairs, "session", "left") if clock_pairs is not None else frames.withColumns({c: F.lit(None).cast("long") for c in ("monotonic_ns", "realtime_ns")})
    real = to_realtime_ns(F.col("ts_ns"), F.col("monotonic_ns"), F.col("realtime_ns"))
    return f.select("session", "index", F.col("ts_ns").alias("ts_mono_ns"), real.alias("ts_realtime_ns"), "seq", "flags", "dropped_before")


def write_sidecar(rows: DataFrame, path: str) -> None:
    """CSV files, a folder per session; null is an empty field."""
    rows.repartition("session").sortWithinPartitions("session", "index").write.partitionBy("session").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def frame_names(frames: DataFrame, *, every: int = 1, include_flagged: bool = False, suffix: str = ".jpg") -> DataFrame:
    """(session, index, name) of frames to extract: every k-th, any flag passed over unless asked for; names sort as frames do."""
    n = frames.groupBy("session").agg((F.max("index") + 1).alias("_n"))
    chosen = frames.join(n, "session").where(F.col("index") % every == 0)
    if not include_flagged:
        chosen = chosen.where("flags = 0")
    width = F.greatest(F.lit(4), F.length((F.col("_n") - 1).cast("string")))
    digits = F.col("index").cast("string")
    return chosen.select("session", "index", F.concat(F.repeat(F.lit("0"), width - F.length(digits)), digits, F.lit(suffix)).alias("name"))


def write_frames(named: DataFrame, folder: str) -> DataFrame:
    """Write data of (session, name, data) to folder/session/name, from the executors (the folder must be shared); returns what was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                to = Path(folder, str(r["session"]), r["name"])
                to.parent.mkdir(parents=True, exist_ok=True)
                part = to.with_name(f".{to.name}.{os.getpid()}")  # a task that runs twice leaves whole files
                part.write_bytes(r["data"] or b"")
                part.replace(to)
            yield pa.RecordBatch.from_pydict({"name": [f"{r['session']}/{r['name']}" for r in rows], "bytes": [len(r["data"] or b"") for r in rows]}, pa.schema([("name", pa.string()), ("bytes", pa.int64())]))

    return named.select(F.col("session").cast("string").alias("session"), "name", "data").mapInArrow(run, "name string, bytes long")


def build_manifests(frames: DataFrame, clocks: DataFrame | None = None, stem: str = "frames") -> DataFrame:
    """A manifest per session of frames (session, segment, index, ts_ns, length, flags, dropped_before), as columns.

    Duration and effective rate are those of the session's clock, from ``clocks`` (session, started_ns, ended_ns): null for a session that
    was not closed, or without clocks. The frames' own span isn't the session's.
    """
    per = frames.groupBy("session", "segment").agg(F.count(F.lit(1)).alias("frames"), F.sum("length").alias("bytes"), F.min_by("ts_ns", "index").alias("first"), F.max_by("ts_ns", "index").alias("last"), *_counters())
    suffix = F.when(F.col("segment") == 0, "").otherwise(F.concat(F.lit("."), F.lpad(F.col("segment").cast("string"), 3, "0")))
    segment = F.struct(
        F.col("segment").alias("number"), F.concat(F.lit(stem), suffix, F.lit(".mjpg")).alias("stream"), F.concat(F.lit(stem), suffix, F.lit(".idx")).alias("index"), "frames", "bytes",
        F.col("first").alias("first_ts_mono_ns"), F.col("last").alias("last_ts_mono_ns"),
    )
    total = lambda c: F.sum(c).alias(c)
    out = per.groupBy("session").agg(
        F.array_sort(F.collect_list(segment)).alias("segments"), F.sum("frames").alias("frames_written"), F.sum("bytes").alias("bytes_written"),
        *map(total, ("driver_dropped", "driver_errors", "corrupt")),
    )
    if clocks is not None:
        out = out.join(clocks.select("session", (F.col("ended_ns") - F.col("started_ns")).alias("_duration")), "session", "left")
    else:
        out = out.withColumn("_duration", F.lit(None).cast("long"))
    duration = F.col("_duration")
    counters = F.struct(F.col("frames_written").alias("frames"), "driver_dropped", "driver_errors", "corrupt")
    return out.select(
        F.lit(FORMAT_VERSION).alias("format_version"), F.col("session").cast("string").alias("session"), "segments", "frames_written", "bytes_written", counters.alias("counters"),
        duration.alias("duration_ns"), effective_fps(F.col("frames_written"), duration).alias("effective_fps"),
    )


def _counters() -> list[Column]:
    return [F.sum("dropped_before").alias("driver_dropped"), F.count_if(F.col("flags").bitwiseAND(1) != 0).alias("driver_errors"), F.count_if(F.col("flags").bitwiseAND(2) != 0).alias("corrupt")]


def write_recordings(frames: DataFrame, folder: str, limit: int, clocks: DataFrame | None = None, stem: str = "frames") -> int:
    """Write frames (session, index, ts_ns, length, seq, flags, dropped_before, data) as recordings: below ``folder`` one folder a session, with
    streams and index files that roll over at ``limit`` bytes and a manifest. How many sessions were written.

    A segment is written by one task, a frame at a time, beside its place, and renamed when it is whole; so is the manifest, after its segments. Workers
    write through Arrow's file systems. Sessions are named by their text, one without by "null". A segment without frames (the first one, if the
    first frame is above the limit) has no files.
    """
    session = F.coalesce(F.col("session").cast("string"), F.lit("null"))
    rows = frames.withColumn("session", session).withColumn("length", F.octet_length("data").cast("long")).drop("segment", "byte_offset")
    cut = rollover(rows, limit).select("session", "index", "segment", "byte_offset")
    placed = rows.join(cut, ["session", "index"]).repartition("session", "segment").sortWithinPartitions("session", "segment", "index")
    fields = [n for n, _, _ in RECORD_FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for b in batches:
            for r in b.to_pylist():
                if writer is None or (r["session"], r["segment"]) != writer.key:
                    if writer:
                        yield writer.close()
                    writer = _SegmentFiles(folder, r["session"], r["segment"], stem)
                writer.add(r)
        if writer:
            yield writer.close()

    columns = ["session", "segment", "index", *fields, "data"]
    written = placed.select(*columns).mapInArrow(run, "session string, number int, stream string, index string, frames long, bytes long, first long, last long, driver_dropped long, driver_errors long, corrupt long")
    segment = F.struct("number", "stream", "index", "frames", "bytes", F.col("first").alias("first_ts_mono_ns"), F.col("last").alias("last_ts_mono_ns"))
    total = lambda c: F.sum(c).alias(c)
    done = written.groupBy("session").agg(F.array_sort(F.collect_list(segment)).alias("segments"), F.sum("frames").alias("frames_written"), F.sum("bytes").alias("bytes_written"), *map(total, ("driver_dropped", "driver_errors", "corrupt")))
    clock = F.lit(None).cast("long")
    if clocks is not None:
        done = done.join(clocks.select(session.alias("session"), (F.col("ended_ns") - F.col("started_ns")).alias("_clock")), "session", "left")
        clock = F.col("_clock")
    manifest = F.struct(
        F.lit(FORMAT_VERSION).alias("format_version"), "session", "segments", "frames_written", "bytes_written", F.struct(F.col("frames_written").alias("frames"), "driver_dropped", "driver_errors", "corrupt").alias("counters"),
        clock.alias("duration_ns"), effective_fps(F.col("frames_written"), clock).alias("effective_fps"),
    )

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with _Whole(f"{folder}/{name}", "manifest.json") as f:
                    f.write(text.encode())
            yield b.select(["session"])

    return done.select("session", F.to_json(manifest).alias("json")).mapInArrow(put, "session string").count()


class _Whole:
    """A file that takes its place when it is closed; an attempt that is lost leaves a part only."""

    def __init__(self, folder: str, name: str):
        uri = Path(folder).absolute().as_uri() if folder.startswith("/") else folder
        self.system, at = fs.FileSystem.from_uri(uri)
        self.place = f"{unquote(at)}/{name}"
        self.part = f"{self.place}.{uuid.uuid4().hex}.part"
        self.system.create_dir(unquote(at), recursive=True)
        self.file = self.system.open_output_stream(self.part)

    def __enter__(self):  # noqa: ANN204
        return self.file

    def __exit__(self, kind, *_) -> None:  # noqa: ANN001
        self.file.close()
        if kind is None:
            self.system.move(self.part, self.place)


class _SegmentFiles:
    """The stream and the index of one segment, and what a manifest says of it."""

    def __init__(self, folder: str, session: str, segment: int, stem: str):
        self.key = session, segment
        name = stem if segment == 0 else f"{stem}.{segment:03d}"
        self.names = f"{name}.mjpg", f"{name}.idx"
        self.files = [_Whole(f"{folder}/{session}", n) for n in self.names]
        self.frames = self.bytes = self.dropped = self.errors = self.corrupt = 0
        self.first = self.last = None

    def add(self, r: dict) -> None:
        record = np.zeros(1, RECORD)
        for n, _, _ in RECORD_FIELDS:
            record[n] = int(r[n])
        self.files[0].file.write(r["data"] or b"")
        self.files[1].file.write(record.tobytes())
        self.frames, self.bytes, self.last = self.frames + 1, self.bytes + r["length"], r["ts_ns"]
        self.first = r["ts_ns"] if self.first is None else self.first
        self.dropped, self.errors, self.corrupt = self.dropped + r["dropped_before"], self.errors + (r["flags"] & 1), self.corrupt + (r["flags"] >> 1 & 1)

    def close(self) -> pa.RecordBatch:
        for f in self.files:
            f.__exit__(None)
        row = [*self.key, *self.names, self.frames, self.bytes, self.first, self.last, self.dropped, self.errors, self.corrupt]
        names = ["session", "number", "stream", "index", "frames", "bytes", "first", "last", "driver_dropped", "driver_errors", "corrupt"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 7]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


def as_json(rows: DataFrame, *keys: str) -> DataFrame:
    """Each row as a JSON text, beside its keys."""
    return rows.select(*keys, F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("json"))


def write_manifest(manifest: dict, path: str) -> None:
    """One manifest, complete or not at all: written beside its place, forced to disk and renamed."""
    part = Path(f"{path}.part")
    with part.open("w", encoding="utf-8") as f:
        json.dump(manifest, f, indent=2)
        f.flush()
        os.fsync(f.fileno())
    part.replace(path)
