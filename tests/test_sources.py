"""Index files, recordings and exports, on files made here."""

import json
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelog.operators import quality, segments
from framelog.plans import verify
from framelog.sources import exports, index, recording

GOLDEN = [
    ((0, 0, 0, 0, 0, 0), "00" * 32),
    ((1, 2, 3, 4, 5, 6), "0100000000000000020000000300000000000000040000000500000006000000"),
    ((2146625835, 302727, 340905782457000, 6892, 2, 1), "2be9f27f00000000879e0400a8b210500d360100ec1a00000200000001000000"),
    ((2**64 - 1, 2**32 - 1, 2**63 - 1, 2**32 - 1, 7, 2**32 - 1), "ffffffffffffffffffffffffffffffffffffff7fffffffff07000000ffffffff"),
]
FIELDS = ("byte_offset", "length", "ts_ns", "seq", "flags", "dropped_before")


def test_golden_records(spark):
    rows = [(k, *map(str, v), bytes.fromhex(h)) for k, (v, h) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "k int, byte_offset string, length string, ts_ns string, seq string, flags string, dropped_before string, record binary")
    unpacked = df.select("k", *index.unpacked(F.col("record"))).orderBy("k").collect()
    assert [tuple(int(r[c]) for c in FIELDS) for r in unpacked] == [v for v, _ in GOLDEN]
    packed = df.select("k", index.packed(*[F.col(c).cast("decimal(20,0)") for c in FIELDS]).alias("r")).orderBy("k").collect()
    assert [bytes(r.r).hex() for r in packed] == [h for _, h in GOLDEN]


def write_index(path, n, start=0, tail=b"", ts=lambda i: 10**9 + i * 16_666_667):
    offset, out = 0, b""
    for i in range(start, start + n):
        out += struct.pack("<QIQIII", offset, 1000 + i, ts(i), i, 0, 0)
        offset += 1000 + i
    path.write_bytes(out + tail)


@pytest.mark.parametrize("per", [7, 1000])
def test_data_source(spark, tmp_path, per):
    folder = tmp_path / "one"
    folder.mkdir()
    write_index(folder / "frames.idx", 10, tail=b"12345")
    (folder / "frames.001.idx").write_bytes(b"")
    write_index(folder / "frames.002.idx", 50, start=10)
    index.register(spark)
    got = spark.read.format("framelog_index").option("path", str(folder)).option("records_per_partition", per).load()
    rows = got.orderBy("segment", "local_index").collect()
    assert len(rows) == 60 and {r.session for r in rows} == {"one"}
    # names sort frames.001, frames.002, frames
    assert [r.seq for r in rows] == [*range(10, 60), *range(10)]
    empty = spark.read.format("framelog_index").option("path", str(folder / "frames.001.idx")).load()
    assert empty.count() == 0
    files = spark.read.format("binaryFile").load(str(folder))
    torn = {r.path.rsplit("/", 1)[1]: (r.frames, r.truncated_bytes) for r in index.torn_bytes(files).collect()}
    assert torn == {"frames.idx": (10, 5), "frames.002.idx": (50, 0)}  # Spark passes over empty files


def jpeg(width, height, fill=b""):
    return b"\xff\xd8\xff\xc0\x00\x0b\x08" + struct.pack(">HH", height, width) + b"\x01\x01\x11\x00" + fill + b"\xff\xd9"


def write_recording(folder, session, payloads, limit, version=1, ended=True, cut=None, lose=None):
    folder.mkdir(parents=True)
    parts, offset = [[]], 0
    for i, data in enumerate(payloads):
        if limit and offset + len(data) > limit:
            parts.append([])
            offset = 0
        parts[-1].append((offset, len(data), 10**9 + i * 16_666_667, i, 0, 0, data))
        offset += len(data)
    listed = []
    for k, rows in enumerate(parts):
        stem = "frames" if k == 0 else f"frames.{k:03d}"
        stream = b"".join(r[6] for r in rows)
        (folder / f"{stem}.mjpg").write_bytes(stream[:cut] if cut else stream)
        if k != lose:
            (folder / f"{stem}.idx").write_bytes(b"".join(struct.pack("<QIQIII", *r[:6]) for r in rows))
        listed.append({"number": k, "stream": f"{stem}.mjpg", "index": f"{stem}.idx", "frames": len(rows), "bytes": len(stream)})
    m = {"format_version": version, "session": session, "segments": listed, "granted": {"pixelformat": "MJPG", "width": 64, "height": 48, "fps": 60.0}}
    if version is None:
        del m["format_version"]
    if ended:
        m["ended"] = {"monotonic_ns": 5, "realtime_ns": 6, "sample_spread_ns": 1}
    exports.write_manifest(m, str(folder / "manifest.json"))
    return len(parts)


def test_recording_in_segments(spark, tmp_path):
    payloads = [jpeg(64, 48, bytes([i % 200]) * (20 + i % 7)) for i in range(200)]
    parts = write_recording(tmp_path / "a", "a", payloads, 2000)
    write_recording(tmp_path / "b", "b", payloads[:40], 0, version=None, cut=400)
    assert parts > 3
    frames = recording.recording(spark, str(tmp_path))
    rows = frames.where("session = 'a'").orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(200)) and [r.seq for r in rows] == list(range(200))
    data = recording.payloads(spark, str(tmp_path), frames).orderBy("session", "index").collect()
    assert [bytes(r.data) for r in data if r.session == "a"] == payloads
    cut = [r for r in data if r.session == "b"]
    assert bytes(cut[0].data) == payloads[0] and cut[39].data is None and "truncated" in cut[39].error
    granted = recording.manifests(spark, f"{tmp_path}/**/manifest.json").select("session", "granted.*", F.lit(True).alias("monotonic"), F.col("ended").isNotNull().alias("ended"))
    chosen = verify.to_check(frames, sample=50)
    checks = verify.payload_checks(recording.payloads(spark, str(tmp_path), chosen), granted)
    inside = verify.payload_checks(recording.inspected(spark, str(tmp_path), chosen), granted)
    assert sorted(map(str, inside.collect())) == sorted(map(str, checks.collect()))
    report = {r.session: r for r in quality.verify(frames, checks, granted).collect()}
    assert report["a"].usable and report["a"].problems == [] and report["a"].checked == 51 and report["a"].wrong_size == 0
    assert not report["b"].usable and report["b"].unreadable > 0 and "truncated" in report["b"].problems[0]


def test_missing_index_and_later_format(spark, tmp_path):
    payloads = [b"x" * 100] * 30
    write_recording(tmp_path / "a", "a", payloads, 1000, lose=1)
    assert recording.recording(spark, str(tmp_path)).count() == 20
    write_recording(tmp_path / "z", "z", payloads, 0, version=2)
    with pytest.raises(Exception, match="later format"):
        recording.manifests(spark, f"{tmp_path}/z/manifest.json").collect()


def test_rollover_edges(spark):
    f = spark.createDataFrame([("s", 0, 50), ("s", 1, 5), ("s", 2, 5), ("s", 3, 6), ("t", 0, 5)], "session string, index long, length long")
    got = [(r.session, r["index"], r.segment, r.byte_offset) for r in segments.rollover(f, 10).orderBy("session", "index").collect()]
    assert got == [("s", 0, 1, 0), ("s", 1, 2, 0), ("s", 2, 2, 5), ("s", 3, 3, 0), ("t", 0, 0, 0)]
    assert {r.segment for r in segments.rollover(f, 0).collect()} == {0}


def test_sidecar_and_frames(spark, tmp_path):
    f = spark.createDataFrame([("s", i, 10**9 + i, i, 4 if i == 3 else 0, 0) for i in range(12)], "session string, index long, ts_ns long, seq long, flags long, dropped_before long")
    exports.write_sidecar(exports.sidecar(f), str(tmp_path / "csv"))
    lines = next((tmp_path / "csv" / "session=s").glob("*.csv")).read_text().splitlines()
    assert lines[0] == "index,ts_mono_ns,ts_realtime_ns,seq,flags,dropped_before" and lines[1] == "0,1000000000,,0,0,0" and len(lines) == 13
    names = exports.frame_names(f, every=3)
    assert sorted(r.name for r in names.collect()) == ["0000.jpg", "0006.jpg", "0009.jpg"]
    written = exports.write_frames(names.withColumn("data", F.encode(F.lit("abc"), "UTF-8")), str(tmp_path / "out")).collect()
    assert {r.bytes for r in written} == {3} and (tmp_path / "out" / "s" / "0006.jpg").read_bytes() == b"abc"
    assert json.loads(exports.as_json(f, "index").where("index = 3").first().json)["flags"] == 4


def test_flags_gaps_and_regressions(spark):
    ts = [0, 10, 20, 60, 70, 65, 80]
    f = spark.createDataFrame([("s", i, t, s, 0, 9) for i, (t, s) in enumerate(zip(ts, [0, 1, 2, 6, 7, 8, 8]))], "session string, index long, ts_ns long, seq long, flags long, length long")
    assert [(r["index"], r.from_ns, r.to_ns) for r in quality.gaps(f).orderBy("index").collect()] == [(2, 20, 60)]
    r = quality.regressions(f).first()
    assert (r.regressions, r.first_regression) == (1, 5)
    assert [(r.dropped_before, r.flags) for r in quality.sequence_gaps(f).orderBy("index").collect()] == [(0, 0), (0, 0), (0, 0), (3, 4), (0, 0), (0, 0), (0, 0)]
    assert quality.gaps(f.limit(2)).count() == 0


def test_rollover_keeps_ids_and_takes_rows_without_session_as_one(spark):
    """Against a plain fold, with ids beyond 2^53, null sessions, frames above the limit and null lengths."""
    rng, rows = random.Random(2), []
    for s in (None, 9007199254740993, 9007199254740992, 5):
        rows += [(s, k, rng.choice([0, 3, 7, 25, None])) for k in range(60)]
    df = spark.createDataFrame(rows, "session long, index long, length long")
    for limit in (0, 20, 1000):
        want = {}
        for s in {r[0] for r in rows}:
            segment = offset = 0
            for _, k, n in (r for r in rows if r[0] == s):
                if limit and offset + (n or 0) > limit:
                    segment, offset = segment + 1, 0
                want[s, k] = segment, offset
                offset += n or 0
        assert {(r.session, r["index"]): (r.segment, r.byte_offset) for r in segments.rollover(df, limit).collect()} == want


def test_a_stream_beyond_two_gigabytes(spark, tmp_path):
    folder = tmp_path / "big"
    folder.mkdir()
    far = (5 << 30) + 7
    with (folder / "frames.mjpg").open("wb") as f:
        f.write(b"first")
        f.seek(far)
        f.write(b"last one")  # the rest is a hole in the file
    (folder / "frames.idx").write_bytes(b"".join(struct.pack("<QIQIII", o, n, 10**9, i, 0, 0) for i, (o, n) in enumerate([(0, 5), (far, 8), (far + 4, 8)])))
    exports.write_manifest({"session": "big", "segments": [{"number": 0, "stream": "frames.mjpg", "index": "frames.idx"}]}, str(folder / "manifest.json"))
    frames = recording.recording(spark, str(tmp_path))
    got = {r["index"]: (r.data and bytes(r.data), r.error) for r in recording.payloads(spark, str(tmp_path), frames).collect()}
    assert got == {0: (b"first", None), 1: (b"last one", None), 2: (None, "the stream is truncated")}


def test_written_recordings_read_back(spark, tmp_path):
    """Frames to streams, index files and manifests, and back through recording, payloads and the report."""
    rng = random.Random(3)
    rows = [(s, k, 10**9 + k * 16_666_667, 4 * k + 1, k % 7 == 3, int(k % 5 == 2), jpeg(64, 48, rng.randbytes(rng.randrange(60)).replace(b"\xff", b"\0"))) for s in (3, 9007199254740993) for k in range(80)]
    df = spark.createDataFrame([(s, k, t, q, int(f), d, bytearray(x)) for s, k, t, q, f, d, x in rows], "session long, index long, ts_ns long, seq long, flags long, dropped_before long, data binary")
    clocks = spark.createDataFrame([(3, 0, 2 * 10**9)], "session long, started_ns long, ended_ns long")
    assert exports.write_recordings(df, str(tmp_path), 700, clocks) == 2
    assert not list(tmp_path.rglob("*.part"))
    frames = recording.recording(spark, str(tmp_path))
    got = {(r.session, r["index"]): (r.ts_ns, r.seq, r.flags, r.dropped_before, bytes(r.data)) for r in recording.payloads(spark, str(tmp_path), frames).collect()}
    assert got == {(str(s), k): (t, q, int(f), d, x) for s, k, t, q, f, d, x in rows}
    held = {r.session: r for r in recording.manifests(spark, f"{tmp_path}/**/manifest.json").collect()}
    assert held["3"].effective_fps == 40 and held["9007199254740993"].duration_ns is None and held["3"].counters.driver_errors == 11
    want = {(s, k): g for (s, k), g in ((("3", r["index"]), (r.segment, r.byte_offset)) for r in segments.rollover(df.where("session = 3").withColumn("length", F.octet_length("data").cast("long")), 700).collect())}
    listed = [(x.number, x.frames) for x in held["3"].segments]
    assert len(listed) > 3 and listed == sorted((n, sum(v[0] == n for v in want.values())) for n in {v[0] for v in want.values()})


def test_recordings_are_listed_and_read_by_workers(spark, tmp_path):
    """The driver lists no files, however many sessions there are; names that Spark's readers pass over are kept, and few listed rows don't count as a small table."""
    rows = [(s, k, 10**9 + k, k, 0, 0, bytearray(f"{s} {k}".encode())) for s in ("_a", ".b", "c d", "50") for k in range(40)]
    df = spark.createDataFrame(rows, "session string, index long, ts_ns long, seq long, flags long, dropped_before long, data binary")
    assert exports.write_recordings(df, str(tmp_path), 60) == 4
    (tmp_path / "empty").mkdir()
    frames = recording.recording(spark, str(tmp_path))
    data = recording.payloads(spark, str(tmp_path), frames)
    assert frames.inputFiles() == data.inputFiles() == recording.manifests(spark, f"{tmp_path}/**/manifest.json").inputFiles() == []
    assert sorted((r.session, r["index"], bytes(r.data)) for r in data.collect()) == sorted((s, k, bytes(x)) for s, k, *_, x in rows)
    assert int(str(frames._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 1 << 40  # unknown counts as large
    assert dict(frames.dtypes) == {f.split()[0]: f.split()[1].replace("long", "bigint") for f in f"{index.INDEX}, index long".split(", ")}


def test_ranges_of_index_files(tmp_path, monkeypatch):
    monkeypatch.setattr(index, "RECORDS_PER_PARTITION", 7)
    monkeypatch.setattr(index, "BATCH", 5)
    write_index(tmp_path / "frames.idx", 16, tail=b"torn")
    (tmp_path / "none.idx").write_bytes(b"")
    write_index(tmp_path / "frames.002.idx", 3, start=16)
    listed = pa.RecordBatch.from_pydict({"session": ["s"], "folder": [tmp_path.as_uri()], "files": [["frames.idx", "none.idx", "lost.idx", None, "frames.002.idx"]]})
    ranges = list(recording._ranges(iter([listed])))
    assert [(r["segment"], r["start"], r["first"], r["count"]) for b in ranges for r in b.to_pylist()] == [(0, 0, 0, 7), (0, 0, 7, 7), (0, 0, 14, 2), (4, 16, 0, 3)]
    rows = [r for b in recording._records(iter(ranges)) for r in b.to_pylist()]
    assert [(r["index"], r["seq"], r["segment"], r["local_index"]) for r in rows] == [(k, k, 0 if k < 16 else 4, k % 16) for k in range(19)]
