"""As-of joins against a plain model, full of ties and empty sides."""

import random

import pytest

from framelog.operators import asof


def model(frames, t):
    """(backward, nearest) of sorted (ts, index) frames by linear search."""
    before = [f for f in frames if f[0] <= t]
    after = [f for f in frames if f[0] > t]
    back = before[-1] if before else None
    if back is None:
        return None, after[0] if after else None
    if not after or t - back[0] <= after[0][0] - t:
        return back, back
    return back, after[0]


@pytest.mark.parametrize("bucket", [None, 7])
def test_against_model(spark, bucket):
    rng = random.Random(3)
    frames, probes, want = [], [], {}
    for key in range(40):
        ts = sorted(rng.randrange(60) for _ in range(rng.choice([0, 1, 2, 12])))
        mine = [(t, i) for i, t in enumerate(ts)]
        frames += [(key, t, i) for t, i in mine]
        for p in range(rng.choice([0, 8])):
            t = rng.randrange(-5, 70)
            probes.append((key, t, p))
            want[key, p] = model(mine, t)
    f = spark.createDataFrame(frames, "session long, ts_ns long, index long")
    p = spark.createDataFrame(probes, "session long, t_ns long, probe long")
    back = {(r.session, r.probe): r for r in asof.backward(p, f, bucket_ns=bucket).collect()}
    near = {(r.session, r.probe): r for r in asof.nearest(p, f, tolerance_ns=None, bucket_ns=bucket).collect()}
    close = {(r.session, r.probe): r for r in asof.nearest(p, f, tolerance_ns=3, bucket_ns=bucket).collect()}
    assert len(back) == len(near) == len(close) == len(probes)
    for k, (b, n) in want.items():
        assert ((back[k].ts_ns, back[k]["index"]) if back[k]["index"] is not None else None) == b
        assert ((near[k].ts_ns, near[k]["index"]) if near[k]["index"] is not None else None) == n
        inside = n is not None and abs(n[0] - near[k].t_ns) <= 3
        assert close[k]["index"] == (n[1] if inside else None)


def test_uniform_log(spark):
    period = 16_666_667
    ts = [1_000_000_000 + i * period for i in range(500)]
    f = spark.createDataFrame([(1, t, i) for i, t in enumerate(ts)], "session int, ts_ns long, index long")
    cases = [(ts[100], 100), (ts[100] + period - 1, 100), (ts[100] + period, 101), (ts[0] - 1, None), (ts[-1] + 10**9, 499)]
    p = spark.createDataFrame([(1, t, k) for k, (t, _) in enumerate(cases)], "session int, t_ns long, k int")
    got = {r.k: r["index"] for r in asof.backward(p, f).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]


def test_bad_nearest_frame_is_not_replaced(spark):
    f = spark.createDataFrame([(1, 10, 0, 2), (1, 14, 1, 0), (1, 30, 2, 4)], "session int, ts_ns long, index long, flags long")
    p = spark.createDataFrame([(1, 11), (1, 29), (None, 5)], "session int, t_ns long")
    assert [(r.t_ns, r["index"]) for r in asof.paired(p, f, tolerance_ns=5).collect()] == [(29, 2)]


def test_equal_names_of_probes_and_frames(spark):
    probes = spark.createDataFrame([("a", 15, 1, 2)], "session string, t_ns long, length long, index long")
    frames = spark.createDataFrame([("a", 10, 0, 7)], "session string, ts_ns long, index long, length long")
    for df in (asof.backward(probes, frames), asof.nearest(probes, frames, tolerance_ns=None)):
        (r,) = df.collect()
        assert (r.length, r["index"], r.frame_length, r.frame_index, r.ts_ns) == (1, 2, 7, 0, 10) and len(set(df.columns)) == len(df.columns)
