import pytest
from pyspark.sql import functions as F

from framelog.functions import scalars as S
from framelog.operators import devices


def test_hints(spark):
    d = spark.createDataFrame([("/dev/by-id/Card-A", "HDMI card", 1), ("/dev/video2", "Webcam", 1), ("/dev/video3", "meta", 4)], "path string, card string, caps int")
    assert devices.find(d, "card-a").first().path == "/dev/by-id/Card-A" and devices.find(d, "WEBCAM").count() == 1
    assert devices.capture_only(d).count() == 2
    for hint in ("video", "nothing", None):
        with pytest.raises(Exception, match="devices"):
            devices.find(d, hint).collect()
    names = spark.createDataFrame([(n,) for n in ("/dev/video10", "/dev/video2", "/dev/other")], "n string")
    assert [r.n for r in names.orderBy(*devices.node_key(F.col("n"))).collect()] == ["/dev/other", "/dev/video2", "/dev/video10"]


def test_outputs(spark):
    o = spark.createDataFrame([("a", "eDP-1", True), ("a", "HDMI-1", False), ("b", "DP-1", False), ("b", "DP-2", False)], "m string, name string, primary boolean")
    assert {r.m: r.name for r in devices.pick_external(o, "m").collect()} == {"a": "HDMI-1", "b": None}
    assert {r.m: r.name for r in devices.pick_external(o, "m", hint="dp-1").collect()} == {"a": "eDP-1", "b": "DP-1"}
    lines = spark.createDataFrame([("Monitors: 2",), (" 0: +*eDP-1 1920/344x1200/215+0+0  eDP-1",), (" 1: +HDMI-1 2560/600x1440/340+1920+7  HDMI-1",)], "l string")
    got = [r.o for r in lines.select(S.output_line(F.col("l")).alias("o")).collect()]
    assert got[0] is None and tuple(got[1]) == ("eDP-1", True, 1920, 1200, 0, 0) and tuple(got[2]) == ("HDMI-1", False, 2560, 1440, 1920, 7)


def test_text(spark):
    one = spark.range(1)
    image = F.struct(F.lit(2).alias("width"), F.lit(1).alias("height"), F.array(F.lit(0), F.lit(255)).alias("samples"))
    assert one.select(S.preview(image, 4, 2).alias("p")).first().p == ["  @@", "  @@"]
    bars = one.select(S.encode_bars(F.lit(5)).alias("b")).first().b
    assert len(bars) == 28 and bars[:2] == [True, False] and bars[-2:] == [False, True]
    with pytest.raises(Exception, match="20 bits"):
        one.select(S.encode_bars(F.lit(1 << 20))).collect()
    wraps = [(1_000_000, 45), ((1 << 20) + 3, 40), (7 * (1 << 20) - 2, 55)]
    for reference, late in wraps:
        v = (reference - late) % (1 << 20)
        assert abs(one.select(S.reconstruct_ms(F.lit(v), F.lit(float(reference))).alias("m")).first().m - (reference - late)) <= 1
    notes = one.select(S.notes_map(F.array(F.lit("a=1"), F.lit("b"), F.lit("a=x=y"))).alias("n")).first().n
    assert notes == {"a": "x=y", "b": ""}
