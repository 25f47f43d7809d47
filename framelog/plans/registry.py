"""Queries of the frame-log engine by name, with their SQL.

The events table stands in for recordings: a user is a session, an event a frame (``sources.events``). Tables of embeddings, documents,
parts and orders stand in for levels, payloads, modes and logs out of order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelog.functions import scalars as S
from framelog.functions.barcode import decode_columns
from framelog.functions.jpeg_dc import jpeg_dimensions
from framelog.operators import asof, devices, quality, runs, segments, stats
from framelog.operators import events as changes
from framelog.plans.verify import payload_checks
from framelog.session import shared_folder
from framelog.sources import events, exports, index, recording
from framelog.sources.events import frames, log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000_000
DAY = 24 * HOUR

_FRAMES = """f AS (SELECT user_id AS session, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, CAST(round(value * 100) AS BIGINT) AS length,
  CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 4 ELSE 0 END AS BIGINT) AS flags, event_type, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS index FROM events)"""
_W = "(PARTITION BY session ORDER BY index)"


def query(sql: str | None = None) -> Callable:
    """Register a query; ``sql`` may use the relation f, the events as frames."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("@f", _FRAMES).replace("@w", _W)
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- as-of joins


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clicks look up views; positions count all events of a user. Row ids stand for positions: they grow with time."""
    e = log(spark, sf_dir)
    probes = e.where("event_type = 'click'").select("session", F.col("ts_ns").alias("t_ns"), F.col("seq").alias("probe"))
    return probes, e.where("event_type = 'view'").select("session", "ts_ns", F.col("seq").alias("index"), "length")


_SIDES = """p AS (SELECT session, ts_ns AS t_ns, seq AS probe FROM f WHERE event_type = 'click'),
v AS (SELECT session, ts_ns, seq AS index, length FROM f WHERE event_type = 'view'),
b AS (SELECT p.*, v.ts_ns AS b_ts, v.index AS b_i, v.length AS b_l FROM p ASOF LEFT JOIN v ON p.session = v.session AND p.t_ns >= v.ts_ns),
a AS (SELECT b.*, v.ts_ns AS a_ts, v.index AS a_i, v.length AS a_l FROM b ASOF LEFT JOIN v ON b.session = v.session AND b.t_ns < v.ts_ns),
n AS (SELECT session, t_ns, probe, CASE WHEN b_ts IS NULL THEN false WHEN a_ts IS NULL THEN true ELSE t_ns - b_ts <= a_ts - t_ns END AS back, b_ts, b_i, b_l, a_ts, a_i, a_l FROM a),
r AS (SELECT session, t_ns, probe, abs(t_ns - CASE WHEN back THEN b_ts ELSE a_ts END) AS gap_ns, CASE WHEN back THEN b_ts ELSE a_ts END AS ts_ns,
  CASE WHEN back THEN b_i ELSE a_i END AS index, CASE WHEN back THEN b_l ELSE a_l END AS length FROM n)"""


@query(f"WITH @f, {_SIDES} SELECT session, t_ns, probe, b_ts AS ts_ns, b_i AS index, b_l AS length FROM b")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.backward(*_sides(spark, sf_dir))


@query(f"WITH @f, {_SIDES} SELECT * FROM r")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.nearest(*_sides(spark, sf_dir), tolerance_ns=None)


@query(f"WITH @f, {_SIDES} SELECT * FROM r")
def asof_nearest_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in buckets of a day, for sessions too large for a task."""
    return asof.nearest(*_sides(spark, sf_dir), tolerance_ns=None, bucket_ns=DAY)


@query(f"WITH @f, {_SIDES} SELECT session, t_ns, probe, gap_ns, ts_ns, index, length FROM r WHERE gap_ns <= {HOUR}")
def asof_nearest_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.nearest(*_sides(spark, sf_dir), tolerance_ns=HOUR).where("index is not null")


_PAIRS = _SIDES.replace("WHERE event_type = 'view'", "WHERE event_type <> 'click'").replace("length FROM f", "flags AS length FROM f")


@query(f"WITH @f, {_PAIRS} SELECT session, t_ns, probe, gap_ns, ts_ns, index, length AS flags FROM r WHERE gap_ns <= {6 * HOUR} AND (length & 3) = 0")
def pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the nearest other event within six hours, if that one is ok."""
    e = log(spark, sf_dir)
    probes = e.where("event_type = 'click'").select("session", F.col("ts_ns").alias("t_ns"), F.col("seq").alias("probe"))
    return asof.paired(probes, e.where("event_type <> 'click'").select("session", "ts_ns", F.col("seq").alias("index"), "flags"), tolerance_ns=6 * HOUR)


@query("""WITH @f, c AS (SELECT session, ts_ns, row_number() OVER (PARTITION BY session ORDER BY ts_ns, seq) AS ordinal FROM f WHERE event_type = 'click'),
v AS (SELECT session, ts_ns, row_number() OVER (PARTITION BY session ORDER BY ts_ns, seq) AS ordinal FROM f WHERE event_type = 'view')
SELECT c.session, c.ordinal::BIGINT AS ordinal, v.ts_ns - c.ts_ns AS offset_ns FROM c JOIN v ON c.session = v.session AND c.ordinal = v.ordinal""")
def offset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets and presses joined by their ordinal in the session."""
    order = Window.partitionBy("session", "event_type").orderBy("ts_ns", "seq")
    e = log(spark, sf_dir).where("event_type in ('click', 'view')").withColumn("ordinal", F.row_number().over(order).cast("long"))
    press, onset = (e.where(F.col("event_type") == k).select("session", "ordinal", F.col("ts_ns").alias(n)) for k, n in (("click", "press"), ("view", "onset")))
    return press.join(onset, ["session", "ordinal"]).select("session", "ordinal", (F.col("onset") - F.col("press")).alias("offset_ns"))


@query("""SELECT n_nationkey, coalesce(s_suppkey, -n_nationkey) AS device FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey""")
def device_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join with the first link of each node, the node itself where there is none."""
    links = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("link"))
    nodes = _table(spark, sf_dir, "nation")
    return nodes.join(links, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", F.coalesce("link", -F.col("n_nationkey").cast("long")).alias("device"))


# ---- filters


@query("WITH @f SELECT session, index, flags FROM f WHERE (flags & 3) = 0")
def ok_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).where(quality.ok(F.col("flags"))).select("session", "index", "flags")


@query("WITH @f SELECT session, index, seq, flags FROM f WHERE flags <> 0")
def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flagged(frames(spark, sf_dir)).select("session", "index", "seq", "flags")


@query("WITH @f SELECT session, index, seq FROM f WHERE index = 3")
def entry_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.entry(frames(spark, sf_dir), 3).select("session", "index", "seq")


@query("WITH @f, n AS (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM f) SELECT session, index, seq FROM n WHERE index = n - 2")
def entry_from_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.entry(frames(spark, sf_dir), -2).select("session", "index", "seq")


@query("WITH @f SELECT session, index, seq FROM f WHERE index % 7 = 0")
def every_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.stride(frames(spark, sf_dir), 7).select("session", "index", "seq")


@query("""WITH @f, n AS (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM f)
SELECT session, index FROM n WHERE index = 0 OR index = n - 1 OR index % greatest(1, n // 20) = 0""")
def sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sampled(frames(spark, sf_dir), 20).select("session", "index")


@query("WITH @f SELECT session, index, seq FROM f WHERE index < 5")
def first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.limited(frames(spark, sf_dir), count=5).select("session", "index", "seq")


@query("WITH @f, n AS (SELECT *, first(ts_ns) OVER (PARTITION BY session ORDER BY index) AS b FROM f) SELECT session, index, seq FROM n WHERE ts_ns < b + 259200000000000")
def first_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.limited(frames(spark, sf_dir), seconds=3 * 86_400).select("session", "index", "seq")


def _shaken(f: DataFrame) -> DataFrame:
    """Frames whose time runs backwards at every 97th of a third of the sessions."""
    return f.withColumn("ts_ns", F.when((F.col("session") % 3 == 0) & (F.col("index") % 97 == 60), F.col("ts_ns") - 30 * DAY).otherwise(F.col("ts_ns")))


_SHAKEN = "k AS (SELECT * REPLACE (CASE WHEN session % 3 = 0 AND index % 97 = 60 THEN ts_ns - 2592000000000000 ELSE ts_ns END AS ts_ns) FROM f)"


@query(f"""WITH @f, {_SHAKEN}, p AS (SELECT *, lag(ts_ns) OVER @w AS previous FROM k),
s AS (SELECT session, count(*) AS frames, (arg_max(ts_ns, index) - arg_min(ts_ns, index)) / 1e9 AS d, count(*) FILTER (ts_ns < previous) AS back FROM p GROUP BY 1)
SELECT session, printf('%d frames, %.2f s, %s', frames, d, CASE WHEN back = 0 THEN 'USABLE' ELSE 'DAMAGED' END) AS line FROM s""")
def verdict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = quality.sequence_gaps(_shaken(frames(spark, sf_dir)))
    v = quality.verify(f)
    return v.select("session", F.concat("frames", F.lit(" frames, "), S.hundredths(F.col("duration_s")), F.lit(" s, "), S.verdict(F.col("usable"))).alias("line"))


@query("SELECT p_partkey, p_size FROM part WHERE p_brand = 'Brand#13' AND p_size = 10")
def mode_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").where("p_brand = 'Brand#13' and p_size = 10").select("p_partkey", "p_size")


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), lower('000000007')) AND (SELECT count(*) FROM supplier WHERE contains(lower(s_name), lower('000000007'))) = 1")
def unique_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device that a hint names, if it is the only one; the count is of matches, so one row is broadcast."""
    hits = _table(spark, sf_dir, "supplier").where(F.contains(F.lower("s_name"), F.lit("000000007"))).select("s_suppkey", "s_name")
    return hits.crossJoin(hits.agg(F.count(F.lit(1)).alias("n"))).where("n = 1").drop("n")


@query("WITH @f, n AS (SELECT session, count(*) AS frames FROM f WHERE event_type = 'error' GROUP BY 1) SELECT session, frames FROM n WHERE frames > 1")
def usable_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where("event_type = 'error'").groupBy("session").agg(F.count(F.lit(1)).alias("frames")).where("frames > 1")


# ---- aggregates


@query("""WITH @f SELECT session, count(*) AS frames, sum(length)::BIGINT AS bytes, count(*) FILTER (flags <> 0) AS flagged, count(*) FILTER (flags & 1 <> 0) AS driver_error,
count(*) FILTER (flags & 2 <> 0) AS corrupt, count(*) FILTER (flags & 4 <> 0) AS gap_before FROM f GROUP BY 1""")
def flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flag_summary(log(spark, sf_dir))


@query("""WITH @f, s AS (SELECT session, count(*) AS frames, arg_min(ts_ns, index) AS first_ns, arg_max(ts_ns, index) AS last_ns FROM f GROUP BY 1)
SELECT *, (last_ns - first_ns) / 1e9 AS duration_s, CASE WHEN last_ns > first_ns THEN (frames - 1) / ((last_ns - first_ns) / 1e9) END AS fps FROM s""")
def span_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.span(log(spark, sf_dir).withColumn("index", F.struct("ts_ns", "seq")))


@query("""WITH @f, s AS (SELECT session, count(*) AS frames, max(ts_ns) - min(ts_ns) AS d FROM f GROUP BY 1)
SELECT session, frames, CASE WHEN d > 0 THEN frames / (d / 1e9) END AS effective_fps FROM s""")
def effective_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = log(spark, sf_dir).groupBy("session").agg(F.count(F.lit(1)).alias("frames"), (F.max("ts_ns") - F.min("ts_ns")).alias("d"))
    return s.select("session", "frames", stats.effective_fps(F.col("frames"), F.col("d")).alias("effective_fps"))


@query("""WITH @f, d AS (SELECT session, (lead(ts_ns) OVER @w - ts_ns) / 1e6 AS ms FROM f)
SELECT session, round(avg(ms), 3) AS mean_ms, round(median(ms), 4) AS median_ms, min(ms) AS min_ms, max(ms) AS max_ms,
round(CASE WHEN count(ms) > 2 THEN stddev_samp(ms) ELSE 0.0 END, 3) AS stdev_ms FROM d WHERE ms IS NOT NULL GROUP BY 1""")
def interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.interval_stats(frames(spark, sf_dir))
    return s.withColumns({c: F.round(c, n) for c, n in (("mean_ms", 3), ("median_ms", 4), ("stdev_ms", 3))})


@query("WITH @f SELECT session, round(avg(length), 6) AS mean_bytes, min(length) AS min_bytes, max(length) AS max_bytes FROM f GROUP BY 1")
def size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size_stats(log(spark, sf_dir)).withColumn("mean_bytes", F.round("mean_bytes", 6))


@query("""WITH @f, r AS (SELECT session, length, row_number() OVER (PARTITION BY session ORDER BY length) - 1 AS r, count(*) OVER (PARTITION BY session) AS n FROM f)
SELECT session, n, length AS upper_median FROM r WHERE r = n // 2""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.upper_median(log(spark, sf_dir), "session", "length")


_GAPPED = f"g AS (SELECT *, greatest(0, coalesce(seq - lag(seq) OVER {_W} - 1, 0)) AS dropped_before FROM f)"


@query(f"WITH @f, {_GAPPED} SELECT session, index, dropped_before, CASE WHEN dropped_before > 0 THEN flags | 4 ELSE flags END AS flags FROM g")
def seq_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sequence_gaps(frames(spark, sf_dir)).select("session", "index", "dropped_before", "flags")


@query(f"WITH @f, {_GAPPED} SELECT session, sum(CASE WHEN flags <> 0 THEN dropped_before ELSE 0 END)::BIGINT AS dropped_total FROM g GROUP BY 1")
def dropped_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    gapped = quality.sequence_gaps(frames(spark, sf_dir).withColumn("own", F.col("flags")))
    return gapped.groupBy("session").agg(F.sum(F.when(F.col("own") != 0, F.col("dropped_before")).otherwise(0)).alias("dropped_total"))


_LATENCY = "l AS (SELECT event_type, value * 10 - 60 AS latency_ms FROM f), g AS (SELECT * FROM l WHERE latency_ms > -50 AND latency_ms < 1000)"


@query(f"""WITH @f, {_LATENCY} SELECT event_type, count(*) AS samples, round(median(latency_ms), 2) AS median_ms, round(avg(latency_ms), 2) AS mean_ms, round(min(latency_ms), 2) AS min_ms,
round(max(latency_ms), 2) AS max_ms, round(CASE WHEN count(*) > 2 THEN stddev_samp(latency_ms) ELSE 0.0 END, 2) AS stdev_ms, CAST(trunc(median(latency_ms) * 1e6) AS BIGINT) AS capture_offset_ns FROM g GROUP BY 1""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    latencies = log(spark, sf_dir).select("event_type", (F.col("value") * 10 - 60).alias("latency_ms"))
    return stats.latency_summary(stats.plausible(latencies), "event_type")


_BASE = """o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY index) AS r FROM f WHERE (flags & 3) = 0),
b AS (SELECT session, avg(length) AS mean, stddev_samp(length) AS s, count(*) AS n FROM o WHERE r <= 10 GROUP BY 1),
base AS (SELECT session, mean, CASE WHEN n > 2 AND s > 0 THEN s ELSE greatest(1.0, mean * 0.01) END AS sd FROM b)"""


@query(f"WITH @f, {_BASE} SELECT session, round(mean, 4) AS mean, round(sd, 4) AS sd FROM base")
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.baseline(frames(spark, sf_dir), 10).select("session", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


_CHANGES = f"""{_BASE}, d AS (SELECT session, index, ts_ns, seq, length, abs(length - lag(length) OVER (PARTITION BY session ORDER BY index)) AS delta FROM o WHERE r > 10),
c AS (SELECT d.*, row_number() OVER (PARTITION BY session ORDER BY index) AS k FROM d JOIN base USING (session) WHERE delta > sd * 1.5)"""


@query(f"WITH @f, {_CHANGES} SELECT session, index, ts_ns, seq, length, delta FROM c")
def change_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.size_changes(frames(spark, sf_dir), sigmas=1.5, learn=10).drop("limit")


@query(f"""WITH RECURSIVE @f, {_CHANGES}, e AS (
SELECT session, k, index, ts_ns, ts_ns AS reported, true AS keep FROM c WHERE k = 1 UNION ALL
SELECT c.session, c.k, c.index, c.ts_ns, CASE WHEN c.ts_ns >= e.reported + {DAY} THEN c.ts_ns ELSE e.reported END, c.ts_ns >= e.reported + {DAY} FROM e JOIN c ON c.session = e.session AND c.k = e.k + 1),
n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY k) AS reports FROM e WHERE keep)
SELECT session, index, ts_ns FROM n WHERE reports <= 5""")
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with a day of silence after each, the first five of a session."""
    found = changes.size_changes(frames(spark, sf_dir), sigmas=1.5, learn=10)
    return changes.debounced(found, settle_ns=DAY, count=5).select("session", "index", "ts_ns")


_MODES = "m AS (SELECT p_brand AS pixelformat, p_size AS width, 16 AS height, p_retailprice AS rate FROM part)"


@query(f"""WITH {_MODES}, x AS (SELECT pixelformat, count(*) AS modes, max(struct_pack(pixels := width * height, rate := rate)) AS b FROM m GROUP BY 1)
SELECT pixelformat, modes, b.pixels AS pixels, b.rate AS rate FROM x""")
def best_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("pixelformat"), F.col("p_size").alias("width"), F.lit(16).alias("height"), F.col("p_retailprice").alias("rate"))
    return stats.best_mode(m, "pixelformat")


@query("SELECT l_returnflag, max(l_quantity) AS high_water FROM lineitem GROUP BY 1")
def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.high_water(_table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")


@query("""WITH x AS (SELECT label, unnest(embedding) AS level, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT label, pos::INTEGER AS pos, round(avg(level), 6) AS mean FROM x GROUP BY 1, 2""")
def column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.column_means(_table(spark, sf_dir, "embeddings"), "embedding", "label").withColumn("mean", F.round("mean", 6))


# ---- windows


@query("WITH @f SELECT session, index, ts_ns AS from_ns, to_ns, to_ns - ts_ns AS delta_ns FROM (SELECT *, lead(ts_ns) OVER @w AS to_ns FROM f) WHERE to_ns IS NOT NULL")
def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.deltas(frames(spark, sf_dir))


@query("""WITH @f, d AS (SELECT session, index, ts_ns AS from_ns, lead(ts_ns) OVER @w AS to_ns FROM f),
e AS (SELECT *, to_ns - from_ns AS d FROM d WHERE to_ns IS NOT NULL),
r AS (SELECT session, d, row_number() OVER (PARTITION BY session ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY session) AS n FROM e),
m AS (SELECT session, d AS m FROM r WHERE r = n // 2 AND n >= 2 AND d > 0)
SELECT e.session, index, from_ns, to_ns FROM e JOIN m ON e.session = m.session WHERE d > 1.5 * m""")
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gaps(frames(spark, sf_dir))


def _orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), events.ts_ns(F.col("o_orderdate")).alias("ts_ns"), F.col("o_orderkey").alias("index"))


@query("""WITH o AS (SELECT o_custkey AS session, o_orderkey AS index, epoch_us(o_orderdate) < lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS back FROM orders)
SELECT session, count(*) FILTER (back) AS regressions, min(index) FILTER (back) AS first_regression FROM o GROUP BY 1""")
def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.regressions(_orders_log(spark, sf_dir))


@query("SELECT conv_id AS session, turn AS segment, length(text) AS frames, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment_start FROM conversations")
def segment_start_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("segment"), F.length("text").cast("long").alias("frames"))
    return segments.segment_starts(c)


_ROLL = """o AS (SELECT session, index, length, ts_ns, 0 AS segment, 0::BIGINT AS byte_offset FROM f WHERE index = 0 AND length <= 50000 UNION ALL
SELECT session, index, length, ts_ns, 1, 0 FROM f WHERE index = 0 AND length > 50000),
s AS (SELECT * FROM o UNION ALL SELECT f.session, f.index, f.length, f.ts_ns, CASE WHEN s.byte_offset + s.length + f.length > 50000 THEN s.segment + 1 ELSE s.segment END,
CASE WHEN s.byte_offset + s.length + f.length > 50000 THEN 0 ELSE s.byte_offset + s.length END FROM s JOIN f ON f.session = s.session AND f.index = s.index + 1)"""


@query(f"WITH RECURSIVE @f, {_ROLL} SELECT session, index, length, segment, byte_offset FROM s")
def segment_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.rollover(frames(spark, sf_dir), 50_000)


@query(f"WITH RECURSIVE @f, {_ROLL} SELECT session, segment, count(*) AS frames, sum(length)::BIGINT AS bytes, arg_min(ts_ns, index) AS first_ts_ns, arg_max(ts_ns, index) AS last_ts_ns FROM s GROUP BY 1, 2")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return segments.segment_stats(segments.rollover(f, 50_000).join(f.select("session", "index", "ts_ns"), ["session", "index"]))


@query("WITH @f SELECT session, index, coalesce(sum(length) OVER (PARTITION BY session ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM f")
def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.offsets(frames(spark, sf_dir).withColumn("segment", F.lit(0))).select("session", "index", "byte_offset")


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS level, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
b AS (SELECT vec_id, pos, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS i FROM x WHERE level > 0)
SELECT vec_id, min(pos)::INTEGER AS start, (max(pos) + 1)::INTEGER AS stop FROM b GROUP BY vec_id, i""")
def bright_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.bright_runs(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.0)


# ---- scalars


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'FFD8' ELSE '' END || hex(encode(text)) || CASE WHEN doc_id % 2 = 0 THEN 'FFD9' ELSE '' END AS h FROM documents)
SELECT doc_id, length(h) >= 8 AND h[1:4] = 'FFD8' AND h[-4:] = 'FFD9' AS jpeg, left(h, 8) AS magic FROM d""")
def payload_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as payloads, with both markers of a JPEG, one or none around them."""
    start, stop = F.when(F.col("doc_id") % 4 < 2, F.lit(b"\xff\xd8")).otherwise(F.lit(b"")), F.when(F.col("doc_id") % 2 == 0, F.lit(b"\xff\xd9")).otherwise(F.lit(b""))
    data = F.concat(start, F.encode("text", "UTF-8"), stop)
    return _table(spark, sf_dir, "documents").select("doc_id", S.looks_like_jpeg(data).alias("jpeg"), F.hex(F.substring(data, 1, 4)).alias("magic"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 < 3 THEN (l_partkey % 4000 + 1)::INTEGER END AS width,
CASE WHEN l_orderkey % 5 < 3 THEN (l_suppkey % 3000 + 1)::INTEGER END AS height FROM lineitem WHERE l_linenumber <= 2""")
def jpeg_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes out of frame headers: plain, behind a table and padding, progressive, cut off before the size, and none at all."""
    rows = _table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    short = lambda c: F.unhex(F.lpad(F.hex(c), 4, "0"))
    size = F.concat(short(F.col("l_suppkey") % 3000 + 1), short(F.col("l_partkey") % 4000 + 1))
    end = F.lit(bytes.fromhex("01011100ffd9"))
    kind = F.col("l_orderkey") % 5
    whole = lambda before, sof: F.concat(F.lit(bytes.fromhex(before + "ff" + sof + "000b08")), size, end)
    data = (
        F.when(kind == 0, whole("ffd8", "c0")).when(kind == 1, whole("ffd8ffc400050102c0ffff", "c0")).when(kind == 2, whole("ffd8ffe0000401ff", "c2"))
        .when(kind == 3, F.lit(bytes.fromhex("ffd8ffc0000b080010"))).otherwise(F.concat(F.lit(b"\xff\xd8\xff\xda\x00\x02"), size, end))
    )
    return rows.select("l_orderkey", "l_linenumber", jpeg_dimensions(data).alias("d")).select("l_orderkey", "l_linenumber", "d.*")


@query("""SELECT event_id, CASE WHEN event_id % 6 < 4 THEN (event_id * 7919 % 1048576)::INTEGER END AS value FROM events""")
def bar_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values read back out of rows of levels: clean, dim, and with something bright at the left or on both sides; one bar flipped and a row
    without contrast give none."""
    kind, bars = F.col("event_id") % 6, S.encode_bars(F.col("event_id") * 7919 % 1048576)
    flipped = F.transform(bars, lambda b, i: F.when((kind == 4) & (i == 2 + F.col("event_id") % 24), ~b).otherwise(b))
    high, low = F.when(kind == 1, 150).when(kind == 5, 130).otherwise(235), F.when(kind == 1, 90).when(kind == 5, 120).otherwise(16)
    drawn = F.flatten(F.transform(flipped, lambda b: F.array_repeat(F.when(b, high).otherwise(low), 8)))
    side = F.when(kind >= 2, F.lit(235)).otherwise(low)
    left, right = F.array_repeat(F.when(kind.isin(2, 3), side).otherwise(low), 11), F.array_repeat(F.when(kind == 3, side).otherwise(low), 9)
    rows = _table(spark, sf_dir, "events").select("event_id", F.concat(left, drawn, right).cast("array<int>").alias("columns"))
    return rows.select("event_id", decode_columns("columns")["value"].alias("value"))


@query("WITH @f, g AS (SELECT session, index % 5 AS segment, index // 5 AS local_index, seq FROM f), c AS (SELECT session, segment, count(*) AS n FROM g GROUP BY 1, 2), "
       "s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY session ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c) "
       "SELECT g.seq, s.before + g.local_index AS index FROM g JOIN s USING (session, segment)")  # fmt: skip
def global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions counted through the segments of a session."""
    f = frames(spark, sf_dir).select("session", "seq", (F.col("index") % 5).alias("segment"), F.expr("index div 5").alias("local_index"))
    return segments.global_index(f).select("seq", "index")


_VALUE = "v AS (SELECT event_id, event_id % 1048576 AS v FROM events)"
_CHECK = "xor(xor(xor(xor(v & 15, (v >> 4) & 15), (v >> 8) & 15), (v >> 12) & 15), (v >> 16) & 15)"


@query(f"WITH {_VALUE} SELECT event_id, {_CHECK} AS checksum FROM v")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", S.checksum(F.col("event_id") % 1048576).alias("checksum"))


@query(f"WITH {_VALUE} SELECT event_id, '10' || right(bin(v + 1048576), 20) || right(bin({_CHECK} + 16), 4) || '01' AS bars FROM v")
def encode_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.encode_bars(F.col("event_id") % 1048576)
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(bars, lambda b: b.cast("int").cast("string")), "").alias("bars"))


@query("SELECT event_id, (event_id % 28 + 0.5) / 32.0 AS centre FROM events")
def bar_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", S.bar_centre((F.col("event_id") % 28).cast("double")).alias("centre"))


_RECON = "r AS (SELECT seq, ts_ns / 1e6 AS ref, (seq * 7919) % 1048576 AS e, floor(ts_ns / 1e6 / 1048576) * 1048576 AS base FROM f), c AS (SELECT *, unnest([base + e - 1048576, base + e, base + e + 1048576]) AS c FROM r)"


@query(f"WITH @f, {_RECON} SELECT seq, arg_min(c, struct_pack(d := abs(ref - c), c := c)) AS ms FROM c GROUP BY seq")
def reconstruct_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select("seq", S.reconstruct_ms((F.col("seq") * 7919) % 1048576, F.col("ts_ns") / 1e6).alias("ms"))


@query(f"WITH @f, {_RECON} SELECT seq, round(any_value(ref) - arg_min(c, struct_pack(d := abs(ref - c), c := c)), 3) AS latency_ms FROM c GROUP BY seq")
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select("seq", F.round(S.latency_ms(F.col("ts_ns"), (F.col("seq") * 7919) % 1048576), 3).alias("latency_ms"))


@query("WITH @f SELECT seq, 1700000000000000000 + (ts_ns - 1000000000) AS realtime_ns FROM f")
def realtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select("seq", S.to_realtime_ns(F.col("ts_ns"), F.lit(1_000_000_000), F.lit(1_700_000_000_000_000_000)).alias("realtime_ns"))


@query("SELECT event_id, event_id * 1000000000 + (event_id % 1000000) * 1000 AS ns FROM events")
def timeval_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", S.timeval_ns(F.col("event_id"), F.col("event_id") % 1_000_000).alias("ns"))


@query("""WITH c AS (SELECT p_partkey, rpad(left(p_brand, 1 + p_partkey % 4), 4, ' ') AS code FROM part)
SELECT p_partkey, ascii(code[1]) + (ascii(code[2])::BIGINT << 8) + (ascii(code[3])::BIGINT << 16) + (ascii(code[4])::BIGINT << 24) AS number, code AS back FROM c""")
def fourcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = S.fourcc_to_int(F.substr("p_brand", F.lit(1), (F.col("p_partkey") % 4 + 1).cast("int")))
    return _table(spark, sf_dir, "part").select("p_partkey", number.alias("number")).withColumn("back", S.int_to_fourcc(F.col("number")))


@query("""SELECT event_id, CASE event_id * 8192 & 57344 WHEN 0 THEN 'unknown' WHEN 8192 THEN 'monotonic' WHEN 16384 THEN 'copy' ELSE 'unrecognised' END AS clock,
CASE event_id * 65536 & 458752 WHEN 0 THEN 'end-of-frame' WHEN 65536 THEN 'start-of-frame' ELSE 'unrecognised' END AS source FROM events""")
def clock_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", S.clock(F.col("event_id") * 8192).alias("clock"), S.timestamp_source(F.col("event_id") * 65536).alias("source"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_size::DOUBLE / (p_partkey % 5) END AS hz, abs(p_size - p_partkey % 50) > 0.5 AS coerced,
CASE WHEN p_partkey % 50 = 0 THEN false ELSE p_size::DOUBLE / (p_partkey % 50) < 0.9 END AS underdelivers FROM part""")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", S.fract_hz(k % 5, size).alias("hz"), S.rate_coerced(k % 50, size).alias("coerced"), S.underdelivers((k % 50).cast("double"), size.cast("double")).alias("underdelivers")
    )


@query("""SELECT s_suppkey, 'HDMI-' || s_suppkey AS name, s_suppkey % 2 = 0 AS is_primary, (s_suppkey * 10)::INTEGER AS width, (s_suppkey * 5)::INTEGER AS height,
s_suppkey::INTEGER AS x, 0::INTEGER AS y FROM supplier WHERE s_suppkey % 3 <> 0""")
def output_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("""if(s_suppkey % 3 = 0, concat('Monitors: ', s_suppkey), concat(' ', s_suppkey, ': +', if(s_suppkey % 2 = 0, '*', ''), 'HDMI-', s_suppkey, ' ',
        s_suppkey * 10, '/344x', s_suppkey * 5, '/215+', s_suppkey, '+0  HDMI'))""")
    out = _table(spark, sf_dir, "supplier").select("s_suppkey", S.output_line(line).alias("o")).where("o is not null")
    return out.select("s_suppkey", "o.name", F.col("o.primary").alias("is_primary"), "o.width", "o.height", "o.x", "o.y")


@query("""SELECT c_nationkey AS site, CASE WHEN count(*) FILTER (c_mktsegment <> 'BUILDING') = 1 THEN min(c_name) FILTER (c_mktsegment <> 'BUILDING') END AS name FROM customer GROUP BY 1""")
def external_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only customer of a nation outside one segment, as the only output of a machine that isn't the primary one."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("site"), F.col("c_name").alias("name"), (F.col("c_mktsegment") == "BUILDING").alias("primary"))
    return devices.pick_external(c, "site")


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 13, 'video' || (s_suppkey % 13), s_suppkey) AS place FROM supplier""")
def node_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by their trailing number and then by name; a table of one machine's devices, so one window orders it."""
    s = _table(spark, sf_dir, "supplier").withColumn("node", F.concat(F.lit("video"), F.col("s_suppkey") % 13))
    return s.select("s_suppkey", F.row_number().over(Window.orderBy(*devices.node_key(F.col("node")), "s_suppkey")).cast("long").alias("place"))


@query("""SELECT p_partkey, p_type || ' ' || p_size || 'x' || p_size || ' @' || (p_partkey % 60 + 1) || ' -> ' || printf('%.1f', p_size::DOUBLE) || ' fps  ' || printf('%.0f', p_retailprice * 100 / 1024) ||
' KB/frame  dropped=0 corrupt=1' || CASE WHEN p_size::DOUBLE / (p_partkey % 60 + 1) < 0.9 THEN '  <- claims ' || (p_partkey % 60 + 1) || ', delivers ' || printf('%.1f', p_size::DOUBLE) ELSE '' END AS line FROM part""")
def mode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, asked = F.col("p_size"), (F.col("p_partkey") % 60 + 1).cast("double")
    line = S.mode_summary(F.col("p_type"), size, size, asked, size.cast("double"), F.col("p_retailprice") * 100, F.lit(0), F.lit(1), F.lit(None).cast("string"))
    return _table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'a=b' AS note FROM events")
def notes_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(F.concat(F.lit("k="), F.get_json_object("props", "$.k")), F.lit("note=x"), F.lit("note=a=b"))
    m = S.notes_map(pairs)
    return _table(spark, sf_dir, "events").select("event_id", m["k"].cast("long").alias("k"), m["note"].alias("note"))


@query("SELECT p_partkey, p_size AS width, 2 * p_size AS height, CASE WHEN p_partkey % 2 = 0 THEN 60.0::DOUBLE END AS fps FROM part")
def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(p_size, 'x', 2 * p_size, if(p_partkey % 2 = 0, '@60', ''))")
    return _table(spark, sf_dir, "part").select("p_partkey", S.geometry(text).alias("g")).select("p_partkey", "g.*")


@query("SELECT p_partkey, coalesce(nullif(p_partkey % 2, 0), nullif(p_partkey % 3, 0), nullif(p_partkey % 5, 0), 30)::DOUBLE AS rate FROM part")
def container_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select("p_partkey", S.container_rate(*[(k % m).cast("double") for m in (2, 3, 5)]).alias("rate"))


@query("""SELECT p_partkey, greatest(0, least(255, floor((p_partkey % 400 - 200) * p_size / 8)::INTEGER + 128))::INTEGER AS level FROM part""")
def dequantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", S.dequantised(F.col("p_partkey") % 400 - 200, F.col("p_size")).alias("level"))


# ---- sources and sinks


@query("WITH @f SELECT session, index, length, ts_ns, seq, flags FROM f")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames packed into 32-byte records and read back."""
    record = index.packed(F.col("length") * 0, F.col("length"), F.col("ts_ns"), F.col("seq"), F.col("flags"), F.lit(0))
    return frames(spark, sf_dir).select("session", "index", record.alias("r")).select("session", "index", *index.unpacked(F.col("r"))).drop("byte_offset", "dropped_before")


@query(f"WITH @f, {_GAPPED} SELECT session, index, ts_ns AS ts_mono_ns, CASE WHEN session % 2 = 0 THEN 1700000000000000000 + (ts_ns - 5) END AS ts_realtime_ns, seq, flags, dropped_before FROM g")
def csv_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("own", F.col("flags"))
    f = quality.sequence_gaps(f).withColumn("flags", F.col("own"))
    pairs = f.where("session % 2 = 0").select("session").distinct().select("session", F.lit(5).cast("long").alias("monotonic_ns"), F.lit(1_700_000_000_000_000_000).alias("realtime_ns"))
    return exports.sidecar(f, pairs)


@query("""WITH @f, n AS (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM f)
SELECT session, index, lpad(index::VARCHAR, greatest(4, length((n - 1)::VARCHAR))::INTEGER, '0') || '.jpg' AS name FROM n WHERE index % 3 = 0 AND flags = 0""")
def frame_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.frame_names(frames(spark, sf_dir), every=3)


@query(f"""WITH RECURSIVE @f, {_ROLL} SELECT session::VARCHAR AS session, count(DISTINCT segment) AS segments, count(*) AS frames_written, sum(length)::BIGINT AS bytes_written,
CASE WHEN session % 7 <> 0 THEN max(ts_ns) - min(ts_ns) + 3500000000 END AS duration_ns,
CASE WHEN session % 7 <> 0 THEN count(*) / ((max(ts_ns) - min(ts_ns) + 3500000000) / 1e9) END AS effective_fps FROM s GROUP BY session""")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = quality.sequence_gaps(frames(spark, sf_dir))
    cut = segments.rollover(f, 50_000).select("session", "index", "segment").join(f, ["session", "index"])
    # the clock starts before the first frame and stops after the last one; every seventh session was not closed
    clocks = f.groupBy("session").agg((F.min("ts_ns") - 1_500_000_000).alias("started_ns"), F.when(F.col("session") % 7 != 0, F.max("ts_ns") + 2_000_000_000).alias("ended_ns"))
    m = exports.build_manifests(cut, clocks)
    return m.select("session", F.size("segments").cast("long").alias("segments"), "frames_written", "bytes_written", "duration_ns", "effective_fps")


@query(f"""WITH @f, r AS (SELECT *, octet_length(encode('frame ' || seq))::BIGINT AS size FROM f)
SELECT r.session::VARCHAR AS session, r.index, r.seq, r.ts_ns, r.flags, r.size AS length, md5('frame ' || r.seq) AS digest FROM r""")
def segment_sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as streams, index files and manifests, and read back with their payloads. The files stay, as the result is read from them."""
    f = frames(spark, sf_dir).withColumn("data", F.encode(F.concat(F.lit("frame "), F.col("seq")), "UTF-8")).withColumn("dropped_before", F.lit(0).cast("long"))
    folder = shared_folder(spark, "recordings")
    exports.write_recordings(f, folder, 200)
    back = recording.payloads(spark, folder, recording.recording(spark, folder))
    return back.select("session", "index", "seq", "ts_ns", "flags", "length", F.md5("data").alias("digest"))


# ---- composites


@query(f"""WITH @f, {_SHAKEN}, g AS (SELECT * REPLACE (flags AS flags), coalesce(greatest(seq - lag(seq) OVER @w - 1, 0), 0) AS dropped_before FROM k),
p AS (SELECT *, lag(ts_ns) OVER @w AS previous FROM g),
s AS (SELECT session, count(*) AS frames, count(*) FILTER (ts_ns < previous) AS timestamp_regressions, min(index) FILTER (ts_ns < previous) AS first_regression, count(*) FILTER (flags <> 0) AS flagged,
count(*) FILTER (flags & 1 <> 0) AS driver_error, count(*) FILTER (flags & 2 <> 0) AS corrupt, count(*) FILTER (flags & 4 <> 0) AS gap_before,
sum(CASE WHEN flags <> 0 THEN dropped_before ELSE 0 END)::BIGINT AS driver_dropped_total, (arg_max(ts_ns, index) - arg_min(ts_ns, index)) / 1e9 AS duration_s,
count(*) FILTER (index % 10 = 0 AND length % 5 <> 4) AS checked, count(*) FILTER (index % 10 = 0 AND length % 5 = 4) AS unreadable, count(*) FILTER (index % 10 = 0 AND length % 5 = 3) AS incomplete_jpeg,
count(*) FILTER (index % 10 = 0 AND length % 5 = 2) AS wrong_size, session % 5 <> 0 AS monotonic, session % 4 <> 0 AS ended FROM p GROUP BY session)
SELECT session, frames, timestamp_regressions, flagged, driver_error, corrupt, gap_before, driver_dropped_total, duration_s, CASE WHEN duration_s > 0 THEN (frames - 1) / duration_s END AS measured_fps,
checked, unreadable, incomplete_jpeg, wrong_size, monotonic AND timestamp_regressions = 0 AND unreadable = 0 AS usable,
concat_ws('; ', CASE WHEN unreadable > 0 THEN unreadable || ' frame(s) could not be read: the stream is truncated' END,
CASE WHEN NOT monotonic THEN 'frame timestamps are not on the monotonic clock' END,
CASE WHEN NOT ended THEN 'no end record: the session was not closed; frames before the cut are valid' END,
CASE WHEN timestamp_regressions > 0 THEN timestamp_regressions || ' timestamp regression(s), first at frame ' || first_regression END,
CASE WHEN wrong_size > 0 THEN wrong_size || ' frame(s) have another geometry than granted' END) AS problems FROM s""")
def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report: index, payloads of every tenth frame and manifests, with every kind of problem among the sessions."""
    f = _shaken(frames(spark, sf_dir))
    f = quality.sequence_gaps(f.withColumn("own", F.col("flags"))).withColumn("flags", F.col("own")).drop("own")
    header = lambda w, tail: F.lit(bytes.fromhex(f"ffd8ffc0000b080030{w:04x}01011100" + tail))
    kind = F.col("length") % 5
    data = F.when(kind == 4, None).when(kind == 3, header(64, "")).when(kind == 2, header(80, "ffd9")).otherwise(header(64, "ffd9"))
    sessions = f.select("session").distinct()
    granted = sessions.select("session", F.lit("MJPG").alias("pixelformat"), F.lit(64).alias("width"), F.lit(48).alias("height"))
    checks = payload_checks(f.where("index % 10 = 0").select("session", "index", data.alias("data")), granted)
    states = sessions.select("session", (F.col("session") % 5 != 0).alias("monotonic"), (F.col("session") % 4 != 0).alias("ended"))
    names = ("session", "frames", "timestamp_regressions", "flagged", "driver_error", "corrupt", "gap_before", "driver_dropped_total", "duration_s", "measured_fps", "checked", "unreadable", "incomplete_jpeg", "wrong_size", "usable")
    return quality.verify(f, checks, states).select(*names, F.array_join("problems", "; ").alias("problems"))


@query("""WITH @f SELECT session, arg_max(ts_ns, index) AS ts_ns, arg_max(seq, index) AS seq, arg_max(length, index) AS length, arg_max(flags, index) AS flags, count(*) AS generation, count(*) - 1 AS overwritten FROM f GROUP BY 1""")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelog.streaming.frames import latest

    return latest(log(spark, sf_dir))
