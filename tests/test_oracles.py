"""Every query of the engine that has SQL, against DuckDB over the smallest tables."""

import math
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from framelog.functions.scalars import hundredths
from framelog.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == theirs


def test_all_queries_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_hundredths_are_those_of_the_exact_value(spark):
    """As C and DuckDB print them: by the binary value, so that 1.015, which lies below, becomes 1.01."""
    rng = random.Random(5)
    near = [(100 * rng.randrange(10 ** rng.randrange(1, 9)) + rng.randrange(100)) * 10_000 + 5_000 for _ in range(20_000)]
    values = [us * 1000 / 1e9 for us in near] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 16) for _ in range(20_000)] + [k / 8 for k in range(-100, 100)]
    for t in (0.005, 0.015, 0.995, 0.125, 0.375, 1.005, 2.675, 99.995, 2.0**-30, 5e-324, 2.0**53 - 1, 2.0**53, 1e15 + 0.125):
        values += [s * v for s in (1, -1) for v in (t, math.nextafter(t, 0), math.nextafter(t, math.inf))]
    values += [0.0, -0.0, -0.001]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", hundredths(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in got if r.t != f"{r.v:.2f}"] == []
    assert spark.range(1).select(hundredths(F.lit(None).cast("double")).alias("t")).first().t is None


def test_verdict_lines_between_hundredths(spark, tmp_path):
    """Durations of so many hundredths and a half: their doubles lie above, below or just there."""
    con = duckdb.connect()
    con.execute(f"""copy (select 2 * s + k as event_id, timestamp '2024-01-01' + to_microseconds(k * (s * 10000 + 5000)) as ts, s as user_id, 'view' as event_type, 1.0::double as value
      from range(400) a(s), range(2) b(k)) to '{tmp_path}/events.parquet'""")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = sorted((r.session, r.line) for r in registry.QUERIES["verdict_lines"](spark, str(tmp_path)).collect())
    assert len(got) == 400 and got == sorted(con.execute(f"select session, line from ({registry.ORACLES['verdict_lines']})").fetchall())
