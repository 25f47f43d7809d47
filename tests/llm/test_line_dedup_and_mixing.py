import hashlib
import random
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from framelog.llm import line_dedup, mixing
from framelog.llm.queries import ORACLES, QUERIES

from .helpers import ODD, docs

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, str(DATA))
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(([plain(r[c]) for c in names] for r in df.collect()), key=repr) == sorted(([plain(v) for v in r] for r in want.fetchall()), key=repr)


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    common = ["A line that Many documents share, word for word %d" % k for k in range(6)] + ["short line"]
    rows = []
    for i in rng.sample(range(1000), 80):
        lines = [rng.choice([rng.choice(common), "  " + rng.choice(common).upper() + "\t", "own line of document %d and some more text here" % i, ""]) for _ in range(rng.randint(0, 150))]
        rows.append((i, "\n".join(lines)))
    key = lambda s: s.strip(" \t\n\x0b\f\r").translate(str.maketrans(line_dedup.BLANKS[:0] + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for i, t in rows:
        for s in t.split("\n"):
            holders[key(s)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    want = {}
    for i, t in rows:
        kept = [s for s in t.split("\n") if gone.get(key(s), i) == i]
        want[i] = (len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 1000


def test_rows_of_one_id_lose_their_own_lines_only(spark):
    shared, own = "a line that five documents share, long enough to count", "kept only here, in the second text of document one"
    rows = [(1, f"{shared}\nown 1"), (1, f"{own}\nsecond\n{shared}")] + [(i, f"{shared}\nown {i}") for i in range(2, 7)]
    got = {(r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {(1, "own 1", 1), (1, f"{own}\nsecond", 1), (6, f"{shared}\nown 6", 0)} | {(i, f"own {i}", 1) for i in range(2, 6)}


def test_windows_stream_over_sorted_range_partitions(spark):
    """The order that the range partitions are sorted in is what the windows consume: no exchange lies between."""
    df = docs(spark, [(i, "a line that all of the documents share, word for word") for i in range(9)])
    plan = line_dedup.keep_bitmaps(df)._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(plan) if "Exchange rangepartitioning(h1" in x)
    assert "Sort [h1" in plan[at - 1] and "DESC" in plan[at - 1] and "Window" in plan[at - 2]
    assert sum("Exchange" in x for x in plan) <= 5 and not any("Python" in x or "Arrow" in x for x in plan)


def test_odd_rows(spark):
    got = line_dedup.dedup_lines(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.n_dropped for r in got} == {0}
    assert [(r.text, r.n_lines) for r in got if r.doc_id == 1] == [("", 1)] and [r.n_lines for r in got if r.doc_id == 4] == [4]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    mixed = mixing.mix(docs(spark, ODD)).collect()
    assert len(mixed) == len(ODD) and mixing.mix(docs(spark, [])).count() == 0


def test_mix(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 5, 200]), rng.choice(["a", "a", "a", "a", "b", "c", None, "Z"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([(i, 10.0 if i % 2 else 0.1) for i in range(0, 400)], "doc_id long, weight double")
    results = []
    for bucket in (50_000, 7):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
        results.append(sorted(map(tuple, mixing.mix(df, weights).collect())))
    assert results[0] == results[1]  # buckets change nothing
    total, size, target = defaultdict(int), {}, {}
    for _, source, n, source_size, goal, taken in results[0]:
        total[source] += taken
        size[source], target[source] = source_size, goal
        assert 0 <= taken <= 3 * n
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, (5, 2, 1, 5, 2)))
    free = [s for s in order if target[s] < 3 * size[s] - 1e-9]
    assert len({round(target[s] / weight[s], 6) for s in free}) == 1
    for s in order:
        assert target[s] <= 3 * size[s] and abs(total[s] - target[s]) <= 0.5
    part = [(i, t, n) for i, s, n, *_, t in results[0] if s == "a" and n]
    good = sum(t for i, t, n in part if i % 2) / sum(n for i, t, n in part if i % 2)
    poor = sum(t for i, t, n in part if not i % 2) / sum(n for i, t, n in part if not i % 2)
    assert good > poor


def test_kept_digest(spark):
    df = QUERIES["op6_line_dedup"](spark, str(DATA)) if DATA.is_dir() else None
    if df is not None:
        assert all(len(r.kept_sha256) == len(hashlib.sha256().hexdigest()) for r in df.collect())
