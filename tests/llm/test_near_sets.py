import random

import numpy as np

import corpus_pipeline
from framelog.llm import near_sets as N
from framelog.llm import simhash

from .helpers import ODD, docs


def corpus(seed):
    """Texts with copies of which a few words are replaced, and a passage that many have in common."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    common, rows = [word() for _ in range(40)], []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 12, 60, 200, 500]))]
        if rng.random() < 0.5:
            base[1:1] = common
        rows.append(base)
        for _ in range(6):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.02, 0.04])) + rng.randrange(2)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    rng.shuffle(rows)
    return [(k, " ".join(r)) for k, r in enumerate(rows)]


def brute(rows):
    """Least doc_id of the component of every doc_id, from all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, (i, _) in enumerate(rows):
        for q, (j, _) in enumerate(rows[:p]):
            union = len(sets[p] | sets[q])
            if not union or 5 * len(sets[p] & sets[q]) >= 4 * union:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in rows}


def test_near_copies_against_all_pairs(spark):
    rows = corpus(3)
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in N.near_duplicates(docs(spark, rows)).collect()} == want
    # what fingerprints three words wide and two bits apart leave in
    fps = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert sum(fps[i] == i for i in want) > sum(want[i] == i for i in want)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs(spark, rows), "").collect()}
    assert kept == {i for i in want if want[i] == i}


def test_blocks_lose_nothing(spark, monkeypatch):
    """With a single neighbour and blocks of three, so that nearly all links are found across blocks."""
    monkeypatch.setattr(N, "FOLLOWING", 1)
    monkeypatch.setattr(N, "BLOCK", 3)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(w if rng.random() > 0.03 else f"x{k}" for w in base)) for k in range(60)] + corpus(9)[:40]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    assert {r.doc_id: r.component_id for r in N.near_duplicates(docs(spark, rows)).collect()} == brute(rows)


def test_odd_rows_of_near_copies(spark):
    got = {(r.doc_id, r.component_id) for r in N.near_duplicates(docs(spark, ODD)).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 1), (5, 5), (6, 6), (7, 6)}
    assert N.near_duplicates(docs(spark, [])).count() == 0
    both = [(1, "a b c d e f g h"), (1, "other words are here in this one"), (2, "A b c d e f g  h"), (3, "none of it at all is like these")]
    assert {(r.doc_id, r.component_id) for r in N.near_duplicates(docs(spark, both)).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 50, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        y = np.unique(np.concatenate((x[n // 7 :], rng.integers(0, 1 << 63, n // 9, np.uint64))))
        apart = int(np.bitwise_count((N._bitmap(x) ^ N._bitmap(y)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(x, y))
