import random
import re

import xxhash

from framelog.llm import simhash as S
from framelog.llm.components import components

from .helpers import ODD, docs


def plain(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rng, text):
    words = text.split()
    words[rng.randrange(len(words))] = "other"
    return " ".join(words)


def test_fingerprints_and_components(spark, monkeypatch):
    rng = random.Random(2)
    base = [" ".join(f"Wört{rng.randrange(300)}" for _ in range(rng.choice([2, 3, 80, 600]))) for _ in range(60)]
    texts = base + base[:10] + [near(rng, t) for t in base for _ in range(2)] + ["", "  \n", None]
    rows = list(zip(rng.sample(range(5000), len(texts)), texts))
    got = {r.doc_id: r for r in S.near_duplicates(docs(spark, rows)).withColumn("hex", S.hex16(S.F.col("fp"))).collect()}
    fps = {i: plain(t) for i, t in rows}
    assert {i: int(r.hex, 16) for i, r in got.items()} == fps
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    linked = 0
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
                linked += fps[a] != fps[b]
    assert linked and {i: r.component_id for i, r in got.items()} == {i: find(i) for i in ids}


def test_pieces_change_nothing(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)).encode()
    whole = S.fingerprint(text)
    for piece in (7, 100, 4096):
        monkeypatch.setattr(S, "PIECE", piece)
        assert S.fingerprint(text) == whole == plain(text.decode())


def test_odd_rows(spark):
    got = S.near_duplicates(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].fp == by[2].fp == by[4].fp == 0 and by[1].component_id == by[2].component_id == by[4].component_id == 1
    assert by[6].component_id == by[7].component_id == 6 and by[None].component_id is None
    assert S.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    chain = list(range(200, 260))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(7, k) for k in range(100, 190)] + [(5, 5), (None, 3), (1, 2), (2, 1), (1, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 200 for k in range(201, 260)}, **{k: 7 for k in range(100, 190)}, 2: 1}
