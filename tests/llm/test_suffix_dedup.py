import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from framelog.llm import suffix_dedup as S
from framelog.llm.suffix_sort import Suffixes, prefix_hashes

from .helpers import ODD, docs


def brute(rows):
    """{doc_id: (bytes, kept, runs)} by a dictionary of all strings."""
    first, out = {}, {}
    for k, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - S.LENGTH + 1):
            if first.setdefault(b[i : i + S.LENGTH], k) < k:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = len(b), bytes(x for x, g in zip(b, gone) if not g), runs
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(rng.randint(8, 40)) for _ in range(6)] + ["St " * 60, "x" * 130, "ab" * 40]
    out = []
    for _ in range(n):
        parts = [rng.choice([text(rng.randint(0, 30)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 20) :]]) for _ in range(rng.randint(0, 5))]
        out.append("".join(parts) if rng.random() < 0.5 else "\n".join(parts))
    out += out[:5]
    return list(zip(rng.sample(range(10_000), len(out)), out))


def by_key(tables):
    rows = [r for t in tables for r in t.to_pylist()]
    return {k: pa.Table.from_pylist([r for r in rows if r["key"] == k], tables[0].schema) for k in {r["key"] for r in rows}}


def by_steps(rows, frequent=None, n_buckets=3, n_docs=5):
    """The steps by hand, so that patched constants hold (workers have their own): {(doc_id, text): (bytes, kept, runs)}. Rows: (doc_id, version, text)."""
    everything = pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].encode() for r in rows], pa.binary())], names=["doc_id", "ver", "data"])
    bucket = S.doc_bucket(np.array(everything.column("doc_id").to_pylist()), n_docs)
    dealt = {k: everything.append_column("key", pa.array(bucket)).filter(pa.array(bucket == k)) for k in range(n_docs) if k in bucket}
    told = by_key([S._tell(t, n_buckets, frequent) for t in dealt.values()])
    answers = by_key([S._answer(t) for t in told.values()])
    none = pa.table({c: pa.array([], pa.int64()) for c in ("key", "source", "blob")})
    sent = by_key([S._send(t, answers.get(k, none), n_buckets, n_docs, frequent) for k, t in dealt.items()])
    first = by_key([S._first(t, n_buckets, n_docs) for t in sent.values()])
    known = by_key([S._second(t, n_docs) for t in first.values()])
    empty = pa.table({"key": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
    out = {}
    for k, left in dealt.items():
        for t, r in zip(left.column("data").to_pylist(), S._apply(left, known.get(k, empty)).to_pylist(), strict=True):
            out[r["doc_id"], t.decode()] = r["n_bytes"], r["kept"], r["n_spans"]
    return out


@pytest.mark.parametrize(("seed", "share", "piece", "size"), [(1, 0, 1 << 21, 1 << 22), (2, 0.3, 1 << 21, 1 << 22), (3, 0, 97, 1 << 22), (5, 0.9, 97, 300), (6, 1, 1000, 5000)])
def test_against_brute_force(monkeypatch, seed, share, piece, size):
    """With none, some and all K-grams taken for frequent, and with texts cut into pieces."""
    monkeypatch.setattr(S, "PIECE", piece)
    monkeypatch.setattr(S, "SLICE", size)
    rows = corpus(seed)
    frequent = np.random.default_rng(seed).random(1 << S.SLOT_BITS) < share if share else None
    got = by_steps([(k, 0, t) for k, t in rows], frequent)
    assert {k: v for (k, _), v in got.items()} == brute(rows)


def test_texts_of_one_id_lose_nothing_to_each_other(spark):
    rows = corpus(7)
    merged = [(k // 300, t) for k, t in rows]  # many ids with several texts
    want = {}
    for k, t in merged:  # a text is judged against smaller ids only
        want[k, t] = brute([(j, x) for j, x in enumerate(x for i, x in merged if i < k)] + [(10_000, t)])[10_000]
    got = by_steps([(k, hash(t) % (1 << 40), t) for k, t in merged])
    assert got == want
    df = spark.createDataFrame(merged, "doc_id long, text string")
    in_spark = {(r.doc_id, r.n_bytes, hashlib.sha256(r.kept).hexdigest(), r.n_spans) for r in S.dedup_substrings(df).collect()}
    assert in_spark == {(k, n, hashlib.sha256(kept).hexdigest(), runs) for (k, _), (n, kept, runs) in want.items()}


def test_no_verdict_by_hash_alone(monkeypatch):
    """With hashes that collide all over, bytes still decide."""
    monkeypatch.setattr(S, "_digest", lambda s, gram: np.zeros(len(s), np.uint64))
    real = S.cut
    monkeypatch.setattr(S, "cut", lambda *a: (*real(*a)[:4], np.zeros(len(real(*a)[0]), np.uint64)))
    monkeypatch.setattr(Suffixes, "common", lambda self, a, b: np.full(len(a), self.length))
    rows = corpus(8, 12)
    got = by_steps([(k, 0, t) for k, t in rows])
    assert {k: v for (k, _), v in got.items()} == brute(rows)


def test_strings_of_no_repeated_gram():
    one = S.Strings(*(np.zeros(1, k) for k in ("i8", "i8", "u4", "u1")), np.full(1, 60, np.uint8), np.arange(S.WIDE, dtype=np.uint8)[None, :])
    table = pa.Table.from_batches([S._batch([(0, S.STRING, one.packed())])])
    assert S._settle(table, 3).num_rows == 0


def test_buckets_are_even():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 2_000_000, np.uint8)
    _, _, _, gram, _ = S.cut(data, np.array([0, len(data)]), 0, len(data) - S.LENGTH + 1, None)
    for n in (10, 100, 1000):
        held = np.bincount(S.bucket_of(gram, n), minlength=n)
        assert held.max() < 2 * held.mean()


def test_in_spark(spark):
    rows = corpus(4, 40)
    got = {r.doc_id: (r.n_bytes, r.kept_sha256, r.n_spans) for r in S.with_digest(S.dedup_substrings(docs(spark, rows))).collect()}
    assert got == {k: (n, hashlib.sha256(kept).hexdigest(), runs) for k, (n, kept, runs) in brute(rows).items()}


def test_odd_rows(spark):
    got = S.dedup_substrings(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[6].n_removed == 0 and by[7].n_removed == by[7].n_bytes and by[7].n_spans == 1
    assert by[1].n_bytes == 0 and by[None].n_removed == 0
    assert S.dedup_substrings(docs(spark, [])).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(0)
    rows = rng.integers(97, 99, (50, 40), dtype=np.uint8)
    row, column = np.repeat(np.arange(50), 10), np.tile(np.arange(10), 50)
    segment = np.sort(rng.integers(0, 9, 500))
    s = Suffixes(rows, prefix_hashes(rows), row, column, 30)
    order = s.sort(segment)
    text = [rows[r, c : c + 30].tobytes() for r, c in zip(row, column)]
    assert order.tolist() == sorted(range(500), key=lambda i: (segment[i], text[i], i))
    classes = s.classes(segment)
    assert len(set(zip(classes, segment))) == len({(g, t) for g, t in zip(segment, text)}) == len(set(classes))


def test_colliding_hashes_are_told_apart():
    rows = np.frombuffer(b"aaaaaaaabbbbbbbbaaaaaaaa", np.uint8).reshape(3, 8)
    s = Suffixes(rows, np.zeros((3, 9), np.uint64), np.arange(3), np.zeros(3, np.int64), 8)  # all hashes equal
    c = s.classes(np.ones(3, np.int64))
    assert c[0] == c[2] != c[1]
