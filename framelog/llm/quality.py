"""Quality classifier: random-indexing word vectors, pooled per document, under a small network with calibrated probabilities.

A word (a run of word characters or of punctuation) is hashed to one of ``BUCKETS`` slots. Each slot has a fixed sparse ternary index
vector; a slot's word vector is the sum of the index vectors of its neighbours in the sample (exact integer sums, so the order in
which tasks finish changes nothing). A document is the mean of its words' vectors, joined with the shares of its words' shapes
and repetitions and its logarithmic length. A two-layer network scores it; a temperature fitted on rows kept out of its training
calibrates the probability.

The classifier is fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of the id; every document is scored in one pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelog.llm.common import checkpoint

#: The bound of the rows that fit the classifier.
SAMPLE = 6000
#: Slots of words, length of a word vector, entries of an index vector, neighbours on each side.
BUCKETS, DIM, ENTRIES, WINDOW = 1 << 15, 64, 4, 2
#: Words handled at a time, and distinct words that a worker remembers.
PIECE, KNOWN = 1 << 16, 400_000
#: Shapes of words: lower, Title, UPPER, mixed, digits, with digits, punctuation.
SHAPES = 7
FEATURES = DIM + SHAPES + 4
_WORD = regex.compile(r"\w+|[^\w\s]+")


def held_out(id_col: Column) -> Column:
    """Rows that no label is ever learned from."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _shape(w: str) -> int:
    if not (w[0].isalnum() or w[0] == "_"):
        return 6
    if w.isdigit():
        return 4
    if any(c.isdigit() for c in w):
        return 5
    if w.islower():
        return 0
    if w.istitle():
        return 1
    return 2 if w.isupper() else 3


class Words:
    """Slots and shapes of words, with a bounded memory of those seen."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def codes(self, words: list[str]) -> np.ndarray:
        """slot + BUCKETS * shape of each word."""
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w.lower().encode()) % BUCKETS + BUCKETS * _shape(w)
        return np.array([known[w] for w in words], np.int64)

    def pieces(self, text: str | None) -> Iterator[np.ndarray]:
        """Codes of a text's words, in arrays of bounded size."""
        if not text:
            return
        if len(text) <= 1 << 20:
            words = _WORD.findall(text)
            for i in range(0, len(words), PIECE):
                yield self.codes(words[i : i + PIECE])
            return
        words = []
        for m in _WORD.finditer(text):
            words.append(m.group())
            if len(words) == PIECE:
                yield self.codes(words)
                words = []
        if words:
            yield self.codes(words)


def index_vectors() -> np.ndarray:
    """BUCKETS sparse ternary vectors: half of the entries +1, half -1."""
    rng = np.random.default_rng(2)
    out = np.zeros((BUCKETS, DIM), np.int8)
    at = rng.permuted(np.tile(np.arange(DIM, dtype=np.uint8), (BUCKETS, 1)), axis=1)[:, :ENTRIES]
    rows = np.arange(BUCKETS)[:, None]
    out[rows, at[:, : ENTRIES // 2]] = 1
    out[rows, at[:, ENTRIES // 2 :]] = -1
    return out


def context_sums(texts: Iterator[str | None]) -> np.ndarray:
    """Sum of the index vectors of each slot's neighbours."""
    index, words, sums = index_vectors(), Words(), np.zeros((BUCKETS, DIM), np.int64)
    for text in texts:
        for codes in words.pieces(text):
            slots = codes % BUCKETS
            for d in range(1, WINDOW + 1):
                a, b = slots[:-d], slots[d:]
                pair, n = np.unique(np.concatenate((a * BUCKETS + b, b * BUCKETS + a)), return_counts=True)
                if len(pair):
                    to, starts = np.unique(pair // BUCKETS, return_index=True)
                    sums[to] += np.add.reduceat(index[pair % BUCKETS].astype(np.int64) * n[:, None], starts, axis=0)
    return sums


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors; zero for slots that the sample doesn't have."""
    v = sums.astype(np.float64)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(words: Words, vectors: np.ndarray, text: str | None) -> np.ndarray:
    """Pooled vector of a text; zeros for a text without words."""
    out, n, last, same, gap, known = np.zeros(FEATURES), 0, -1, 0, 0, 0
    for codes in words.pieces(text):
        slots, shapes = codes % BUCKETS, codes // BUCKETS
        which, times = np.unique(slots, return_counts=True)
        out[:DIM] += times @ vectors[which]
        out[DIM : DIM + SHAPES] += np.bincount(shapes, minlength=SHAPES)
        same += int((slots[1:] == slots[:-1]).sum()) + int(slots[0] == last)
        gap += int((slots[2:] == slots[:-2]).sum())
        known += len(which)
        n, last = n + len(slots), slots[-1]
    if n:
        out /= n
        out[DIM + SHAPES :] = same / n, gap / n, known / n, np.log1p(n) / 10
    return out


class Network:
    """Two layers; the weights are the result of ``fit``."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, layers: list[np.ndarray], temperature: float):
        self.mean, self.scale, self.layers, self.temperature = mean, scale, layers, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        z = (x - self.mean) / self.scale
        # row by row: a product of matrices would depend on which rows share a batch, in its last bits
        return np.array([np.maximum(r @ a + b, 0) @ c + d[0] for r in z])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 60, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 2) -> Network:
        rng = np.random.default_rng(seed)
        if not len(y) or y.min() == y.max():  # nothing to tell apart: a constant score
            at = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
            return cls(np.zeros(FEATURES), np.ones(FEATURES), [np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), np.array([at])], 1.0)
        aside = rng.random(len(y)) < 0.2
        if not aside.any() or len(set(y[~aside])) < 2:
            aside[:] = False
        net = cls(x.mean(0), x.std(0) + 1e-3, [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)], 1.0)
        z, t = (x[~aside] - net.mean) / net.scale, y[~aside].astype(float)
        m, v = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(t))
            for lo, hi in pairwise([*range(0, len(t), batch), len(t)]):
                i = order[lo:hi]
                a, b, c, d = net.layers
                h = np.maximum(z[i] @ a + b, 0)
                g = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -40, 40))) - t[i]) / len(i)
                back = np.outer(g, c) * (h > 0)
                step += 1
                for k, grad in enumerate((z[i].T @ back + decay * a, back.sum(0), h.T @ g + decay * c, np.array([g.sum()]))):
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad**2 - v[k])
                    net.layers[k] = net.layers[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if aside.any():
            logit, t = net.logits(x[aside]), y[aside].astype(float)
            grid = np.geomspace(0.25, 8, 81)
            losses = [np.logaddexp(0, np.where(t > 0, -1, 1) * logit / s).mean() for s in grid]
            net.temperature = float(grid[int(np.argmin(losses))])
        return net


def sample_ids(labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, label) of at most ``bound`` labelled rows that may be learned from; a document labelled more than once counts by majority."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def _vectors(sample: DataFrame) -> np.ndarray:
    part = 512

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = context_sums(t.as_py() for b in batches for t in b.column("text"))
        for k in range(BUCKETS // part):
            block = sums[k * part : (k + 1) * part]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())], names=["block", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(s), np.int64) for s in pdf["sums"])
        return pd.DataFrame({"block": pdf["block"][:1], "sums": [zlib.compress(total.tobytes(), 1)]})

    blocks = sample.select("text").mapInArrow(partial, "block int, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary")
    sums = np.zeros((BUCKETS, DIM), np.int64)
    for r in blocks.toLocalIterator():  # BUCKETS * DIM numbers whatever the input
        sums[r["block"] * part : (r["block"] + 1) * part] = np.frombuffer(zlib.decompress(r["sums"]), np.int64).reshape(part, DIM)
    return word_vectors(sums)


def _pooled(words: Words, vectors: np.ndarray, texts: pa.Array) -> np.ndarray:
    return np.array([features(words, vectors, t.as_py()) for t in texts]).reshape(-1, FEATURES)


class Classifier:
    """Word vectors and network; small and of fixed size, so it is broadcast."""

    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def scores(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) of every row of docs (doc_id, text)."""
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, words = shared.value, Words()
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.network.score(_pooled(words, c.vectors, b.column(1))))], names=["doc_id", "score"])

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")

    def accepted(self, docs: DataFrame, threshold: float) -> DataFrame:
        """The rows of docs, with all their columns, that score ``threshold`` or more."""
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, words = shared.value, Words()
            for b in batches:
                yield b.filter(pa.array(c.network.score(_pooled(words, c.vectors, b.column("text"))) >= threshold))

        return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, *, bound: int = SAMPLE) -> Classifier:
    """Fit on at most ``bound`` labelled rows of ``docs``, never on held-out ones.

    Of rows with one id the least text is learned from; rows without text as empty texts. Without labels, or with one label only, every score is the same (0.5, or
    near that label)."""
    ids = F.broadcast(sample_ids(labels, bound))  # bounded by ``bound`` rows
    sample = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one row an id
    sample = checkpoint(sample.repartition(8, "doc_id"))
    vectors = _vectors(sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            x = _pooled(words, shared.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "label", "text").mapInArrow(run, f"doc_id {kind}, label int, x binary")
    got = sorted((r["doc_id"], r["label"], bytes(r["x"])) for r in rows.toLocalIterator())  # ``bound`` rows at most
    x = np.array([np.frombuffer(v) for _, _, v in got]).reshape(-1, FEATURES)
    return Classifier(vectors, Network.fit(x, np.array([y for _, y, _ in got])))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Null and empty texts are scored as texts without words. A null doc_id is held out or not by the crc32 of the empty string. Repeated
    rows are scored alike. Empty documents give no rows. Other columns are never read.
    """
    out = fit(docs, labels, bound=bound).scores(docs)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
