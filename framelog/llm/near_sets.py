"""Near-duplicates by the exact similarity of word shingles: every pair of texts with a Jaccard similarity of 0.8 or more is linked.

Texts are sets of 64-bit hashes of five words each. Two sets of similarity 0.8 share at least K hashes among the
first n / 5 + K of each, in any order that all texts keep to (K grows with n), so only those prefixes meet in a shuffle. The order is that of
the hashes, frequent ones after all others: a passage that very many texts share is in no prefix unless it is nearly all of a text. Hashes
that no other text has are dropped, and so are texts with fewer than K left; of the rest a text keeps all but its K - 1 most frequent
ones, which still must hold a shared one. No pair is lost by any of these steps.

SimHash's balls come first (``simhash.links``, fingerprints of the same five words): they find most copies with few edits. What they leave apart
meets under the hashes of the prefixes: each text with a few neighbours, and then, where a hash has texts that aren't all joined, all of
them in blocks of bounded size. A bitmap of each set bounds the similarity from above and keeps most other pairs from the
comparison of the sets themselves, which decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelog.llm.common import checkpoint
from framelog.llm.components import components
from framelog.llm.simhash import _pieces, links, majority

SHINGLE = 5
#: Bits of a set's bitmap, as longs.
LONGS = 16
#: Texts that a text is first held against under a hash; texts of a block when all are.
FOLLOWING, BLOCK = 4, 4096
#: Slots of the filter that keeps texts out of the second reading.
SLOTS = 1 << 25
#: Slots in which hashes are counted, and from which count of a task (and how many times the mean) on they are frequent.
COUNT_BITS, FREQUENT, TIMES_MEAN = 22, 8, 4


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of UTF-8 text; a text of fewer words is one shingle, one without words has none."""
    found, carry = [np.zeros(0, np.uint64)], []
    digest = xxhash.xxh64_intdigest
    for words in _pieces(data):
        words = carry + words
        if len(words) >= SHINGLE:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            joined = b" ".join(words)
            found.append(np.unique(np.array([digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)))
        carry = words[-(SHINGLE - 1) :]
    if len(found) == 1 and carry:
        return np.array([digest(b" ".join(carry), 42)], np.uint64)
    return np.unique(np.concatenate(found))


def _at_least(n: int) -> int:
    """The fewest hashes that a text similar to one of n may have."""
    return -(-4 * n // 5)


def _name(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of hashes fall on it: sets differ in no fewer hashes than their bitmaps in bits."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def frequent_slots(docs: DataFrame) -> np.ndarray:
    """Bits of the slots (the first COUNT_BITS of a hash) that are frequent in some task's texts; of fixed size, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            held = [np.zeros(0, np.uint64), *(shingle_set((t.as_py() or "").encode()) for t in b.column(0))]
            counts += np.bincount((np.concatenate(held) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(counts))
        slots = np.flatnonzero(counts >= max(FREQUENT, TIMES_MEAN * counts.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32))], names=["slot"])

    bits = np.zeros(1 << (COUNT_BITS - 5), np.uint32)
    slots = docs.select("text").mapInArrow(count, "slot int")
    for r in slots.groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 31)")).alias("bits")).toLocalIterator():
        bits[r["word"]] = r["bits"]
    return bits


def _prefixes(docs: DataFrame) -> DataFrame:
    """(doc_id, name, n, fp, bits, low) of every row: the set's name, size and SimHash, its bitmap and the hashes that may meet others, these
    only in the first of a task's rows with this set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_slots(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(shared.value.view(np.uint8), bitorder="little").astype(bool)
        known: set[int] = set()
        for b in batches:
            names, sizes, fps, bits, low = [], [], [], [], []
            for t in b.column(1):
                s = shingle_set((t.as_py() or "").encode())
                n = len(s)
                names.append(_name(s))
                sizes.append(n)
                fps.append(majority(s))
                bits.append(_bitmap(s))
                late = frequent[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                first = np.concatenate((s[~late], s[late]))[: n - _at_least(n) + 1 + n // 20].view(np.int64)
                low.append(first[: 0 if names[-1] in known else None])
                known.add(names[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bits, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))], names=["doc_id", "name", "n", "fp", "bits", "low"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, name long, n long, fp long, bits array<long>, low array<long>")


def _meetings(rows: DataFrame) -> DataFrame:
    """(name, n, h): the hashes under which a text meets every text that is similar to it."""
    rows = rows.select("name", "n", F.explode("low").alias("h")).repartition("h").dropDuplicates(["h", "name"])
    rows = rows.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("df > 1")
    whole = Window.partitionBy("name")
    rows = rows.withColumn("c", F.count(F.lit(1)).over(whole)).withColumn("r", F.row_number().over(whole.orderBy("df", "h")))
    # a similar text shares K hashes at least: so many that the fewest hashes it may have give it in _prefixes
    return rows.where("r <= c - floor(ceil(4 * n / 5) / 20)").select("name", "n", "h")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of names whose sets are similar."""
    a, b = (nodes.select(F.col("name").alias(k), F.col("n").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits")) for k in "ab")
    apart = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = checkpoint(pairs.distinct().join(a, "a").join(b, "b").where(9 * apart <= F.col("a_n") + F.col("b_n")).select("a", "b"))
    need = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct().join(nodes.select("name", "doc_id"), "name")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int")
    asked = np.zeros(SLOTS, bool)
    for r in need.select(slot.alias("slot")).distinct().toLocalIterator():
        asked[r["slot"]] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(asked))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            hit = batch.filter(pa.array((asked[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            sets = [shingle_set((t.as_py() or "").encode()) for t in hit.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_name, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["name", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            yes = [similar(np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)) for s, t in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    sets = docs.select(slot.alias("slot"), "text").mapInArrow(read, "name long, hashes binary").join(need.select("name"), "name", "left_semi")
    sets = checkpoint(sets)
    met = pairs.join(sets.select(F.col("name").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("name").alias("b"), F.col("hashes").alias("y")), "b")
    return checkpoint(met.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct())


def _neighbours(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts under one hash: each text and the FOLLOWING next ones in an order that is the same under all hashes, so that
    pairs recur. If a hash has no more than FOLLOWING + 1 texts that is all pairs."""
    order = Window.partitionBy("h").orderBy(F.xxhash64("name"), "name")
    me = F.struct("name", "n")
    met = met.select(F.array(*[F.lag(me, k).over(order) for k in range(1, FOLLOWING + 1)]).alias("others"), me.alias("me"))
    like = lambda x: x.isNotNull() & (5 * x["n"] >= 4 * F.col("me.n")) & (5 * F.col("me.n") >= 4 * x["n"])
    pairs = met.select("me", F.explode(F.filter("others", like)).alias("other"))
    return pairs.select(F.least("me.name", "other.name").alias("a"), F.greatest("me.name", "other.name").alias("b"))


def _hold(table: pa.Table) -> pa.Table:
    """Pairs of two blocks of texts under a hash whose bitmaps allow similarity, if they aren't joined."""
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    name, n, root, block = (table.column(c).to_numpy() for c in ("name", "n", "root", "block"))
    bits = np.asarray(table.column("bits").combine_chunks().flatten()).view(np.uint64).reshape(-1, LONGS)
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    found, step = [np.zeros((0, 2), np.int64)], max(1, (1 << 16) // max(1, len(right)))
    for k in range(0, len(left), step):
        x, y = left[k : k + step, None], right[None, :]
        near = (root[x] != root[y]) & (5 * n[x] >= 4 * n[y]) & (5 * n[y] >= 4 * n[x]) & ((x < y) | (lo != hi))
        x, y = (z[near] for z in np.broadcast_arrays(x, y))
        apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
        ok = 9 * apart <= n[x] + n[y]
        found.append(np.stack((name[x[ok]], name[y[ok]]), axis=1))
    a, b = np.sort(np.concatenate(found), axis=1).T
    return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])


def _across(met: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs (a, b) of texts under one hash that aren't joined and whose bitmaps allow similarity. Texts under a hash that has many are
    held against each other in blocks of some BLOCK texts, two at a time, so that no task holds all of them."""
    met = met.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    key = Window.partitionBy("h")
    met = met.withColumns({"least": F.min("root").over(key), "most": F.max("root").over(key), "k": F.count(F.lit(1)).over(key)})
    met = met.where(F.col("k") > FOLLOWING + 1).where("least < most")
    blocks = F.ceil(F.col("k") / BLOCK).cast("long")
    met = met.withColumn("block", F.pmod(F.xxhash64("name"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = met.select("name", "n", "h", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    met = met.join(nodes.select("name", "bits"), "name")
    return met.groupBy("h", "lo", "hi").applyInArrow(_hold, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` (doc_id, text) that has a doc_id.

    Texts are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or more (case of ASCII letters and white
    space aside); texts without words are alike. A component is named by its smallest doc_id. Repeated rows stay. No rows give no rows.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    rows = checkpoint(_prefixes(docs))
    nodes = checkpoint(rows.groupBy("name").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "fp", "bits")]))
    met = checkpoint(_meetings(rows))
    heads = checkpoint(nodes.groupBy("fp").agg(F.min("name").alias("head")))
    near = links(heads.select("fp")).join(heads.select(F.col("fp").alias("x"), F.col("head").alias("a")), "x").join(heads.select(F.col("fp").alias("y"), F.col("head").alias("b")), "y")
    same = nodes.select("fp", F.col("name").alias("a")).join(heads.withColumnRenamed("head", "b"), "fp").where("a <> b")
    pairs = near.select("a", "b").union(same.select("a", "b")).union(_neighbours(met))
    roots = components(_verified(docs, nodes, pairs))
    found = _verified(docs, nodes, _across(met, roots, nodes))
    # what is known is stars; the new links join some of them
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))
    roots = roots.withColumnRenamed("node", "name")
    named = nodes.select("name", "doc_id").join(roots, "name", "left").select("name", "doc_id", F.coalesce("root", "name").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.select("doc_id", "name").join(named.select("name", "root").join(least, "root"), "name").select("doc_id", "component_id")
