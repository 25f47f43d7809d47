"""SimHash near-dedup with meet-in-the-middle ball hashing.

Two fingerprints within 2r bits share a point within r bits of both. Every distinct fingerprint emits its ball of radius r (65
variants for r = 1); equal variants meet in one shuffle. The members of a meeting point differ by 2r bits at most, and there are
no more of them than the ball has points, so chaining neighbours in sorted order links a whole meeting point with one edge
per member, and a meeting point never grows with the data. Chained pairs are verified by their distance.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelog.llm.common import checkpoint
from framelog.llm.components import components

#: Bytes of a text whose words are listed at a time.
PIECE = 1 << 20
BITS = 64
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Words of lower-cased data, in lists of bounded size. bytes.lower and bytes.split know ASCII only, as is asked for."""
    at = 0
    while at < len(data):
        end = _BLANK.search(data, at + PIECE) if at + PIECE < len(data) else None
        stop = end.start() if end else len(data)
        yield data[at:stop].lower().split()
        at = stop


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """Unsigned SimHash of UTF-8 text: a bit is set when more than half of the XXH64s (seed 42) of its shingles have it."""
    ones, total, carry = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in _pieces(data):
        words = carry + words
        if len(words) >= shingle:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            joined = b" ".join(words)
            hashes = [digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
            total += len(hashes)
            h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
            for i in range(0, len(h), 1 << 14):
                ones += np.unpackbits(h[i : i + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        carry = words[-(shingle - 1) :] if shingle > 1 else []
    if not total:
        return digest(b" ".join(carry), 42) if carry else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """Unsigned fingerprint of hashes: the bits that more than half of them have."""
    h, ones = hashes.view(np.uint8).reshape(-1, 8), np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row; null and empty texts and texts without words have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint((t.as_py() or "").encode(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def ball(radius: int) -> list[int]:
    """Masks of up to ``radius`` bits as signed longs, 0 first."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(BITS), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(distinct: DataFrame, *, distance: int = 2) -> DataFrame:
    """Edges (x, y) between fingerprints of ``distinct`` (fp), enough of those within ``distance`` bits to connect all of them."""
    masks = F.array(*[F.lit(m) for m in ball((distance + 1) // 2)])
    near = distinct.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = near.select("fp", before.alias("other")).where("other is not null").distinct()
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance).select(F.col("fp").alias("x"), F.col("other").alias("y"))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of ``docs`` (doc_id, text).

    Texts are linked when their fingerprints differ in ``distance`` bits or fewer (an even number); a component is named by its smallest doc_id.
    Texts without words have fingerprint 0 and are linked like any other. Rows with a null doc_id get the component of their
    fingerprint, null if no row with an id is in it. Repeated rows stay. An empty table gives no rows. Other columns are ignored.
    """
    if distance % 2:
        raise ValueError("distance must be even: with an odd one the members of a meeting point may be farther apart")
    fps = checkpoint(fingerprints(docs, shingle=shingle))
    # copies meet here by partial aggregation, so later steps see each fingerprint once
    nodes = checkpoint(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")))
    edges = links(nodes.select("fp"), distance=distance)
    edges = edges.join(nodes.select(F.col("fp").alias("x"), F.col("node").alias("a")), "x").join(nodes.select(F.col("fp").alias("y"), F.col("node").alias("b")), "y")
    roots = components(edges.select("a", "b"))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` (doc_id, text) that has a doc_id: components of five-word similarity 0.8 or more.

    Fingerprints at 2 bits link copies with few edits only, so links are verified by their words, and what the balls leave apart is held
    against each other further (``near_sets``).
    """
    from framelog.llm import near_sets  # it builds on this module

    return near_sets.near_duplicates(docs)


def hex16(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
