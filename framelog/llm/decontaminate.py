"""Benchmark decontamination with spaced seeds.

A spaced seed hashes the tokens of a window at the positions of a fixed mask and ignores the others, so a passage with a few
substituted words still shares seeds with its source. Seeds of the benchmark meet seeds of the documents; around each hit the two token
sequences are laid over each other, and the best run of matching tokens, which may contain substitutions, decides.

The benchmark is the query set. One of a proven size is a single block, whose seeds are sent to the tasks and joined there, in one narrow
pass without a shuffle. Seeds of a larger one are joined in a shuffle with those of the documents that pass a bitmap of fixed size; only
documents with a common seed meet the benchmark's blocks that they share it with. The benchmark is never gathered on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framelog.llm.common import checkpoint

#: Masks: 1 is compared, 0 is ignored. Those of weight 7 hit a passage of 13 tokens with a substitution anywhere; the last one hits every
#: run of 13 matches or more with four to a substitution, as some four of its tokens in a row match.
MASKS = ("1111111", "110110111", "1101010111", "111001001011", "1111")
#: Bytes of a benchmark block; what is broadcast is some ten bytes for each.
BLOCK_BYTES = 3 << 20
#: Bits of the filter that documents' seeds pass before they are joined, and shares of the documents that meet a block.
FILTER_BITS, SALTS = 25, 16
#: Pairs of tokens compared at a time.
PAIRS = 1 << 22
#: Tokens of documents seeded at once.
PIECE = 1 << 18
#: A substituted token costs as much as so many matching ones earn.
PENALTY = 4
#: Tokens of an item at least.
SHORTEST = 7
_TOKEN = re.compile(r"\w+")
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _TOKEN.findall(text.lower()) if text else []


def _stream(text: str | None) -> Iterator[list[str]]:
    """The tokens in lists of bounded size."""
    if not text or len(text) <= 1 << 20:
        yield tokens(text)
        return
    some: list[str] = []
    for m in _TOKEN.finditer(text):
        some.append(m.group().lower())
        if len(some) == 1 << 16:
            yield some
            some = []
    yield some


def _value(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 5) | 1


def seeds(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the window at each position under mask k, from the values of the tokens; masks differ by their number."""
    mask = MASKS[k]
    n = len(values) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, _FACTORS[63 - k])
    for i, c in enumerate(mask):
        if c == "1":
            h += values[i : i + n] * _FACTORS[i]
    h ^= h >> np.uint64(31)
    return h * _FACTORS[32]


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... (n[0] of them), lo[1], ..."""
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def _shares(n: np.ndarray) -> Iterator[slice]:
    """Consecutive parts of some PAIRS in sum."""
    total, at = np.cumsum(n), 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        yield slice(at, stop)
        at = stop


class Block:
    """Seeds of some benchmark items; equal items are one, with several ids."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        equal: dict[tuple[str, ...], list[int]] = {}
        for i, words in items:
            equal.setdefault(tuple(words), []).append(i)
        equal = {words: ids for words, ids in equal.items() if len(words) >= SHORTEST}
        self.ids = list(equal.values())
        self.vocabulary: dict[str, int] = {}
        for words in equal:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.items = [np.array([self.vocabulary[w] for w in words], np.int32) for words in equal]
        self.flat = np.concatenate([np.zeros(0, np.int32), *self.items])
        self.size = np.array(list(map(len, self.items)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        # tokens that no item has are 0
        self.value = np.array([0, *map(_value, self.vocabulary)], np.uint64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int32),) * 2)]
        for n, item in enumerate(self.items):
            for k in range(len(MASKS)):
                h = seeds(self.value[item], k)
                found.append((h, np.full(len(h), n, np.int32), np.arange(len(h), dtype=np.int32)))
        self.hash, self.item, self.at = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.at = self.hash[order], self.item[order], self.at[order]
        self.shift = np.uint64(64 - max(10, min(24, 5 + int(len(self.hash)).bit_length())))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self.hash >> self.shift] = True

    def alignments(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct rows (number of the text, item, place of the item's start in ids) of the shared seeds."""
        out, value = [np.zeros(0, np.int64)], self.value[ids]
        most, n_items = int(self.size.max()), len(self.items)
        wide = len(ids) + most  # a row as one number: texts of a batch, items of a block and tokens at once are bounded
        for k in range(len(MASKS)):
            h = seeds(value, k)
            at = np.flatnonzero(self.maybe[h >> self.shift])
            lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            for part in _shares(n):
                to = _spread(lo[part], n[part])
                p = np.repeat(at[part], n[part])
                out.append(np.unique((np.searchsorted(ends, p, "right") * n_items + self.item[to]) * wide + (p - self.at[to] + most)))
        rows = np.unique(np.concatenate(out))
        return np.stack((rows // wide // n_items, rows // wide % n_items, rows % wide - most), axis=1)

    def overlaps(self, texts: list[np.ndarray], least: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(number of the text, item, matches, length, start in the text, start in the item) of the best verified overlap of each pair.

        The texts are seeded together, kept apart by tokens that match nothing."""
        gap = np.zeros(max(map(len, MASKS)), np.int32)
        ends = np.cumsum([len(x) + len(gap) for x in texts])
        ids = np.concatenate([y for x in texts for y in (x, gap)])
        laid = self.alignments(ids, ends)
        length = np.array(list(map(len, texts)), np.int64)
        begin = ends - length - len(gap)
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        j, n, shift = laid[:, 0], laid[:, 1], laid[:, 2] - begin[laid[:, 0]]
        a, b = np.maximum(0, -shift), np.minimum(self.size[n], length[j] - shift)
        enough = np.minimum(least, self.size[n])
        for part in _shares(b - a):
            m = (b - a)[part]
            same = ids[_spread((begin[j] + shift + a)[part], m)] == self.flat[_spread((self.start[n] + a)[part], m)]
            cuts = np.cumsum(m) - m
            count = np.add.reduceat(same, cuts, dtype=np.int64) if len(m) else m
            good = np.flatnonzero(count >= enough[part])
            for r in good[np.lexsort(((a + shift)[part][good], -count[good]))].tolist():
                i = part.start + r
                pair, need, c = (int(j[i]), int(n[i])), int(enough[i]), int(count[r])
                known = best.get(pair)
                if known and (known[0], known[1]) < (-c, int(a[i] + shift[i])):
                    continue  # no run of this alignment can be better
                if c == m[r]:
                    matches, start, stop = c, 0, c
                else:
                    run = same[cuts[r] : cuts[r] + m[r]]
                    matches, start, stop = best_run(run)
                    if matches < need:
                        matches, start, stop = longest_run(run)
                if matches >= need:
                    o = (-matches, int(a[i] + shift[i]) + start, int(a[i]) + start, stop - start)
                    best[pair] = min(known, o) if known else o
        for (j_, n_), o in best.items():
            yield j_, n_, -o[0], o[3], o[1], o[2]


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """(matches, start, stop) of the run with the greatest matches - PENALTY * substitutions; the longest of equals, then the last."""
    score = np.concatenate(([0], np.cumsum(np.where(same, 1, -PENALTY))))
    low = np.minimum.accumulate(score)
    gain = score - low
    ends = np.flatnonzero(gain == gain.max())
    starts = np.searchsorted(-low, -low[ends])
    k = len(ends) - 1 - int(np.argmax((ends - starts)[::-1]))
    start, stop = int(starts[k]), int(ends[k])
    return int(same[start:stop].sum()), start, stop


def longest_run(same: np.ndarray) -> tuple[int, int, int]:
    """(matches, start, stop) of the run with the most matches that has PENALTY of them to a substitution at least; the first of equals."""
    score = np.concatenate(([0], np.cumsum(np.where(same, 1, -PENALTY))))
    hits = np.concatenate(([0], np.cumsum(same)))
    # each stop goes with the first start that has no greater score
    starts = np.searchsorted(-np.minimum.accumulate(score), -score)
    matches = hits - hits[starts]
    stop = int(np.argmax(matches))
    start = int(starts[stop])
    start += int(np.argmax(same[start:stop])) if stop > start else 0
    return int(matches[stop]), start, stop


def _best(block: Block, texts: Iterator[str | None], least: int) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, matches, length, start in the text, start in the item): the best overlap of each row and item, in order."""
    if not block.items:
        return []
    get, longest = block.vocabulary.get, int(block.size.max())
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    held: list[tuple[int, int, np.ndarray]] = []

    def settle() -> None:
        if held:
            for j, n, matches, length, at, item_at in block.overlaps([x for _, _, x in held], least):
                row, base, _ = held[j]
                o = (-matches, base + at, item_at, length)
                best[row, n] = min(best.get((row, n), o), o)
            held.clear()

    size = 0
    for row, text in enumerate(texts):
        base, tail = 0, np.zeros(0, np.int32)
        for words in _stream(text):
            x = np.concatenate((tail, np.array(list(map(get, words, repeat(0))), np.int32)))
            held.append((row, base - len(tail), x))
            base, tail, size = base + len(words), x[-2 * longest :], size + len(x)
        if size >= PIECE:
            settle()
            size = 0
    settle()
    return [(row, n, -o[0], o[3], o[1], o[2]) for (row, n), o in sorted(best.items())]


def _overlaps_in(block: Block, batch: pa.RecordBatch, item_type: pa.DataType, least: int) -> pa.RecordBatch:
    """Rows of ``contaminated`` for a batch whose first columns are an id and a text."""
    row, n, *numbers = zip(*found) if (found := _best(block, (t.as_py() for t in batch.column(1)), least)) else ((),) * 6
    copies = np.array([len(block.ids[k]) for k in n], np.int64)
    at = np.repeat(np.arange(len(n)), copies)
    ids = [batch.column(0).take(pa.array(np.array(row, np.int64)[at])), pa.array([i for k in n for i in block.ids[k]], item_type)]
    numbers = [pa.array(np.array(x, np.int64)[at]).cast(k) for x, k in zip(numbers, (pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)]
    return pa.RecordBatch.from_arrays(ids + numbers, names=["doc_id", "item_id", "matches", "length", "doc_start", "item_start"])


def single_block(benchmark: DataFrame) -> Block | None:
    """The benchmark as one block, or None if it is too large to be sent to all tasks."""
    size, n = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    if size + 8 * n > BLOCK_BYTES:
        return None
    return Block([(r["item_id"], tokens(r["text"])) for r in benchmark.select("item_id", "text").toLocalIterator()])


def short_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_tokens) of the items that are too short to be looked for."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(tokens(t.as_py())) for t in b.column(1)], pa.int64())], names=["item_id", "n_tokens"])

    return benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, n_tokens long").where(F.col("n_tokens") < SHORTEST)


def _by_join(docs: DataFrame, benchmark: DataFrame, least: int) -> DataFrame:
    """``contaminated`` for a benchmark of any size. Texts go by a digest, so that null and repeated ids are rows like any other."""
    spark = docs.sparkSession
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0]
    n_blocks = size // BLOCK_BYTES + 1
    items = benchmark.select("item_id", "text", F.pmod(F.xxhash64("text"), F.lit(n_blocks)).alias("block"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)

    def of(words: list[str]) -> np.ndarray:
        values = np.array(list(map(_value, words)), np.uint64)
        return np.unique(np.concatenate([seeds(values, k) for k in range(len(MASKS))]))

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [of(w) if len(w := tokens(t.as_py())) >= SHORTEST else np.zeros(0, np.uint64) for t in b.column(1)]
            block = np.repeat(b.column(0).to_numpy(zero_copy_only=False), list(map(len, found))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["block", "seed"])

    known = checkpoint(items.where("text is not null").select("block", "text").mapInArrow(item_seeds, "block long, seed long").distinct())
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    slot = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    words = known.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))
    for r in words.toLocalIterator():  # of fixed size, whatever the benchmark
        bits[r["word"]] = r["bits"]
    shared = spark.sparkContext.broadcast(bits)

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, longest = shared.value, max(map(len, MASKS))
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                tail: list[str] = []
                for some in _stream(text.as_py()):
                    h = of(tail + some)
                    at = h >> np.uint64(64 - FILTER_BITS)
                    h = h[(bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)]
                    tail = some[-longest:]
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(h), pa.string()), pa.array(h.view(np.int64))], names=["digest", "seed"])

    texts = docs.select(digest.alias("digest"), "text")
    # test and training hashes meet; a text goes to each block that it shares one with
    met = texts.mapInArrow(doc_seeds, "digest string, seed long").join(known, "seed").select("digest", "block").distinct()
    held = checkpoint(met).join(texts.dropDuplicates(["digest"]), "digest")
    held = held.select("digest", "text", "block", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).alias("salt"))
    asked = items.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block([(i, tokens(t)) for i, t in zip(right.column("item_id").to_pylist(), right.column("text").to_pylist(), strict=True)])
        batches = [_overlaps_in(block, b, item_type, least) for b in left.select(["digest", "text"]).to_batches()]
        nothing = pa.record_batch([pa.array([], pa.string())] * 2, names=["digest", "text"])
        return pa.Table.from_batches(batches or [_overlaps_in(block, nothing, item_type, least)])

    schema = f"doc_id string, item_id {item_kind}, matches int, length int, doc_start long, item_start int"
    found = held.groupBy("block", "salt").cogroup(asked.groupBy("block", "salt")).applyInArrow(verify, schema)
    found = checkpoint(found.withColumnRenamed("doc_id", "digest"))
    return docs.select("doc_id", digest.alias("digest")).join(found, "digest").drop("digest")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, least: int = 13) -> DataFrame:
    """(doc_id, item_id, matches, length, doc_start, item_start), in tokens: a row for each document and benchmark item that overlap.

    An overlap is a run of aligned tokens with at least ``least`` matches (all of the item's tokens if it has fewer, 7 at least) and at
    least four matches to a substitution. Of an alignment the run with the greatest matches - 4 * substitutions is given or, if that
    has too few matches, the longest overlap; of a pair the alignment with most matches, then first in the document, then in the item. Null or
    empty texts and items of fewer than 7 tokens (``short_items`` lists them) overlap nothing. A null doc_id or item_id is carried as it is;
    repeated rows give repeated results; equal items each give a row; an empty table on either side gives no rows.
    """
    block = single_block(benchmark)
    if block is None:
        return _by_join(docs, benchmark, least)
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _overlaps_in(shared.value, batch, item_type, least)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, matches int, length int, doc_start long, item_start int")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, least: int = 13) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text overlaps no item of ``benchmark`` as ``contaminated`` has it."""
    block = single_block(benchmark)
    if block is None:
        digest = F.sha2(F.coalesce("text", F.lit("")), 256)
        bad = _by_join(docs.select(digest.alias("doc_id"), "text"), benchmark, least).select(F.col("doc_id").alias("__digest")).distinct()
        return docs.join(bad, digest == F.col("__digest"), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = {row for row, *_ in _best(shared.value, (t.as_py() for t in batch.column("text")), least)}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
