"""Substring dedup over a corpus: bytes of strings that an earlier document has, too, go.

Every string of ``LENGTH`` bytes that two documents share is a pair of equal suffixes (over that length). Sorting all suffixes of a corpus
in one place isn't possible, so they are dealt out first, in a way that brings equal ones together:

1. Each window of ``LENGTH`` bytes belongs to the K-gram of least rank in it (the first of equals). Neighbouring windows mostly share
   theirs, so a text falls into strings of some 65 bytes, each a run of windows of one K-gram, and each window lies in one string.
   A K-gram's rank is a hash, frequent K-grams after all others: they get only the windows that hold no other K-gram. So the ends of a
   passage that very many documents share, each with a text of its own before it, go by the K-grams of those texts.
2. Only strings whose K-gram several documents have can share a window: hashes of the K-grams are counted first, and each bucket
   of documents learns which of its own are repeated. Strings of these travel, compressed, to the bucket of their K-gram. Equal
   strings of a bucket of documents travel once; those of frequent K-grams meet in shares first.
3. In a bucket the suffixes at the strings' starts are put in order by hash-compared mergesort (``suffix_sort``) and verified by their bytes:
   equal strings are one from then on. Then all windows of the strings left of one K-gram are sorted and verified the same way. Each
   class learns its least document, and windows of later ones go.
4. The documents learn their ranges and drop the bytes covered.

No verdict rests on a hash alone, and nothing depends on the size of the corpus but the number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelog.llm.common import checkpoint
from framelog.llm.suffix_sort import BASE, INVERSE, VALUES, Suffixes, mixed, powers, prefix_hashes

#: Bytes of a repeated string and of a K-gram; K-grams of a window; bytes of a string at most.
LENGTH, K = 50, 16
WINDOWS = LENGTH - K + 1
WIDE = LENGTH + WINDOWS - 1
#: Windows hashed at a time, and bytes of documents whose strings are held at a time.
PIECE, SLICE = 1 << 21, 6 << 20
#: Mean content of a bucket, in bytes: strings; documents.
STRINGS, TEXT = 8 << 20, 6 << 20
#: Bytes of strings that travel for a byte of text, at most some 3.4 when every string is repeated.
GROWTH = 2
#: Slots in which K-grams are counted, and from which count (and how many times the mean) on they are frequent.
SLOT_BITS, FREQUENT, TIMES_MEAN = 22, 8, 4
#: Shares in which equal strings of frequent K-grams meet first.
SHARES = 16
#: Ids of documents with several texts that are sent to all tasks at most.
BROADCAST_IDS = 100_000
#: Kinds of records: strings, ranges of a string that go, strings like another one of their document.
STRING, RANGE, ALIAS = range(3)
_U = np.uint64
_BUCKETS = _U(0x9E6C63D0876A3F6B)


# ---- packing -------------------------------------------------------------------------------------------------------------


def pack(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Columns of integers, byte by byte, so that those that hardly differ compress well."""
    body = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(4, "little") + b"".join(body) + tail)


def unpack(blob: bytes, *kinds: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns and the tail of a packed blob."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(k).ravel())
        at += n * size
    return out, np.frombuffer(data, np.uint8, offset=at)


def split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each key, in order."""
    if len(key):
        order = np.argsort(key, kind="stable")
        key = key[order]
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        yield from zip(key[np.concatenate(([0], cuts))].tolist(), np.split(order, cuts), strict=True)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    key, kind, blob = zip(*rows) if rows else ((),) * 3
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["key", "kind", "blob"])


def bucket_of(gram: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a K-gram, by another hash than the one that ranks it: least hashes crowd at zero."""
    return (mixed(gram ^ _BUCKETS) % _U(n)).astype(np.int64)


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a document, as ``doc_bucket_column`` has it."""
    u = doc.view(_U)
    return ((u ^ (u >> _U(17)) ^ (u >> _U(31))) % _U(1 << 62) % _U(n)).astype(np.int64)


def doc_bucket_column(doc: Column, n: int) -> Column:
    h = doc.bitwiseXOR(F.shiftrightunsigned(doc, 17)).bitwiseXOR(F.shiftrightunsigned(doc, 31))
    return F.pmod(h.bitwiseAND(F.lit((1 << 62) - 1)), F.lit(n))


# ---- step 1: strings -----------------------------------------------------------------------------------------------------


class Strings:
    """Strings of documents: document, version, place, place of the K-gram in the string, length, and the bytes, a row each."""

    def __init__(self, doc: np.ndarray, ver: np.ndarray, pos: np.ndarray, off: np.ndarray, size: np.ndarray, rows: np.ndarray):
        self.doc, self.ver, self.pos, self.off, self.size, self.rows = doc, ver, pos, off, size, rows

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, at: np.ndarray) -> Strings:
        return Strings(self.doc[at], self.ver[at], self.pos[at], self.off[at], self.size[at], self.rows[at])

    @staticmethod
    def join(parts: list[Strings]) -> Strings:
        columns = zip(*((p.doc, p.ver, p.pos, p.off, p.size, p.rows) for p in parts))
        return Strings(*(np.concatenate(c) for c in columns))

    def packed(self) -> bytes:
        text = self.rows[np.arange(WIDE) < self.size[:, None]].tobytes()
        return pack(np.diff(self.doc, prepend=0), self.ver, self.pos, self.off, self.size, tail=text)

    @staticmethod
    def unpacked(blob: bytes) -> Strings:
        (step, ver, pos, off, size), text = unpack(blob, "i8", "i8", "u4", "u1", "u1")
        rows = np.zeros((len(step), WIDE), np.uint8)
        rows[np.arange(WIDE) < size[:, None]] = text
        return Strings(np.cumsum(step), ver, pos, off, size, rows)

    def grams(self) -> np.ndarray:
        """Hash of each string's K-gram, as ``gram_hashes`` has it."""
        weights, out = powers(BASE, K), np.zeros(len(self), _U)
        flat, at = self.rows.ravel(), np.arange(len(self)) * WIDE + self.off
        for i in range(K):
            out += VALUES[flat[at + i]] * weights[i]
        return mixed(out)


def gram_hashes(data: np.ndarray, prefix: np.ndarray, undo: np.ndarray) -> np.ndarray:
    n = len(data) - K + 1
    return mixed((prefix[K : K + n] - prefix[:n]) * undo[:n])


def cut(data: np.ndarray, offsets: np.ndarray, a: int, b: int, frequent: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(start, stop, place of the K-gram, its hash, digest) of the strings whose windows start in [a, b) of the texts
    data[offsets[i]:offsets[i + 1]]."""
    part = data[a : b + LENGTH - 1]
    prefix, undo = prefix_hashes(part), powers(INVERSE, len(part) + 1)
    gram = gram_hashes(part, prefix, undo)
    least = gram >> _U(1)
    if frequent is not None:
        least |= frequent[(gram >> _U(64 - SLOT_BITS)).astype(np.int64)].astype(_U) << _U(63)
    at, span = np.arange(len(gram), dtype=np.int32), 1
    while span < WINDOWS:  # the first of the least among ever more K-grams
        step = min(span, WINDOWS - span)
        later = least[step:] < least[: len(least) - step]
        at, least, span = np.where(later, at[step:], at[:-step]), np.minimum(least[step:], least[:-step]), span + step
    window = np.arange(b - a)
    end = offsets[np.searchsorted(offsets, window + a, "right")] if len(offsets) > 2 else offsets[-1]
    whole = window + a + LENGTH <= end
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])))
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(at)) - 1 + LENGTH
    keep = whole[start]
    start, stop = start[keep], stop[keep]
    place = at[start].astype(np.int64)
    digest = mixed((prefix[stop] - prefix[start]) * undo[start]) + mixed((place - start).astype(_U) * _U(256) + (stop - start).astype(_U))
    return start + a, stop + a, place + a, gram[place], digest


def _repeated(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by h, and which places of that order have an equal neighbour."""
    order = np.argsort(h)
    s = h[order]
    twice = np.zeros(len(h), bool)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= twice[1:]
    return order, twice


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _records(kind: int, n_docs: int, doc: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Records by bucket of the document, with negative keys, beside those of the strings."""
    out = []
    for k, i in split(doc_bucket(doc, n_docs)):
        i = i[np.argsort(doc[i], kind="stable")]
        out.append((-1 - k, kind, pack(np.diff(doc[i], prepend=0), *(c[i] for c in columns))))
    return out


def merge(s: Strings, digest: np.ndarray, n_docs: int) -> tuple[np.ndarray, list[tuple[int, int, bytes]]]:
    """The places of the strings that stay of equal ones - the least document's first - and what becomes of the others.

    Strings whose digest occurs once can't be equal to another and are left out of the sort.
    """
    order, twice = _repeated(digest)
    at = order[twice]
    if not len(at):
        return np.arange(len(s)), []
    rows = s.rows[at]
    segment = np.cumsum(_firsts(digest[at]))
    found = Suffixes(rows, prefix_hashes(rows), np.arange(len(at)), np.zeros(len(at), np.int64), WIDE).classes(segment)
    order_ = np.lexsort((s.pos[at], s.ver[at], s.doc[at], s.size[at], s.off[at], found))
    at, found = at[order_], found[order_]
    first = _firsts(found, s.off[at], s.size[at])  # equal bytes with the K-gram at another place are another string
    leader = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
    later = s.doc[at] > s.doc[leader]
    like = ~later & ~first
    gone, twin, own = at[later], at[like], leader[like]
    zero = np.zeros(len(gone), np.uint8)
    rows_out = _records(RANGE, n_docs, s.doc[gone], s.ver[gone], s.pos[gone], zero, s.size[gone])
    rows_out += _records(ALIAS, n_docs, s.doc[twin], s.ver[twin], s.pos[twin], s.ver[own], s.pos[own])
    return np.sort(np.concatenate((order[~twice], at[first]))), rows_out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, versions, data, offsets) of rows (doc_id, ver, data) with an id and long enough, of some SLICE bytes."""
    for batch in batches:
        batch = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.greater_equal(pc.binary_length(batch.column(2)), LENGTH)))
        texts = batch.column(2).cast(pa.binary())  # a session may send large types
        ids, versions = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
            yield ids[at:stop], versions[at:stop], whole[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at]
            at = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bytes, slots) of a task: the bytes of its texts and the slots of the K-grams that are frequent in them."""
    counts, total = np.zeros(1 << SLOT_BITS, np.int64), 0
    for _, _, data, _ in _slices(batches):
        total += len(data)
        for a in range(0, max(0, len(data) - K + 1), PIECE):
            part = data[a : a + PIECE + K - 1]
            gram = gram_hashes(part, prefix_hashes(part), powers(INVERSE, len(part) + 1))
            counts += np.bincount((gram >> _U(64 - SLOT_BITS)).astype(np.int64), minlength=len(counts))
    slots = np.flatnonzero(counts >= max(FREQUENT, TIMES_MEAN * total / len(counts)))
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([slots.astype(np.int32)], pa.list_(pa.int32()))], names=["n_bytes", "slots"])


def _cuts(texts: pa.Table, frequent: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, versions, data, offsets, start, stop, place of the K-gram, its hash, digest), the last five of strings, of documents of a
    bucket; a text longer than SLICE comes in several parts."""
    for ids, versions, data, offsets in _slices(iter(texts.select(["doc_id", "ver", "data"]).to_batches())):
        n = len(data) - LENGTH + 1
        for flush in range(0, n, SLICE):
            parts = [cut(data, offsets, a, min(a + PIECE, flush + SLICE, n), frequent) for a in range(flush, min(flush + SLICE, n), PIECE)]
            yield ids, versions, data, offsets, *map(np.concatenate, zip(*parts, strict=True))


def _numbers(gram: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of a K-gram and 32 more bits of its hash, in one number. K-grams that fall together only cost the travel of a string."""
    h = mixed(gram ^ _BUCKETS)
    return ((h % _U(n_buckets)) << _U(32) | (h // _U(n_buckets)) & _U(0xFFFFFFFF)).astype(np.int64)


def _tell(texts: pa.Table, n_buckets: int, frequent: np.ndarray | None) -> pa.Table:
    """The distinct K-grams of a bucket of documents, by their buckets."""
    out = []
    grams = [c[7] for c in _cuts(texts, frequent)]
    if grams:
        number = np.unique(np.concatenate([np.unique(_numbers(g, n_buckets)) for g in grams]))
        for k, i in split(number >> 32):
            out.append((k, texts.column("key")[0].as_py(), pack(np.diff(number[i] & 0xFFFFFFFF, prepend=0).astype(np.uint32))))
    key, source, blob = zip(*out) if out else ((),) * 3
    return pa.table([pa.array(key, pa.int64()), pa.array(source, pa.int64()), pa.array(blob, pa.binary())], names=["key", "source", "blob"])


def _answer(told: pa.Table) -> pa.Table:
    """For each bucket of documents, bits that say which of its K-grams of this bucket other buckets of documents have, too."""
    values = [np.cumsum(unpack(b, "u4")[0][0], dtype=np.uint32) for b in told.column("blob").to_pylist()]
    order, twice = _repeated(np.concatenate(values))
    again = np.zeros(len(order), bool)
    again[order] = twice
    bits = [np.packbits(x).tobytes() if x.any() else None for x in np.split(again, np.cumsum([len(v) for v in values])[:-1])]
    answer = pa.table([told.column("source"), told.column("key"), pa.array(bits, pa.binary())], names=["key", "source", "blob"])
    return answer.filter(pc.is_valid(answer.column("blob")))


def _send(texts: pa.Table, answers: pa.Table, n_buckets: int, n_docs: int, frequent: np.ndarray | None) -> pa.Table:
    """The strings of a bucket of documents whose K-gram several documents have, by bucket of the K-gram, equal ones once; what becomes of the
    others by bucket of the document (negative keys). Strings of frequent K-grams go to shares of their bucket (keys from n_buckets on)."""
    cuts = list(_cuts(texts, frequent)) if texts.num_rows else []
    if not cuts:
        return pa.Table.from_batches([_batch([])])
    share = texts.column("key")[0].as_py() % SHARES
    numbers = [_numbers(c[7], n_buckets) for c in cuts]
    distinct = np.unique(np.concatenate([np.unique(x) for x in numbers]))
    wanted = np.zeros(len(distinct), bool)
    cuts_of = np.searchsorted(distinct >> 32, np.arange(n_buckets + 1))
    for k, blob in zip(answers.column("source").to_pylist(), answers.column("blob").to_pylist(), strict=True) if answers.num_rows else ():
        lo, hi = cuts_of[k], cuts_of[k + 1]
        wanted[lo:hi] = np.unpackbits(np.frombuffer(blob, np.uint8), count=hi - lo)
    # or several documents of this bucket
    least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    places = [np.searchsorted(distinct, x) for x in numbers]
    documents = [c[0][np.searchsorted(c[3], c[4], "right") - 1] for c in cuts]
    for at, d in zip(places, documents, strict=True):
        np.minimum.at(least, at, d)
        np.maximum.at(most, at, d)
    wanted |= least < most
    out: list[tuple[int, int, bytes]] = []
    for (ids, versions, data, offsets, start, stop, place, gram, digest), at in zip(cuts, places, strict=True):
        mine = np.flatnonzero(wanted[at])
        start, stop, place, gram, digest = start[mine], stop[mine], place[mine], gram[mine], digest[mine]
        row = np.searchsorted(offsets, start, "right") - 1
        padded = np.concatenate((data, np.zeros(WIDE, np.uint8)))
        bytes_ = padded[start[:, None] + np.arange(WIDE)]
        bytes_[np.arange(WIDE) >= (stop - start)[:, None]] = 0
        s = Strings(ids[row], versions[row], (start - offsets[row]).astype(np.uint32), (place - start).astype(np.uint8), (stop - start).astype(np.uint8), bytes_)
        keep, gone = merge(s, digest, n_docs)
        gram = gram[keep]
        key = bucket_of(gram, n_buckets)
        if frequent is not None:
            key = np.where(frequent[(gram >> _U(64 - SLOT_BITS)).astype(np.int64)], n_buckets + key * SHARES + share, key)
        out += gone
        out += [(k, STRING, s.take(keep[i]).packed()) for k, i in split(key)]
    return pa.Table.from_batches([_batch(out)])


# ---- steps 2 and 3: suffixes in buckets ------------------------------------------------------------------------------------


def _content(table: pa.Table) -> Strings:
    return Strings.join([Strings.unpacked(b) for b in table.column("blob").to_pylist()])


def _digest(s: Strings, gram: np.ndarray) -> np.ndarray:
    """Digest of a string, its length and the place of its K-gram."""
    weights, out = powers(BASE, WIDE), np.zeros(len(s), _U)
    for i in range(WIDE):
        out += VALUES[s.rows[:, i]] * weights[i]
    return mixed(out) + mixed(gram + s.off.astype(_U) * _U(256) + s.size)


def _first(table: pa.Table, n_buckets: int, n_docs: int) -> pa.Table:
    """A bucket of strings is settled. Of a share of one, with strings of frequent K-grams, equal strings become one and go on. What is
    settled (negative keys) passes."""
    key = table.column("key")[0].as_py()
    if key < 0:
        return table
    if key < n_buckets:
        return _settle(table, n_docs)
    s = _content(table)
    keep, out = merge(s, _digest(s, s.grams()), n_docs)
    s = s.take(keep[np.argsort(s.doc[keep], kind="stable")])
    return pa.Table.from_batches([_batch([*out, ((key - n_buckets) // SHARES, STRING, s.packed())])])


def _second(table: pa.Table, n_docs: int) -> pa.Table:
    """What the shares of a bucket have left is settled. From here on keys are buckets of documents."""
    if table.column("key")[0].as_py() >= 0:
        table = _settle(table, n_docs)
    return table.set_column(0, "key", pc.subtract(-1, table.column("key")))


def _settle(table: pa.Table, n_docs: int) -> pa.Table:
    """A bucket of strings: the ranges of them that an earlier document has, and strings like another one of their document."""
    s = _content(table)
    gram = s.grams()
    order, twice = _repeated(gram)
    at = np.sort(order[twice])  # a string without another one of its K-gram shares no window
    s, gram = s.take(at), gram[at]
    keep, out = merge(s, _digest(s, gram), n_docs)
    s, gram = s.take(keep), gram[keep]
    order, twice = _repeated(gram)
    at = order[twice]
    if len(at):
        doc = s.doc[at]
        starts = np.flatnonzero(_firsts(gram[at]))
        several = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
        at = at[np.repeat(several, np.diff(np.append(starts, len(at))))]
    if len(at):
        s = s.take(at)
        row, low, high = shared_windows(s, gram[at])
        out += _records(RANGE, n_docs, s.doc[row], s.ver[row], s.pos[row], low.astype(np.uint8), high.astype(np.uint8))
    return pa.Table.from_batches([_batch(out)])


def shared_windows(s: Strings, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, stop) of the ranges of strings that lie in a smaller document's string of the same K-gram.

    Windows whose hash occurs once can't be equal to another and are left out of the sort. Windows of one string overlap, so what
    goes of it is one range.
    """
    prefix, undo = prefix_hashes(s.rows), powers(INVERSE, WIDE + 1)
    column = np.arange(WINDOWS)
    # a window is at the same distance from the K-gram wherever it occurs
    group = mixed(gram[:, None] + mixed((column - s.off[:, None].astype(np.int64) + WIDE).astype(_U)))
    h = mixed((prefix[:, LENGTH : LENGTH + WINDOWS] - prefix[:, :WINDOWS]) * undo[:WINDOWS]) + group
    row, col = np.nonzero(column + LENGTH <= s.size[:, None])
    order, twice = _repeated(h[row, col])
    row, col = row[order[twice]], col[order[twice]]
    order = np.argsort(group[row, col], kind="stable")
    row, col = row[order], col[order]
    segment = np.cumsum(_firsts(group[row, col]))
    found = Suffixes(s.rows, prefix, row, col, LENGTH).classes(segment)
    order = np.lexsort((s.doc[row], found))
    first = _firsts(found[order])
    least = s.doc[row[order[np.flatnonzero(first)[np.cumsum(first) - 1]]]] if len(order) else s.doc[:0]
    gone = order[s.doc[row[order]] > least]
    row, col = row[gone], col[gone]
    order = np.lexsort((col, row))
    row, col = row[order], col[order]
    starts = np.flatnonzero(_firsts(row))
    stops = np.append(starts[1:], len(row)) - 1 if len(starts) else starts
    return row[starts], col[starts], col[stops] + LENGTH


# ---- step 4: what stays --------------------------------------------------------------------------------------------------


def covered(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.subtract.at(edge, stop, 1)
    return np.cumsum(edge[:n]) > 0


def _of_kind(table: pa.Table, kind: int, *kinds: str) -> list[np.ndarray]:
    parts = [unpack(b.as_py(), "i8", *kinds)[0] for k, b in zip(table.column("kind").to_pylist(), table.column("blob"), strict=True) if k == kind] if table.num_rows else []
    doc = [np.cumsum(p[0]) for p in parts]
    return [np.concatenate(x) for x in (doc, *zip(*(p[1:] for p in parts), strict=True))] if parts else [np.zeros(0, k) for k in ("i8", *kinds)]


def _places(*pairs: tuple[np.ndarray, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Pairs of (version, position) as one number each, and the versions in order of their share of it."""
    versions = np.unique(np.concatenate([v for v, _ in pairs]))
    return [(np.searchsorted(versions, v) << 32) + p.astype(np.int64) for v, p in pairs], versions


def ranges(place: np.ndarray, low: np.ndarray, high: np.ndarray, twin: np.ndarray, leader: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, start, stop) of all ranges of a document: those of its strings, and of strings like them."""
    if len(twin) and len(place):
        order = np.argsort(twin)
        twin, leader = twin[order], leader[order]
        while True:  # the leader of a batch may be like another one
            at = np.minimum(np.searchsorted(twin, leader), len(twin) - 1)
            chained = twin[at] == leader
            if not chained.any():
                break
            leader = np.where(chained, leader[at], leader)
        order = np.argsort(place, kind="stable")
        lo, hi = np.searchsorted(place[order], leader, "left"), np.searchsorted(place[order], leader, "right")
        n = hi - lo
        take = order[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        place, low, high = np.concatenate((place, np.repeat(twin, n))), np.concatenate((low, low[take])), np.concatenate((high, high[take]))
    return place, low.astype(np.int64), high.astype(np.int64)


def _apply(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a bucket without the bytes that go."""
    gone, alias = _of_kind(right, RANGE, "i8", "u4", "u1", "u1"), _of_kind(right, ALIAS, "i8", "u4", "i8", "u4")
    places = {k: i for k, i in split(gone[0])}
    twins = {k: i for k, i in split(alias[0])}
    none = np.zeros(0, np.int64)
    known: dict[int, tuple] = {}
    out: list[tuple] = []
    kept: list[bytes] = []
    for d, v, t in zip(left.column("doc_id").to_pylist(), left.column("ver").to_pylist(), left.column("data"), strict=True):
        text = t.as_py()
        rest, spans = text, 0
        if d in places:
            if d not in known:
                i, j = places[d], twins.get(d, none)
                (place, twin, leader), versions = _places((gone[1][i], gone[2][i]), (alias[1][j], alias[2][j]), (alias[3][j], alias[4][j]))
                known[d] = *ranges(place, gone[3][i], gone[4][i], twin, leader), versions
            place, low, high, versions = known[d]
            mine = place >> 32 == np.searchsorted(versions, v) if v in versions else place < 0
            at = place[mine] & 0xFFFFFFFF
            lost = covered(len(text), at + low[mine], at + high[mine])
            spans = int(lost[:1].sum()) + int((lost[1:] & ~lost[:-1]).sum())
            rest = np.frombuffer(text, np.uint8)[~lost].tobytes()
        out.append((d, len(text), len(text) - len(rest), spans))
        kept.append(rest)
    columns = zip(*out) if out else ((),) * 4
    return pa.table([*(pa.array(c, pa.int64()) for c in columns), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _versioned(rows: DataFrame) -> DataFrame:
    """A column ``ver`` that tells apart the different texts of one doc_id: 0 where there is but one."""
    h = F.xxhash64("data")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select("doc_id")
    several = checkpoint(several)
    n = several.count()
    if not n:
        return rows.withColumn("ver", F.lit(0).cast("long"))
    several = several.withColumn("__several", F.lit(True))
    joined = rows.join(F.broadcast(several) if n <= BROADCAST_IDS else several, "doc_id", "left")
    return joined.select("doc_id", "data", F.when(F.col("__several"), h).otherwise(F.lit(0).cast("long")).alias("ver"))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of ``docs`` (doc_id, text).

    A byte of a text's UTF-8 goes if a string of LENGTH bytes over it lies in a document with a smaller doc_id, too; strings don't cross
    documents and are judged on the input. n_spans counts maximal runs that go. Null and empty texts have nothing to lose. Rows with a
    null doc_id stay whole and take nothing from others. Rows of one doc_id, equal or not, lose nothing to each other, and each is
    judged by itself against smaller ids. A string that repeats within one document only stays. An empty table gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")
    rows = _versioned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), data)).select("doc_id", "ver", "data")
    counted = checkpoint(rows.mapInArrow(_count, "n_bytes long, slots array<int>"))
    total = counted.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # buckets of bounded size, and as many as there are tasks; every pair of buckets is a row that travels, so no more than that
    n_buckets, n_docs = max(total * GROWTH // STRINGS + 1, tasks), max(total // TEXT + 1, tasks)
    # frequent slots as words of 32 bits: 2^17 rows at most, whatever the corpus
    slots = counted.select(F.explode("slots").alias("slot"))
    bits = np.zeros(1 << (SLOT_BITS - 5), np.uint32)
    for r in slots.groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 31)")).alias("bits")).toLocalIterator():
        bits[r["word"]] = r["bits"]
    shared = spark.sparkContext.broadcast(bits)

    def frequent() -> np.ndarray:
        return np.unpackbits(shared.value.view(np.uint8), bitorder="little").astype(bool)

    null_at = F.pmod(F.xxhash64("data"), F.lit(n_docs))  # nothing is known of rows without id: anywhere
    # one exchange of the texts for the three steps that read them
    dealt = rows.withColumn("key", F.coalesce(doc_bucket_column(F.col("doc_id"), n_docs), null_at)).groupBy("key")
    told = dealt.applyInArrow(lambda t: _tell(t, n_buckets, frequent()), "key long, source long, blob binary")
    answers = told.groupBy("key").applyInArrow(_answer, "key long, source long, blob binary")
    record = "key long, kind int, blob binary"
    sent = dealt.cogroup(answers.groupBy("key")).applyInArrow(lambda a, b: _send(a, b, n_buckets, n_docs, frequent()), record)
    first = sent.groupBy("key").applyInArrow(lambda t: _first(t, n_buckets, n_docs), record)
    known = first.groupBy("key").applyInArrow(lambda t: _second(t, n_docs), record)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return dealt.cogroup(known.groupBy("key")).applyInArrow(_apply, result)


def with_digest(kept: DataFrame) -> DataFrame:
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
