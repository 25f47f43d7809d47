"""Sorting suffixes by hashes.

Prefix polynomial hashes give the hash of any substring in constant time; two suffixes' common extension is found by binary search over
its length, so a comparison costs a logarithm of the length and not the length. A bottom-up mergesort uses these comparisons, on
many independent segments at once. Where the order says that suffixes are equal, their bytes are compared; a segment in which
hashes collide is sorted again by its bytes.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(1)
#: A random value for each byte, an odd base and its inverse modulo 2^64.
VALUES = _rng.integers(1, 1 << 63, 256, np.uint64)
BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """For each row of bytes (the last axis), the hashes of its prefixes, the empty one first."""
    n = rows.shape[-1]
    out = np.zeros((*rows.shape[:-1], n + 1), np.uint64)
    np.add.accumulate(VALUES[rows] * powers(BASE, n), axis=-1, out=out[..., 1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits of h over its high bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


class Suffixes:
    """Suffixes (row, column) of rows of bytes, compared over ``length`` bytes."""

    def __init__(self, rows: np.ndarray, prefixes: np.ndarray, row: np.ndarray, column: np.ndarray, length: int):
        self.rows, self.prefixes, self.length = rows.ravel(), prefixes.ravel(), length
        self.byte_at = row.astype(np.int64) * rows.shape[1] + column
        self.hash_at = row.astype(np.int64) * prefixes.shape[1] + column
        self.column, self.undo = column.astype(np.int64), powers(INVERSE, prefixes.shape[1])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search over hashes."""
        p, u = self.prefixes, self.undo
        got = np.zeros(len(a), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        while step:
            fits = got + step <= self.length
            k = np.where(fits, step, 0)
            x, y = self.hash_at[a] + got, self.hash_at[b] + got
            same = (p[x + k] - p[x]) * u[self.column[a] + got] == (p[y + k] - p[y]) * u[self.column[b] + got]
            got += np.where(same, k, 0)
            step >>= 1
        return got

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before b; of equal ones as ``or_equal`` says."""
        n = self.common(a, b)
        end = n >= self.length
        at = np.minimum(n, self.length - 1)
        return np.where(end, or_equal, self.rows[self.byte_at[a] + at] < self.rows[self.byte_at[b] + at])

    def sort(self, segment: np.ndarray) -> np.ndarray:
        """Order of the suffixes by segment (given in non-decreasing order), then by suffix; stable."""
        order = np.arange(len(segment))
        if not len(order):
            return order
        starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        start = np.repeat(starts, np.diff(np.append(starts, len(segment))))
        stop = np.repeat(np.append(starts[1:], len(segment)), np.diff(np.append(starts, len(segment))))
        width = 1
        live = np.flatnonzero(stop - start > width)
        while len(live):
            # each place of a live segment belongs to a run; its sibling is the other run of the pair to merge
            lo, hi = start[live], stop[live]
            pair = lo + (live - lo) // (2 * width) * (2 * width)
            middle = np.minimum(pair + width, hi)
            end = np.minimum(pair + 2 * width, hi)
            left = live < middle
            a, b = np.where(left, middle, pair), np.where(left, end, middle)
            mine, base = order[live], np.where(left, live - pair, live - middle)
            first = a.copy()
            while True:  # how many of the sibling's come before mine
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    break
                mid = (a[open_] + b[open_]) >> 1
                # an equal suffix of the left run comes first
                before = self.less(order[mid], mine[open_], ~left[open_])
                a[open_] = np.where(before, mid + 1, a[open_])
                b[open_] = np.where(before, b[open_], mid)
            moved = order.copy()
            moved[pair + base + (a - first)] = mine
            order = moved
            width *= 2
            live = live[hi - lo > width]
        return order

    def classes(self, segment: np.ndarray) -> np.ndarray:
        """A number for each suffix, equal where segment and bytes are equal."""
        order = self.sort(segment)
        if not len(order):
            return order
        a, b = order[:-1], order[1:]
        linked = (segment[a] == segment[b]) & (self.common(a, b) >= self.length)
        at = np.flatnonzero(linked)
        span = np.arange(self.length)
        true = np.ones(len(at), bool)
        for i in range(0, len(at), 1 << 16):
            x, y = a[at[i : i + (1 << 16)]], b[at[i : i + (1 << 16)]]
            true[i : i + (1 << 16)] = (self.rows[self.byte_at[x][:, None] + span] == self.rows[self.byte_at[y][:, None] + span]).all(axis=1)
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(np.concatenate(([True], ~linked)))
        for s in np.unique(segment[a[at[~true]]]):  # hashes collide: by bytes
            mine = np.flatnonzero(segment == s)
            text = [self.rows[self.byte_at[m] : self.byte_at[m] + self.length].tobytes() for m in mine]
            known = {t: int(out.max()) + 1 + k for k, t in enumerate(dict.fromkeys(text))}
            out[mine] = [known[t] for t in text]
        return out
