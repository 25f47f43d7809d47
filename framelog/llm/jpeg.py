"""Progressive JPEG: a decoder for any Huffman-coded progressive file of 8-bit samples, and an encoder that stores bytes in one.

Decoding follows ITU-T T.81: every scan (a band of coefficients, first or refining pass, DC or AC) adds to integer coefficient
arrays; only after the last one are they dequantised, inverse-transformed in numpy, chroma upsampled and turned into RGB.

``store`` keeps a payload losslessly: each of its 64-byte groups becomes the 64 quantised coefficients of a block, which the format
holds exactly (its samples, after the inverse transform, are rounded and clipped; the coefficients are not). Byte b becomes b + 2 for
b < 128 and 126 - b otherwise, so no coefficient is 0 after the first pass has dropped its last bit. Its Huffman tables
give every coefficient of a first pass the same length, 8 bits for AC and 16 for DC; the decoder notices such tables and, if a segment
holds nothing else, reads all of it with one table look-up. Other segments are decoded symbol by symbol.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Order in which a block's coefficients are sent (fixed values of the format: row-major places along the zigzag).
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))), np.int64)
#: MCUs in a row of a stored payload, at most.
MAX_ACROSS = 256


class JpegError(ValueError):
    """A file that is damaged or of another kind."""


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    across: int = 0  # blocks that have samples
    down: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))  # padded to whole MCUs, zigzag order


class Table:
    """A Huffman table: symbol and length for each 16-bit window; length 0 where no code fits."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol, self.length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code, k = 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                lo, hi = code << (16 - n), (code + 1) << (16 - n)
                if hi > 1 << 16 or k >= len(symbols):
                    raise JpegError("bad Huffman table")
                self.symbol[lo:hi], self.length[lo:hi] = symbols[k], n
                code, k = code + 1, k + 1
            code <<= 1

    def uniform(self, bits: int, ac: bool) -> np.ndarray | None:
        """If every code for a plain value fills ``bits`` bits with its extra bits: the value for each of their patterns, and
        a marker (1 << 20) for patterns that start anything else."""
        window = np.arange(1 << bits, dtype=np.int64) << (16 - bits)
        symbol, length = self.symbol[window].astype(np.int64), self.length[window].astype(np.int64)
        size = symbol & 15
        plain = (length > 0) & (length + size == bits) & ((symbol >> 4 == 0) & (size > 0) if ac else symbol < 12)
        if not plain.any():
            return None
        extra = np.arange(1 << bits) & ((1 << size) - 1)
        value = np.where(size == 0, 0, np.where(extra >> np.maximum(size - 1, 0) & 1, extra, extra - (1 << size) + 1))
        return np.where(plain, value, 1 << 20).astype(np.int32)


@lru_cache(64)
def _table(counts: bytes, symbols: bytes) -> Table:
    return Table(counts, symbols)


@lru_cache(64)
def _uniform(counts: bytes, symbols: bytes, bits: int, ac: bool) -> np.ndarray | None:
    return _table(counts, symbols).uniform(bits, ac)


class Bits:
    """Bits of an entropy-coded segment, already without stuffing; zeros follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data, 0, 0, 0

    def _fill(self) -> None:
        chunk = self.data[self.at : self.at + 6]
        self.at += 6
        self.acc = (self.acc & ((1 << self.n) - 1)) << 48 | int.from_bytes(chunk.ljust(6, b"\0"), "big")
        self.n += 48

    def take(self, k: int) -> int:
        if not k:
            return 0
        while self.n < k:
            self._fill()
        self.n -= k
        return self.acc >> self.n & ((1 << k) - 1)

    def symbol(self, t: Table) -> int:
        if self.n < 16:
            self._fill()
        w = self.acc >> (self.n - 16) & 0xFFFF
        length = int(t.length[w])
        if not length:
            raise JpegError("bad Huffman code")
        self.n -= length
        return int(t.symbol[w])

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _unstuffed(data: bytes) -> bytes:
    return data.replace(b"\xff\x00", b"\xff")


class Decoder:
    """Walks the markers of a file and adds each scan to the coefficients."""

    def __init__(self, data: bytes):
        self.data, self.components, self.scans, self.comment = data, [], 0, b""
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        self.orders: dict[tuple[int, ...], list[tuple[int, np.ndarray]]] = {}
        self.restart = self.width = self.height = 0
        self._walk()

    def _walk(self) -> None:
        d, at = self.data, 2
        if d[:2] != b"\xff\xd8":
            raise JpegError("no SOI")
        while at < len(d):
            if d[at] != 0xFF:
                raise JpegError("marker expected")
            while at < len(d) and d[at] == 0xFF:
                at += 1
            if at >= len(d):
                break
            marker, at = d[at], at + 1
            if marker == 0xD9:
                return
            if marker == 1 or 0xD0 <= marker <= 0xD7:
                continue
            n = int.from_bytes(d[at : at + 2], "big")
            body, at = d[at + 2 : at + n], at + n
            if marker == 0xC2:
                self._frame(body)
            elif marker == 0xDB:
                self._quant(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                at = self._scan(body, at)
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise JpegError("not progressive Huffman")
        raise JpegError("no EOI")

    def _quant(self, body: bytes) -> None:
        while body:
            wide, n = body[0] >> 4, body[0] & 15
            size = 64 << wide
            self.quant[n] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1").astype(np.int32)
            body = body[1 + size :]

    def _huffman(self, body: bytes) -> None:
        while body:
            counts = bytes(body[1:17])
            n = sum(counts)
            self.huffman[body[0] >> 4, body[0] & 15] = counts, bytes(body[17 : 17 + n])
            body = body[17 + n :]

    def _frame(self, body: bytes) -> None:
        if body[0] != 8:
            raise JpegError("not 8-bit")
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        if not self.height or not self.width:
            raise JpegError("no size")
        self.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        self.hmax, self.vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        self.mcus_across, self.mcus_down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.components:
            c.across = -(-(-(-self.width * c.h // self.hmax)) // 8)
            c.down = -(-(-(-self.height * c.v // self.vmax)) // 8)
            c.coef = np.zeros((self.mcus_down * c.v, self.mcus_across * c.h, 64), np.int32)

    def _segments(self, at: int) -> tuple[list[bytes], int]:
        """Entropy-coded segments from ``at`` on, split at restart markers, and where the next other marker is."""
        d, out, start = self.data, [], at
        while True:
            at = d.find(b"\xff", at)
            if at < 0 or at + 1 >= len(d):
                raise JpegError("scan without end")
            m = d[at + 1]
            if m == 0:
                at += 2
            elif 0xD0 <= m <= 0xD7:
                out.append(_unstuffed(d[start:at]))
                start = at = at + 2
            elif m == 0xFF:
                at += 1
            else:
                out.append(_unstuffed(d[start:at]))
                return out, at

    def _order(self, idents: tuple[int, ...]) -> list[tuple[int, np.ndarray]]:
        """For a scan of these components: (number of the component, flat place of its block in every unit), in the order of sending."""
        if idents not in self.orders:
            parts = [next(c for c in self.components if c.ident == i) for i in idents]
            if len(parts) == 1:  # its own blocks, row by row, without those that only fill up an MCU
                c = parts[0]
                self.orders[idents] = [(0, (np.arange(c.down)[:, None] * c.coef.shape[1] + np.arange(c.across)).ravel())]
            else:
                my, mx = np.divmod(np.arange(self.mcus_across * self.mcus_down), self.mcus_across)
                self.orders[idents] = [(k, (my * c.v + v) * c.coef.shape[1] + mx * c.h + h) for k, c in enumerate(parts) for v in range(c.v) for h in range(c.h)]
        return self.orders[idents]

    def _scan(self, body: bytes, at: int) -> int:
        by_id = {c.ident: c for c in self.components}
        parts = [(by_id[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
        first, last, high, low = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
        segments, end = self._segments(at)
        self.scans += 1
        order = self._order(tuple(c.ident for c, _, _ in parts))
        units = len(order[0][1])
        step = self.restart or units
        flats = [p[0].coef.reshape(-1, 64) for p in parts]
        for n, lo in enumerate(range(0, units, step)):
            data = segments[n] if n < len(segments) else b""
            hi = min(units, lo + step)
            if first == 0:
                if high:
                    self._refine_dc(data, flats, order, lo, hi, low)
                else:
                    self._first_dc(data, flats, order, lo, hi, low, [self.huffman.get((0, p[1])) for p in parts])
            else:
                table = self.huffman.get((1, parts[0][2]))
                if table is None:
                    raise JpegError("no Huffman table")
                (self._refine_ac if high else self._first_ac)(data, flats[0], order[0][1][lo:hi], first, last, low, table)
        return end

    @staticmethod
    def _first_dc(data: bytes, flats: list, order: list, lo: int, hi: int, low: int, tables: list) -> None:
        if None in tables:
            raise JpegError("no Huffman table")
        n, per = hi - lo, len(order)
        maps = [_uniform(*t, 16, False) for t in tables]
        if len(data) == 2 * n * per and all(m is not None for m in maps):
            words = np.frombuffer(data, ">u2").reshape(n, per)
            diffs = np.stack([maps[k][words[:, i]] for i, (k, _) in enumerate(order)], axis=1)
            if not (diffs == 1 << 20).any():
                for k in range(len(flats)):
                    mine = [i for i, (j, _) in enumerate(order) if j == k]
                    values = np.cumsum(diffs[:, mine].ravel()).reshape(n, len(mine)) << low
                    for i, column in zip(mine, values.T, strict=True):
                        flats[k][order[i][1][lo:hi], 0] = column
                return
        bits, last = Bits(data), [0] * len(flats)
        decoded = [_table(*t) for t in tables]
        for u in range(lo, hi):
            for k, places in order:
                last[k] += bits.signed(bits.symbol(decoded[k]))
                flats[k][places[u], 0] = last[k] << low

    @staticmethod
    def _refine_dc(data: bytes, flats: list, order: list, lo: int, hi: int, low: int) -> None:
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        need = (hi - lo) * len(order)
        bits = np.concatenate((bits, np.zeros(max(0, need - len(bits)), np.uint8)))[:need].reshape(-1, len(order)).astype(np.int32)
        for i, (k, places) in enumerate(order):
            flats[k][places[lo:hi], 0] |= bits[:, i] << low

    @staticmethod
    def _first_ac(data: bytes, flat: np.ndarray, places: np.ndarray, first: int, last: int, low: int, table: tuple) -> None:
        width = last - first + 1
        values = _uniform(*table, 8, True)
        if values is not None and len(data) == len(places) * width:
            found = values[np.frombuffer(data, np.uint8)]
            if not (found == 1 << 20).any():
                rows = slice(places[0], places[-1] + 1) if len(places) == places[-1] - places[0] + 1 else places
                flat[rows, first : last + 1] = (found << low).reshape(-1, width)
                return
        bits, t, run = Bits(data), _table(*table), 0
        for p in places:
            if run:
                run -= 1
                continue
            k = first
            while k <= last:
                s = bits.symbol(t)
                zeros, size = s >> 4, s & 15
                if size:
                    k += zeros
                    if k > last:
                        raise JpegError("coefficient out of its band")
                    flat[p, k] = bits.signed(size) * (1 << low)
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) - 1 + bits.take(zeros)
                    break

    @staticmethod
    def _refine_ac(data: bytes, flat: np.ndarray, places: np.ndarray, first: int, last: int, low: int, table: tuple) -> None:
        bits, t, done = Bits(data), _table(*table), 0
        while done < len(places):
            k, p = first, places[done]
            new = 0
            while k <= last:
                s = bits.symbol(t)
                zeros, size = s >> 4, s & 15
                if not size and zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    Decoder._correct(bits, flat, places[done : done + run], k, first, last, low)
                    done += run
                    break
                new = (1 if bits.take(1) else -1) << low if size else 0
                while k <= last:
                    if flat[p, k]:
                        if bits.take(1):
                            flat[p, k] += (1 << low) if flat[p, k] > 0 else -(1 << low)
                    elif zeros:
                        zeros -= 1
                    else:
                        flat[p, k] = new
                        k += 1
                        break
                    k += 1
            else:
                done += 1

    @staticmethod
    def _correct(bits: Bits, flat: np.ndarray, places: np.ndarray, k: int, first: int, last: int, low: int) -> None:
        """Correction bits of a run of blocks without new coefficients, the first of them from k on: one bit for each that isn't 0."""
        rows = slice(places[0], places[-1] + 1) if len(places) and len(places) == places[-1] - places[0] + 1 else places
        band = flat[rows, first : last + 1]
        live = band != 0
        live[0, : k - first] = False
        n = int(live.sum())
        at = bits.at * 8 - bits.n  # where the reader stands, in bits
        raw = np.unpackbits(np.frombuffer(bits.data, np.uint8, max(0, min(len(bits.data), (at + n + 7) // 8) - at // 8), at // 8 if at // 8 < len(bits.data) else 0))[at % 8 :][:n]
        raw = np.concatenate((raw, np.zeros(n - len(raw), np.uint8)))
        band[live] += np.sign(band[live]) * (raw.astype(np.int32) << low)
        flat[rows, first : last + 1] = band
        bits.at, bits.acc, bits.n = (at + n) // 8, 0, 0
        bits.take((at + n) % 8)

    def planes(self) -> list[np.ndarray]:
        """Samples of each component, 0 to 255, padded to whole MCUs."""
        out = []
        for c in self.components:
            if c.table not in self.quant:
                raise JpegError("no quantisation table")
            rows, columns, _ = c.coef.shape
            basis = self.quant[c.table][:, None].astype(np.float32) * _basis()
            s = c.coef.reshape(-1, 64).astype(np.float32) @ basis
            s = np.clip(np.rint(s + 128), 0, 255).astype(np.uint8)
            out.append(s.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8))
        return out

    def rgb(self) -> np.ndarray:
        """Full-resolution tensor height x width x 3: chroma samples repeated, YCbCr to RGB; one component is grey."""
        up = []
        for c, p in zip(self.components, self.planes(), strict=True):
            up.append(np.repeat(np.repeat(p, self.vmax // c.v, axis=0), self.hmax // c.h, axis=1)[: self.height, : self.width])
        if len(up) == 1:
            return np.repeat(up[0][:, :, None], 3, axis=2)
        if len(up) != 3:
            raise JpegError("neither one component nor three")
        y, cb, cr = up[0].astype(np.int32) << 16, up[1].astype(np.int32) - 128, up[2].astype(np.int32) - 128
        half = 1 << 15
        channels = (y + 91881 * cr + half, y - 22554 * cb - 46802 * cr + half, y + 116130 * cb + half)
        return np.stack([np.clip(x >> 16, 0, 255).astype(np.uint8) for x in channels], axis=2)


@lru_cache(1)
def _basis() -> np.ndarray:
    """64 x 64: the samples (row-major) of each coefficient (zigzag order)."""
    u, x = np.arange(8)[:, None], np.arange(8)
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("vy,ux->vuyx", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


# ---- storing bytes -------------------------------------------------------------------------------------------------------


def _codes(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """Canonical codes for symbols of given lengths: counts and symbols of the table, and (code, length) by symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, codes, code, n = [0] * 16, {}, 0, 0
    for s in order:
        code <<= lengths[s] - n
        n = lengths[s]
        codes[s] = code, n
        counts[n - 1] += 1
        code += 1
    return bytes(counts), bytes(order), codes


#: A value of s bits has a code of 8 - s (AC) or 16 - s (DC) bits; runs of blocks without new coefficients take 8 more.
_AC = _codes({s: 8 - s for s in range(1, 8)} | {n << 4: 12 for n in range(15)})
_DC = _codes({s: 16 - s for s in range(10)})


@lru_cache(2)
def _word_table(ac: bool) -> np.ndarray:
    """Code and extra bits of each value from -255 to 255 as one word (8 bits for AC, 16 for DC)."""
    table = np.zeros(511, np.uint8 if ac else np.uint16)
    for v in range(-255, 256):
        size = abs(v).bit_length()
        if size in (codes := (_AC if ac else _DC)[2]) and (v or not ac):
            table[v + 255] = codes[size][0] << size | (v if v > 0 else v + (1 << size) - 1)
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


@lru_cache(1)
def _value_of_byte() -> np.ndarray:
    b = np.arange(256)
    return np.where(b < 128, b + 2, 126 - b).astype(np.int32)


def _refining_scan(coef: np.ndarray) -> bytes:
    """The last bits of coefficients that are all known already: runs of blocks, each run followed by its bits."""
    out = []
    for lo in range(0, len(coef), 32767):
        block = coef[lo : lo + 32767]
        n = len(block).bit_length() - 1
        code, length = _AC[2][n << 4]
        head = [code >> (length - 1 - i) & 1 for i in range(length)] + [(len(block) - (1 << n)) >> (n - 1 - i) & 1 for i in range(n)]
        out += [np.array(head, np.uint8), (np.abs(block) & 1).astype(np.uint8).ravel()]
    bits = np.concatenate(out)
    return np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))).tobytes()


def store(payload: bytes) -> bytes:
    """A progressive 4:2:0 file whose coefficients hold ``payload`` (a positive multiple of 64 bytes); its length is in a comment.

    An MCU holds 6 groups (four of luma, one of each chroma); the last one is filled up with groups of byte 0.
    Scans: DC without the last bit, its last bit; then for each component two bands of AC without the last bit, and their last bits.
    """
    if not payload or len(payload) % 64:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    blocks = len(payload) // 64
    mcus = -(-blocks // 6)
    across = min(mcus, MAX_ACROSS if mcus <= MAX_ACROSS * 4095 else 4095)
    down = -(-mcus // across)
    if down > 4095:
        raise ValueError("the payload is larger than a file can hold")
    mcus = across * down
    data = np.zeros((mcus * 6, 64), np.uint8)
    data[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    coef = _value_of_byte()[data].reshape(mcus, 6, 64)
    # raster order of each component's blocks, which scans of one component follow
    luma = coef[:, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    planes = [luma, coef[:, 4], coef[:, 5]]
    out = [b"\xff\xd8", _segment(0xFE, b"bytes %d" % len(payload)), _segment(0xDB, b"\0" + b"\1" * 64)]
    frame = b"\x08" + (down * 16).to_bytes(2, "big") + (across * 16).to_bytes(2, "big") + b"\x03\x01\x22\0\x02\x11\0\x03\x11\0"
    out += [_segment(0xC2, frame), _segment(0xC4, b"\0" + _DC[0] + _DC[1] + b"\x10" + _AC[0] + _AC[1])]
    dc = coef[:, :, 0] >> 1
    diffs = np.empty_like(dc)
    flat = dc[:, :4].reshape(-1)
    diffs[:, :4] = np.diff(flat, prepend=0).reshape(-1, 4)
    diffs[:, 4:] = np.diff(dc[:, 4:], axis=0, prepend=0)
    everything = b"\x03\x01\0\x02\0\x03\0"
    out += [_segment(0xDA, everything + b"\0\0\x01"), _stuffed(_word_table(False)[diffs.ravel() + 255].astype(">u2").tobytes())]
    bits = (coef[:, :, 0] & 1).astype(np.uint8).ravel()
    out += [_segment(0xDA, everything + b"\0\0\x10"), _stuffed(np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))).tobytes())]
    for n, plane in enumerate(planes, 1):
        halves = np.sign(plane) * (np.abs(plane) >> 1)
        words = _word_table(True)[halves + 255]
        for lo, hi in ((1, 5), (6, 63)):
            out += [_segment(0xDA, bytes((1, n, 0, lo, hi, 1))), _stuffed(np.ascontiguousarray(words[:, lo : hi + 1]).tobytes())]
    for n, plane in enumerate(planes, 1):
        out += [_segment(0xDA, bytes((1, n, 0, 1, 63, 0x10))), _stuffed(_refining_scan(plane[:, 1:]))]
    return b"".join(out) + b"\xff\xd9"


def load(file: bytes | Decoder) -> bytes:
    """The payload of a file that ``store`` made."""
    d = file if isinstance(file, Decoder) else Decoder(file)
    if not d.comment.startswith(b"bytes "):
        raise JpegError("no stored payload")
    luma, cb, cr = (c.coef for c in d.components)
    down, across = cb.shape[:2]
    coef = np.empty((down * across, 6, 64), np.int32)
    coef[:, :4] = luma.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    coef[:, 4], coef[:, 5] = cb.reshape(-1, 64), cr.reshape(-1, 64)
    return np.where(coef > 0, coef - 2, 126 - coef).astype(np.uint8).tobytes()[: int(d.comment[6:])]
