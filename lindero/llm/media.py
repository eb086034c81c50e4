"""Media columns: progressive JPEG files decoded to full-resolution RGB tensors, and payloads stored as such files.

Decoding accumulates a file's scans (spectral selection, successive approximation) into coefficient
arrays, inverse-transforms those in numpy, upsamples the chroma planes and converts to RGB. All the
files of a batch are decoded together: the stretches between restart markers are independent, so each
step takes the next symbol of every stretch. The transform and the colours are in whole numbers,
which makes a tensor depend on its file alone.

A payload's byte is a coefficient: bytes less 128 fill the blocks of the three components in zigzag
order, with quantisers of 1, so that the file holds them without loss.

Nulls and edge cases: a null payload counts as empty, and an empty one is a block of zero bytes; equal
payloads give equal files; a null file gives null results; a file that is no progressive JPEG, or is
broken, gives nulls and an error text and leaves the others alone, as does one whose header asks for
more blocks than its bytes can hold (at least a bit each) or, beyond MOST_BLOCKS, for more than one to
32 bytes (which a stored text never needs), so that memory follows the bytes of the files; ids may be null or repeated; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.llm.common import bounded_batches, map_texts, slices

#: MCUs between restart markers.
RESTART = 16
#: Blocks of an MCU with halved chroma: four of luma in two rows, one of each chroma.
_SHAPE = ((2, 2), (1, 1), (1, 1))
_COMMENT = b"payload:"
#: Blocks of 64 coefficients that a file may have whatever its size: pictures of 16 million pixels, about.
MOST_BLOCKS = 1 << 18
#: Blocks of the files that are decoded together; one file may have more.
_TOGETHER = 1 << 16


@cache
def zigzag() -> np.ndarray:
    """Row-major places of the 64 coefficients in the order of a file: along the anti-diagonals, in turns up and down."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@cache
def _transform() -> np.ndarray:
    """Pixels of a block from its coefficients in zigzag order, times 2**13, in whole numbers, which float64 sums exactly."""
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)[:, None]
    both = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.round(both[zigzag()] * 8192)


# Huffman tables


def canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A DHT body (counts, symbols) with the codes and lengths by symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size, codes, sizes = 0, 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s in order:
        code <<= lengths[s] - size
        size = lengths[s]
        codes[s], sizes[s] = code, size
        code += 1
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return counts + bytes(order), codes, sizes


@cache
def _tables() -> dict[str, tuple[bytes, np.ndarray, np.ndarray]]:
    """Fixed tables for payloads, in which most coefficients differ from zero."""
    ac = {16 * r + s: (4 if r == 0 else 7 if r == 1 else 9) for r in range(16) for s in range(1, 9)} | {0x00: 5, 0xF0: 9}
    refine = {16 * r + 1: 5 for r in range(16)} | {0x00: 5, 0xF0: 5}
    return {"dc": canonical({s: 4 for s in range(12)}), "ac": canonical(ac), "refine": canonical(refine)}


@cache
def _lookup(body: bytes) -> np.ndarray:
    """For each 16 bits that come next: length of the code times 256 plus the symbol; length 0 is no code."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            table[code << (16 - n) : (code + 1) << (16 - n)] = n * 256 + body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


# Encoding


@cache
def _magnitude_table() -> tuple[np.ndarray, np.ndarray]:
    v = np.arange(-1024, 1025)
    size = np.zeros(len(v), np.int32)
    for k in range(11):
        size += (np.abs(v) >= 1 << k).astype(np.int32)
    return size, np.where(v < 0, v + (1 << size) - 1, v).astype(np.int32)


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size category and extra bits of whole numbers from -1024 to 1024."""
    size, extra = _magnitude_table()
    return size[v + 1024], extra[v + 1024]


@cache
def _coded() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each run of up to 15 zeros and the value after it, from -128 to 127."""
    _, codes, sizes = _tables()["ac"]
    size, extra = _magnitude(np.arange(-128, 128))
    symbol = (np.arange(16)[:, None] << 4) | size[None, :]
    return ((codes[symbol] << size) | extra).astype(np.int32).reshape(-1), (sizes[symbol] + size).astype(np.int32).reshape(-1)


class _Bits:
    """Entropy-coded stretches of one scan of many files: (bits, number) in order, by stretch."""

    def __init__(self, value: np.ndarray, size: np.ndarray, stretch: np.ndarray, stretches: int):
        ends = np.cumsum(size, dtype=np.int64)
        last = np.searchsorted(stretch, np.arange(stretches), "right")  # stretches come in order
        until = np.concatenate([[0], ends])[last]
        total = np.diff(until, prepend=0)
        self.bytes = (total + 7) // 8
        base = np.cumsum(self.bytes) - self.bytes
        many = np.diff(last, prepend=0)
        at = ends - size + np.repeat(8 * base - (until - total), many)
        pad = 8 * self.bytes - total  # ones up to the byte
        words = int(self.bytes.sum()) // 4 + 2
        out = np.zeros(words + 1)
        for value_, at_, size_ in ((value.astype(np.int64), at, size), ((1 << pad) - 1, 8 * base + total, pad)):
            word, shifted = at_ >> 5, (value_ << (64 - (at_ & 31) - size_)).view(np.uint64)
            # Bits never overlap, so the sums are exact.
            out += np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), words + 1)
            out += np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 1)
        self.data = np.frombuffer(out.astype(np.uint64).astype(">u4").tobytes(), np.uint8)[: int(self.bytes.sum())]

    def files(self, per_file: np.ndarray) -> list[bytes]:
        """Stuffed bytes with restart markers; per_file: how many stretches each file has."""
        start = np.cumsum(self.bytes) - self.bytes
        first = np.cumsum(per_file) - per_file
        number = np.arange(len(self.bytes)) - np.repeat(first, per_file)  # of the stretch in its file
        marked = number > 0
        full = self.data == 255
        extra = np.concatenate([[0], np.cumsum(full)])
        marks = np.cumsum(marked)
        of = np.repeat(np.arange(len(self.bytes)), self.bytes)
        place = np.arange(len(self.data)) + extra[:-1] + 2 * marks[of]
        out = np.zeros(len(self.data) + int(extra[-1]) + 2 * int(marks[-1]), np.uint8)
        out[place] = self.data
        where = (start + extra[start] + 2 * (marks - 1))[marked]
        out[where], out[where + 1] = 255, 0xD0 + (number[marked] - 1) % 8
        ends = np.append(start[first[1:]] + extra[start[first[1:]]] + 2 * marks[first[1:]], len(out))
        return [out[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]


def _ac_first(v: np.ndarray, stretch: np.ndarray, stretches: int, table) -> _Bits:
    """v: blocks by coefficients of the band."""
    _, codes, sizes = table
    n, width = v.shape
    plain = np.ascontiguousarray(v).reshape(-1)
    flat = np.flatnonzero(plain)
    block = flat // width
    # Zeros since the one before, or since the start of the block.
    run = flat - np.maximum(np.concatenate([[-1], flat[:-1]]), block * width - 1) - 1
    of = ((run & 15) << 8) + plain[flat] + 128
    value, bits = (x[of] for x in _coded())
    skips = run >> 4
    if skips.any():  # sixteen zeros each
        many = skips + 1
        last = np.cumsum(many) - 1
        value, bits, block = np.repeat(value, many), np.repeat(bits, many), np.repeat(block, many)
        zrl = np.ones(len(value), bool)
        zrl[last] = False
        value[zrl], bits[zrl] = codes[0xF0], sizes[0xF0]
    ends = np.flatnonzero(v[:, -1] == 0)
    return _merge(value, bits, block, ends, codes[0], sizes[0], n, stretch, stretches)


def _merge(value, bits, block, ends, code, size, n, stretch, stretches) -> _Bits:
    """The end of a block after what the block has."""
    is_end = np.zeros(n, np.int64)
    is_end[ends] = 1
    ended = np.cumsum(is_end)
    counts = np.cumsum(np.bincount(block, minlength=n))
    place, place_end = np.arange(len(value)) + (ended - is_end)[block], counts[ends] + np.arange(len(ends))
    out = [np.zeros(len(value) + len(ends), np.int32) for _ in range(3)]
    for x, a, b in zip(out, (value, bits, block), (code, size, ends), strict=True):
        x[place], x[place_end] = a, b
    return _Bits(out[0], out[1], stretch[out[2]], stretches)


def _ac_refine(v: np.ndarray, al: int, stretch: np.ndarray, stretches: int, table) -> _Bits:
    """The next bit of coefficients that are not zero so far, and those that become so."""
    _, codes, sizes = table
    n, width = v.shape
    a = np.abs(v) >> al
    zero, new, known = a == 0, a == 1, a > 1
    seen = np.cumsum(zero, 1)
    since = np.maximum.accumulate(np.where(new, seen, 0), 1)
    run = seen - np.concatenate([np.zeros((n, 1), np.int64), since[:, :-1]], 1)
    last = np.where(new.any(1), width - 1 - new[:, ::-1].argmax(1), -1)
    skip = zero & (run > 0) & (run % 16 == 0) & (np.arange(width)[None, :] < last[:, None])
    event = np.concatenate([new | skip, (last < width - 1)[:, None]], 1).reshape(-1)
    fix = np.concatenate([known, np.zeros((n, 1), bool)], 1).reshape(-1)
    at, fixes = np.flatnonzero(event), np.flatnonzero(fix)
    block, k = at // (width + 1), at % (width + 1)
    is_new = np.concatenate([new, np.zeros((n, 1), bool)], 1).reshape(-1)[at]
    kk = np.minimum(k, width - 1)
    symbol = np.where(is_new, ((run[block, kk] % 16) << 4) | 1, np.where(k == width, 0x00, 0xF0))
    value = np.where(is_new, (codes[symbol] << 1) | (v[block, kk] > 0), codes[symbol])
    bits = sizes[symbol] + is_new
    # The bits of known coefficients follow the event that comes after them.
    which = np.cumsum(event)[fixes]
    place_fix = np.arange(len(fixes)) + which + 1
    place = np.arange(len(at)) + np.searchsorted(which, np.arange(len(at)), "left")
    out = [np.zeros(len(at) + len(fixes), np.int32) for _ in range(3)]
    fixed_block, fixed_k = fixes // (width + 1), fixes % (width + 1)
    for x, e, f in zip(out, (value, bits, block), (a[fixed_block, fixed_k] & 1, 1, fixed_block), strict=True):
        x[place], x[place_fix] = e, f
    return _Bits(out[0], out[1], stretch[out[2]], stretches)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


@lru_cache(4096)
def _mcu_order(wide: int, high: int, shape: tuple = _SHAPE) -> np.ndarray:
    """For each MCU its blocks as (component, place in the component's raster), flattened to places in all components one after another."""
    out, base = [], 0
    row, col = np.arange(wide * high) // wide, np.arange(wide * high) % wide
    for h, v in shape:
        for y in range(v):
            for x in range(h):
                out.append(base + (row * v + y) * wide * h + col * h + x)
        base += wide * high * h * v
    return np.stack(out, 1)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload, padded with zero bytes to a positive multiple of 64."""
    t = _tables()
    blocks = [max(1, -(-len(p) // 64)) for p in payloads]
    mcus = [-(-b // 6) for b in blocks]
    wide = [max(min(m, 32), -(-m // 4000)) for m in mcus]
    high = [-(-m // w) for m, w in zip(mcus, wide, strict=True)]
    mcus = np.array(wide) * np.array(high)
    base = 6 * (np.cumsum(mcus) - mcus)
    coef = np.zeros((6 * int(mcus.sum()), 64), np.int16)
    for p, at, b in zip(payloads, base.tolist(), blocks, strict=True):
        coef[at : at + b] = np.frombuffer(p.ljust(64 * b, b"\0"), np.uint8).reshape(b, 64).astype(np.int16) - 128
    # Blocks of each component over all files, and the stretches that they are coded in.
    order = np.concatenate([_mcu_order(w, h) + b for w, h, b in zip(wide, high, base.tolist(), strict=True)])

    def stretches(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        per_file = -(-count // RESTART)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(np.cumsum(per_file) - per_file, count) + inside // RESTART, per_file

    mcu_stretch, mcu_files = stretches(mcus)
    luma_stretch, luma_files = stretches(4 * mcus)
    rows = {c: np.concatenate([np.arange(a, a + n * m) for a, m in zip((base + o * mcus).tolist(), mcus.tolist(), strict=True)]) for c, n, o in ((0, 4, 0), (1, 1, 4), (2, 1, 5))}
    dc = coef[order, 0].astype(np.int64)  # MCUs by 6
    start = np.concatenate([[True], mcu_stretch[1:] != mcu_stretch[:-1]])
    shifted = dc >> 1
    before = np.concatenate([np.zeros((1, 6), np.int64), shifted[:-1]])
    before[start] = 0
    diff = np.empty_like(shifted)
    diff[:, 0] = shifted[:, 0] - before[:, 3]
    diff[:, 1:4] = shifted[:, 1:4] - shifted[:, 0:3]
    diff[:, 4:] = shifted[:, 4:] - before[:, 4:]
    size, extra = _magnitude(diff.reshape(-1))
    six = np.repeat(mcu_stretch, 6)
    n_mcu, n_luma = int(mcu_files.sum()), int(luma_files.sum())
    y, cb, cr = (coef[rows[c]] for c in range(3))
    half = lambda x: np.sign(x) * (np.abs(x) >> 1)
    # (components, first and last coefficient, high and low bit, table) with the coded bits.
    plan = [
        ((1, 2, 3), 0, 0, 0, 1, _Bits((t["dc"][1][size] << size) | extra, t["dc"][2][size] + size, six, n_mcu).files(mcu_files)),
        ((1,), 1, 5, 0, 0, _ac_first(y[:, 1:6], luma_stretch, n_luma, t["ac"]).files(luma_files)),
        ((2,), 1, 63, 0, 1, _ac_first(half(cb[:, 1:]), mcu_stretch, n_mcu, t["ac"]).files(mcu_files)),
        ((3,), 1, 63, 0, 1, _ac_first(half(cr[:, 1:]), mcu_stretch, n_mcu, t["ac"]).files(mcu_files)),
        ((1,), 6, 63, 0, 0, _ac_first(y[:, 6:], luma_stretch, n_luma, t["ac"]).files(luma_files)),
        ((1, 2, 3), 0, 0, 1, 0, _Bits(dc.reshape(-1) & 1, np.ones(dc.size, np.int64), six, n_mcu).files(mcu_files)),
        ((2,), 1, 63, 1, 0, _ac_refine(cb[:, 1:], 0, mcu_stretch, n_mcu, t["refine"]).files(mcu_files)),
        ((3,), 1, 63, 1, 0, _ac_refine(cr[:, 1:], 0, mcu_stretch, n_mcu, t["refine"]).files(mcu_files)),
    ]
    heads = []
    for comps, first, last, hi, lo, _ in plan:
        table = 1 if hi and first else 0
        heads.append(_segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c, table]) for c in comps) + bytes([first, last, hi << 4 | lo])))
    tables = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\x00" + t["dc"][0] + b"\x10" + t["ac"][0] + b"\x11" + t["refine"][0]) + _segment(0xDD, struct.pack(">H", RESTART))
    out = []
    for i, p in enumerate(payloads):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * high[i], 16 * wide[i], 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        parts = [b"\xff\xd8", _segment(0xFE, _COMMENT + struct.pack(">QQ", len(p), 64 * blocks[i])), tables, frame]
        for head, scan in zip(heads, plan, strict=True):
            parts += [head, scan[5][i]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


# Decoding

_BROKEN = (ValueError, IndexError, KeyError, OverflowError, struct.error)
_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RST = re.compile(rb"\xff[\xd0-\xd7]")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _huffman(body: bytes) -> dict[int, bytes]:
    """The tables of a DHT segment by class and number, each as counts and symbols."""
    out = {}
    while body:
        n = 17 + sum(body[1:17])
        _need(len(body) >= max(n, 18) and body[0] & 0xEE == 0, "a broken code table")
        left = 1
        for count in body[1:17]:  # codes of each length that are not taken
            left = 2 * left - count
            _need(left >= 0, "a code table with too many codes")
        out[body[0]], body = body[1:n], body[n:]
    return out


def _quantisers(body: bytes) -> dict[int, np.ndarray]:
    out = {}
    while body:
        wide = 1 + (body[0] >> 4)
        _need(wide < 3 and body[0] & 15 < 4 and len(body) >= 1 + 64 * wide, "a broken quantiser")
        out[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
        body = body[1 + 64 * wide :]
    return out


class Picture:
    """A file's frame, tables and scans."""

    def __init__(self, data: bytes):
        _need(data[:2] == b"\xff\xd8", "no JPEG")
        self.scans, self.comment, self.shape = [], b"", ()
        quant, huff, restart, at = {}, {}, 0, 2
        while True:
            _need(at + 2 <= len(data) and data[at] == 255, "a marker is missing")
            marker = data[at + 1]
            if marker == 0xD9:
                break
            if marker == 255:
                at += 1
                continue
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            _need(len(body) == size - 2, "a segment is cut")
            at += 2 + size
            if marker == 0xC2:
                _need(not self.shape, "two frames")
                self._frame(body, len(data))
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not progressive")
            elif marker == 0xDB:
                quant |= _quantisers(body)
            elif marker == 0xC4:
                huff |= _huffman(body)
            elif marker == 0xDD:
                _need(len(body) == 2, "a broken restart interval")
                restart = int.from_bytes(body, "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                end = _END.search(data, at)
                _need(end is not None, "a scan without an end")
                self._scan(body, huff, restart, data[at : end.start()])
                at = end.start()
        whole = {c for comps, first, _, high, *_ in self.scans if first == 0 and high == 0 for c in comps}
        _need(bool(self.shape) and len(whole) == len(self.shape), "a component has no scan")
        _need(all(q in quant for q in self.quant_of), "a quantiser is missing")
        self.quant = tuple(quant[q].tobytes() for q in self.quant_of)

    def _frame(self, body: bytes, size: int) -> None:
        precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        _need(precision == 8 and n in (1, 3) and self.width > 0 and self.height > 0 and len(body) == 6 + 3 * n, "unsupported frame")
        self.ids = [body[6 + 3 * i] for i in range(n)]
        shape = tuple((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n))
        self.quant_of = [body[8 + 3 * i] for i in range(n)]
        _need(len(set(self.ids)) == n and all(1 <= x <= 4 for s in shape for x in s), "unsupported sampling")
        self.shape = ((1, 1),) if n == 1 else shape
        self.h, self.v = max(h for h, _ in self.shape), max(v for _, v in self.shape)
        _need(not any(self.h % h or self.v % v for h, v in self.shape), "unsupported sampling")
        self.wide, self.high = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        self.blocks = self.wide * self.high * sum(h * v for h, v in self.shape)
        # A scan that leaves out what lies outside the picture has fewer blocks than whole MCUs have.
        seen = sum(_inside(self.shape, self.width, self.height, c)[0] * _inside(self.shape, self.width, self.height, c)[1] for c in range(n))
        _need(seen <= 8 * size and self.blocks <= max(MOST_BLOCKS, size // 32), "more blocks than its bytes can hold")

    def _scan(self, body: bytes, huff: dict[int, bytes], restart: int, coded: bytes) -> None:
        _need(bool(self.shape), "a scan before its frame")
        n = body[0] if body else 0
        _need(0 < n <= len(self.ids) and len(body) == 4 + 2 * n, "a broken scan")
        comps = tuple(self.ids.index(body[1 + 2 * i]) for i in range(n))
        first, last, bits = body[1 + 2 * n : 4 + 2 * n]
        high, low = bits >> 4, bits & 15
        _need(list(comps) == sorted(set(comps)) and low <= 13 and high in (0, low + 1), "a broken scan")
        _need(last == 0 if first == 0 else n == 1 and first <= last <= 63, "a broken scan")
        tables = [body[2 + 2 * i] for i in range(n)]
        used = tuple(huff.get(16 + (x & 15) if first else x >> 4, b"") for x in tables) if first or not high else ()
        _need(b"" not in used, "a code table is missing")
        parts = [x.replace(b"\xff\x00", b"\xff") for x in _RST.split(coded)]
        self.scans.append((comps, first, last, high, low, used, restart, parts))

    def places(self, comps: tuple[int, ...]) -> np.ndarray:
        return _places(self.shape, self.wide, self.high, self.width, self.height, comps)


def _inside(shape: tuple, width: int, height: int, c: int) -> tuple[int, int]:
    """Rows and columns of a component's blocks that the picture reaches."""
    h, v = shape[c]
    most_h, most_v = max(a for a, _ in shape), max(b for _, b in shape)
    return -(-(-(-height * v // most_v)) // 8), -(-(-(-width * h // most_h)) // 8)


@lru_cache(4096)
def _places(shape: tuple, wide: int, high: int, width: int, height: int, comps: tuple[int, ...]) -> np.ndarray:
    """Blocks in the order of a scan: MCUs by their blocks. A scan of one component leaves out blocks that lie outside the picture."""
    if len(comps) > 1:
        of = np.repeat(np.arange(len(shape)), [h * v for h, v in shape])
        return _mcu_order(wide, high, shape)[:, np.isin(of, comps)]
    c = comps[0]
    h, v = shape[c]
    base = wide * high * sum(a * b for a, b in shape[:c])
    rows, cols = _inside(shape, width, height, c)
    return (base + np.arange(rows)[:, None] * wide * h + np.arange(cols)[None, :]).reshape(-1, 1)


class _Streams:
    """Stretches of coded bytes, read together."""

    def __init__(self, parts: list[bytes]):
        # Past its end a stretch reads as zero bits, which give end-of-block or a flagged code and never run on for ever.
        data = np.frombuffer(b"".join([p + b"\0" * 8 for p in parts]) + b"\0" * 8, np.uint8).astype(np.int64)
        n = len(data) - 5
        self.window = (data[:n] << 32) | (data[1 : n + 1] << 24) | (data[2 : n + 2] << 16) | (data[3 : n + 3] << 8) | data[4 : n + 4]
        size = np.array([len(p) + 8 for p in parts], np.int64)
        self.start = 8 * (np.cumsum(size) - size)
        self.end = self.start + 8 * size - 32

    def peek(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """40 bits from the byte that a position is in, and the position in it."""
        return self.window[at >> 3], at & 7


def _extend(w, at, used, size):
    extra = (w >> (40 - at - used - size)) & ((1 << size) - 1)
    return np.where(extra >> np.maximum(size - 1, 0) > 0, extra, extra - (1 << size) + 1)


def _decode_dc(s: _Streams, places: list[np.ndarray], comps: list[int], high: int, low: int, tables: list[bytes], coef: np.ndarray, bad: np.ndarray) -> None:
    """places: for each stretch its MCUs by blocks; comps: the component of each block of an MCU."""
    most, width = max(map(len, places)), len(comps)
    order = np.argsort([-len(p) for p in places], kind="stable")
    count = np.array([len(places[i]) for i in order])
    grid = np.zeros((len(places), most, width), np.int64)
    for row, i in enumerate(order):
        grid[row, : len(places[i])] = places[i]
    at, last = s.start[order].copy(), np.zeros((len(places), max(comps) + 1), np.int64)
    for m in range(most):
        k = int((count > m).sum())
        for j, c in enumerate(comps):
            w, off = s.peek(at[:k])
            if high:
                coef[grid[:k, m, j], 0] |= ((w >> (39 - off)) & 1) << low
                at[:k] += 1
            else:
                hit = _lookup(tables[c])[(w >> (24 - off)) & 0xFFFF]
                used, size = hit >> 8, np.minimum(hit & 255, 15)
                bad[order[:k]] |= used == 0
                last[:k, c] += np.where(size > 0, _extend(w, off, used, size), 0)
                coef[grid[:k, m, j], 0] = last[:k, c] << low
                at[:k] += used + size
            bad[order[:k]] |= at[:k] > s.end[order[:k]]
            np.minimum(at[:k], s.end[order[:k]], out=at[:k])


def _decode_ac_first(s: _Streams, places: list[np.ndarray], first: int, last: int, low: int, table: bytes, coef: np.ndarray, bad: np.ndarray) -> None:
    lookup, flat = _lookup(table), coef.reshape(-1)
    size = np.array([len(p) for p in places])
    block = np.concatenate([*[p[:, 0] for p in places], [0]])
    live = np.flatnonzero(size)
    at, b = s.start[live].copy(), (np.cumsum(size) - size)[live]
    stop, end, k = b + size[live], s.end[live], np.full(len(live), first)
    while len(live):
        w, off = s.peek(at)
        hit = lookup[(w >> (24 - off)) & 0xFFFF]
        used, run, n = hit >> 8, (hit >> 4) & 15, hit & 15
        value = n > 0
        runs = ~value & (run < 15)  # the end of this and maybe of following blocks
        more = np.where(runs, run, n)
        extra = (w >> (40 - off - used - more)) & ((1 << more) - 1)
        k = k + run
        ok = value & (k <= last)
        v = np.where(extra >> np.maximum(n - 1, 0) > 0, extra, extra - (1 << n) + 1)
        flat[(block[b] * 64 + k)[ok]] = (v << low)[ok]
        at = at + used + more
        k = k + 1
        over = runs | (k > last)
        b = b + np.where(runs, (1 << run) + extra, over)
        k = np.where(over, first, k)
        broken = (used == 0) | (at > end) | (value & ~ok)
        bad[live] |= broken
        go = (b < stop) & ~broken
        if not go.all():
            live, at, b, stop, end, k = live[go], at[go], b[go], stop[go], end[go], k[go]


def _decode_ac_refine(s: _Streams, places: list[np.ndarray], first: int, last: int, low: int, table: bytes, coef: np.ndarray, bad: np.ndarray) -> None:
    """A step is a coefficient; the symbol that says where the next new one goes is read when there is none."""
    lookup, flat, unit = _lookup(table), coef.reshape(-1), 1 << low
    size = np.array([len(p) for p in places])
    block = np.concatenate([*[p[:, 0] for p in places], [0]])
    live = np.flatnonzero(size)
    at, b = s.start[live].copy(), (np.cumsum(size) - size)[live]
    stop, end = b + size[live], s.end[live]
    k, run, new, rest = np.full(len(live), first), np.full(len(live), -1), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    while len(live):
        ask = np.flatnonzero((run < 0) & (rest == 0))
        broken = np.zeros(len(live), bool)
        if len(ask):
            w, off = s.peek(at[ask])
            hit = lookup[(w >> (24 - off)) & 0xFFFF]
            used, r, n = hit >> 8, (hit >> 4) & 15, hit & 15
            ends = (n == 0) & (r < 15)
            more = np.where(ends, r, n > 0)
            extra = (w >> (40 - off - used - more)) & ((1 << more) - 1)
            run[ask] = np.where(ends, -1, r)
            new[ask] = np.where(n > 0, np.where(extra > 0, unit, -unit), 0)
            rest[ask] = np.where(ends, (1 << r) + extra, 0)
            at[ask] += used + more
            broken[ask] = used == 0
        place = block[b] * 64 + k
        c = flat[place]
        known = c != 0
        w, off = s.peek(at)
        fix = known & (((w >> (39 - off)) & 1) > 0) & ((c & unit) == 0)
        at = at + known
        here = ~known & (run == 0)
        c = np.where(fix, np.where(c > 0, c + unit, c - unit), np.where(here, new, c))
        flat[place] = c
        run = np.where(~known & (run >= 0), run - 1, run)
        k = k + 1
        over = k > last
        run, rest = np.where(over, -1, run), np.where(over & (rest > 0), rest - 1, rest)
        b, k = b + over, np.where(over, first, k)
        broken |= at > end
        bad[live] |= broken
        go = (b < stop) & ~broken
        if not go.all():
            live, at, b, stop, end, k, run, new, rest = (x[go] for x in (live, at, b, stop, end, k, run, new, rest))


def coefficients(pictures: list[Picture]) -> tuple[list[np.ndarray], list[bool]]:
    """Blocks by 64 coefficients in zigzag order for each file, all components one after another, and which files are broken."""
    base = np.cumsum([0] + [p.blocks for p in pictures])
    coef = np.zeros((int(base[-1]), 64), np.int64)
    broken = np.zeros(len(pictures), bool)
    for step in range(max((len(p.scans) for p in pictures), default=0)):
        alike: dict[tuple, list] = {}
        for i, p in enumerate(pictures):
            if step < len(p.scans):
                comps, first, last, high, low, tables, restart, parts = p.scans[step]
                shape = p.shape if len(comps) > 1 else ()
                alike.setdefault((comps, first, last, high, low, tables, shape), []).append((i, restart, parts))
        for (comps, first, last, high, low, tables, shape), members in alike.items():
            places, parts, of = [], [], []
            for i, restart, stretches in members:
                order = pictures[i].places(comps) + base[i]
                for n in range(0, len(order), restart or len(order)):
                    places.append(order[n : n + (restart or len(order))])
                    of.append(i)
                n = -(-len(order) // (restart or len(order)))
                broken[i] |= len(stretches) < n
                parts += (stretches + [b""] * n)[:n]
            bad = np.zeros(len(places), bool)
            streams = _Streams(parts)
            if first == 0:
                kinds = [j for j, c in enumerate(comps) for _ in range(shape[c][0] * shape[c][1] if shape else 1)]
                _decode_dc(streams, places, kinds, high, low, list(tables), coef, bad)
            elif high:
                _decode_ac_refine(streams, places, first, last, low, tables[0], coef, bad)
            else:
                _decode_ac_first(streams, places, first, last, low, tables[0], coef, bad)
            np.logical_or.at(broken, of, bad)
    return [coef[a:b] for a, b in zip(base[:-1], base[1:], strict=True)], broken.tolist()


def tensors(pictures: list[Picture], coef: list[np.ndarray]) -> list[np.ndarray]:
    """Height by width by RGB, as bytes."""
    out: list = [None] * len(pictures)
    alike: dict[tuple, list[int]] = {}
    for i, p in enumerate(pictures):
        alike.setdefault((p.shape, p.quant), []).append(i)
    for (shape, quant), members in alike.items():
        h, v = max(a for a, _ in shape), max(b for _, b in shape)
        tiles = []
        for c, (ch, cv) in enumerate(shape):
            before = sum(a * b for a, b in shape[:c])
            blocks = np.concatenate([_tiled(coef[i], pictures[i], before, ch, cv) for i in members])
            pixels = blocks.astype(np.float64) * np.frombuffer(quant[c], np.int64)
            level = ((pixels @ _transform()).astype(np.int64) + 4096) >> 13
            plane = np.clip(level + 128, 0, 255).astype(np.int32).reshape(-1, cv, ch, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 8 * cv, 8 * ch)
            tiles.append(plane.repeat(v // cv, 1).repeat(h // ch, 2))
        if len(tiles) == 1:
            rgb = np.stack([tiles[0]] * 3, -1)
        else:
            y, cb, cr = tiles[0], tiles[1] - 128, tiles[2] - 128
            # The colour matrix of JFIF, times 2**16.
            rgb = np.stack([y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16)], -1)
        rgb = np.clip(rgb, 0, 255).astype(np.uint8)
        at = 0
        for i in members:
            p = pictures[i]
            n = p.wide * p.high
            whole = rgb[at : at + n].reshape(p.high, p.wide, 8 * v, 8 * h, 3).transpose(0, 2, 1, 3, 4).reshape(p.high * 8 * v, p.wide * 8 * h, 3)
            out[i] = np.ascontiguousarray(whole[: p.height, : p.width])
            at += n
    return out


def _tiled(coef: np.ndarray, p: Picture, before: int, h: int, v: int) -> np.ndarray:
    """A component's blocks by MCU."""
    n = p.wide * p.high
    own = coef[before * n : (before + h * v) * n].reshape(p.high, v, p.wide, h, 64)
    return own.transpose(0, 2, 1, 3, 4).reshape(-1, 64)


def decode(files: list[bytes | None]) -> list[dict]:
    """For each file: error, or picture, coef and rgb."""
    out: list[dict] = [{"error": None} for _ in files]
    good: list[int] = []
    for i, data in enumerate(files):
        if data is not None:
            try:
                out[i]["picture"] = Picture(data)
                good.append(i)
            except _BROKEN as e:
                out[i]["error"] = str(e) or "broken"
    for a, b in slices([out[i]["picture"].blocks for i in good], _TOGETHER):
        try:
            _decode_some([out[i] for i in good[a:b]])
        except _BROKEN:  # one of them: each alone
            for i in good[a:b]:
                try:
                    _decode_some([out[i]])
                except _BROKEN as e:
                    out[i]["error"] = str(e) or "broken"
    return out


def _decode_some(rows: list[dict]) -> None:
    coef, broken = coefficients([x["picture"] for x in rows])
    for x, c, b in zip(rows, coef, broken, strict=True):
        x["coef"], x["error"] = c, "broken entropy-coded data" if b else None
    whole = [x for x in rows if not x["error"]]
    for x, rgb in zip(whole, tensors([x["picture"] for x in whole], [x["coef"] for x in whole]), strict=True):
        x["rgb"] = rgb


def payload(picture: Picture, coef: np.ndarray) -> tuple[int, bytes]:
    """What encode() stored: its length and the padded bytes."""
    if not picture.comment.startswith(_COMMENT):
        raise ValueError("no payload")
    size, padded = struct.unpack(">QQ", picture.comment[len(_COMMENT) :])
    _need(size <= padded <= coef.size and padded % 64 == 0 and padded > 0, "a broken payload length")
    return size, (coef[: padded // 64] + 128).astype(np.uint8).tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel and a checksum of the whole tensor."""
    mean = rgb.reshape(-1, 3).sum(0, dtype=np.int64) / (rgb.size // 3)
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ",".join(f"{x:.4f}" for x in mean) + f";{zlib.crc32(rgb.tobytes()):08x}"


# Columns


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and media, a progressive JPEG that holds the text's UTF-8 bytes."""
    return map_texts(docs, [id_col], text_col, "media binary", lambda: lambda texts: [encode(texts)])


def _map_media(df: DataFrame, media_col: str, keep: list[str], schema: str, row) -> DataFrame:
    bounded_batches(df.sparkSession)
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media_col}`").alias("__media"))
    added = df.sparkSession.createDataFrame([], schema)
    out = src.drop("__media").schema
    for f in added.schema:
        out = out.add(f)
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[f.dataType.simpleString()] for f in added.schema]

    def run(batches):
        for batch in batches:
            files = batch.column(len(keep)).to_pylist()
            for a, b in slices([len(x or b"") for x in files]):
                rows = [row(x, data) for x, data in zip(decode(files[a:b]), files[a:b], strict=True)]
                part = batch.slice(a, b - a)
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    return src.mapInArrow(run, out)


def to_tensors(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns kept with height, width, rgb (rows of pixels of three bytes) and error."""

    def row(x, _):
        rgb = x.get("rgb")
        return (None, None, None, x["error"]) if rgb is None else (*rgb.shape[:2], rgb.tobytes(), None)

    return _map_media(df, media_col, list(keep), "height int, width int, rgb binary, error string", row)


def read_back(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Digests of what the stored files hold, and the feature of their tensors; nulls and error for a file without."""

    def row(x, data):
        if "rgb" not in x:
            return (None,) * 7 + (x["error"],)
        try:
            n, held = payload(x["picture"], x["coef"])
        except (ValueError, struct.error) as e:
            return (None,) * 7 + (str(e),)
        return n, len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(x["rgb"]), None

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return _map_media(df, media_col, list(keep), schema, row)
