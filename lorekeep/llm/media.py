"""Progressive JPEG as a media column: payload bytes as quantised coefficients, read back exactly.

A byte b becomes the coefficient b where b is 128 or more, and b - 255 otherwise: the 256 values of eight
significant bits. Coefficients are JPEG's own unit; they survive storing without loss, while samples don't. The image
is 4:2:0, every quantiser is 1, and the scans use spectral selection and successive approximation.
The decoder reads any Huffman-coded progressive JPEG of three components: it accumulates the scans into
coefficient arrays, transforms them back with an integer inverse DCT, upsamples the chroma and gives full-resolution RGB.
It works on all restart intervals of all images of a batch in lockstep.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import as_bytes, map_slices

UNIT = 576
FILL = 255
#: MCUs, or blocks in scans of one component, between restart marks.
RESTART = 8
_MCU_BLOCKS = 6
#: Bytes of texts written, and of images read, at once. A longer text or image is taken alone, strip by strip where much is needed for each byte.
WRITE_BYTES = 1 << 20
READ_BYTES = 2 << 20
#: Blocks whose codes are made together, each byte of which takes some hundred bytes meanwhile; and rows of samples turned into RGB together.
STRIP_BLOCKS = 1 << 14
STRIP_SAMPLES = 1 << 20
#: An image whose header claims more samples than this, and more than its bytes could hold, is reported as an error rather than read.
MOST_SAMPLES = 1 << 28
_COMMENT = b"payload="

# The order in which JPEG stores the 64 coefficients of a block: diagonal by diagonal.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8))))


@dataclass
class Huffman:
    """code and size of each symbol for writing; symbol and size by the next 16 bits for reading."""

    counts: tuple[int, ...]
    symbols: bytes
    code: np.ndarray = field(init=False)
    size: np.ndarray = field(init=False)
    symbol_of: np.ndarray = field(init=False)
    size_of: np.ndarray = field(init=False)
    entry: np.ndarray = field(init=False)  # symbol and size together

    def __post_init__(self) -> None:
        self.code, self.size = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.symbol_of, self.size_of = np.zeros(1 << 16, np.int16), np.full(1 << 16, 17, np.int8)
        self.entry = np.full(1 << 16, 31, np.int64)
        code = at = 0
        for bits, n in enumerate(self.counts, 1):
            for s in self.symbols[at : at + n]:
                self.code[s], self.size[s] = code, bits
                low = code << (16 - bits)
                self.entry[low : low + (1 << (16 - bits))] = s << 5 | bits
                self.symbol_of[low : low + (1 << (16 - bits))] = s
                self.size_of[low : low + (1 << (16 - bits))] = bits
                code += 1
            at += n
            code <<= 1

    def segment(self, kind: int) -> bytes:
        body = bytes([kind]) + bytes(self.counts) + self.symbols
        return b"\xff\xc4" + (len(body) + 2).to_bytes(2, "big") + body


def _counts(**sizes: int) -> tuple[int, ...]:
    return tuple(sizes.get(f"b{i}", 0) for i in range(1, 17))


#: For differences of up to nine bits.
DC_TABLE = Huffman(_counts(b4=10), bytes(range(10)))
#: A coefficient of seven bits without a run takes one bit; ends of bands, runs of sixteen and other sizes take more.
AC_TABLE = Huffman(_counts(b1=1, b4=4, b6=15), bytes([0x07, 0x00, 0x10, 0x20, 0x30, 0xF0, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x08, 0x17, 0x40, 0x50, 0x60, 0x70, 0x80, 0x90]))

#: (components, first and last coefficient, bits still missing before and after): what this encoder writes.
SCANS = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0))


def geometry(payload: int) -> tuple[int, int]:
    """(columns, rows) of MCUs that hold so many bytes."""
    n = -(-payload // (64 * _MCU_BLOCKS))
    across = int(np.ceil(np.sqrt(n)))
    return across, -(-n // across)


def _scan_blocks(components: tuple[int, ...], across: int, down: int) -> np.ndarray:
    """Numbers of the blocks in a scan's order. Block 6 * m + j belongs to MCU m: luma j = 0 to 3, then one of each chroma."""
    mcu = np.arange(across * down)
    if len(components) > 1:
        return (mcu[:, None] * _MCU_BLOCKS + np.arange(_MCU_BLOCKS)).reshape(-1)
    if components[0]:
        return mcu * _MCU_BLOCKS + 3 + components[0]
    grid = np.arange(down * 2)[:, None], np.arange(across * 2)[None, :]
    return ((grid[0] // 2 * across + grid[1] // 2) * _MCU_BLOCKS + grid[0] % 2 * 2 + grid[1] % 2).reshape(-1)


def _pack(values: np.ndarray, sizes: np.ndarray, segment: np.ndarray, n: int) -> list[bytes]:
    """The bits of each segment's values (16 bits at most each), filled with ones to whole bytes."""
    if len(sizes) and (sizes == 8).all():
        return _cut(values.astype(np.uint8).tobytes(), np.bincount(segment, minlength=n))
    bits = np.bincount(segment, weights=sizes, minlength=n).astype(np.int64)
    return _pack_bits(np.unpackbits(values.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[np.arange(16) >= 16 - sizes[:, None]], bits)


def _pack_bits(flat: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """The same from single bits, so many for each segment."""
    fill = -bits % 8
    if fill.any():
        flat = np.insert(flat, np.repeat(np.cumsum(bits), fill), 1)
    return _cut(np.packbits(flat).tobytes(), (bits + fill) // 8)


def _cut(whole: bytes, sizes: np.ndarray) -> list[bytes]:
    """Parts of so many bytes, with a zero byte behind each 255."""
    ends = np.cumsum(sizes).tolist()
    return [whole[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip([0, *ends], ends, strict=False)]


_SIZES = np.array([i.bit_length() for i in range(1 << 12)])


def _size_of(x: np.ndarray) -> np.ndarray:
    """Bits of each magnitude."""
    return _SIZES[x]


def _entropy(coef: np.ndarray, order: np.ndarray, which: np.ndarray, part: np.ndarray, n: int, lo: int, hi: int, before: int, after: int) -> list[bytes]:
    """The restart intervals of one scan of one or more images: their blocks in order, the component and the interval of each.

    Coefficients must be 0 or of 2 and more, so that none appears only in the refinement.
    """
    if not hi:
        dc = coef[order, 0].astype(np.int64)
        if before:
            return _pack(dc >> after & 1, np.ones(len(dc), np.int64), part, n)
        dc >>= after
        diff = dc.copy()
        for c in range(3):
            own = np.flatnonzero(which == c)
            diff[own[1:]] -= np.where(part[own[1:]] == part[own[:-1]], dc[own[:-1]], 0)
        size = _size_of(np.abs(diff))
        low = np.where(diff >= 0, diff, diff + (1 << size) - 1)
        values = np.stack([DC_TABLE.code[size], low], axis=1).reshape(-1)
        return _pack(values, np.stack([DC_TABLE.size[size], size], axis=1).reshape(-1), np.repeat(part, 2), n)
    band = coef[order, lo : hi + 1].astype(np.int32)
    there = band != 0
    if before:
        # One end-of-band run over the interval, then the next bit of every coefficient that isn't zero.
        count = np.bincount(part, minlength=n)
        kind = _size_of(count) - 1
        heads = np.stack([AC_TABLE.code[kind << 4], count - (1 << kind)], axis=1).reshape(-1)
        sizes = np.stack([AC_TABLE.size[kind << 4], kind], axis=1)
        own = np.bincount(part, weights=there.sum(axis=1), minlength=n).astype(np.int64)
        front = np.unpackbits(heads.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[np.arange(16) >= 16 - sizes.reshape(-1, 1)]
        size = sizes.sum(axis=1)
        flat = np.insert((np.abs(band[there]) >> after & 1).astype(np.uint8), np.repeat(np.cumsum(own) - own, size), front)
        return _pack_bits(flat, own + size)
    some, full = there.any(axis=1), there.all(axis=1)
    mixed = np.flatnonzero(some & ~full)
    r = np.flatnonzero(full)
    size = hi - lo + 1
    own = band[r].reshape(-1)
    low = np.abs(own) >> after
    bits = _size_of(low)
    values = AC_TABLE.code[bits] << bits | np.where(own >= 0, low, (1 << bits) - 1 - low)
    sizes = AC_TABLE.size[bits] + bits
    if len(r) == len(order):
        return _pack(values, sizes, np.repeat(part, size), n)
    # Blocks with some zeros one by one; an end of band for each block without any coefficient.
    empty = np.flatnonzero(~some)
    more = [_mixed(band[i].tolist(), after) for i in mixed.tolist()]
    blocks = np.concatenate([np.repeat(r, size), empty, np.repeat(mixed, [len(x) for x in more])])
    values = np.concatenate([values, np.full(len(empty), AC_TABLE.code[0]), np.array([v for x in more for v, _ in x], np.int64)])
    sizes = np.concatenate([sizes, np.full(len(empty), AC_TABLE.size[0]), np.array([k for x in more for _, k in x], np.int64)])
    place = np.argsort(blocks, kind="stable")
    return _pack(values[place], sizes[place], part[blocks[place]], n)


def _in_strips(coef: np.ndarray, order: np.ndarray, which: np.ndarray, part: np.ndarray, n: int, lo: int, hi: int, before: int, after: int) -> list[bytes]:
    """_entropy() for some intervals after the other; nothing is carried over from one interval to the next."""
    out: list[bytes] = []
    at = 0
    while at < len(order):
        to = min(len(order), at + STRIP_BLOCKS)
        to = len(order) if to == len(order) else int(np.searchsorted(part, part[to - 1] + 1))
        out += _entropy(coef, order[at:to], which[at:to], part[at:to] - part[at], int(part[to - 1] - part[at]) + 1, lo, hi, before, after)
        at = to
    return out


def _mixed(row: list[int], after: int) -> list[tuple[int, int]]:
    """Codes of a band in which some coefficients are zero: runs of zeros before each other one, and an end of band."""
    out = []
    run = 0
    for x in row:
        low = abs(x) >> after
        if not low:
            run += 1
            continue
        while run > 15:
            out.append((int(AC_TABLE.code[0xF0]), int(AC_TABLE.size[0xF0])))
            run -= 16
        bits = low.bit_length()
        symbol = run << 4 | bits
        if not AC_TABLE.size[symbol]:
            raise ValueError("this table has no code for such a run and size")
        out += [(int(AC_TABLE.code[symbol]), int(AC_TABLE.size[symbol])), (low if x > 0 else (1 << bits) - 1 - low, bits)]
        run = 0
    if run:
        out.append((int(AC_TABLE.code[0]), int(AC_TABLE.size[0])))
    return out


_HEAD = b"\xff\xd8\xff\xdb\x00\x43\x00" + b"\x01" * 64
_TABLES = DC_TABLE.segment(0x00) + AC_TABLE.segment(0x10) + b"\xff\xdd\x00\x04" + RESTART.to_bytes(2, "big")
_RESTARTS = [bytes([0xFF, 0xD0 + k]) for k in range(8)]


@functools.lru_cache(maxsize=4096)
def _scan_plan(components: tuple[int, ...], across: int, down: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of a scan over an image of that size: its blocks in order, the component and the restart interval of each, and the number of intervals."""
    order = _scan_blocks(components, across, down)
    per = RESTART * (_MCU_BLOCKS if len(components) > 1 else 1)
    return order, np.maximum(order % _MCU_BLOCKS - 3, 0), np.arange(len(order)) // per, -(-len(order) // per)


def encode_coefficients(coef: np.ndarray, sizes: list[tuple[int, int]], notes: list[bytes]) -> list[bytes]:
    """Progressive JPEGs of (across, down) MCUs each, from the coefficients of all of them (blocks x 64, in zigzag order; block 6 * m + j of MCU m)."""
    base = np.cumsum([0, *(a * d * _MCU_BLOCKS for a, d in sizes)])
    out = []
    for (across, down), note in zip(sizes, notes, strict=True):
        head = [_HEAD]
        if note:
            head.append(b"\xff\xfe" + (len(note) + 2).to_bytes(2, "big") + note)
        head.append(b"\xff\xc2\x00\x11\x08" + (down * 16).to_bytes(2, "big") + (across * 16).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00" + _TABLES)
        out.append(head)
    for components, lo, hi, before, after in SCANS:
        plans = [_scan_plan(components, a, d) for a, d in sizes]
        order = np.concatenate([p[0] + b for p, b in zip(plans, base, strict=False)])
        first = np.cumsum([0, *(p[3] for p in plans)])
        part = np.concatenate([p[2] + f for p, f in zip(plans, first, strict=False)])
        coded = _in_strips(coef, order, np.concatenate([p[1] for p in plans]), part, int(first[-1]), lo, hi, before, after)
        head = b"\xff\xda" + (6 + 2 * len(components)).to_bytes(2, "big") + bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([lo, hi, before << 4 | after])
        for i, x in enumerate(out):
            x.append(head)
            for k, own in enumerate(coded[first[i] : first[i + 1]]):
                if k:
                    x.append(_RESTARTS[(k - 1) % 8])
                x.append(own)
    return [b"".join(x) + b"\xff\xd9" for x in out]


def padded(data: bytes) -> bytes:
    """The payload: the data and as many bytes of FILL as make a positive multiple of UNIT."""
    return data + bytes([FILL]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


#: The coefficient of each byte.
_COEFFICIENT = np.array([b if b >= 128 else b - 255 for b in range(256)], np.int16)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEGs whose coefficients are the payloads' bytes."""
    sizes = [geometry(len(p)) for p in payloads]
    if not sizes:
        return []
    flat = b"".join(p + bytes(a * d * _MCU_BLOCKS * 64 - len(p)) for p, (a, d) in zip(payloads, sizes, strict=True))
    coef = _COEFFICIENT[np.frombuffer(flat, np.uint8)]
    at = 0
    for p, (a, d) in zip(payloads, sizes, strict=True):
        end = at + a * d * _MCU_BLOCKS * 64
        coef[at + len(p) : end] = 0
        at = end
    return encode_coefficients(coef.reshape(-1, 64), sizes, [_COMMENT + str(len(p)).encode() for p in payloads])


# Reading


@dataclass
class Image:
    width: int
    height: int
    sampling: list[tuple[int, int]]
    quant: list[np.ndarray]
    note: bytes
    first: list[int] = field(default_factory=list)  # of each component its first block
    shape: list[tuple[int, int]] = field(default_factory=list)  # and rows and columns of blocks, whole MCUs
    scans: list = field(default_factory=list)


def _parse(data: bytes) -> Image:
    """Headers and the place of every entropy-coded part."""
    at, tables, quant, image, restart, note, order = 2, {}, {}, None, 0, b"", []
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (tuple(body[1:17]), body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDD:
            restart = int.from_bytes(body, "big")
        elif mark == 0xFE:
            note = body
        elif mark == 0xC2:
            if body[0] != 8 or body[5] != 3:
                raise ValueError("three components of eight bits expected")
            order = [body[6 + 3 * i] for i in range(3)]
            if any(not 1 <= x <= 4 for i in range(3) for x in (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15)):
                raise ValueError("no such sampling")
            image = Image(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(3)], [body[8 + 3 * i] for i in range(3)], b"")
        elif 0xC0 <= mark <= 0xCF and mark != 0xCC:
            raise ValueError("a progressive Huffman-coded JPEG expected")
        elif mark == 0xDA:
            if image is None:
                raise ValueError("no frame header")
            n = body[0]
            use = [(order.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            parts, begin = [], at
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    at = len(data)
                    break
                if data[at + 1] == 0:
                    at += 2
                elif 0xD0 <= data[at + 1] <= 0xD7:
                    parts.append((begin, at))
                    at += 2
                    begin = at
                else:
                    break
            parts.append((begin, at))
            lo, hi, bits = body[1 + 2 * n : 4 + 2 * n]
            coded = tuple(tables.get((0x10 if hi else 0) | (t & 15 if hi else t >> 4)) for _, t in use)
            image.scans.append((tuple(c for c, _ in use), lo, hi, bits >> 4, bits & 15, coded, restart, [data[a:b].replace(b"\xff\x00", b"\xff") for a, b in parts]))
    if image is None:
        raise ValueError("no frame header")
    # As many as its bytes could hold, a bit for each, are no mere claim.
    if not image.width or not image.height or image.width * image.height > max(MOST_SAMPLES, 8 * len(data)):
        raise ValueError("an image without samples, or with too many")
    image.note = note
    image.quant = [quant[q] for q in image.quant]
    wide, high = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
    across, down = -(-image.width // (8 * wide)), -(-image.height // (8 * high))
    image.shape = [(down * v, across * h) for h, v in image.sampling]
    image.first = [0, *np.cumsum([r * c for r, c in image.shape])[:-1].tolist()]
    return image


@functools.lru_cache(maxsize=4096)
def _lane_blocks(width: int, height: int, sampling: tuple[tuple[int, int], ...], components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of an image in a scan's order, the component of each among those of the scan, and the blocks of one MCU."""
    wide, high = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    shape = [(down * v, across * h) for h, v in sampling]
    first = [0, *np.cumsum([r * c for r, c in shape])[:-1].tolist()]
    if len(components) == 1:
        c = components[0]
        h, v = sampling[c]
        cols, rows = -(-width * h // (8 * wide)), -(-height * v // (8 * high))
        blocks = (np.arange(rows)[:, None] * shape[c][1] + np.arange(cols)).reshape(-1) + first[c]
        return blocks, np.zeros(len(blocks), np.int64), 1
    y, x = np.arange(down)[:, None], np.arange(across)[None, :]
    parts, which = [], []
    for k, c in enumerate(components):
        h, v = sampling[c]
        for dy in range(v):
            for dx in range(h):
                parts.append(((y * v + dy) * shape[c][1] + x * h + dx).reshape(-1) + first[c])
                which.append(k)
    return np.stack(parts, axis=1).reshape(-1), np.tile(which, across * down), len(parts)


class _Bits:
    """Bit positions of many lanes in one buffer."""

    def __init__(self, parts: list[bytes]):
        starts = np.cumsum([0, *(len(p) + 8 for p in parts)])[:-1]
        self.buf = np.frombuffer(b"".join(p + b"\xff" * 8 for p in parts) + bytes(8), np.uint8)
        self.window = np.ndarray((len(self.buf) - 3,), ">u4", self.buf, 0, (1,))
        self.at = starts.astype(np.int64) * 8

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        """The next 16 bits."""
        at = self.at[lanes]
        return (self.window[at >> 3].astype(np.int64) >> (16 - (at & 7))) & 0xFFFF

    def read(self, lanes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The next `sizes` bits, 16 at most."""
        out = self.peek(lanes) >> (16 - sizes)
        self.at[lanes] += sizes
        return out

    def symbol(self, lanes: np.ndarray, table: Huffman) -> np.ndarray:
        x = self.peek(lanes)
        size = table.size_of[x].astype(np.int64)
        if len(size) and size.max() > 16:
            raise ValueError("a code that no table has")
        self.at[lanes] += size
        return table.symbol_of[x].astype(np.int64)

    def run(self, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """`count` single bits from each position on."""
        total = int(count.sum())
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(total)
        return self.buf[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits >> np.maximum(size - 1, 0) & 1, bits, bits - (1 << size) + 1)


def _first_band(bits: _Bits, coef: np.ndarray, blocks: np.ndarray, first: np.ndarray, count: np.ndarray, lo: int, hi: int, after: int, table: Huffman) -> None:
    """The first scan of a band. Lane l has the blocks blocks[first[l]:first[l]+count[l]]; one symbol of each lane at a time."""
    flat = coef.reshape(-1)
    place = blocks * 64
    window = np.ndarray((len(bits.buf) - 7,), ">u8", bits.buf, 0, (1,))
    at, now, end, k = bits.at, first, first + count, np.full(len(count), lo)
    while len(at):
        ahead = window[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        entry = table.entry[(ahead >> np.uint64(48)).astype(np.int64)]
        code, run, size = entry & 31, entry >> 9, entry >> 5 & 15
        if (code == 31).any():
            raise ValueError("a code that no table has")
        if size.all():
            k = k + run
            if k.max() > hi:
                raise ValueError("a coefficient beyond its band")
            x = (ahead << code.astype(np.uint64) >> (64 - size).astype(np.uint64)).astype(np.int64)
            flat[place[now] + k] = _signed(x, size) << after
            at = at + code + size
            k += 1
            over = k > hi
            if not over.any():
                continue
            now = now + over
            k[over] = lo
        else:
            ends = (size == 0) & (run < 15)
            more = np.where(ends, run, size)
            x = np.where(more > 0, (ahead << code.astype(np.uint64) >> (64 - np.maximum(more, 1)).astype(np.uint64)).astype(np.int64), 0)
            at = at + code + more
            k = k + np.where(ends, 0, run)
            some = np.flatnonzero(size)
            if len(some):
                if k[some].max() > hi:
                    raise ValueError("a coefficient beyond its band")
                flat[place[now[some]] + k[some]] = _signed(x[some], size[some]) << after
            k += 1
            over = ends | (k > hi)
            now = now + np.where(ends, (1 << np.where(ends, run, 0)) + x, over)
            k[over] = lo
        live = now < end
        if not live.all():
            at, now, end, k = at[live], now[live], end[live], k[live]


def _refine_band(bits: _Bits, coef: np.ndarray, blocks: np.ndarray, first: np.ndarray, count: np.ndarray, lo: int, hi: int, after: int, table: Huffman) -> None:
    """A refinement scan of a band. Lane l has the blocks blocks[first[l]:first[l]+count[l]]."""
    n = len(first)
    b, k, run = np.zeros(n, np.int64), np.full(n, lo), np.zeros(n, np.int64)
    column = np.arange(lo, hi + 1)
    live = np.arange(n)
    while len(live := live[b[live] < count[live]]):
        # Lanes inside an end-of-band run: every coefficient of the block that isn't zero has its next bit here.
        over = live[run[live] > 0]
        if len(over):
            at = blocks[first[over] + b[over]]
            band = coef[at, lo : hi + 1]
            use = (band != 0) & (column >= k[over][:, None])
            size = use.sum(axis=1)
            r, c = np.nonzero(use)
            add = bits.run(bits.at[over], size).astype(np.int64) << after
            bits.at[over] += size
            coef[at[r], c + lo] += np.where(band[r, c] > 0, add, -add).astype(coef.dtype)
            run[over] -= 1
            b[over] += 1
            k[over] = lo
            continue
        rs = bits.symbol(live, table)
        zeros, size = rs >> 4, rs & 15
        ends = (size == 0) & (zeros < 15)
        e = live[ends]
        run[e] = (1 << zeros[ends]) + bits.read(e, zeros[ends])
        go = live[~ends]
        if not len(go):
            continue
        zeros, size = zeros[~ends], size[~ends]
        sign = np.where(bits.read(go, np.minimum(size, 1)), 1, -1) << after
        moving = np.arange(len(go))
        while len(moving):
            lane = go[moving]
            at = blocks[first[lane] + b[lane]]
            now = coef[at, k[lane]]
            filled = now != 0
            f = lane[filled]
            add = bits.read(f, np.ones(len(f), np.int64)) << after
            coef[at[filled], k[f]] += np.where(now[filled] > 0, add, -add).astype(coef.dtype)
            stop = ~filled & (zeros[moving] == 0)
            new = stop & (size[moving] > 0)
            coef[at[new], k[lane[new]]] = sign[moving[new]]
            zeros[moving[~filled]] -= 1
            k[lane] += 1
            moving = moving[~stop & (k[lane] <= hi)]
        done = go[k[go] > hi]
        b[done] += 1
        k[done] = lo


def coefficients(images: list[Image]) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of all blocks of all images, first block of each image)."""
    sizes = [im.first[2] + im.shape[2][0] * im.shape[2][1] for im in images]
    base = np.cumsum([0, *sizes])
    coef = np.zeros((int(base[-1]), 64), dtype=np.int32)
    made: dict[tuple, Huffman] = {}
    for nth in range(max((len(im.scans) for im in images), default=0)):
        alike: dict[tuple, list[int]] = {}
        for i, im in enumerate(images):
            if nth < len(im.scans):
                alike.setdefault((*im.scans[nth][:6], tuple(im.sampling)), []).append(i)
        for (components, lo, hi, before, after, coded, _), members in alike.items():
            tables = [made.setdefault(t, Huffman(*t)) if t else None for t in coded]
            parts, blocks, which, count = [], [], [], []
            for i in members:
                own, comp, mcu = _lane_blocks(images[i].width, images[i].height, tuple(images[i].sampling), components)
                restart, data = images[i].scans[nth][6:]
                per = restart * mcu if restart else len(own)
                used = 0
                for x in data[: -(-len(own) // per)]:
                    parts.append(x)
                    count.append(min(per, len(own) - used))
                    used += count[-1]
                blocks.append(own[:used] + base[i])
                which.append(comp[:used])
            if not parts:
                continue
            bits, blocks, which, count = _Bits(parts), np.concatenate(blocks), np.concatenate(which), np.array(count)
            first = np.cumsum(count) - count
            if not hi:
                if before:
                    coef[blocks, 0] |= bits.run(bits.at, count).astype(np.int32) << after
                    continue
                guess = np.zeros((len(count), len(components)), np.int64)
                for step in range(int(count.max())):
                    lane = np.flatnonzero(count > step)
                    comp = which[first[lane] + step]
                    size = np.zeros(len(lane), np.int64)
                    for c, t in enumerate(tables):
                        own = comp == c
                        size[own] = bits.symbol(lane[own], t)
                    guess[lane, comp] += np.where(size > 0, _signed(bits.read(lane, size), size), 0)
                    coef[blocks[first[lane] + step], 0] = guess[lane, comp] << after
            elif before:
                _refine_band(bits, coef, blocks, first, count, lo, hi, after, tables[0])
            else:
                _first_band(bits, coef, blocks, first, count, lo, hi, after, tables[0])
    return coef, base


def _inverse_dct() -> np.ndarray:
    """64 x 64 integers: samples, times 2 ** 20, from coefficients in zigzag order."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    return np.rint(np.kron(one, one)[ZIGZAG] * (1 << 20))


_IDCT = _inverse_dct()


def _samples(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples (blocks x 64) from coefficients. Sums of whole numbers below 2 ** 53 are exact in any order, so equal blocks give equal samples."""
    out = np.empty(coef.shape, np.uint8)
    for i in range(0, len(coef), 8192):
        x = (coef[i : i + 8192] * quant).astype(np.float64) @ _IDCT
        out[i : i + 8192] = np.clip(np.floor((x + (1 << 19)) * 2.0**-20) + 128, 0, 255)
    return out


def planes(image: Image, coef: np.ndarray, samples: np.ndarray | None = None) -> np.ndarray:
    """Full-resolution RGB (height x width x 3) from an image's own coefficients, or from its samples where they are known."""
    wide, high = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
    parts = []
    for c in range(3):
        rows, cols = image.shape[c]
        own = slice(image.first[c], image.first[c] + rows * cols)
        parts.append((_samples(coef[own], image.quant[c]) if samples is None else samples[own]).reshape(rows, cols, 8, 8))
    out = np.empty((image.height, image.width, 3), np.uint8)
    step = max(1, STRIP_SAMPLES // (image.width * 8 * high))  # rows of MCUs
    for at in range(0, -(-image.height // (8 * high)), step):
        full = []
        for (h, v), x in zip(image.sampling, parts, strict=True):
            x = x[at * v : (at + step) * v]
            plane = x.transpose(0, 2, 1, 3).reshape(x.shape[0] * 8, x.shape[1] * 8).astype(np.int32)
            if high % v or wide % h:
                # Factors that don't divide each other: the nearest sample.
                plane = plane[np.arange(x.shape[0] * 8 * high // v) * v // high][:, np.arange(x.shape[1] * 8 * wide // h) * h // wide]
            elif (h, v) != (wide, high):
                plane = np.repeat(np.repeat(plane, high // v, axis=0), wide // h, axis=1)
            full.append(plane)
        strip = out[at * 8 * high : (at + step) * 8 * high]
        y, cb, cr = (x[: strip.shape[0], : image.width] for x in full)
        y, cb, cr = y << 16, cb - 128, cr - 128
        # The usual colour matrix, times 2 ** 16.
        for k, x in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
            strip[:, :, k] = np.clip((x + (1 << 15)) >> 16, 0, 255)
    return out


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and a hash of which cells of an 8 x 8 grid are lighter than the image."""
    h, w, _ = rgb.shape
    sums, lines = np.zeros(3, np.int64), np.empty((h, 8), np.int64)
    rows, cols = np.arange(8) * h // 8, np.arange(8) * w // 8
    step = max(1, STRIP_SAMPLES // w)
    for at in range(0, h, step):
        strip = rgb[at : at + step]
        sums += strip.sum(axis=(0, 1), dtype=np.int64)
        lines[at : at + step] = np.add.reduceat(strip.sum(axis=2, dtype=np.int64), cols, axis=1)
    cell = np.add.reduceat(lines, rows, axis=0)
    area = np.diff(np.append(rows, h))[:, None] * np.diff(np.append(cols, w))
    light = cell * (h * w) > area * int(sums.sum())
    return f"{w}x{h};{','.join(str(int(s) * 1000 // (h * w)) for s in sums)};{np.packbits(light.reshape(-1)).tobytes().hex()}"


def _payload(image: Image, coef: np.ndarray) -> bytes:
    """What encode_payloads() stored in an image; empty for any other."""
    if not image.note.startswith(_COMMENT) or image.sampling != [(2, 2), (1, 1), (1, 1)]:
        return b""
    n = int(image.note[len(_COMMENT) :])
    across, down = image.shape[0][1] // 2, image.shape[0][0] // 2
    # From component order to the order in which the payload was laid.
    at = np.empty(across * down * _MCU_BLOCKS, np.int64)
    for c in range(3):
        at[_scan_plan((c,), across, down)[0]] = np.arange(image.shape[c][0] * image.shape[c][1]) + image.first[c]
    x = coef[at].reshape(-1)[:n]
    return np.where(x > 0, x, x + 255).astype(np.uint8).tobytes()


def decode(media: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, RGB) of each image; the payload of images that encode_payloads() didn't make is empty. Raises for what isn't a progressive JPEG of three components."""
    images = [_parse(m) for m in media]
    coef, base = coefficients(images)
    # The usual case: all of one kind, transformed together.
    plain = all((q == 1).all() for im in images for q in im.quant)
    samples = _samples(coef, np.ones(64, np.int32)) if plain else None
    out = []
    for i, im in enumerate(images):
        own = coef[base[i] : base[i + 1]]
        out.append((_payload(im, own), planes(im, own, samples[base[i] : base[i + 1]] if plain else None)))
    return out


def decode_each(media: list[bytes]) -> list[tuple[bytes, np.ndarray] | str]:
    """decode(), with what is wrong in place of an image that can't be read; the others are read as they are."""
    try:
        return decode(media)
    except Exception as e:  # what broken bytes lead to can't be listed
        if len(media) == 1:
            return [f"{type(e).__name__}: {e}"[:200]]
        half = len(media) // 2
        return decode_each(media[:half]) + decode_each(media[half:])


def to_media(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_bytes (of the text as UTF-8) and media, a progressive JPEG that holds the padded text. Null texts count as empty. Texts of any length are stored whole. Repeated rows and rows with equal or null ids each get a row. An empty table gives an empty result."""
    own = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t"))

    def work():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = as_bytes(batch.column(1))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(encode_payloads([padded(x) for x in raw]), pa.binary())], names=["i", "n_bytes", "media"])

        return each

    return map_slices(own, "t", f"i {own.schema['i'].dataType.simpleString()}, n_bytes long, media binary", work, WRITE_BYTES).withColumnRenamed("i", id)


def from_media(stored: DataFrame, media: str = "media") -> DataFrame:
    """The table with payload (the bytes read back), height, width, rgb (height x width x 3 bytes), feature and error added.

    Rows without media get nulls. Bytes that aren't a progressive JPEG of three components get nulls and say why in error, and don't disturb other rows. Repeated rows each get a row. An empty table gives an empty result. Columns of these names in the input are replaced.
    """
    new = ["payload", "height", "width", "rgb", "feature", "error"]
    own = stored.select(F.col(media).alias("m_"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(stored.columns)])
    kept = own.schema.fields[1:]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "payload binary, height int, width int, rgb binary, feature string, error string"])

    def work():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = batch.column(0).to_pylist()
            some = [x for x in raw if x is not None]
            got = iter(decode_each(some))
            rows = [next(got) if x is not None else None for x in raw]
            wrong = [r if isinstance(r, str) else None for r in rows]
            rows = [None if isinstance(r, str) else r for r in rows]
            columns = [
                pa.array([r and r[0] for r in rows], pa.binary()), pa.array([r and r[1].shape[0] for r in rows], pa.int32()), pa.array([r and r[1].shape[1] for r in rows], pa.int32()),
                pa.array([r and r[1].tobytes() for r in rows], pa.binary()), pa.array([r and feature_of(r[1]) for r in rows], pa.string()),
                pa.array(wrong, pa.string()),
            ]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*(f.name for f in kept), *new])

        return each

    out = map_slices(own, "m_", schema, work, READ_BYTES)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(stored.columns) if c not in new], *new)
