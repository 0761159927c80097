"""Words of many texts at once as spans of one byte buffer, and their XXH64 hashes in numpy.

UTF-8 keeps ASCII bytes apart from the bytes of longer characters, so word rules whose separators are
all ASCII can be applied to bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Spans longer than this are hashed one at a time.
_LONG = 512
_PAD = bytes(40)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(separators: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes that separate words, given as closed ranges."""
    out = np.zeros(256, dtype=bool)
    for a, b in separators:
        out[a : b + 1] = True
    return out


SPACES = table([(0x20, 0x20), (0x09, 0x0D)])
NOT_ALNUM = table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


@dataclass
class Words:
    """buf: all texts, each between separators. starts, lens: of every word. bounds: row i has the words bounds[i]:bounds[i+1]."""

    buf: np.ndarray
    starts: np.ndarray
    lens: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        return xxh64(self.buf, self.starts, self.lens, seed)


def split(texts: list[bytes], separators: np.ndarray, lower: bool = True) -> Words:
    """Words of every text: maximal runs of bytes that aren't separators."""
    sep = b"\n" if separators[10] else bytes([int(np.flatnonzero(separators)[0])])
    buf = np.frombuffer(sep + sep.join(texts) + sep + _PAD, dtype=np.uint8)
    if lower:
        buf = LOWER[buf]
    n = len(buf) - len(_PAD)
    space = separators[buf[:n]]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    first = 1 + np.cumsum(np.fromiter((len(x) + 1 for x in texts), dtype=np.int64, count=len(texts)))
    bounds = np.concatenate([[0], np.searchsorted(starts, first)])
    return Words(buf, starts, ends - starts, bounds)


def same(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word i[k] of a and word j[k] of b have the same bytes, for each k."""
    out = a.lens[i] == b.lens[j]
    wide_a, wide_b = (np.ndarray((len(x.buf) - 7,), "<u8", np.ascontiguousarray(x.buf), 0, (1,)) for x in (a, b))
    on, step = np.flatnonzero(out & (a.lens[i] > 0)), 0
    while len(on):
        left = a.lens[i[on]] - step
        keep = np.uint64(2**64 - 1) >> (np.uint64(8) * np.maximum(8 - left, 0).astype(np.uint64))
        out[on] = (wide_a[a.starts[i[on]] + step] ^ wide_b[b.starts[j[on]] + step]) & keep == 0
        on, step = on[out[on] & (left > 8)], step + 8
    return out


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(index, of): a word of each kind, and the kind of each word. Words are told apart by their hashes first and by their bytes in the end."""
    _, index, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
    of = of.reshape(-1)
    own = np.flatnonzero(index[of] != np.arange(len(of)))
    clash = own[~same(words, own, words, index[of[own]])]
    if len(clash):
        known: dict[bytes, int] = {}
        more: list[int] = []
        for k in clash.tolist():
            b = words.buf[words.starts[k] : words.starts[k] + words.lens[k]].tobytes()
            if b not in known:
                known[b] = len(index) + len(more)
                more.append(k)
            of[k] = known[b]
        index = np.concatenate([index, more])
    return index, of


def spaced(words: Words) -> Words:
    """The same words with exactly one space between neighbours, so that a run of words is one span."""
    total = int(words.lens.sum()) + len(words)
    starts = np.cumsum(words.lens + 1) - words.lens - 1
    at = np.arange(total) + np.repeat(words.starts - starts, words.lens + 1)
    buf = words.buf[at]
    buf[starts + words.lens] = 32
    return Words(np.concatenate([buf, np.zeros(len(_PAD), np.uint8)]), starts, words.lens, words.bounds)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of buf[s:s+n] for each span; buf must reach 8 bytes beyond the last."""
    buf = np.ascontiguousarray(buf)
    wide = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    half = np.ndarray((len(buf) - 3,), "<u4", buf, 0, (1,))
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = lens.astype(np.uint64) + (s + _P5)
        pos = starts.astype(np.int64)
        big = np.flatnonzero((lens >= 32) & (lens <= _LONG))
        if len(big):
            p, left = pos[big], lens[big] // 32
            v = [np.full(len(big), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            for k in range(int(left.max())):
                on = np.flatnonzero(left > k)
                for i in range(4):
                    v[i][on] = _round(v[i][on], wide[p[on] + 32 * k + 8 * i])
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _round(np.zeros_like(x), x)) * _P1 + _P4
            h[big] = acc + lens[big].astype(np.uint64)
            pos[big] += left * 32
        rest = lens & 31
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            if not len(on):
                break
            x = h[on] ^ _round(np.zeros(len(on), np.uint64), wide[pos[on]])
            h[on] = _rotl(x, 27) * _P1 + _P4
            pos[on] += 8
        on = np.flatnonzero(rest & 4)
        if len(on):
            h[on] = _rotl(h[on] ^ (half[pos[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
            pos[on] += 4
        for k in range(3):
            on = np.flatnonzero((rest & 3) > k)
            if not len(on):
                break
            h[on] = _rotl(h[on] ^ (buf[pos[on]].astype(np.uint64) * _P5), 11) * _P1
            pos[on] += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h = h ^ (h >> np.uint64(32))
    for i in np.flatnonzero(lens > _LONG):
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : starts[i] + lens[i]].tobytes(), seed)
    return h
