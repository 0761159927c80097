"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

All tokens of the vocabulary are compiled, with the ids that they encode to, into a minimal acyclic automaton: suffixes are
shared, and each edge carries how many entries precede it, so the sum along a path is the entry's number and
leads to its ids. Automaton, merges and vocabulary are one flat file that every worker of a machine
maps into memory. Pieces that the automaton doesn't hold are merged pair by pair, exactly as the
ranks order it. Splitting, look-up, merging and decoding work on all pieces of a run of texts at once.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _flat, _words
from ._batches import as_bytes, map_slices

#: Pieces up to this many bytes are merged side by side, longer ones one at a time.
WIDE = 32
_NONE = np.int32(2**31 - 1)

# White space as the splitting pattern has it.
_WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# Endings that the pattern cuts off after an apostrophe.
_ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    for a, b in _WHITE:
        out[a : b + 1] = SPACE
    return out


def minimal_automaton(entries: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted, distinct entries, with entry numbers as outputs.

    classes: column of each byte value. edge: number of the edge from a state by a column, plus 1; 0 for none. target and skip of each edge. final: of each state. State 0 is the start.
    """
    register: dict[tuple, int] = {}
    kept: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(kept)
            kept.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open nodes: [final, [(byte, child)]]
    before = b""

    def close(to: int) -> None:
        while len(path) - 1 > to:
            child = freeze(path.pop())
            path[-1][1].append((before[len(path) - 1], child))

    for word in entries:
        same = len(os.path.commonprefix([before, word]))
        close(same)
        path.extend([False, []] for _ in range(len(word) - same))
        path[-1][0] = True
        before = word
    close(0)
    start = freeze(path[0])
    below = [0] * len(kept)  # entries that a state leads to; children are kept before their parents
    for i, (final, edges) in enumerate(kept):
        below[i] = final + sum(below[c] for _, c in edges)
    number = {start: 0} | {s: i + 1 for i, s in enumerate(x for x in range(len(kept)) if x != start)}
    used = sorted({b for _, edges in kept for b, _ in edges})
    classes = np.zeros(256, dtype=np.int32)
    classes[used] = np.arange(1, len(used) + 1)
    edge = np.zeros((len(kept), len(used) + 1), dtype=np.int32)
    target, skip, final_of = [], [], np.zeros(len(kept), dtype=bool)
    for i, (final, edges) in enumerate(kept):
        ahead = int(final)
        final_of[number[i]] = final
        for b, c in edges:
            target.append(number[c])
            skip.append(ahead)
            edge[number[i], classes[b]] = len(target)
            ahead += below[c]
    return {"classes": classes, "edge": edge, "target": np.array([0, *target], np.int32), "skip": np.array([0, *skip], np.int32), "final": final_of}


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable Latin-1 for itself, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    """Slot of each key in a table of `size` slots, a power of two."""
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def load_vocabulary(path: str) -> dict[str, np.ndarray]:
    """Vocabulary and merges of a tokenizer file, as arrays. special: text and id of tokens that stand for themselves."""
    got = json.loads(Path(path).read_text(encoding="utf-8"))
    model = got["model"]
    char = _byte_of_char()
    vocab = {k: v for k, v in model["vocab"].items()}
    tokens = {i: bytes(char[c] for c in t) for t, i in vocab.items()}
    specials = [(t["content"], t["id"]) for t in got.get("added_tokens", [])]
    tokens |= {i: t.encode() for t, i in specials}
    flat = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    size = 1 << max(4, (2 * len(pairs)).bit_length())
    left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
    keys = np.full(size, -1, dtype=np.int64)
    ranks = np.full(size, _NONE, dtype=np.int32)
    at = _slot(left << 32 | right, size)
    for rank, (key, slot) in enumerate(zip((left << 32 | right).tolist(), at.tolist(), strict=True)):
        while keys[slot] >= 0:
            slot = (slot + 1) % size
        keys[slot], ranks[slot] = key, rank
    single = np.zeros(256, dtype=np.int32)
    for c, b in char.items():
        single[b] = vocab[c]
    return {
        "token_bytes": np.frombuffer(b"".join(flat), np.uint8), "token_first": np.cumsum([0, *map(len, flat)]), "pair_keys": keys, "pair_ranks": ranks,
        "merged": np.array([vocab[a + b] for a, b in pairs], dtype=np.int32), "single": single, "char_class": _classes(),
        "special": np.frombuffer(json.dumps(specials).encode(), np.uint8),
    }


class Encoder:
    """Encodes and decodes runs of texts with the arrays of load_vocabulary() and, where there is one, of a lexicon."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.specials = [(t.encode(), i) for t, i in json.loads(bytes(arrays["special"]))]
        self.token_len = np.diff(arrays["token_first"])

    # Splitting

    def pieces(self, texts: list[bytes]) -> _words.Words:
        """Spans of the pieces that are merged on their own."""
        text = "\x00".join(t.decode("utf-8", "replace") for t in texts) + "\x00"
        point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        n = len(point)
        kind = self.a["char_class"][point]
        size = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(size)])
        lens = np.fromiter((len(t.decode("utf-8", "replace")) + 1 for t in texts), np.int64, len(texts)) if offset[-1] != n else np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        end = np.cumsum(lens)  # just behind each text's closing mark
        mark = np.zeros(n + 1, dtype=bool)
        mark[end - 1] = True
        kind = np.where(mark[:n], np.uint8(9), kind)
        start = np.ones(n, dtype=bool)
        start[1:] = (kind[1:] != kind[:-1]) | mark[1:n]
        # The last of a run of white space belongs to what follows it: alone, or as a blank before it.
        white = kind == SPACE
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~mark[1:n])
        start[last] = True
        start[last[point[last] == 32] + 1] = False
        # An apostrophe that begins a piece cuts off certain endings.
        ticks = np.flatnonzero((point == 39) & start & ~mark[:n])
        for i in ticks[kind[ticks + 1] == LETTER].tolist():
            for e in _ENDINGS:
                if text.startswith(e, i + 1):
                    start[i + 1] = False
                    if i + 1 + len(e) < n:
                        start[i + 1 + len(e)] = True
                    break
        at = np.flatnonzero(start)
        stop = np.append(at[1:], n)
        real = ~mark[at]
        at, stop = at[real], stop[real]
        buf = np.frombuffer(text.encode("utf-8", "surrogatepass") + bytes(40), dtype=np.uint8)
        bounds = np.searchsorted(at, np.concatenate([[0], end]))
        return _words.Words(buf, offset[at], offset[stop] - offset[at], bounds)

    # Look-up and merging

    def _find(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Number of each span's entry in the lexicon, or -1."""
        if "edge" not in self.a:
            return np.full(len(starts), -1, np.int64)
        a = self.a
        state, entry = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        on = np.arange(len(starts))
        out = np.full(len(starts), -1, np.int64)
        step = 0
        while len(on):
            ended = lens[on] == step
            done = on[ended]
            out[done] = np.where(a["final"][state[done]], entry[done], -1)
            on = on[~ended]
            e = a["edge"][state[on], a["classes"][buf[starts[on] + step]]]
            on, e = on[e > 0], e[e > 0]
            state[on] = a["target"][e]
            entry[on] += a["skip"][e]
            step += 1
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, _NONE where they don't merge."""
        keys, ranks = self.a["pair_keys"], self.a["pair_ranks"]
        key = left.astype(np.int64) << 32 | right
        slot = _slot(key, len(keys))
        found = keys[slot]
        out = np.where(found == key, ranks[slot], _NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(keys) - 1)
            found = keys[slot[open_]]
            same = found == key[open_]
            out[open_[same]] = ranks[slot[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        return out

    def _merge_wide(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of ids (count of them in each) until no pair has a rank; one merge a row and round."""
        n, w = ids.shape
        if w < 2:
            return ids, count
        rank = np.full((n, w - 1), _NONE, dtype=np.int32)
        r, c = np.nonzero(np.arange(1, w) < count[:, None])
        rank[r, c] = self._ranks(ids[r, c], ids[r, c + 1])
        done_ids, done_count = np.zeros_like(ids), np.zeros_like(count)
        live = np.arange(n)
        column = np.arange(w)
        while len(live):
            j = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), j]
            stay = best < _NONE
            if not stay.all():
                done_ids[live[~stay]], done_count[live[~stay]] = ids[~stay], count[~stay]
                live, ids, count, rank, j, best = live[stay], ids[stay], count[stay], rank[stay], j[stay], best[stay]
                if not len(live):
                    break
            row = np.arange(len(live))
            ids[row, j] = self.a["merged"][best]
            shift = np.minimum(column + (column > j[:, None]), w - 1)
            ids = np.take_along_axis(ids, shift, axis=1)
            rank = np.take_along_axis(rank, np.minimum(shift[:, : w - 1], w - 2), axis=1)
            count = count - 1
            rank[column[: w - 1] >= (count - 1)[:, None]] = _NONE
            for near in (j - 1, j):
                ok = np.flatnonzero((near >= 0) & (near + 1 < count))
                rank[ok, near[ok]] = self._ranks(ids[ok, near[ok]], ids[ok, near[ok] + 1])
        return done_ids, done_count

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length, in about n log n steps."""
        ids = self.a["single"][np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: list[int]) -> None:
            i = [x for x in i if x >= 0 and after[x] < n]
            if i:
                got = self._ranks(np.array([ids[x] for x in i]), np.array([ids[after[x]] for x in i])).tolist()
                for x, r in zip(i, got, strict=True):
                    if r < _NONE:
                        heapq.heappush(heap, (r, x, ids[x], ids[after[x]]))

        offer(list(range(n - 1)))
        while heap:
            r, x, a, b = heapq.heappop(heap)
            y = after[x]
            if ids[x] != a or y >= n or ids[y] != b:
                continue
            ids[x], ids[y] = int(self.a["merged"][r]), -1
            after[x] = after[y]
            if after[y] < n:
                before[after[y]] = x
            offer([before[x], x])
        return [x for x in ids if x >= 0]

    def _encode_spans(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): span i has ids[first[i]:first[i+1]]."""
        n = len(starts)
        count = np.zeros(n, np.int64)
        entry = self._find(buf, starts, lens)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # spans, count of each, their ids
        held = np.flatnonzero(entry >= 0)
        if len(held):
            first = self.a["entry_first"]
            size = first[entry[held] + 1] - first[entry[held]]
            parts.append((held, size, self.a["entry_ids"][np.repeat(first[entry[held]] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]))
        rest = np.flatnonzero(entry < 0)
        low = 0
        for w in (4, 8, 12, 16, 24, WIDE):
            own = rest[(lens[rest] > low) & (lens[rest] <= w)]
            low = w
            if len(own):
                column = np.arange(w)
                ids = self.a["single"][buf[starts[own][:, None] + column]]
                ids, size = self._merge_wide(ids, lens[own].astype(np.int64))
                parts.append((own, size, ids[column < size[:, None]]))
        for i in rest[lens[rest] > WIDE].tolist():
            ids = self.merge_one(buf[starts[i] : starts[i] + lens[i]].tobytes())
            parts.append((np.array([i]), np.array([len(ids)]), np.array(ids, np.int32)))
        for own, size, _ in parts:
            count[own] = size
        first = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(int(first[-1]), dtype=np.int32)
        for own, size, ids in parts:
            out[np.repeat(first[own] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] = ids
        return out, first

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): text i has ids[first[i]:first[i+1]]."""
        segments, own, special = [], [], []
        for i, t in enumerate(texts):
            parts = [(t, -1)]
            for mark, id in self.specials:
                if mark in t:
                    parts = [y for x, s in parts for y in ([(x, s)] if s >= 0 or mark not in x else [z for p in x.split(mark) for z in ((p, -1), (mark, id))][:-1])]
            for x, s in parts:
                segments.append(b"" if s >= 0 else x)
                special.append(s)
                own.append(i)
        words = self.pieces(segments)
        index, inverse = _words.distinct(words)
        unique, first = self._encode_spans(words.buf, words.starts[index], words.lens[index])
        size = np.diff(first)[inverse]
        ids = unique[np.repeat(first[inverse] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        total = np.concatenate([[0], np.cumsum(size)])[words.bounds]  # ids before each segment
        marks = np.array(special)
        if (marks >= 0).any():
            at = np.flatnonzero(marks >= 0)
            ids = np.insert(ids, total[at], marks[at])
            total = total + np.concatenate([[0], np.cumsum(marks >= 0)])
        ends = np.searchsorted(np.array(own), np.arange(len(texts) + 1))
        return ids.astype("<u4"), total[ends]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """UTF-8 text of each run of ids; bytes that don't form characters become U+FFFD."""
        ids = ids.astype(np.int64)
        size = self.token_len[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.a["token_bytes"][np.repeat(self.a["token_first"][ids] - total[:-1], size) + np.arange(int(total[-1]))].tobytes()
        cut = total[first]
        return [flat[a:b].decode("utf-8", "replace").encode() for a, b in zip(cut, cut[1:], strict=False)]


_OPEN: dict[str, Encoder] = {}


def encoder_for(name: str) -> Encoder:
    """In a worker: the encoder over a shipped file, opened once."""
    if name not in _OPEN:
        _OPEN[name] = Encoder(_flat.open_mapped(SparkFiles.get(name)))
    return _OPEN[name]


def lexicon(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays of load_vocabulary() with a lexicon of all tokens. Its ids are made by merging, as a token may be one that no merges lead to."""
    first, flat = arrays["token_first"], arrays["token_bytes"].tobytes()
    entries = sorted({flat[a:b] for a, b in zip(first, first[1:], strict=False) if a < b})
    lens = np.array([len(e) for e in entries])
    buf = np.frombuffer(b"".join(entries) + bytes(40), np.uint8)
    ids, ends = Encoder(arrays)._encode_spans(buf, np.cumsum(lens) - lens, lens)
    return arrays | {"entry_ids": ids, "entry_first": ends} | minimal_automaton(entries)


def build_lexicon(spark: SparkSession, tokenizer: str) -> str:
    """Compile vocabulary and lexicon into one file, hand it to the executors, and return its name for encoder_for(). No document is read for it."""
    return _flat.share(spark, lexicon(load_vocabulary(tokenizer)), "lexicon")


def encode(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Per document: id, n_tokens, ids (binary: unsigned 32-bit little-endian numbers), and with decoded=True the text that the ids decode to.

    tokenizer: path of a byte-level BPE file, read by the driver only. Special tokens in a text become their
    id, as the library does by default. Null texts count as empty, and empty texts have no ids. Repeated rows each get a row. Only the columns named are read.
    """
    name = build_lexicon(docs.sparkSession, tokenizer)
    own = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t"))

    def work():
        encoder = encoder_for(name)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, first = encoder.encode(as_bytes(batch.column(1)))
            flat = ids.tobytes()
            columns = [batch.column(0), pa.array(np.diff(first)), pa.array([flat[4 * a : 4 * b] for a, b in zip(first, first[1:], strict=False)], pa.binary())]
            if decoded:
                columns.append(pa.array([x.decode() for x in encoder.decode(ids, first)], pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=["i", "n_tokens", "ids", "decoded"][: len(columns)])

        return each

    kind = own.schema["i"].dataType.simpleString()
    return map_slices(own, "t", f"i {kind}, n_tokens long, ids binary" + ", decoded string" * decoded, work).withColumnRenamed("i", id)


def decode(encoded: DataFrame, tokenizer: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: id and text, from ids as encode() returns them. Null ids decode to an empty text."""
    spark: SparkSession = encoded.sparkSession
    name = _flat.share(spark, load_vocabulary(tokenizer), "vocabulary")
    own = encoded.select(F.col(id).alias("i"), F.col(ids).alias("b"))

    def work():
        encoder = encoder_for(name)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = as_bytes(batch.column(1))
            first = np.cumsum([0, *(len(x) // 4 for x in raw)])
            texts = encoder.decode(np.frombuffer(b"".join(raw), "<u4"), first)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode() for x in texts], pa.string())], names=["i", "text"])

        return each

    return map_slices(own, "b", f"i {own.schema['i'].dataType.simpleString()}, text string", work).withColumnRenamed("i", id)
