"""Keyword points of many queries for blocks of records, inside a task: products of matrices of counts.

Points are search.keyword_points(): the sum over what query and record share of the query's count and the record's points for it. Terms that many queries and records
share are multiplied as dense matrices, the others by their lists, so no pair of a query and a record is ever a row. All values are whole, and so exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions import text as T
from .search import ENTITY, LABEL, STEM, WORD

#: Queries and records of a block, and list elements that are added up at once.
QUERIES, RECORDS, ELEMENTS = 512, 2048, 1 << 20
#: Share of the pairs that have a term in common from which on it's multiplied densely.
DENSE = 0.001
#: Rounding of points by weight, by which the best of a task are told before the greatest points of all are known.
NEAR = 1e-12
#: Words and entities that a task remembers.
REMEMBERED = 1 << 20
TOKEN, IDEOGRAPH = re.compile("[A-Za-z0-9_一-鿿]+"), re.compile("[一-鿿]")
#: What may make tokens differ from words: ideographs, and letters outside ASCII whose small letter is inside.
OTHER = re.compile("[一-鿿\u0130\u212a]")
#: Bytes of words in lower case, all others as blanks.
LOWER = bytes(ord(chr(b).lower()) if b < 128 and (chr(b).isalnum() or b == 95) else 32 for b in range(256))


class Asked:
    """Queries with their terms' numbers and counts, in the order of the scope that each sees beside the global one."""

    def __init__(self, ids: list, texts: list[str], owns: list[str | None]):
        order = sorted(range(len(ids)), key=lambda i: owns[i] or "")
        self.ids = [ids[i] for i in order]
        self.of: dict[str, dict[str, int]] = {k: {} for k in "wscgtae"}
        ptr, terms, times = [0], [], []
        self.n_terms = 0
        for i in order:
            own: Counter = Counter()
            for t, n in Counter(T.py_search_tokens(texts[i])).items():
                stem = T.py_stem(t)
                if len(t) >= 2:
                    own[self._number("c" if IDEOGRAPH.search(t) else "w", t)] += n
                if len(stem) >= 2:
                    own[self._number("s", stem)] += n
                for kind in "tae":
                    own[self._number(kind, t)] += n
            for g, n in Counter(T.py_cjk_ngrams(texts[i], 2)).items():
                own[self._number("g", g)] += n
            terms += own.keys()
            times += own.values()
            ptr.append(len(terms))
        self.ptr, self.terms, self.times = np.array(ptr, np.int64), np.array(terms, np.int32), np.array(times, np.int32)
        self.most = int(self.times.max(initial=1))
        # The queries of each scope stand together.
        self.ranges: dict[str, tuple[int, int]] = {"global": (0, len(order))}
        for place, i in enumerate(order):
            if owns[i]:
                first, _ = self.ranges.get(owns[i], (place, place))
                self.ranges[owns[i]] = (first, place + 1)

    def _number(self, kind: str, key: str) -> int:
        of = self.of[kind]
        if key not in of:
            of[key] = self.n_terms
            self.n_terms += 1
        return of[key]


class Reader:
    """What records say, as numbers of the queries' terms with points."""

    def __init__(self, asked: Asked):
        self.asked, self.of = asked, asked.of
        self.words: dict[bytes, tuple[int | None, int | None]] = {}
        self.inside: dict[str, list[int]] = {}
        self.longest = max(map(len, self.of["e"]), default=0)
        self.signs: dict[str, list[tuple[re.Pattern, int]]] = {}
        for t, k in self.of["c"].items():
            self.signs.setdefault(IDEOGRAPH.search(t)[0], []).append((re.compile(T.occurrence_pattern(t), re.ASCII), k))

    def _numbers(self, word: bytes) -> tuple[int | None, int | None]:
        """Of the word itself, and of its stem."""
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        w = word.decode()
        found = self.words[word] = (self.of["w"].get(w), self.of["s"].get(T.py_stem(w)))
        return found

    def _inside(self, entity: str) -> list[int]:
        """The terms that stand anywhere in an entity."""
        if entity not in self.inside:
            if len(self.inside) >= REMEMBERED:
                self.inside.clear()
            parts = {entity[i:j] for i in range(len(entity)) for j in range(i + 1, min(len(entity), i + self.longest) + 1)}
            self.inside[entity] = [self.of["e"][p] for p in parts if p in self.of["e"]]
        return self.inside[entity]

    def read(self, content: bytes, tools: list, tags: list, entities: list) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of terms, and the points of each."""
        of, out, known = self.of, {}, self.words
        text = "" if content.isascii() else content.decode()
        other = bool(text) and OTHER.search(text) is not None
        for w, n in Counter(content.translate(LOWER).split()).items():
            word, stem = known.get(w) or self._numbers(w)
            if word is not None:
                out[word] = n * WORD
            if stem is not None and not other:
                out[stem] = STEM
        if other:
            for t in set(TOKEN.findall(text.lower())):
                k = of["s"].get(T.py_stem(t))
                if k is not None:
                    out[k] = STEM
            for g in T.py_cjk_ngrams(text, 2):
                k = of["g"].get(g)
                if k is not None:
                    out[k] = STEM
            for sign in set(IDEOGRAPH.findall(text)):
                for pattern, k in self.signs.get(sign, ()):
                    n = len(pattern.findall(text))
                    if n:
                        out[k] = n * WORD
        for kind, values in (("t", tools), ("a", tags)):
            for x in values or ():
                k = None if x is None else of[kind].get(x.lower())
                if k is not None:
                    out[k] = LABEL
        for x in entities or ():
            for k in self._inside(x.lower()) if x is not None else ():
                out[k] = ENTITY
        return np.fromiter(out, np.int32, len(out)), np.fromiter(out.values(), np.int32, len(out))


class Block:
    """Records of one scope, as lists of records with points for each term."""

    def __init__(self, read: list[tuple[np.ndarray, np.ndarray]], n_terms: int, most: int):
        self.n = len(read)
        sizes = np.array([len(r[0]) for r in read], np.int64)
        term, value = (np.concatenate(x) for x in zip(*read, strict=True))
        record = np.repeat(np.arange(self.n), sizes)
        # Single precision where it's exact.
        whole = np.bincount(record, weights=value, minlength=self.n).max(initial=0.0) * most < 1 << 24
        self.kind = np.float32 if whole else np.float64
        order = np.argsort(term, kind="stable")
        self.term, self.record, self.value = term[order], record[order], value[order]
        self.size = np.bincount(term, minlength=n_terms)
        self.start = np.cumsum(self.size) - self.size

    def points(self, asked: Asked, first: int, end: int) -> np.ndarray:
        """Points of the queries from first to end for the records."""
        at = slice(asked.ptr[first], asked.ptr[end])
        query = np.repeat(np.arange(end - first), np.diff(asked.ptr[first : end + 1]))
        met = self.size[asked.terms[at]] > 0
        query, term, times = query[met], asked.terms[at][met], asked.times[at][met]
        dense = np.bincount(term, minlength=len(self.size)) * self.size > DENSE * self.n * (end - first)
        place = np.cumsum(dense) - 1
        out = np.zeros((end - first, self.n), self.kind)
        width = int(dense.sum())
        if width:
            left, right = np.zeros((end - first, width), self.kind), np.zeros((width, self.n), self.kind)
            own, theirs = dense[term], dense[self.term]
            left[query[own], place[term[own]]] = times[own]
            right[place[self.term[theirs]], self.record[theirs]] = self.value[theirs]
            out = left @ right
        rest = ~dense[term]
        query, term, times = query[rest], term[rest], times[rest]
        sizes = self.size[term]
        total = np.cumsum(sizes)
        k, flat = 0, out.reshape(-1)
        while k < len(term):
            upto = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + ELEMENTS, "right")))
            n = sizes[k:upto]
            where = np.repeat(self.start[term[k:upto]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            cell = np.repeat(query[k:upto] * self.n, n) + self.record[where]
            flat += np.bincount(cell, weights=np.repeat(times[k:upto], n) * self.value[where], minlength=flat.size).astype(self.kind)
            k = upto
        return out


class Best:
    """The best records of each query so far: those that may be among its first k by points / greatest points * weight * boost, then weight, then id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.least, self.most = np.zeros(n), np.zeros(n)
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, first: int, points: np.ndarray, ids: np.ndarray, weight: np.ndarray, boost: np.ndarray) -> None:
        end = first + len(points)
        self.most[first:end] = np.maximum(self.most[first:end], points.max(axis=1))
        value = points * (weight * boost)
        hit = (value >= self.least[first:end, None] * (1 - NEAR)) & (points > 0)
        many = np.flatnonzero(hit.sum(axis=1) > self.k)
        if len(many):
            own = np.where(hit[many], value[many], 0.0)
            self.least[first + many] = np.maximum(self.least[first + many], np.partition(own, own.shape[1] - self.k, axis=1)[:, own.shape[1] - self.k])
            hit[many] &= value[many] >= self.least[first + many, None] * (1 - NEAR)
        query, record = np.nonzero(hit)
        if not len(query):
            return
        self.parts.append((query + first, points[query, record].astype(np.float64), ids[record], weight[record], boost[record]))
        self.held += len(query)
        if self.held > ELEMENTS:
            self._thin()

    def _thin(self) -> None:
        """Of a query's records with the same points, weight and boost k are enough, by id."""
        query, points, ids, weight, boost = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        kept = np.flatnonzero(points * (weight * boost) >= self.least[query] * (1 - NEAR))
        order = kept[np.lexsort((ids[kept].astype(str), boost[kept], weight[kept], points[kept], query[kept]))]
        differ = [x[order][1:] != x[order][:-1] for x in (query, points, weight, boost)]
        new = np.r_[True, np.logical_or.reduce(differ)][: len(order)]
        begin = np.flatnonzero(new)
        rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
        order = order[rank < self.k]
        self.parts = [(query[order], points[order], ids[order], weight[order], boost[order])]
        self.held = len(order)

    def rows(self) -> Iterator[tuple]:
        if self.parts:
            self._thin()
            yield self.parts[0]


_NOTHING = (np.zeros(0, np.int32), np.zeros(0, np.int32))
SCHEMA = "q int, id string, points double, decay_weight double, _b double"
_NAMES = ["q", "id", "points", "decay_weight", "_b"]


def score(batches: Iterator[pa.RecordBatch], asked: Asked, k: int) -> Iterator[pa.RecordBatch]:
    """Records (id, content, scope, decay_weight, _b, related_tools, tags, key_entities) in; the best of each query out, and a row without an id for each query's greatest points."""
    reader, best = Reader(asked), Best(len(asked.ids), k)
    for b in batches:
        scopes = b.column("scope").to_numpy(zero_copy_only=False)
        for scope in sorted({s for s in scopes.tolist() if s in asked.ranges}):
            rows = np.flatnonzero(scopes == scope)
            for start in range(0, len(rows), RECORDS):
                part = b.take(pa.array(rows[start : start + RECORDS]))
                columns = [part.column("content").cast(pa.binary()).to_pylist(), *(part.column(c).to_pylist() for c in ("related_tools", "tags", "key_entities"))]
                block = Block([reader.read(*r) if r[0] is not None else _NOTHING for r in zip(*columns, strict=True)], asked.n_terms, asked.most)
                ids, weight, boost = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "decay_weight", "_b"))
                first, end = asked.ranges[scope]
                for at in range(first, end, QUERIES):
                    upto = min(end, at + QUERIES)
                    best.add(at, block.points(asked, at, upto), ids, weight, boost)
    for query, points, ids, weight, boost in best.rows():
        for at in range(0, len(query), 65536):
            s = slice(at, at + 65536)
            yield pa.RecordBatch.from_arrays([pa.array(query[s], pa.int32()), pa.array(ids[s], pa.string()), pa.array(points[s]), pa.array(weight[s]), pa.array(boost[s])], names=_NAMES)
    some = np.flatnonzero(best.most > 0)
    if len(some):
        none = pa.nulls(len(some), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.nulls(len(some), pa.string()), pa.array(best.most[some]), none, none], names=_NAMES)
