"""Benchmark decontamination by suffix arrays over the training text.

Each run of documents that a task reads is a shard, and its suffix array lists all suffixes of its documents in the
order of their words. Every suffix of the benchmark is looked up in every shard by binary search, all of them in lockstep. That
gives the range of training suffixes that it begins, hence every verbatim match and its place; the neighbours of where it would
stand give its longest match. Documents with a match of a whole window are affected, and can be removed.

Nothing is shuffled: only the benchmark travels, indexed in parts of bounded size. Each part is one flat file that all
workers of a machine map into memory, and each run of documents is looked up in all parts while it's there.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _flat, _words
from ._batches import as_bytes, map_slices

WINDOW = 10
#: Bytes of different benchmark texts in one part of the index, and of item ids.
PART_BYTES = 4 << 20


# Suffix arrays


def _following(rank: np.ndarray, at: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """Rank of what follows `step` words behind each place, plus 1; 0 where the text ends before."""
    there = at + step
    return np.where(there < ends[at], rank[np.minimum(there, len(rank) - 1)] + 1, 0)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): rank is where the run of equal keys begins in the order."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(key) else np.zeros(0, np.int64)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.repeat(head, np.diff(head, append=len(key)))
    return order, rank


def suffix_array(ids: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of all suffixes in the order of their first `depth` words, rank of each place). ends: where the text of each place ends."""
    at = np.arange(len(ids))
    order, rank = _ranked(ids)
    known = 1
    while known < depth:
        step = min(known, depth - known)
        # The words from `step` on overlap with those before where the depth isn't a power of two.
        order, rank = _ranked(rank * (len(ids) + 1) + _following(rank, at, ends, step))
        known += step
    return order, rank


def refine(order: np.ndarray, rank: np.ndarray, ends: np.ndarray, depth: int, among: np.ndarray, longest: int) -> None:
    """Order the suffixes with equal rank further, in place, as far as `longest` words. among: the places concerned, whole runs of equal rank.

    Where what follows isn't among them, it's known to `depth` words only, which is enough to tell what any suffix of interest would find there.
    """
    known, own = depth, among
    while len(own) and known < longest:
        place = np.lexsort((_following(rank, own, ends, known), rank[own]))
        own = own[place]
        first, second = rank[own], _following(rank, own, ends, known)
        run = np.concatenate([[True], first[1:] != first[:-1]])
        head = np.flatnonzero(run)
        order[np.repeat(first[head] - head, np.diff(head, append=len(own))) + np.arange(len(own))] = own
        split = np.flatnonzero(run | np.concatenate([[True], second[1:] != second[:-1]]))
        size = np.diff(split, append=len(own))
        begin = np.repeat(head, np.diff(head, append=len(own)))[split]
        rank[own] = np.repeat(first[split] + split - begin, size)
        own = own[np.repeat(size > 1, size)]
        known *= 2


def _common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How many words a[i:] and b[j:] have in common, `most` at most; the first `known` are."""
    out = known.copy()
    on, wide = np.flatnonzero(out < most), 4
    while len(on):
        k = out[on][:, None] + np.arange(wide)
        equal = (k < most[on][:, None]) & (a[np.minimum(i[on][:, None] + k, len(a) - 1)] == b[np.minimum(j[on][:, None] + k, len(b) - 1)])
        run = np.where(equal.all(axis=1), wide, equal.argmin(axis=1))
        out[on] += run
        on, wide = on[run == wide], min(64, 2 * wide)
    return out


@dataclass
class Text:
    """Word ids of some texts, where each word's text ends, and the order of their suffixes."""

    ids: np.ndarray
    ends: np.ndarray
    order: np.ndarray


def bounds(text: Text, ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of `size` words ids[at:at+size] the range of text.order whose suffixes begin with it."""
    out = []
    for after in (False, True):
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(text.order), np.int64)
        on = np.flatnonzero(low < high)
        while len(on):
            mid = (low[on] + high[on]) // 2
            there = text.order[mid]
            left = text.ends[there] - there
            n = _common(text.ids, there, ids, at[on], np.minimum(left, size[on]), np.zeros(len(on), np.int64))
            ahead = text.ids[np.minimum(there + n, len(text.ids) - 1)] < ids[np.minimum(at[on] + n, len(ids) - 1)]
            right = np.where(n == size[on], after, (n == left) | ahead)
            low[on] = np.where(right, mid + 1, low[on])
            high[on] = np.where(right, high[on], mid)
            on = on[low[on] < high[on]]
        out.append(low)
    return out[0], out[1]


def longest(text: Text, ids: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix ids[at:ends] its longest match in the text and a place of one, by binary search for its neighbours."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(text.order), np.int64)
    low_common, high_common = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    best, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    on = np.flatnonzero(low < high)
    while len(on):
        mid = (low[on] + high[on]) // 2
        there = text.order[mid]
        left, own = text.ends[there] - there, (ends - at)[on]
        n = _common(text.ids, there, ids, at[on], np.minimum(left, own), np.minimum(low_common[on], high_common[on]))
        better = n > best[on]
        best[on], place[on] = np.where(better, n, best[on]), np.where(better, there, place[on])
        right = (n < own) & ((n == left) | (text.ids[np.minimum(there + n, len(text.ids) - 1)] < ids[np.minimum(at[on] + n, len(ids) - 1)]))
        low[on], low_common[on] = np.where(right, mid + 1, low[on]), np.where(right, n, low_common[on])
        high[on], high_common[on] = np.where(right, high[on], mid), np.where(right, high_common[on], n)
        on = on[low[on] < high[on]]
    return best, place


# The benchmark's side


@dataclass
class Index:
    """One part of the benchmark. vocabulary: its different words, sorted by hash; word k has id k + 1. text: of all items, its suffixes fully sorted. first: where each item begins. at, size: a place of each different window, and its words; the items with window w are owners[begin[w]:begin[w + 1]]. names: the ids of each item."""

    vocabulary: _words.Words
    hashes: np.ndarray
    filter: np.ndarray
    text: Text
    first: np.ndarray
    at: np.ndarray
    size: np.ndarray
    begin: np.ndarray
    owners: np.ndarray
    names: list[list[str | None]]

    def ids(self, words: _words.Words) -> np.ndarray:
        """Id of each word, 0 for words that the benchmark lacks."""
        hashes = words.hashes()
        out = np.zeros(len(hashes), dtype=np.int64)
        open_ = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)]) if len(self.hashes) else out[:0]
        at = np.searchsorted(self.hashes, hashes[open_])
        while len(open_):
            there = np.minimum(at, len(self.hashes) - 1)
            alike = (at < len(self.hashes)) & (self.hashes[there] == hashes[open_])
            open_, at = open_[alike], at[alike]
            # Equal hashes don't make equal words.
            equal = _words.same(words, open_, self.vocabulary, at)
            out[open_[equal]] = at[equal] + 1
            open_, at = open_[~equal], at[~equal] + 1
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        v, t = self.vocabulary, self.text
        names = np.frombuffer(json.dumps(self.names).encode(), np.uint8)
        return {"buf": v.buf, "starts": v.starts, "lens": v.lens, "hashes": self.hashes, "filter": self.filter, "ids": t.ids, "ends": t.ends, "order": t.order, "first": self.first, "at": self.at, "size": self.size, "begin": self.begin, "owners": self.owners, "names": names}

    @staticmethod
    def of(a: dict[str, np.ndarray]) -> Index:
        words = _words.Words(a["buf"], a["starts"], a["lens"], np.array([0, len(a["starts"])]))
        return Index(words, a["hashes"], a["filter"], Text(a["ids"], a["ends"], a["order"]), a["first"], a["at"], a["size"], a["begin"], a["owners"], json.loads(bytes(a["names"])))


def _csr(group: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, values): the different values of each group."""
    pairs = np.unique(np.stack([group, value], axis=1), axis=0) if len(group) else np.zeros((0, 2), np.int64)
    return np.searchsorted(pairs[:, 0], np.arange(n + 1)), pairs[:, 1]


def _ranges(low: np.ndarray, high: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, value) for all values[low[k]:high[k]]."""
    size = high - low
    into = np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    return np.repeat(np.arange(len(low)), size), values[into]


def _take(begin: np.ndarray, values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, value) for all values of groups[k]."""
    return _ranges(begin[groups], begin[groups + 1], values)


def build_index(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> Index:
    """Index of (name, text) items; equal texts are one item with several names."""
    names: dict[bytes, list[str | None]] = {}
    for name, t in items:
        names.setdefault(t, []).append(name)
    words = _words.split(list(names), _words.NOT_ALNUM)
    kinds, of = _words.distinct(words)
    hashes = _words.xxh64(words.buf, words.starts[kinds], words.lens[kinds])
    sort = np.argsort(hashes, kind="stable")
    number = np.empty(len(sort), np.int64)
    number[sort] = np.arange(1, len(sort) + 1)
    kinds, hashes = kinds[sort], hashes[sort]
    # The vocabulary's bytes alone, not the whole text's.
    vocabulary = _words.spaced(_words.Words(words.buf, words.starts[kinds], words.lens[kinds], np.array([0, len(kinds)])))
    filter = np.zeros(1 << 20, dtype=bool)
    filter[(hashes >> np.uint64(44)).astype(np.int64)] = True
    ids = number[of]
    ends = np.repeat(words.bounds[1:], words.counts())
    at = np.arange(len(ids))
    order, rank = suffix_array(ids, ends, window)
    # Windows: everywhere in long items, at the start of short ones. Equal rank means equal words, ends included.
    starts = at[(ends - at >= window) | (at == words.bounds[:-1][words.rows()])] if len(ids) else at
    _, one, window_of = np.unique(rank[starts], return_index=True, return_inverse=True)
    begin, owners = _csr(window_of.reshape(-1), words.rows()[starts], len(one))
    many = np.bincount(rank, minlength=len(ids))[rank] > 1
    refine(order, rank, ends, window, at[many], int((ends - at).max()) if len(ids) else 0)
    own = starts[one]
    return Index(vocabulary, hashes, filter, Text(ids, ends, order), words.bounds, own, np.minimum(window, ends[own] - own), begin, owners, list(names.values()))


def _indexes(benchmark: DataFrame, id: str, text: str, window: int) -> list[str]:
    """Names of the files of all parts of the index, for index_for(). The driver holds one part at a time.

    Parts are by the hash of the text, so that equal texts meet, and by that of the id where the ids alone are more than PART_BYTES.
    """
    spark = benchmark.sparkSession
    own = benchmark.select(F.col(id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("length(t) > 0").distinct()
    texts = own.select("t").distinct().agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ids = own.agg(F.sum(F.coalesce(F.octet_length("i"), F.lit(0)) + 8)).first()[0] or 0
    by_text, by_id = 1 + texts // PART_BYTES, 1 + ids // PART_BYTES
    part = F.pmod(F.xxhash64("t"), F.lit(by_text)) * by_id + F.pmod(F.xxhash64("i"), F.lit(by_id))
    out = []
    for k in range(by_text * by_id):
        rows = (own if by_text * by_id == 1 else own.where(part == k)).orderBy("t", "i").collect()
        out.append(_flat.share(spark, build_index([(r.i, r.t.encode()) for r in rows], window).arrays(), "benchmark"))
    return out


_OPEN: dict[str, Index] = {}


def index_for(name: str) -> Index:
    """In a worker: a shipped part, mapped into memory once."""
    if name not in _OPEN:
        _OPEN[name] = Index.of(_flat.open_mapped(SparkFiles.get(name)))
    return _OPEN[name]


# The training side


@dataclass
class Shard:
    """The words of some documents, their suffix array and the rank of each suffix by `depth` words."""

    words: _words.Words
    text: Text
    rank: np.ndarray


def build_shard(texts: list[bytes], index: Index, depth: int = WINDOW) -> Shard:
    words = _words.split(texts, _words.NOT_ALNUM)
    ids, ends = index.ids(words), np.repeat(words.bounds[1:], words.counts())
    order, rank = suffix_array(ids, ends, depth)
    return Shard(words, Text(ids, ends, order), rank)


def occurrences(shard: Shard, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(word position, window) of every occurrence of every window in the shard."""
    low, high = bounds(shard.text, index.text.ids, index.at, index.size)
    some = np.flatnonzero(high > low)
    k, at = _ranges(low[some], high[some], shard.text.order)
    return at, some[k]


@dataclass
class Found:
    """Of each text: whether each of its words is hit, the names of its items, its longest match and the first word of the first such."""

    words: _words.Words
    hit: np.ndarray
    items: list[set[str]]
    longest: np.ndarray
    longest_at: np.ndarray


def find(texts: list[bytes], index: Index, window: int = WINDOW, detail: bool = True) -> Found:
    """Everything that one part of the index says of some texts; detail: items and longest matches too."""
    shard = build_shard(texts, index, window)
    at, which = occurrences(shard, index)
    n = len(shard.words)
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + index.size[which], minlength=n + 1)
    items: list[set[str]] = [set() for _ in texts]
    best, best_at = np.zeros(len(texts), np.int64), np.full(len(texts), -1)
    if detail and len(at):
        row = np.searchsorted(shard.words.bounds, at, side="right") - 1
        pair = np.unique(row * len(index.at) + which)
        k, owner = _take(index.begin, index.owners, pair % len(index.at))
        both = np.unique((pair // len(index.at))[k] * len(index.names) + owner)
        for r, o in zip((both // len(index.names)).tolist(), (both % len(index.names)).tolist(), strict=True):
            items[r].update(x for x in index.names[o] if x is not None)
        # The longest match at each place where a window begins; a match below a window counts only as a whole short item.
        place, of = np.unique(at, return_inverse=True)
        length, _ = longest(index.text, shard.text.ids, place, shard.text.ends[place])
        short = np.zeros(len(place), np.int64)
        np.maximum.at(short, of.reshape(-1), index.size[which])
        length = np.where(length >= window, length, short)
        row = np.searchsorted(shard.words.bounds, place, side="right") - 1
        order = np.lexsort((place, -length, row))
        one = order[np.concatenate([[True], np.diff(row[order]) > 0])]
        best[row[one]], best_at[row[one]] = length[one], place[one] - shard.words.bounds[row[one]]
    return Found(shard.words, np.cumsum(edge)[:n] > 0, items, best, best_at)


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: id, n_words, n_hit (words inside any occurrence of a window), longest_match (words of the longest verbatim match of a window or more, 0 for none), longest_at (the word where the first such match begins, -1 for none), items (array of the ids, as sorted strings, of the items with a window here).

    A window is `window` consecutive words of an item, or all words of a shorter one. Null texts have no words,
    on either side. Items without an id count for n_hit but have no entry in items; repeated items count
    once. Repeated documents each get a row. An empty benchmark hits nothing; empty documents give an empty result. Texts of any length are read whole. Only the columns named are read.
    """
    names = _indexes(benchmark, item, item_text, window)
    own = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t"))

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(batch.column(1))
            found = [find(texts, index_for(name), window) for name in names]
            words, hit = found[0].words, np.logical_or.reduce([f.hit for f in found])
            total = np.concatenate([[0], np.cumsum(hit)])
            longest_ = np.stack([f.longest for f in found])
            first = np.stack([f.longest_at for f in found])
            best = longest_.max(axis=0)
            at = np.where(longest_ == best, first, np.iinfo(np.int64).max).min(axis=0)
            items = [sorted(set().union(*x)) for x in zip(*(f.items for f in found), strict=True)]
            columns = [pa.array(words.counts(), pa.int64()), pa.array(total[words.bounds[1:]] - total[words.bounds[:-1]], pa.int64()), pa.array(best), pa.array(at), pa.array(items, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["i", "n_words", "n_hit", "longest_match", "longest_at", "items"])

        return each

    kind = own.schema["i"].dataType.simpleString()
    return map_slices(own, "t", f"i {kind}, n_words long, n_hit long, longest_match long, longest_at long, items array<string>", work).withColumnRenamed("i", id)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs. Nulls, repeats and empty tables as in contamination(); documents without words stay."""
    names = _indexes(benchmark, item, item_text, window)
    where = docs.columns.index(text)

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(batch.column(where))
            clean = np.ones(len(texts), bool)
            for name in names:
                found = find(texts, index_for(name), window, detail=False)
                total = np.concatenate([[0], np.cumsum(found.hit)])
                clean &= total[found.words.bounds[1:]] == total[found.words.bounds[:-1]]
            return batch.filter(pa.array(clean))

        return each

    return map_slices(docs, text, docs.schema, work)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per benchmark item (id as string) and shard the longest verbatim match, of one word or more: item, length in words, doc, position of the match among the document's words, item_position.

    Take the greatest length for each item to get the longest of all shards. Of equally long ones in a shard one is listed. Nulls and empty tables as in contamination().
    """
    names = _indexes(benchmark, item, item_text, window)
    own = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t"))

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = []
            for name in names:
                index = index_for(name)
                shard = build_shard(as_bytes(batch.column(1)), index, window)
                if not len(shard.words) or not len(index.text.ids):
                    continue
                at = np.arange(len(index.text.ids))
                # Only where a window of the benchmark occurs can a match reach beyond what is sorted.
                hit = np.zeros(len(shard.rank), bool)
                hit[shard.rank[occurrences(shard, index)[0]]] = True
                many = hit[shard.rank] & (np.bincount(shard.rank, minlength=len(shard.rank))[shard.rank] > 1)
                refine(shard.text.order, shard.rank, shard.text.ends, window, np.flatnonzero(many), int((index.text.ends - at).max()))
                best, place = longest(shard.text, index.text.ids, at, index.text.ends)
                owner = np.searchsorted(index.first, at, side="right") - 1
                order = np.lexsort((at, -best, owner))
                one = order[np.concatenate([[True], np.diff(owner[order]) > 0])]
                one = one[best[one] > 0]
                row = np.searchsorted(shard.words.bounds, place[one], side="right") - 1
                for o, n, r, p, a in zip(owner[one].tolist(), best[one].tolist(), row.tolist(), (place[one] - shard.words.bounds[row]).tolist(), (at[one] - index.first[owner[one]]).tolist(), strict=True):
                    rows += [(x, n, r, p, a) for x in index.names[o]]
            if not rows:
                return None
            item_, length, row, position, within = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(item_, pa.string()), pa.array(length, pa.int64()), batch.column(0).take(pa.array(row)), pa.array(position, pa.int64()), pa.array(within, pa.int64())], names=["item", "length", "doc", "position", "item_position"])

        return each

    return map_slices(own, "t", f"item string, length long, doc {own.schema['i'].dataType.simpleString()}, position long, item_position long", work)
