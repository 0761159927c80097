"""Collocations from counts of all phrases, by suffix-sigma.

Every word begins a suffix of its piece, cut to the longest phrase. A task counts its equal suffixes and sends, for each language and first word, one
row with what follows that word and how often. The rows are dealt out by language and first word and sorted; there the
suffixes are put in reverse order, so that one pass with a stack of open prefixes counts all phrases that begin with the word. Counts that are
too small are left there already. What a phrase's parts count is joined afterwards.

First words with much behind them are dealt out in parts by the whole suffix. Their shorter prefixes are counted in each part and then added up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words
from ._batches import as_bytes, map_slices, mapped, written

LONGEST, LEAST, COVER, TOP = 3, 10, 50, 2000
#: Between pieces, and between the words of a piece.
PIECES = _words.table([(c, c) for c in b".,;:!?"] + [(0x0A, 0x0D)])
BREAKS = PIECES | _words.table([(0x20, 0x20), (0x09, 0x09)])
#: In what follows a first word: a space between words, a new line behind each suffix. No word holds either.
_MARKS = _words.table([(0x20, 0x20), (0x0A, 0x0A)])
#: Bytes of text that are counted together before anything is sent.
COUNTED_BYTES = 8 << 20
#: First words with more bytes behind them than this, or than the MOST_HOT-th part of all, are dealt out in parts of about that size. So at most MOST_HOT words are listed.
HOT_BYTES, MOST_HOT = 4 << 20, 1 << 18
#: Bytes that are copied together by an index for each of them.
GATHERED_BYTES = 1 << 20
#: Bytes that a task puts in order at once; a first word with more gives partial counts.
SORTED_BYTES = 8 << 20

_SUFFIXES = "lang string, word binary, size long, rest binary, counts binary"
_COUNTS = "lang string, phrase string, words int, n long, whole boolean"


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The stretches of data between the offsets."""
    offsets = np.concatenate([[0], offsets]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _gathered(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): the spans of a buffer behind each other, and where each ends."""
    to = np.cumsum(lens, dtype=np.int64)
    out = np.empty(int(to[-1]) if len(to) else 0, np.uint8)
    # An index for each byte takes several times the bytes themselves, so it is made for a stretch of them at a time.
    a = 0
    while a < len(to):
        base = int(to[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(to, base + GATHERED_BYTES, side="right")))
        if b == a + 1:
            out[base : to[a]] = buf[starts[a] : starts[a] + lens[a]]
        else:
            at = np.arange(base, int(to[b - 1]))
            at += np.repeat(starts[a:b] - (to[a:b] - lens[a:b]), lens[a:b])
            out[base : to[b - 1]] = buf[at]
        a = b
    return out, to


def _in_order(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): places in the order of several columns of numbers from 0 to below their sizes, and whether each there differs from the one before it. By one number for all of them where 63 bits hold it."""
    if math.prod(sizes) < 1 << 63:
        key = columns[0].astype(np.int64)
        for c, n in zip(columns[1:], sizes[1:], strict=True):
            key *= n
            key += c
        columns, order = [key], np.argsort(key)
    else:
        order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in columns:
        own = c[order]
        new[1:] |= own[1:] != own[:-1]
    return order, new


def suffixes(texts: list[bytes], langs: list[str], longest: int = LONGEST) -> pa.RecordBatch | None:
    """A row for each language and first word of some texts: the rest of each different suffix, and how often it occurs."""
    words = _words.split(texts, BREAKS)
    n = len(words)
    if not n:
        return None
    # Numbers of 32 bits where they hold all places, as these arrays are what takes most memory here.
    kind = np.int32 if len(words.buf) < 1 << 31 else np.int64
    of = _words.distinct(words)[1].astype(kind)
    starts, sizes = words.starts.astype(kind), words.lens.astype(kind)
    names = sorted(set(langs))
    lang = np.repeat(np.searchsorted(np.array(names), np.array(langs)).astype(np.int32), words.counts())
    piece = np.cumsum(PIECES[words.buf], dtype=np.int32)[starts]
    first = _runs(piece)
    ends = np.repeat(np.append(first[1:], n).astype(kind), np.diff(first, append=n))
    del piece
    # The words of each suffix as numbers from 1, 0 behind its end. All have the language of the first one.
    kinds = int(of.max()) + 2
    at = np.arange(n, dtype=kind)
    columns = [lang] + [np.where(at + kind(d) < ends, of[np.minimum(at + kind(d), n - 1)] + kind(1), kind(0)) for d in range(longest)]
    order, new = _in_order(columns, [len(names)] + [kinds] * longest)
    del columns
    head = np.flatnonzero(new)
    counts = np.diff(head, append=n)
    at = order[head].astype(kind)
    del order, new, head
    more = np.minimum(ends[at] - at, longest) - 1
    # The words behind the first one, or nothing, and their marks.
    slots = np.maximum(more, 1)
    last = np.cumsum(slots, dtype=np.int64)
    nth = np.arange(int(last[-1]), dtype=kind)
    nth -= np.repeat((last - slots).astype(kind), slots)
    place = np.minimum(np.repeat(at, slots) + kind(1) + nth, n - 1)
    lens = np.where(np.repeat(more, slots) > 0, sizes[place], kind(0))
    lens += 1
    data, to = _gathered(words.buf, starts[place], lens)
    data[to - 1] = np.where(nth + 1 == np.repeat(slots, slots), np.uint8(10), np.uint8(32))
    del nth, place, lens
    row = np.flatnonzero(np.concatenate([[True], (of[at][1:] != of[at][:-1]) | (lang[at][1:] != lang[at][:-1])]))
    stop = np.append(row[1:], len(at))
    size = to[last[stop - 1] - 1]
    one = at[row]
    name, total = _gathered(words.buf, starts[one], sizes[one])
    return pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(lang[one])), _binary(name, total), pa.array(np.diff(size, prepend=0)), _binary(data, size), _binary(counts.astype("<u4").view(np.uint8), 4 * stop)], names=["lang", "word", "size", "rest", "counts"])


def _dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of first words that go in parts, cut up by a hash of each suffix's rest. The last column has how many parts."""
    rows: list[list] = [[] for _ in range(5)]
    for lang, word, _, rest, counts, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        n = np.frombuffer(counts, "<u4")
        buf = np.frombuffer(rest + bytes(8), np.uint8)
        end = np.flatnonzero(buf[: len(rest)] == 10) + 1
        begin = np.concatenate([[0], end[:-1]])
        part = (_words.xxh64(buf, begin, end - begin) % np.uint64(many)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        data, to = _gathered(buf, begin[order], (end - begin)[order])
        runs = _runs(part[order]).tolist()
        for a, b in zip(runs, [*runs[1:], len(order)], strict=True):
            for column, value in zip(rows, (lang, word, 1 + int(part[order[a]]), data[to[a - 1] if a else 0 : to[b - 1]].tobytes(), n[order[a:b]].tobytes()), strict=True):
                column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["lang", "word", "part", "rest", "counts"])


def _spans(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of a column of bytes or texts."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    kind = "<i8" if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else "<i4"
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


@dataclass
class Prefixes:
    """Phrases of one length: the group of each, its count, and where what follows its first word stands in buf."""

    group: np.ndarray
    n: np.ndarray
    buf: np.ndarray
    start: np.ndarray
    size: np.ndarray


def prefixes(group: np.ndarray, rest: np.ndarray, n: np.ndarray, longest: int = LONGEST) -> list[Prefixes]:
    """The phrases of each length of some suffixes. group: the first word of each suffix, as a number; rest: what follows it, each with a new line behind it; n: its count.

    Suffixes go in reverse order, so a prefix is open, on the stack, from its first suffix to the last one that it begins; what was counted meanwhile is its count.
    """
    words = _words.split([rest.tobytes()], _MARKS, lower=False)
    # split() puts one mark before the text.
    end = np.flatnonzero(words.buf[1 : len(rest) + 1] == 10) + 1
    begin = np.searchsorted(words.starts, np.concatenate([[1], end[:-1] + 1]))
    left = np.searchsorted(words.starts, end) - begin
    kind = _words.distinct(words)[1] + 1 if len(words) else np.zeros(1, np.int64)
    follow = [np.where(left > d, kind[np.minimum(begin + d, len(kind) - 1)], 0) for d in range(longest - 1)]
    order = _in_order([group, *follow], [int(group.max(initial=0)) + 1, *[int(kind.max()) + 1] * (longest - 1)])[0][::-1]
    run = np.cumsum(n[order])
    open_ = np.ones(len(order), bool)
    own = group[order]
    open_[1:] = own[1:] != own[:-1]
    out = []
    for d in range(longest):
        if d:
            word = follow[d - 1][order]
            open_[1:] |= word[1:] != word[:-1]
        head = np.flatnonzero(open_)
        count = np.diff(run[np.append(head[1:], len(order)) - 1], prepend=0) if len(order) else head
        if d:
            on = word[head] > 0
            head, count = head[on], count[on]
        at = order[head]
        if d:
            start, last = words.starts[begin[at]], begin[at] + d - 1
            out.append(Prefixes(group[at], count, words.buf, start, words.starts[last] + words.lens[last] - start))
        else:
            out.append(Prefixes(group[at], count, words.buf, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)))
    return out


def _counted(least: int, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of all phrases from rows in which those of a language, first word and part stand together."""

    def flush(held: list[tuple[pa.RecordBatch, np.ndarray]], partial: bool) -> pa.RecordBatch:
        """held: rows, and whether each begins a group."""
        rows = pa.Table.from_batches([b for b, _ in held])
        new = np.concatenate([x for _, x in held])
        new[0] = True
        group = np.cumsum(new) - 1
        first = pa.array(np.flatnonzero(new))
        lang, (name, name_end), split = rows["lang"].take(first).combine_chunks(), _spans(rows["word"].take(first)), rows["part"].take(first).to_numpy() > 0
        n, n_end = _spans(rows["counts"])
        n = n.view("<u4").astype(np.int64) if len(n) else np.zeros(0, np.int64)
        of = np.repeat(group, np.diff(n_end, prepend=0) // 4)
        found = prefixes(of, _spans(rows["rest"])[0], n, longest)
        kinds = lang.dictionary_encode()
        kinds = kinds.combine_chunks() if isinstance(kinds, pa.ChunkedArray) else kinds
        total = np.zeros(len(kinds.dictionary), np.int64)
        np.add.at(total, kinds.indices.to_numpy()[found[0].group], found[0].n)
        out = [pa.RecordBatch.from_arrays([kinds.dictionary, pa.nulls(len(total), pa.string()), pa.array(np.zeros(len(total)), pa.int32()), pa.array(total), pa.array(np.zeros(len(total), bool))], names=["lang", "phrase", "words", "n", "whole"])]
        name_start = name_end - np.diff(name_end, prepend=0)
        for d, f in enumerate(found):
            # A suffix of full length is in one part alone.
            part = np.full(len(f.n), partial) if partial or d + 1 == longest else split[f.group]
            on = np.flatnonzero(part | (f.n >= least))
            g = f.group[on]
            # The first word, then a space and the rest.
            buf = np.concatenate([name, f.buf])
            starts = np.stack([name_start[g], len(name) + f.start[on] - 1], axis=1)[:, : 1 + (d > 0)]
            lens = np.stack([name_end[g] - name_start[g], f.size[on] + 1], axis=1)[:, : 1 + (d > 0)]
            text, to = _gathered(buf, starts.ravel(), lens.ravel())
            if d:
                text[to[1::2] - lens[:, 1]] = 32
            phrase = _binary(text, to[d > 0 :: 1 + (d > 0)]).cast(pa.string())
            out.append(pa.RecordBatch.from_arrays([lang.take(pa.array(g)), phrase, pa.array(np.full(len(on), d + 1), pa.int32()), pa.array(f.n[on]), pa.array(~part[on])], names=["lang", "phrase", "words", "n", "whole"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, np.ndarray]] = []
        size, last, torn = 0, None, False
        for b in batches:
            new = np.zeros(b.num_rows, bool)
            keys = [b.column(k) for k in range(3)]
            for c in keys:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            bytes_ = np.cumsum(pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False))
            new[0] = [c[0].as_py() for c in keys] != last
            last = [c[b.num_rows - 1].as_py() for c in keys]
            at = 0
            while at < b.num_rows:
                # As much as fits, a row at least.
                to = max(at + 1, int(np.searchsorted(bytes_, (bytes_[at - 1] if at else 0) + SORTED_BYTES - size, side="right")))
                held.append((b.slice(at, to - at), new[at:to]))
                size += int(bytes_[to - 1] - (bytes_[at - 1] if at else 0))
                at = to
                if size < SORTED_BYTES:
                    continue
                # Whole groups go; the last one may go on. One that fills all of it goes in pieces.
                flags = np.concatenate([x for _, x in held])
                begins = np.flatnonzero(flags)
                begins = begins[begins > 0]
                if torn and len(begins):
                    cut, piece = int(begins[0]), True
                elif len(begins):
                    cut, piece = int(begins[-1]), False
                else:
                    cut, piece = len(flags), True
                go, stay, seen = [], [], 0
                for part, flag in held:
                    k = min(max(cut - seen, 0), len(flag))
                    go += [(part.slice(0, k), flag[:k])] if k else []
                    stay += [(part.slice(k), flag[k:])] if k < len(flag) else []
                    seen += len(flag)
                yield flush(go, piece)
                torn = piece and not len(begins)
                held = stay
                size = sum(int(pc.sum(pc.binary_length(p.column(3))).as_py() or 0) for p, _ in held)
        if held:
            flags = np.concatenate([x for _, x in held])
            begins = np.flatnonzero(flags[1:]) + 1
            if torn and not flags[0] and len(begins):
                # The end of a group that went in pieces, then whole ones.
                cut, seen = int(begins[0]), 0
                go, stay = [], []
                for part, flag in held:
                    k = min(max(cut - seen, 0), len(flag))
                    go += [(part.slice(0, k), flag[:k])] if k else []
                    stay += [(part.slice(k), flag[k:])] if k < len(flag) else []
                    seen += len(flag)
                yield flush(go, True)
                yield flush(stay, False)
            else:
                yield flush(held, torn and not flags[0])

    return run


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): lang, phrase, words, n of all phrases of up to `longest` words that occur `least` times or more; and lang, n of all words.

    Everything is by language, a null one is `und`; null texts have no words. Texts of any length count whole and repeated documents each time. Empty documents
    give empty results. Only the columns named are read, once.
    """
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("l"), F.col(text).cast("string").alias("t"))

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
        return lambda batch: suffixes(as_bytes(batch.column(1)), batch.column(0).to_pylist(), longest)

    found = written(map_slices(own, "t", _SUFFIXES, work, COUNTED_BYTES), "suffixes", compression="zstd")
    behind = found.groupBy("lang", "word").agg(F.sum("size").alias("size"))
    # The sizes alone are read for this.
    size = max(HOT_BYTES, (found.agg(F.sum("size")).first()[0] or 0) // MOST_HOT)
    parts = [(r["lang"], bytes(r["word"]), int(-(-r["size"] // size))) for r in behind.where(F.col("size") > size).collect()]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _dealt(b)

    # MOST_HOT rows at most.
    hot = F.broadcast(docs.sparkSession.createDataFrame(parts, "lang string, word binary, many int"))
    dealt = found.join(hot, ["lang", "word"], "left_anti").select("lang", "word", F.lit(0).alias("part"), "rest", "counts")
    if parts:
        dealt = dealt.unionByName(mapped(found.join(hot, ["lang", "word"]), deal, "lang string, word binary, part int, rest binary, counts binary"))
    # By a hash first, as that is quick to compare; rows of one language, word and part stand together.
    dealt = dealt.repartition("lang", "word", "part").sortWithinPartitions(F.xxhash64("lang", "word", "part"), "lang", "word", "part")
    raw = written(mapped(dealt, _counted(least, longest), _COUNTS), "phrases")
    added = raw.where("not whole and words > 0").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = written(raw.where("whole").select("lang", "phrase", "words", "n").unionByName(added), "phrases")
    return counts, raw.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """Each language's best `top` phrases of 2 to `longest` words: lang, rank, phrase, a (its count), l and r (the counts of its parts), n (all words), score.

    A phrase is cut where its score floor(1000000 a a / (l r)) is lowest, ties at the first such place. A phrase inside a longer one that has at least `cover` per cent of its count
    is left out. Ranked by score, then a, then the phrase, which no two rows share. Arithmetic is exact up to counts of 10**15. Nulls, repeats, long texts and empty tables as in phrase_counts().
    """
    counts, totals = phrase_counts(docs, lang, text, longest, least)
    word = F.split("phrase", " ")
    phrases = counts.where("words >= 2")
    part = lambda name: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(name[0]))
    cut = phrases.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumn("left_part", F.array_join(F.slice(word, 1, F.col("k")), " ")).withColumn("right_part", F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    cut = cut.join(part("left_part"), ["lang", "left_part"]).join(part("right_part"), ["lang", "right_part"])
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    cut = cut.withColumn("score", F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a")), exact("l") * exact("r")).cast("long"))
    best = cut.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("b")).select("lang", "phrase", "b.*")
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(word, i, n), " "))))
    longer = counts.where("words >= 3").select("lang", "n", F.explode(within).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * cover))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
