"""Importance resampling towards a target: documents are drawn whose word runs look like the target's.

Each run of documents that a task reads gets a suffix array over its word ids. Neighbours in it with the same first n words form a run, so every
different n-gram is met once: its CRC is put together from those of its words and its bucket is scattered back to all of its places. One pass
counts the buckets of the documents, one those of the target; a last one sums each document's gains.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words
from ._batches import as_bytes, map_slices, mapped, numbered, slices, written
from .decontam import suffix_array

LONGEST, BUCKETS, LEAST_WORDS, SHARE, SEED = 3, 10_000, 20, 5, 42


# CRC-32 of joined strings: the CRC of the left one is moved on by the length of the right one.


@cache
def _moves(power: int) -> np.ndarray:
    """For each of the four bytes of a CRC what 2 ** power zero bytes make of it."""
    if power:
        return _move(_moves(power - 1), _moves(power - 1))
    low = np.arange(256, dtype=np.uint32)
    table = low.copy()
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    crc = low[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    return table[crc & 255] ^ (crc >> 8)


def _move(moves: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return moves[0][crc & 255] ^ moves[1][(crc >> 8) & 255] ^ moves[2][(crc >> 16) & 255] ^ moves[3][crc >> 24]


def joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each pair of strings behind each other, from those of the two and the bytes of the right one."""
    out = left.copy()
    for k in range(int(size.max(initial=0)).bit_length()):
        on = np.flatnonzero((size >> k) & 1)
        out[on] = _move(_moves(k), out[on])
    return out ^ right


# Features of a run of documents


def buckets(texts: list[bytes], longest: int = LONGEST, n_buckets: int = BUCKETS) -> tuple[_words.Words, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(words, hashed, sizes, scattered). For each n: the bucket of every different n-gram, how often it occurs, and the bucket at each word, -1 where no n words are left in its text."""
    words = _words.split(texts, _words.NOT_ALNUM)
    n_words = len(words)
    if not n_words:
        nothing = [np.zeros(0, np.int64)] * longest
        return words, nothing, nothing, nothing
    kinds, of = _words.distinct(words)
    ends = np.repeat(words.bounds[1:], words.counts())
    order, _ = suffix_array(of, ends, longest)
    raw = words.buf.tobytes()
    starts, lens = words.starts[kinds], words.lens[kinds]
    alone = np.fromiter((zlib.crc32(raw[s : s + n]) for s, n in zip(starts.tolist(), lens.tolist(), strict=True)), np.uint32, len(kinds))
    spaced = joined(np.full(len(kinds), zlib.crc32(b" "), np.uint32), alone, lens)
    left = ends[order] - order
    # Whether each suffix has the words so far in common with the one before it.
    same = np.ones(n_words, bool)
    same[0] = False
    crc = np.zeros(n_words, np.uint32)
    hashed, sizes, scattered = [], [], []
    for n in range(longest):
        has = left > n
        word = of[np.minimum(order + n, n_words - 1)]
        same[1:] &= has[1:] & has[:-1] & (word[1:] == word[:-1])
        run = np.flatnonzero(has & ~same)
        first = word[run]
        crc[run] = alone[first] if not n else joined(crc[run], spaced[first], lens[first] + 1)
        # A run's CRC is known to all of its places, as longer n-grams go on from there.
        size = np.diff(np.flatnonzero(~same), append=n_words)[has[~same]]
        places = np.flatnonzero(has)
        crc[places] = np.repeat(crc[run], size)
        bucket = (crc[run] % np.uint32(n_buckets)).astype(np.int64)
        at = np.full(n_words, -1)
        at[order[places]] = np.repeat(bucket, size)
        hashed.append(bucket)
        sizes.append(size)
        scattered.append(at)
    return words, hashed, sizes, scattered


def counted(texts: DataFrame, text: str = "text", longest: int = LONGEST, n_buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds. A task sends a row for each bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                _, hashed, sizes, _ = buckets(as_bytes(part.column(0)), longest, n_buckets)
                for b, n in zip(hashed, sizes, strict=True):
                    # Sums below 2**53 are exact as doubles; a slice has far fewer places.
                    total += np.bincount(b, weights=n, minlength=n_buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    # One row for each bucket at most comes to the driver.
    for r in mapped(texts.select(F.col(text).cast("string").alias("t")), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket a thousand times the log of its share of the target over that of the source, one added to each count, rounded down."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """Per document: id, n_words, n_features, weight (the sum of its features' gains)."""
    own = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t"))

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        padded = np.concatenate([gain, [0]])

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, _, _, scattered = buckets(as_bytes(batch.column(1)), longest, len(gain))
            at = np.zeros(len(words), np.int64)
            for b in scattered:
                at += padded[b]
            run = np.concatenate([[0], np.cumsum(at)])
            n = words.counts()
            features = sum(np.maximum(n - k, 0) for k in range(longest))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(features, pa.int64()), pa.array(run[words.bounds[1:]] - run[words.bounds[:-1]], pa.int64())], names=["i", "n_words", "n_features", "weight"])

        return each

    return map_slices(own, "t", f"i {own.schema['i'].dataType.simpleString()}, n_words long, n_features long, weight long", work).withColumnRenamed("i", id)


def noise(id: Column, seed: int = SEED) -> Column:
    """A Gumbel variate for each id, a thousandfold and rounded down: the best scores are then a draw without replacement by weight."""
    h = F.conv(F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * -1000).cast("long")


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: id, n_words, n_features, weight, score, and rank, from 1, of those drawn: the best `share` per cent of the documents with at least `least` words, else null.

    Ties in score go to the smaller id, a null id last; rows equal in both get their ranks in any order, and repeated documents each count. Null texts have no words. Texts of any
    length count whole. Without target texts all its counts are 0; empty documents give an empty result. Only the columns named are read, twice: to count and to score.
    """
    gain = gains(counted(docs, text), counted(target, target_text))
    scored = weighed(docs, gain, id, text)
    scored = written(scored.withColumn("score", F.col("weight") + noise(F.col(id), seed)), "scored")
    able = scored.where(F.col("n_words") >= least)
    drawn = able.count() * share // 100
    ranked = numbered(able, F.desc("score"), F.asc_nulls_last(id), name="rank").withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return ranked.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
