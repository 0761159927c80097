"""Cross-entropy difference: how much more a text resembles a target than the background.

Two bigram models of the same form share one vocabulary: all words of the corpus, so no word is unknown to
either. One counts the documents of the target, the other all documents. Every word and every pair of neighbours in the corpus is
counted exactly, by a 63-bit hash: each task counts its texts, and the counts are added up by a shuffle into a table that
grows with the corpus and lies in buckets by the key. To score, texts are put into chunks; the keys of each chunk go to
their buckets, and the counts found come back to the chunk. Each document is scored with its own counts taken out of both models, so that a
document of the target doesn't know itself. The loss of a token is minus the log of its probability; a document's score
is the mean difference of its tokens' losses, target minus background, and is lower the more it resembles the target.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words
from ._batches import as_bytes, mapped, slices, written

#: The vocabulary counts as 2 ** WORD_BITS words at least, which leaves a small corpus room for words that it lacks.
WORD_BITS = 18
#: Weight of the pair's share against the word's own.
PAIR_WEIGHT = 0.6
#: Count that every word has beforehand.
PRIOR = 0.1
#: Text bytes whose words and pairs are counted, or looked up, together.
CHUNK_BYTES = 16 << 20
#: The counts lie in 2 ** BUCKET_BITS buckets by the key, and in more where there are more chunks of text than that.
BUCKET_BITS = 8


def tokens(texts: list[bytes], bits: int = WORD_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leading `bits` of each word's hash, hash of the pair with the word before, bounds); a text's first word pairs with its start, which is no word."""
    words = _words.split(texts, _words.NOT_ALNUM)
    h = words.hashes(7)
    before = np.zeros(len(h), np.uint64)
    before[1:] = h[:-1]
    before[words.bounds[:-1][words.counts() > 0]] = 0
    with np.errstate(over="ignore"):
        pair = (before * np.uint64(0x9E3779B97F4A7C15) ^ h) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(64 - bits)).view(np.int64), pair.view(np.int64), words.bounds


def keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word key, pair key, bounds): odd numbers for words and even ones for pairs."""
    word, pair, bounds = tokens(texts, 64)
    return word.view(np.uint64) | np.uint64(1), pair.view(np.uint64) & ~np.uint64(1), bounds


def _follows(bounds: np.ndarray) -> np.ndarray:
    """Whether each word has a word before it in its text."""
    out = np.ones(bounds[-1], bool)
    out[bounds[:-1][np.diff(bounds) > 0]] = False
    return out


def _packed(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the greatest needs, lowest bytes first of all."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : b[0]] = raw.T
    return out.view("<u8").reshape(-1)


def _packed_keys(sorted_keys: np.ndarray, bits: int) -> bytes:
    """Keys of one bucket as the steps between them."""
    return _packed(np.diff(sorted_keys & np.uint64((1 << (64 - bits)) - 1), prepend=np.uint64(0)))


def _unpacked_keys(b: bytes, bucket: int, bits: int) -> np.ndarray:
    return np.cumsum(_unpacked(b), dtype=np.uint64) + np.uint64(bucket << (64 - bits))


def _buckets(sorted_keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    edge = np.searchsorted(sorted_keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(edge)).tolist():
        yield k, slice(int(edge[k]), int(edge[k + 1]))


def _once(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs."""
    return np.unique(x, return_counts=True)


def count(docs: DataFrame, target: Column, text: str = "text") -> tuple[DataFrame, int]:
    """Counts of all words and of all pairs of neighbours over the whole corpus, and the bits of a key that number its bucket.

    One row for each bucket: bucket, keys, n_target, n_all (packed), and its words: how many, and their counts summed.
    A pair that occurs once, outside the target, isn't kept: without the text's own counts it counts 0, as if it were unseen.
    target: a condition on the columns of docs; null counts as false.
    """
    own = docs.select(F.col(text).cast("string").alias("t"), F.coalesce(target, F.lit(False)).alias("y"))
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = max(BUCKET_BITS, (size // CHUNK_BYTES).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> Iterator[pa.RecordBatch]:
            every, n_all = _once(np.concatenate([k for k, _ in held]))
            n_target = np.zeros_like(n_all)
            inside, n = _once(np.concatenate([k for _, k in held]))
            n_target[np.searchsorted(every, inside)] = n
            rows = [(k, _packed_keys(every[s], bits), _packed(n_target[s]), _packed(n_all[s])) for k, s in _buckets(every, bits)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "keys", "n_target", "n_all"])

        for batch in batches:
            for part in slices(batch, "t"):
                texts = as_bytes(part.column(0))
                word, pair, bounds = keys(texts)
                inside = np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
                follows = _follows(bounds)
                held.append((np.concatenate([word, pair[follows]]), np.concatenate([word[inside], pair[follows & inside]])))
                size += sum(map(len, texts))
                if size >= CHUNK_BYTES:
                    yield from summed()
                    held, size = [], 0
        if held:
            yield from summed()

    def added(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        every = np.concatenate([_unpacked_keys(b, bucket, bits) for b in rows["keys"].to_pylist()])
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        every = every[first]
        n_target, n_all = (np.add.reduceat(np.concatenate([_unpacked(b) for b in rows[c].to_pylist()])[order], first) for c in ("n_target", "n_all"))
        word = every & np.uint64(1) > 0
        keep = word | (n_all > 1) | (n_target > 0)
        packed = [_packed_keys(every[keep], bits), _packed(n_target[keep]), _packed(n_all[keep])] if keep.any() else [b"\1"] * 3
        sums = [int(word.sum()), int(n_target[word].sum()), int(n_all[word].sum())]
        return pa.table([pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in packed), *(pa.array([x], pa.int64()) for x in sums)], names=["bucket", "keys", "n_target", "n_all", "words", "in_target", "in_all"])

    rows = mapped(own, run, "bucket int, keys binary, n_target binary, n_all binary")
    return rows.groupBy("bucket").applyInArrow(added, "bucket int, keys binary, n_target binary, n_all binary, words long, in_target long, in_all long"), bits


@dataclass
class Models:
    """counts, bits: as from count(). totals: words of the target and of all. vocabulary: how many words the prior counts for."""

    counts: DataFrame
    bits: int
    totals: tuple[int, int]
    vocabulary: int


def losses(word: np.ndarray, pair: np.ndarray, bounds: np.ndarray, inside: np.ndarray, known: np.ndarray, counts: np.ndarray, totals: tuple[int, int], vocabulary: int) -> np.ndarray:
    """Mean loss of each text's tokens (texts x 2), without the text's own counts; 0 for a text without tokens.

    inside: whether a text is of the target. known: sorted keys, whose counts are the columns of `counts`; other keys count 0.
    """
    n = np.diff(bounds)
    out = np.zeros((len(n), 2))
    some = np.flatnonzero(n)
    if not len(some):
        return out
    row = np.repeat(np.arange(len(n)), n)
    padded = np.concatenate([counts, np.zeros((2, 1), np.int64)], axis=1)

    def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Counts in both models, and how often the token's text has the same key.
        u, where = np.unique(x, return_inverse=True)
        at = np.searchsorted(known, u)
        at = np.where(np.append(known, np.uint64(0))[at] == u, at, len(known)) if len(known) else np.zeros(len(u), np.int64)
        _, inverse, times = np.unique(row * len(u) + where, return_inverse=True, return_counts=True)
        return padded[:, at[where]], times[inverse]

    (words, own_word), (pairs, own_pair) = counted(word), counted(pair)
    # The history of a token is the word before it; the first token of a text has none.
    histories, own_before = np.zeros_like(words), np.zeros_like(own_word)
    histories[:, 1:], own_before[1:] = words[:, :-1], own_word[:-1]
    for k in range(2):
        minus = (inside[row] if k == 0 else np.ones(len(row), bool)).astype(np.int64)
        w = np.maximum(words[k] - own_word * minus, 0)
        total = np.maximum(totals[k] - n[row] * minus, 0)
        p = (w + PRIOR) / (total + PRIOR * vocabulary)
        history = np.maximum(histories[k] - own_before * minus, 0)
        both = np.minimum(np.maximum(pairs[k] - own_pair * minus, 0), history)
        follows = (history > 0) & _follows(bounds)
        share = np.where(follows, both / np.maximum(history, 1), 0)
        p = np.where(follows, PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * p, p)
        out[some, k] = np.add.reduceat(-np.log(p), bounds[some]) / n[some]
    return out


def fit(docs: DataFrame, target: Column, text: str = "text") -> Models:
    """Both models of the corpus. The counts stay a table in the shared folder; the driver gets three numbers."""
    found, bits = count(docs, target, text)
    counts = written(found, "counts")
    n, n_target, n_all = counts.agg(F.sum("words"), F.sum("in_target"), F.sum("in_all")).first()
    return Models(counts.select("bucket", "keys", "n_target", "n_all"), bits, (n_target or 0, n_all or 0), max(n or 0, 1 << WORD_BITS))


def _chunked(own: DataFrame) -> DataFrame:
    """(chunk, rows): the rows in compressed slices; about CHUNK_BYTES of texts share a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, "t"):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "rows"])
                size += sum(map(len, as_bytes(part.column(1))))
                if size >= CHUNK_BYTES:
                    chunk, size = chunk + 1, 0

    return mapped(own, run, "chunk long, rows binary")


def _slice(rows: pa.Scalar) -> pa.RecordBatch:
    """A slice of rows (i, t, y)."""
    return pa.ipc.open_stream(rows.as_buffer()).read_next_batch()


def _keys_in(rows: list[pa.RecordBatch]) -> np.ndarray:
    """The distinct keys of some slices, in order."""
    held = [np.zeros(0, np.uint64)]
    for part in rows:
        word, pair, bounds = keys(as_bytes(part.column(1)))
        held += [word, pair[_follows(bounds)]]
    return _once(np.concatenate(held))[0]


def _asked(chunks: DataFrame, bits: int) -> DataFrame:
    """(chunk, bucket, keys): the keys that each chunk needs. A chunk that is read by several tasks has a row from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def asked() -> Iterator[pa.RecordBatch]:
            every = _keys_in(held)
            rows = [(now, k, _packed_keys(every[s], bits)) for k, s in _buckets(every, bits)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["chunk", "bucket", "keys"])

        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and chunk != now:
                    yield from asked()
                    held = []
                now = chunk
                held.append(_slice(rows))
        if held:
            yield from asked()

    return mapped(chunks, run, "chunk long, bucket int, keys binary")


def score(docs: DataFrame, models: Models, target: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ce_target, ce_background (mean losses in nats) and score, their difference.

    Null, empty and wordless texts have no tokens and 0 everywhere. With an empty target its model is uniform. Repeated rows each get a row, and count as often. Only the columns named are read.
    """
    own = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t"), F.coalesce(target, F.lit(False)).alias("y"))
    chunks = written(_chunked(own), "chunks")
    bits, totals, vocabulary = models.bits, models.totals, models.vocabulary

    def look_up(asked: pa.Table, counts: pa.Table) -> pa.Table:
        # Per chunk the counts of its keys of the bucket, in the order of the keys; 0 for keys without.
        rows = []
        if asked.num_rows and counts.num_rows:
            bucket = counts["bucket"][0].as_py()
            known = _unpacked_keys(counts["keys"][0].as_py(), bucket, bits)
            n_target, n_all = _unpacked(counts["n_target"][0].as_py()), _unpacked(counts["n_all"][0].as_py())
            asked = asked.sort_by("chunk")
            for chunk, own in groupby(zip(asked["chunk"].to_pylist(), asked["keys"].to_pylist(), strict=True), key=lambda x: x[0]):
                parts = [_unpacked_keys(b, bucket, bits) for _, b in own]
                every = parts[0] if len(parts) == 1 else _once(np.concatenate(parts))[0]
                at = np.searchsorted(known, every)
                at = np.where(np.append(known, np.uint64(0))[at] == every, at, len(known))
                rows.append((chunk, bucket, _packed(np.append(n_target, np.uint64(0))[at]), _packed(np.append(n_all, np.uint64(0))[at])))
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, types, strict=True)], names=["chunk", "bucket", "n_target", "n_all"])

    found = _asked(chunks, bits).groupBy("bucket").cogroup(models.counts.groupBy("bucket")).applyInArrow(look_up, "chunk long, bucket int, n_target binary, n_all binary")

    def work(texts: pa.Table, found: pa.Table) -> pa.Table:
        rows = [_slice(x) for x in texts["rows"]]
        known = _keys_in(rows)
        place = dict(_buckets(known, bits))
        counts = np.zeros((2, len(known)), np.int64)
        for k, bucket in enumerate(found["bucket"].to_pylist()):
            counts[0, place[bucket]], counts[1, place[bucket]] = _unpacked(found["n_target"][k].as_py()), _unpacked(found["n_all"][k].as_py())
        out = []
        for part in rows:
            word, pair, bounds = keys(as_bytes(part.column(1)))
            ce = losses(word, pair, bounds, part.column(2).to_numpy(zero_copy_only=False).astype(bool), known, counts, totals, vocabulary)
            out.append(pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(ce[:, 0]), pa.array(ce[:, 1]), pa.array(ce[:, 0] - ce[:, 1])], names=["i", "n_tokens", "ce_target", "ce_background", "score"]))
        return pa.Table.from_batches(out)

    schema = f"i {own.schema['i'].dataType.simpleString()}, n_tokens long, ce_target double, ce_background double, score double"
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(work, schema).withColumnRenamed("i", id)
