"""Packing of token ids into rows of fixed length by best-fit-decreasing.

Documents longer than a row are cut into full rows and a rest, so no token is lost. Documents go to blocks by a hash of id and text, as many
blocks as the table's size asks for, so rows don't depend on files, tasks or cores. The segments of a block
are placed by falling length, each into the open row with the least room that still takes it; a segment
tree over the room values finds it. A block takes BLOCK_BYTES of text on average, so a task holds little; the
loss against packing the whole table at once is about one row that isn't full for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import as_bytes, map_slices, mapped, written
from .bpe import build_lexicon, encoder_for

ROW = 2048
#: Bytes of text that a block has on average.
BLOCK_BYTES = 16 << 20
#: Tokens at which a block is packed and begun anew, which takes a block far beyond the average: copies of one row, without ids.
MOST_TOKENS = 1 << 24
#: Copies of one row, id and text, that stay in one block.
COPIES = 64


class Rooms:
    """A segment tree over room values 1 to `size`: which of them some open row has, and which rows those are."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, row: int) -> None:
        if not room:
            return
        self.rows[room].append(row)
        at = self.leaves + room
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the smallest room that is at least `least`, which is open no more; of several the one opened last."""
        at = self.leaves + least
        if not self.some[at]:
            # Up to the first right-hand neighbour that has rows, then down along the left.
            while at > 1 and (at & 1 or not self.some[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.some[at] = 0
            at >>= 1
            while at and not (self.some[2 * at] or self.some[2 * at + 1]):
                self.some[at] = 0
                at >>= 1
        return room, row


def best_fit_decreasing(lens: np.ndarray, size: int) -> list[list[int]]:
    """Rows of segment numbers; every segment is 1 to `size` long. Ties keep the input's order."""
    rows: list[list[int]] = []
    rooms = Rooms(size)
    for i in np.argsort(-lens, kind="stable").tolist():
        n = int(lens[i])
        got = rooms.take(n)
        if got is None:
            rows.append([i])
            rooms.put(size - n, len(rows) - 1)
        else:
            room, row = got
            rows[row].append(i)
            rooms.put(room - n, row)
    return rows


def _dealt(own: DataFrame) -> DataFrame:
    """(i, t, h, block): each row with its block, of as many as the table's bytes ask for. A row that occurs more than COPIES times is counted, and its copies go to several blocks by their number, whichever files they came from."""
    sizes = written(own.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("t"), F.lit(0))).alias("b")), "sizes")
    total, most = sizes.agg(F.sum("b"), F.max("n")).first()
    blocks = F.lit(1 + (total or 0) // BLOCK_BYTES)
    plain = own.withColumn("block", F.pmod("h", blocks))
    if (most or 0) <= COPIES:
        return plain
    often = sizes.where(F.col("n") > COPIES).select("h")
    counted = own.join(often, "h", "left_semi").groupBy("i", "t", "h").agg(F.count("*").alias("n"))
    copies = counted.select("i", "t", "h", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    copies = copies.withColumn("block", F.pmod(F.xxhash64("h", F.floor(F.col("copy") / COPIES)), blocks)).drop("copy")
    return plain.join(often, "h", "left_anti").select("i", "t", "h", "block").unionByName(copies)


def _encoded(own: DataFrame, name: str, end: int | None) -> DataFrame:
    """(block, h, i, ids) of each row (i, t, h, block)."""

    def work():
        encoder = encoder_for(name)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, first = encoder.encode(as_bytes(batch.column(1)))
            last = [] if end is None else [end]
            ids = [np.append(flat[a:b], np.array(last, "<u4")).astype("<u4").tobytes() for a, b in zip(first, first[1:], strict=False)]
            return pa.RecordBatch.from_arrays([batch.column(3), batch.column(2), batch.column(0), pa.array(ids, pa.binary())], names=["block", "h", "i", "ids"])

        return each

    return map_slices(own, "t", f"block long, h long, i {own.schema['i'].dataType.simpleString()}, ids binary", work)


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", size: int = ROW, pad: int = 0, end: int | None = None) -> DataFrame:
    """One row for each packed row of `size` ids.

    ids: binary, `size` unsigned 32-bit little-endian ids, `pad` behind the last token. n_tokens. doc_ids and
    doc_starts: of each segment its document (ids keep their type) and the position of its first token in that document. cu_seqlens: where each segment
    begins in the row, and the end of the last. position_ids: binary like ids, counting from 0 in each segment. block:
    the packed block; with row_in_block it names the row.

    end: an id appended to each document. Without it, documents without tokens are in no row; null texts count
    as empty. Documents with a null id are packed with a null in doc_ids. Repeated rows are packed as often as they occur; segments of equal
    length are placed in the order of a hash of id and text. An empty table gives an empty result. Only the columns named are read.
    """
    name = build_lexicon(docs.sparkSession, tokenizer)
    own = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t"))
    own = own.withColumn("h", F.xxhash64("i", F.coalesce("t", F.lit(""))))
    kind = own.schema["i"].dataType
    rows = _encoded(_dealt(own), name, end).repartition("block").sortWithinPartitions("block", "h", "i")

    def packed(ids: pa.Array, tokens: list[np.ndarray], block: int, first_row: int) -> tuple[pa.RecordBatch | None, int]:
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        pieces = -(-counts // size)
        owner = np.repeat(np.arange(len(tokens)), pieces)
        if not len(owner):
            return None, first_row
        begin = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
        lens = np.minimum(size, counts[owner] - begin)
        filled = best_fit_decreasing(lens, size)
        # All rows of the block at once: the segments in their order, and where each of their tokens goes.
        segments = np.concatenate([np.array(x) for x in filled])
        per_row = np.fromiter(map(len, filled), np.int64, len(filled))
        row = np.repeat(np.arange(len(filled)), per_row)
        n, cuts = lens[segments], np.concatenate([[0], np.cumsum(per_row)])
        to = np.cumsum(n)
        filling = to[cuts[1:] - 1] - np.concatenate([[0], to[cuts[1:-1] - 1]])
        offset = to - n - np.repeat(np.cumsum(filling) - filling, per_row)
        place = np.arange(int(to[-1])) - np.repeat(to - n, n)
        target = place + np.repeat(row * size + offset, n)
        first = np.cumsum(counts) - counts
        flat, position = np.full(len(filled) * size, pad, "<u4"), np.zeros(len(filled) * size, "<u4")
        flat[target] = np.concatenate(tokens)[place + np.repeat(first[owner[segments]] + begin[segments], n)]
        position[target] = place
        ends = np.arange(len(filled) + 1, dtype=np.int32) * (4 * size)
        binary = lambda x: pa.BinaryArray.from_buffers(pa.binary(), len(filled), [None, pa.py_buffer(ends), pa.py_buffer(x)])
        # Where the segments of a row begin, and where the last one ends.
        edges = np.empty(len(segments) + len(filled), np.int32)
        at = np.arange(len(segments)) + row
        edges[at] = offset
        edges[cuts[1:] + np.arange(len(filled))] = filling
        lists = lambda values, cuts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
        arrays = [
            pa.array(np.full(len(filled), block)), pa.array(np.arange(first_row, first_row + len(filled)), pa.int32()), pa.array(filling, pa.int32()), lists(ids.take(pa.array(owner[segments])), cuts),
            lists(pa.array(begin[segments], pa.int64()), cuts), lists(pa.array(edges), cuts + np.arange(len(filled) + 1)), binary(flat), binary(position),
        ]
        names = ["block", "row_in_block", "n_tokens", "doc_ids", "doc_starts", "cu_seqlens", "ids", "position_ids"]
        return pa.RecordBatch.from_arrays(arrays, names=names), first_row + len(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        now, held, row = -1, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, row
            if tokens:
                out, row = packed(pa.concat_arrays(ids), tokens, now, row)
                ids.clear()
                tokens.clear()
                held = 0
                if out is not None:
                    for k in range(0, out.num_rows, 512):
                        yield out.slice(k, 512)

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if blocks[a] != now:
                    yield from flush()
                    now, row = int(blocks[a]), 0
                while a < b:
                    to = a
                    while to < b and held < MOST_TOKENS:
                        tokens.append(np.frombuffer(batch.column(3)[to].as_buffer(), "<u4"))
                        held += len(tokens[-1])
                        to += 1
                    ids.append(batch.column(2).slice(a, to - a))
                    a = to
                    if held >= MOST_TOKENS:
                        yield from flush()
        yield from flush()

    schema = f"block long, row_in_block int, n_tokens int, doc_ids array<{kind.simpleString()}>, doc_starts array<long>, cu_seqlens array<int>, ids binary, position_ids binary"
    return mapped(rows, run, schema)
