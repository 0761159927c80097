"""Near-duplicate detection by SimHash fingerprints and covering locality-sensitive hashing.

A covering family for radius r over 64 bits: every bit position gets a non-zero vector of r + 1 bits, and
every non-zero vector v of r + 1 bits gives a mask that keeps the positions whose vector has an odd inner
product with v. Any r positions span a space of dimension r at most, so some v is orthogonal to all of
them: under that mask two fingerprints that differ in those r positions are equal. With r = 3 there are
15 masks of about 34 kept bits, each a table; pairs within the radius meet in one of them with
certainty, and unrelated fingerprints hardly ever do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words
from ._batches import as_bytes, drop_written, map_slices, mapped, written
from .components import components

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Buckets up to this size are compared pair by pair; larger ones through the values between their members.
SMALL_BUCKET = 512
#: A bucket of more fingerprints than this is split by further bits before any task gets it.
HOT_BUCKET = 1 << 18


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits."""
    of = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (of[i] & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def fingerprints_of(texts: list[bytes], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprint of each text as an unsigned 64-bit number."""
    words = _words.split(texts, _words.SPACES)
    one = _words.spaced(words)
    n = one.counts()
    out = np.zeros(len(texts), dtype=np.uint64)
    ends = one.starts + one.lens
    if len(one):
        # A shingle starts at each word that has size - 1 successors in its text, or at the first of a shorter text.
        rows = one.rows()
        last = np.minimum(np.arange(len(one)) + size - 1, len(one) - 1)
        short = (n[rows] < size) & (np.arange(len(one)) == one.bounds[rows])
        whole = np.arange(len(one)) + size <= one.bounds[rows + 1]
        last = np.where(short, one.bounds[rows + 1] - 1, last)
        at = np.flatnonzero(whole | short)
        h = _words.xxh64(one.buf, one.starts[at], ends[last[at]] - one.starts[at], seed)
        first = np.searchsorted(at, one.bounds)
        for i in np.flatnonzero(n):
            own = h[first[i] : first[i + 1]]
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduce(bits, axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = SHINGLE) -> DataFrame:
    """The columns `keep` and `fp`, the fingerprint as a long of the same bits.

    Null and blank texts have fingerprint 0. Any other column of the input may have any name: only those named are read.
    """
    own = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("t"))
    kinds = [f.dataType.simpleString() for f in own.schema.fields[:-1]]

    def work():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = fingerprints_of(as_bytes(batch.column(len(keep))), size).view(np.int64)
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fp)], names=[*(f"k{i}" for i in range(len(keep))), "fp"])

        return each

    out = map_slices(own, "t", ", ".join([*(f"k{i} {k}" for i, k in enumerate(kinds)), "fp long"]), work)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "fp")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between n nodes, as few as hold the same nodes together."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def _link_large(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together all members within `radius`, by the values halfway between them.

    With near = radius // 2 and far = radius - near: members within the radius have a value at most `near`
    bits from one and at most `far` from the other. Whoever is `far` from a value is within the radius of
    whoever is `near` to it. So each member lists the values around it that differ in bits which
    vary in this bucket, and is linked to one member near to such a value: time and memory grow with the
    members, not with their pairs.
    """
    vary = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [np.uint64(1 << i) for i in range(BITS) if vary >> i & 1]

    def patterns(most: int) -> list[np.uint64]:
        out = [np.uint64(0)]
        level = [(np.uint64(0), -1)]
        for _ in range(most):
            level = [(p | b, i) for p, last in level for i, b in enumerate(bits) if i > last]
            out += [p for p, _ in level]
        return out

    near = radius // 2
    around = np.concatenate([fps ^ p for p in patterns(near)])
    owner = np.tile(np.arange(len(fps)), len(around) // len(fps))
    order = np.argsort(around, kind="stable")
    around, owner = around[order], owner[order]
    first = np.concatenate([[True], around[1:] != around[:-1]])
    around, owner = around[first], owner[first]
    label_a, label_b = np.arange(0), np.arange(0)
    for p in patterns(radius - near):
        want = fps ^ p
        at = np.minimum(np.searchsorted(around, want), len(around) - 1)
        hit = np.flatnonzero((around[at] == want) & (owner[at] != np.arange(len(fps))))
        if len(hit):
            label_a, label_b = _forest(len(fps), np.concatenate([label_a, hit]), np.concatenate([label_b, owner[at[hit]]]))
    return label_a, label_b


def _link_sorted(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys, as few as keep connected what is within the radius."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.diff(edge)
    found_a, found_b = [], []
    in_small = np.repeat(np.where(size <= SMALL_BUCKET, size, 1), size)
    at = np.flatnonzero(in_small > 1)
    end = np.repeat(edge[1:], size)
    step = 1
    while len(at := at[at + step < end[at]]):
        hit = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= radius]
        found_a.append(hit)
        found_b.append(hit + step)
        step += 1
    for k in np.flatnonzero(size > SMALL_BUCKET):
        a, b = _link_large(fps[edge[k] : edge[k + 1]], radius)
        found_a.append(a + edge[k])
        found_b.append(b + edge[k])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    own, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = _forest(len(own), where[: len(a)], where[len(a) :])
    return own[a], own[b]


def signed(x: int) -> int:
    """The long of the same 64 bits."""
    return x - (1 << 64) if x >> 63 else x


def narrower(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks that split what one mask holds together: its other bits fall into radius + 1 groups, and of two values within the radius one group at least is equal."""
    mask &= (1 << BITS) - 1
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k :: radius + 1]) for k in range(min(radius + 1, max(1, len(free))))]


def _masked(rows: DataFrame, masks: Column) -> DataFrame:
    """(mask, key, fp): each fingerprint under each of its masks."""
    return rows.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def buckets(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(mask, key, fp): the fingerprints in all their buckets, none of which is hot, whatever their number.

    A bucket of more than HOT_BUCKET members is dealt out under narrower masks, which keep every pair within the radius in some
    bucket, and so on. Only the masks that have hot buckets come to the driver.
    """
    now = _masked(distinct.select("fp"), F.array(*[F.lit(signed(m)) for m in covering_masks(radius)]))
    out = None
    while True:
        hot = written(now.groupBy("mask", "key").count().where(F.col("count") > HOT_BUCKET).select("mask", "key"), "hot")
        masks = [r.mask for r in hot.select("mask").distinct().collect()]
        if not masks:
            drop_written(hot)
            return now if out is None else out.unionByName(now)
        # At most one row for each HOT_BUCKET rows of `now`.
        cool = now.join(F.broadcast(hot), ["mask", "key"], "left_anti")
        out = cool if out is None else out.unionByName(cool)
        into = F.create_map(*[F.lit(x) if isinstance(x, int) else F.array(*[F.lit(signed(m)) for m in x]) for m0 in masks for x in (m0, narrower(m0, radius))])
        now = _masked(now.join(F.broadcast(hot), ["mask", "key"], "left_semi").select("fp", F.element_at(into, F.col("mask")).alias("into")), F.col("into")).distinct()


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between different fingerprints of the column `fp`, which connect all that are within the radius.

    Not every pair is listed: of each bucket as few links as hold its near members together, so a bucket of n rows gives n - 1 at most.
    """
    rows = buckets(distinct, radius).repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def linked(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(part) > 1:
                # Masked values under different masks may be equal, so both are the key.
                change = np.cumsum(np.concatenate([[0], (part[1:, :2] != part[:-1, :2]).any(axis=1)]))
                a, b = _link_sorted(change, part[:, 2].view(np.uint64), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(part[a, 2]), pa.array(part[b, 2])], names=["a", "b"])

        for batch in batches:
            new = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if not len(new):
                continue
            held.append(new)
            if (held[0][0, :2] == new[-1, :2]).all():
                continue  # still the same bucket
            part = np.concatenate(held)
            cut = len(part) - int(np.argmax((part[::-1, :2] != part[-1, :2]).any(axis=1)))
            yield from linked(np.ascontiguousarray(part[:cut]))
            held = [part[cut:]]
        if held:
            yield from linked(np.ascontiguousarray(np.concatenate(held)))

    return mapped(rows, run, "a long, b long")


def _classes(own: DataFrame, radius: int) -> DataFrame:
    """(fp, root) of the distinct fingerprints of a table."""
    distinct = own.select("fp").distinct()
    found = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    return distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """Per document: id, fp (long), component_id (smallest id among all that links reach, itself included).

    Nulls: a null text counts as empty; a row with a null id takes part like any other, and component_id
    is null only where no reachable row has an id. Texts without words have fingerprint 0 and are linked
    like others. Repeated rows each get a row. An empty table gives an empty result. Only the two columns named are read.
    """
    own = written(fingerprints(docs, text, (id,), size).withColumnRenamed(id, "id"), "fingerprints")
    known = written(_classes(own, radius).join(own.groupBy("fp").agg(F.min("id").alias("least_id")), "fp"), "classes")
    least = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = known.join(least, "root").select("fp", "component_id", "root")
    return own.join(classes, "fp").select(F.col("id").alias(id), "fp", "component_id", "root")


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits of a long."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def first_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """The documents without near duplicates: of each group exactly one row stays, with all its columns.

    The row with the smallest id stays, nulls behind all others; of several with that id the one whose text has the smallest SHA-256,
    and of those with equal texts the one whose other columns come first as JSON. So a row is chosen by its own
    fingerprint, also where rows with one id have different texts. Null texts count as empty. Repeated rows are near
    duplicates of each other. An empty table gives an empty result. Columns may have any names.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    i, t = names[docs.columns.index(id)], names[docs.columns.index(text)]
    # The fingerprint depends on the text alone, so id and digest name what a row is in a group.
    plain = docs.toDF(*names).withColumn("d_", F.unhex(F.sha2(F.encode(F.coalesce(F.col(t).cast("string"), F.lit("")), "UTF-8"), 256)))
    own = written(fingerprints(plain, t, (i, "d_"), size).withColumnsRenamed({i: "i_"}), "fingerprints")
    rows = own.groupBy("fp", "i_", "d_").agg(F.count("*").alias("n_"))
    order = F.struct(F.col("i_").isNull().alias("a"), F.col("i_").alias("i_"), F.col("d_").alias("d_"))
    first = rows.join(_classes(own, radius), "fp").groupBy("root").agg(F.min(F.struct(order.alias("k"), "n_")).alias("m"))
    first = written(first.select(F.col("m.k.i_").alias("i_"), F.col("m.k.d_").alias("d_"), F.col("m.n_").alias("n_")), "firsts")

    def of(rows: DataFrame) -> DataFrame:
        right = rows.select("i_", F.col("d_").alias("e_"))
        return plain.join(right, plain[i].eqNullSafe(right["i_"]) & (plain["d_"] == right["e_"]), "left_semi")

    out = of(first.where("n_ = 1")).select(*names)
    again = first.where("n_ > 1")
    if again.limit(1).count():
        # Rows with one id and text: an aggregate, so that repeats of any number meet only as one row of each task.
        rest = F.to_json(F.struct(F.col(t).isNull().alias("null"), *[F.col(n) for n in names if n != t]))
        one = of(again).groupBy(i, "d_").agg(F.min_by(F.struct(*names), rest).alias("r"))
        out = out.unionByName(one.select("r.*"))
    return out.toDF(*docs.columns)
