"""Shards of nearly equal bytes by sampled splitters.

Records are ordered by a key: the digest of the text, then that of the id. Keys are drawn with a chance in proportion to their
records' sizes; quantiles of the sample split the order into many ranges, and every range that turns out too full is sampled again and subdivided, so that
no task gets much more than its part, whatever the keys' sizes or copies. Exact sizes of all ranges then say where the shards begin: the cut
before the first record with at least k / n of all bytes before it.

Copies of a text stand side by side. A cut inside a group of copies moves to its end if the group has at most 1 / (64 n) of all bytes; larger groups are cut
where the bytes say. So each shard has the n-th part of all bytes, but for a record and such a group at either end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._batches import mapped, written

SHARDS = 16
#: A range has so many rows on average, as far as MOST_RANGES allows; the ranges' bounds and sizes are all that comes to the driver.
ROWS_IN_RANGE, LEAST_RANGES, MOST_RANGES = 1 << 16, 256, 1 << 16
#: Keys drawn for each range, and again for each part of a range that is too full.
DRAWN, DRAWN_AGAIN = 32, 256
#: Rounds of subdividing; one is enough unless the sample was unlucky.
ROUNDS = 4
#: Digits of the text's digest, and of the whole key.
GROUP_DIGITS, KEY_DIGITS = 16, 48


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with _size, _crc and _key: 16 digits each of the text's digest, the id's, and a number of the row that tells equal rows apart."""
    raw = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    named = F.encode(F.coalesce(F.col(id).cast("string"), F.lit("")), "UTF-8")
    digits = lambda c: F.substring(F.md5(c), 1, GROUP_DIGITS)
    tie = F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0")
    return docs.withColumns({"_size": F.octet_length(raw).cast("long") + 1, "_crc": F.crc32(raw), "_key": F.concat(digits(raw), digits(named), tie)})


@dataclass
class Ranges:
    """splitters: where each range but the first begins. rows, size: of each range."""

    splitters: list[str]
    rows: np.ndarray
    size: np.ndarray


def _ranged(slim: DataFrame, splitters: list[str]) -> DataFrame:
    """The rows with _range, the number of the splitters up to their key."""
    bounds = np.array([s.encode() for s in splitters], dtype=f"S{KEY_DIGITS}")
    at = slim.columns.index("_key")

    def run(batches):
        for b in batches:
            keys = np.array(b.column(at).to_pylist(), dtype=f"S{KEY_DIGITS}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(bounds, keys, side="right"), pa.int32())], names=[*b.schema.names, "_range"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    return mapped(slim, run, f"{kinds}, _range int")


def _drawn(rows: DataFrame, chance: float, salt: int) -> list[tuple[str, float]]:
    """(key, weight) of a sample in which a row is with a chance in proportion to its size, in the order of the keys. Its expected length is the rows' bytes times chance at most."""
    u = F.pmod(F.xxhash64("_key", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    got = rows.where(u < F.col("_size") * chance).select("_key", F.greatest(F.col("_size").cast("double"), F.lit(1.0 / chance)).alias("w")).collect()
    return sorted((r["_key"], r["w"]) for r in got)


def _quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    """Keys that split a sorted sample into parts of equal weight. A text that is chosen once begins at its first copy; one that is chosen again and again is split."""
    if not sample:
        return []
    run = np.cumsum([w for _, w in sample])
    chosen = [sample[int(i)][0] for i in np.searchsorted(run, run[-1] * np.arange(1, parts) / parts)]
    group = [k[:GROUP_DIGITS] for k in chosen]
    alone = [(i == 0 or group[i - 1] != g) and (i + 1 == len(group) or group[i + 1] != g) for i, g in enumerate(group)]
    return sorted({g if one else k for k, g, one in zip(chosen, group, alone, strict=True)})


def split(slim: DataFrame) -> Ranges:
    """Ranges of nearly equal bytes over a table with _key and _size, none above twice the mean unless it is one row."""
    slim = slim.select("_key", "_size")
    total = slim.agg(F.count("*").alias("n"), F.sum("_size").alias("b")).first()
    if not total["n"]:
        return Ranges([], np.zeros(1, np.int64), np.zeros(1, np.int64))
    wanted = min(MOST_RANGES, max(LEAST_RANGES, total["n"] // ROWS_IN_RANGE))
    splitters = _quantiles(_drawn(slim, DRAWN * wanted / total["b"], 0), wanted)
    for round in range(1, ROUNDS + 1):
        rows, size = np.zeros(len(splitters) + 1, np.int64), np.zeros(len(splitters) + 1, np.int64)
        ranged = _ranged(slim, splitters)
        for r in ranged.groupBy("_range").agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect():
            rows[r["_range"]], size[r["_range"]] = r["n"], r["b"]
        over = np.flatnonzero((size * wanted > 2 * total["b"]) & (rows > 1))
        if not len(over) or round == ROUNDS or len(splitters) > 2 * MOST_RANGES:
            break
        sample = _drawn(ranged.where(F.col("_range").isin(over.tolist())), DRAWN_AGAIN * wanted / total["b"], round)
        of = np.searchsorted(np.array(splitters), np.array([k for k, _ in sample]), side="right") if splitters and sample else np.zeros(len(sample), int)
        more = {k for r in over.tolist() for k in _quantiles([x for x, o in zip(sample, of.tolist(), strict=True) if o == r], int(-(-size[r] * wanted // total["b"])))}
        if not more - set(splitters):
            break
        splitters = sorted(more | set(splitters))
    return Ranges(splitters, rows, size)


def _placed(slim: DataFrame, ranges: Ranges, only: list[int] | None = None) -> DataFrame:
    """Rows with their place in the whole order, _at, and the bytes before them, _before. Each range is sorted in a task of its own."""
    own = _ranged(slim, ranges.splitters)
    if only is not None:
        own = own.where(F.col("_range").isin(only))
    first, before = np.cumsum(ranges.rows) - ranges.rows, np.cumsum(ranges.size) - ranges.size
    starts = slim.sparkSession.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(first, before, strict=True))], "_range int, _first long, _bytes long")
    window = Window.partitionBy("_range").orderBy("_key")
    own = own.withColumn("_at", F.row_number().over(window).cast("long") - 1).withColumn("_before", F.sum("_size").over(window.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    # At most 2 * MOST_RANGES rows and a few more.
    return own.join(F.broadcast(starts), "_range").withColumn("_at", F.col("_at") + F.col("_first")).withColumn("_before", F.col("_before") + F.col("_bytes")).drop("_first", "_bytes")


def cuts(slim: DataFrame, ranges: Ranges, shards: int) -> list[int]:
    """Where each shard but the first begins, as places in the whole order. Only the ranges around the cuts are read in order."""
    n, total = int(ranges.rows.sum()), int(ranges.size.sum())
    if not n:
        return [0] * (shards - 1)
    slim = slim.select("_key", "_size")
    before = np.cumsum(ranges.size) - ranges.size
    wanted = [-(-k * total // shards) for k in range(1, shards)]
    # The range in which the bytes pass the mark; the first record at or behind it may begin the next one.
    at = [int(np.searchsorted(before, w, side="right")) - 1 for w in wanted]
    found = _placed(slim, ranges, sorted(set(at))).select("_at", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(wanted)])).alias("c"), "_before").where("_before >= c.w")
    best = {r["k"]: r["m"] for r in found.groupBy("c.k").agg(F.min("_at").alias("m")).collect()}
    ends = np.cumsum(ranges.rows)
    out = [int(min(best.get(k, n), ends[at[k]])) for k in range(shards - 1)]
    # Groups of copies that a cut runs through: the record before it and the one behind it have one text.
    edge = _placed(slim, ranges, sorted({int(r) for c in out for i in (c - 1, c) if 0 <= i < n for r in [np.searchsorted(ends, i, side="right")]}))
    group = F.substring("_key", 1, GROUP_DIGITS)
    sides = {r["_at"]: r["g"] for r in edge.where(F.col("_at").isin(sorted({i for c in out for i in (c - 1, c)}))).select("_at", group.alias("g")).collect()}
    cut = sorted({sides[c] for c in out if 0 < c < n and sides[c - 1] == sides[c]})
    if not cut:
        return out
    size = {r["g"]: (r["n"], r["b"]) for r in slim.where(group.isin(cut)).groupBy(group.alias("g")).agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect()}
    small = [g for g in cut if size[g][1] * 64 * shards <= total]
    touched = [r for r in range(len(ranges.rows)) for g in small if (r == 0 or ranges.splitters[r - 1][:GROUP_DIGITS] <= g) and (r == len(ranges.splitters) or ranges.splitters[r] >= g)]
    last = {}
    if small:
        last = {r["g"]: r["m"] for r in _placed(slim, ranges, sorted(set(touched))).where(group.isin(small)).groupBy(group.alias("g")).agg(F.max("_at").alias("m")).collect()}
    return [int(last[sides[c]]) + 1 if 0 < c < n and sides[c - 1] == sides[c] and sides[c] in last else c for c in out]


def _shard(at: F.Column, begins: list[int]) -> F.Column:
    return sum((F.when(at >= c, 1).otherwise(0) for c in begins), F.lit(0)).cast("int")


def assign(docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, size (UTF-8 bytes and 1), text_crc32, shard, slot (its place within the shard, from 0). Only the columns named are read, once.

    Null texts are empty, null ids count as empty ones in the order. Repeated rows each get a place of their own; rows that are equal in id and text may
    have each other's. Texts of any length count whole: a text larger than a shard's part leaves the shards behind it smaller or empty. Empty documents give an empty result. Ties don't exist,
    but for such equal rows. The result depends on the rows alone, not on the sample nor on files or tasks.
    """
    slim = written(keyed(docs.select(F.col(id).alias("i"), F.col(text).alias("t")), "i", "t").select("i", "_size", "_crc", "_key"), "keys")
    ranges = split(slim)
    begins = cuts(slim, ranges, shards)
    at = _shard(F.col("_at"), begins)
    first = F.element_at(F.array(*[F.lit(c).cast("long") for c in (0, *begins)]), at + 1)
    placed = _placed(slim, ranges)
    return placed.select(F.col("i").alias(id), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), at.alias("shard"), (F.col("_at") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> None:
    """Write the documents, all columns, into path/shard=k, each shard in the order of its slots. Nulls, ties and repeats as in assign().

    The records are moved once, by their range; a range is one file at most, so no task holds a shard.
    """
    spark = docs.sparkSession
    clash = {"_size", "_crc", "_key", "_range", "_at", "_before", "shard"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns that the shards need themselves: {sorted(clash)}")
    whole = written(keyed(docs, id, text), "keyed")
    slim = whole.select("_size", "_key")
    ranges = split(slim)
    begins = cuts(slim, ranges, shards)
    ends = np.cumsum(ranges.rows)
    n = int(ends[-1])
    near = sorted({int(np.searchsorted(ends, c, side="right")) for c in begins if c < n})
    keys = {r["_at"]: r["_key"] for r in _placed(slim, ranges, near).where(F.col("_at").isin(begins)).select("_at", "_key").collect()} if near else {}
    shard = sum((F.when(F.col("_key") >= keys[c], 1).otherwise(0) for c in begins if c < n), F.lit(0)).cast("int")
    dealt = _ranged(whole, ranges.splitters).withColumn("shard", shard).repartition("_range").sortWithinPartitions("shard", "_key")
    dealt.select(*docs.columns, "shard").write.partitionBy("shard").parquet(path)
    if not n:
        spark.createDataFrame([], docs.schema).write.mode("append").parquet(path)
