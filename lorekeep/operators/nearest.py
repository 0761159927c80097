"""An index of vectors in cells, for nearest neighbours and for pairs above a similarity.

Cells are an inverted file: a bounded sample gives their centers, every vector belongs to the center that it is nearest to, and each cell knows between
which angles to its center its members lie. By the triangle inequality a vector can have a neighbour within an angle only in cells
whose members are that near, so the other cells are left out without losing anything. How many that are depends on the vectors: where they lie in clusters almost all,
among random directions of many dimensions almost none, as there every vector is about as far from every center.

What is left is compared in blocks: the vectors of a cell that many others ask for are dealt out in parts of bounded size, and a task multiplies one part of either side as matrices. Equal
vectors are one vector with several ids, so copies don't multiply. No pair is formed before it's compared, and nothing but the centers and the cells' bounds comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from ..ship import ship

#: Vectors of a cell on average, as far as MOST_CELLS allows, and of one side of a block.
IN_CELL, MOST_CELLS, BLOCK = 2048, 4096, 4096
#: Vectors for each center in the sample that the centers are made from, and rounds of making them.
SAMPLE, ROUNDS = 16, 5
#: Queries by which the number of cells to look into is measured.
TRIAL = 256
#: Added to bounds, against rounding.
SLACK = 1e-9


@dataclass
class Cells:
    """centers: unit vectors. low, high: least and greatest angle of each cell's members to its center."""

    centers: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def angles(self, v: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(v @ self.centers.T, -1.0, 1.0))

    def least_angle(self, v: np.ndarray) -> np.ndarray:
        """For each vector and cell an angle that no member of the cell is nearer than."""
        own = self.angles(v)
        return np.maximum(0.0, np.maximum(own - self.high, self.low - own))


def unit_rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Unit vectors as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True)) if len(v) else v


def usable(df: DataFrame, id: str, dim: int | None = None) -> DataFrame:
    """(i, v) of the rows with an id and a vector that has a direction and the index's length."""
    v = F.col("embedding").cast("array<double>")
    own = df.select(F.col(id).alias("i"), v.alias("v")).where(F.col("i").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return own if dim is None else own.where(F.size("v") == dim)


def _mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _centers(sample: np.ndarray, n: int) -> np.ndarray:
    """Directions of n groups of a sample, by a few rounds of spherical k-means from every so-many-th vector."""
    if not len(sample):
        return sample
    centers = sample[np.unique(np.linspace(0, len(sample) - 1, n).astype(int))]
    for _ in range(ROUNDS):
        of = np.concatenate([(part @ centers.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        total = np.zeros_like(centers)
        np.add.at(total, of, sample)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centers = np.where(size > 0, total / np.where(size > 0, size, 1.0), centers)
    return centers


def sampled_centers(own: DataFrame, n: int, dim: int) -> np.ndarray:
    """Centers of the cells of n vectors v, from a sample that a hash of the vectors chooses: SAMPLE for each of MOST_CELLS cells at most on average."""
    cells, space = max(1, min(MOST_CELLS, n // IN_CELL)), 1 << 40
    part = own.where(F.pmod(F.xxhash64("v"), F.lit(space)) < F.lit(int(min(1.0, cells * SAMPLE / max(1, n)) * space))).select("v").collect()
    sample = np.array([r["v"] for r in part], np.float64).reshape(-1, dim or 1)
    sample = sample[np.lexsort(sample.T)] if len(sample) else sample
    sample = sample / np.sqrt((sample * sample).sum(axis=1, keepdims=True))
    # A sample may by chance have no vector at all; any direction is a center then.
    return _centers(sample, cells) if len(sample) else np.eye(1, dim or 1)


def assigned(own: DataFrame, centers: np.ndarray) -> DataFrame:
    """The rows with the cell of their vector v and its angle to the center."""
    at, dim = own.columns.index("v"), centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = unit_rows(b.column(at), dim) @ centers.T
            of = s.argmax(axis=1) if len(s) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(s[np.arange(len(s)), of], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(angle), *b.columns], names=["cell", "angle", *b.schema.names])

    return _mapped(own, run, f"cell int, angle double, {_kinds(own)}")


def cells_of(members: DataFrame, centers: np.ndarray) -> Cells:
    """The cells of assigned rows, with their bounds: one row for each comes to the driver."""
    low, high = np.full(len(centers), np.inf), np.full(len(centers), -np.inf)
    for r in members.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect():
        low[r["cell"]], high[r["cell"]] = r["low"] - SLACK, r["high"] + SLACK
    return Cells(centers, low, high)


def asking(queries: DataFrame, marks: Callable[[np.ndarray, np.ndarray | None], np.ndarray], dim: int) -> DataFrame:
    """A row for each query and cell that marks(unit vectors, the column least if there is one) marks: the query's columns but least, and cell."""
    own = queries.drop("least")
    names = [*own.columns, "cell"]
    at, least = queries.columns.index("v"), queries.columns.index("least") if "least" in queries.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                row, cell = np.nonzero(marks(unit_rows(part.column(at), dim), None if least is None else part.column(least).to_numpy(zero_copy_only=False)))
                kept = [c for k, c in enumerate(part.columns) if k != least]
                for k in range(0, len(row), 8192):
                    rows = pa.array(row[k : k + 8192])
                    yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in kept), pa.array(cell[k : k + 8192], pa.int32())], names=names)

    return _mapped(queries, run, f"{_kinds(own)}, cell int")


def open_to(queries: DataFrame, cells: Cells, least: float) -> DataFrame:
    """The queries (with v) with each cell that may hold a vector of similarity `least` or more."""
    return asking(queries, lambda v, _: (np.cos(cells.least_angle(v)) >= least - SLACK) & np.isfinite(cells.high), cells.centers.shape[1])


class VectorIndex:
    """An index of the rows of a table. members: cell, ids (the smallest of each different vector, in order), v; written to the shared folder.

    Rows without an id or a vector, and those whose vector has no direction or another length than the first row's, are left out. An empty table gives an empty index.
    """

    def __init__(self, known: DataFrame, id: str = "id", keep: int = 11):
        self.keep = keep
        own = usable(known, id)
        first = own.select(F.size("v").alias("d")).first()
        self.dim = first["d"] if first else 0
        own = own.where(F.size("v") == self.dim)
        self.kind = own.schema["i"].dataType.simpleString()
        # Of equal vectors as many ids as can be asked for; a task keeps no more before the shuffle either.
        place = F.row_number().over(Window.partitionBy("v").orderBy("i"))
        own = own.withColumn("n", place).where(F.col("n") <= keep).groupBy("v").agg(F.array_sort(F.collect_list("i")).alias("ids"))
        own = written(own, "vectors", keep=True)
        self.n = own.count()
        centers = sampled_centers(own, self.n, self.dim)
        self.members = written(assigned(own, centers), "cells", keep=True)
        self.cells = cells_of(self.members, centers)

    def top(self, queries: DataFrame, k: int = 1, id: str = "id", probes: int | None = None, exact: bool = True) -> DataFrame:
        """Of each query the k nearest rows of another id: id, rank (from 1), best_id, similarity, compared (how many different vectors it was compared with).

        The nearest `probes` cells come first (by default as many as trial() finds to be enough). If exact, all further cells that may hold a nearer one follow, so the result is
        that of a comparison with all rows. Equally near ones go by the smaller id. Queries without a usable vector have no rows.
        """
        if k >= self.keep:
            raise ValueError("the index keeps too few ids of equal vectors for this")
        own = usable(queries, id, self.dim).select(F.col("i").alias("a"), "v", F.lit(-1.0).alias("least"))
        probes = probes if probes is not None else 1 if exact else self.trial(k)
        cells = self.cells

        def nearest_cells(v: np.ndarray, _: np.ndarray) -> np.ndarray:
            angle = np.where(np.isfinite(cells.high), cells.angles(v), np.inf)
            out = np.zeros(angle.shape, bool)
            np.put_along_axis(out, np.argsort(angle, axis=1, kind="stable")[:, :probes], True, axis=1)
            return out & np.isfinite(angle)

        first = written(self._best(asking(own, nearest_cells, self.dim), k), "found", keep=True)
        found = first
        if exact and len(cells.centers) > probes:
            # What the first cells leave open; where they have too few vectors everything is.
            so_far = first.groupBy("a").agg(F.min("s").alias("s"), F.count("*").alias("n")).select("a", F.when(F.col("n") > k, F.col("s")).otherwise(-1.0).alias("least"))
            rest = own.drop("least").join(so_far, "a", "left").select("a", "v", F.coalesce("least", F.lit(-1.0)).alias("least"))

            def open_cells(v: np.ndarray, least: np.ndarray) -> np.ndarray:
                return (np.cos(cells.least_angle(v)) >= least[:, None] - SLACK) & np.isfinite(cells.high) & ~nearest_cells(v, least)

            found = first.unionByName(self._best(asking(rest, open_cells, self.dim), k))
        found = found.withColumn("compared", F.sum("compared").over(Window.partitionBy("a")))
        each = found.select("a", "s", "compared", F.explode("ids").alias("b")).where("a <> b")
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
        return each.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("a").alias(id), "rank", F.col("b").alias("best_id"), F.col("s").alias("similarity"), "compared")

    def _best(self, asked: DataFrame, k: int) -> DataFrame:
        """(a, s, ids, compared): the k + 1 nearest different vectors of each query among the cells asked for. compared is on a query's first row, 0 on the others."""
        dim, kind = self.dim, self.kind
        schema = f"a {asked.schema['a'].dataType.simpleString()}, s double, ids array<{kind}>, compared long"

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            rows, where, sims, compared = [], [], [], []
            if left.num_rows and right.num_rows:
                members = unit_rows(right["v"], dim)
                for start in range(0, left.num_rows, 512):
                    s = unit_rows(left["v"].slice(start, 512), dim) @ members.T
                    n = min(k + 1, s.shape[1])
                    best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                    rows.append(np.repeat(np.arange(start, start + len(s)), n))
                    where.append(best.ravel())
                    sims.append(np.take_along_axis(s, best, axis=1).ravel())
                    compared.append(np.tile([right.num_rows] + [0] * (n - 1), len(s)))
            row, at, s, total = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, where, sims, compared))
            columns = [left["a"].take(pa.array(row, pa.int64())), pa.array(s, pa.float64()), right["ids"].take(pa.array(at, pa.int64())), pa.array(total, pa.int64())]
            return pa.Table.from_arrays(columns, names=["a", "s", "ids", "compared"])

        found = blocks(asked, self.members.select("cell", "v", "ids"), ("cell",), F.xxhash64("a"), F.xxhash64("v"), compare, schema)
        # A task sends k + 1 rows of a query and part at most.
        each = Window.partitionBy("a")
        place = F.row_number().over(each.orderBy(F.desc("s"), F.col("ids")[0]))
        found = found.withColumn("compared", F.sum("compared").over(each)).withColumn("n", place).where(F.col("n") <= k + 1)
        return found.withColumn("compared", F.when(F.col("n") == 1, F.col("compared")).otherwise(0)).drop("n")

    def trial(self, k: int = 10, share: float = 0.95) -> int:
        """How many cells a query has to look into so that a sample of known vectors finds `share` of its k nearest: measured against all vectors in one scan."""
        space = 1 << 40
        chosen = self.members.where(F.pmod(F.xxhash64("v", F.lit(1)), F.lit(space)) < F.lit(int(min(1.0, TRIAL / max(1, self.n)) * space))).select("v").collect()
        if not chosen:
            return 1
        own = np.array([r["v"] for r in chosen])
        own = own / np.sqrt((own * own).sum(axis=1, keepdims=True))
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = own @ unit_rows(b.column(1), dim).T
                if not s.size:
                    continue
                n = min(k + 1, s.shape[1])
                best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                cell = b.column(0).to_numpy(zero_copy_only=False)[best.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(s)), n), pa.int32()), pa.array(np.take_along_axis(s, best, axis=1).ravel()), pa.array(cell, pa.int32())], names=["q", "s", "cell"])

        found = _mapped(self.members.select("cell", "v"), run, "q int, s double, cell int")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))
        # The nearest of all is the query itself. TRIAL times k rows come to the driver.
        got = found.withColumn("n", place).where((F.col("n") > 1) & (F.col("n") <= k + 1)).select("q", "cell").collect()
        rank = np.argsort(np.argsort(np.where(np.isfinite(self.cells.high), self.cells.angles(own), np.inf), axis=1), axis=1)
        needed = sorted(int(rank[r["q"], r["cell"]]) + 1 for r in got)
        return needed[min(len(needed) - 1, int(share * len(needed)))] if needed else 1


def blocks(left: DataFrame, right: DataFrame, by: tuple[str, ...], left_hash, right_hash, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """compare(left, right) for the rows of both sides that share the columns `by`, in parts of about BLOCK rows of either side.

    Each part of one side meets each part of the other, so no task gets more than two parts, however many rows share a key; keys of one side alone take no part.
    """
    ship(left.sparkSession)
    parts = lambda d, name: d.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    both = parts(left, "_ln").join(parts(right, "_rn"), list(by))
    deal = lambda d, own, n, other, m, hash: d.join(both, list(by)).withColumn(own, F.pmod(hash, F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
    one = deal(left, "_l", "_ln", "_r", "_rn", left_hash).drop("_ln", "_rn")
    two = deal(right, "_r", "_rn", "_l", "_ln", right_hash).drop("_ln", "_rn")
    keys = [*by, "_l", "_r"]
    return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(compare, schema)


#: Vectors of one side of a task that looks for links, and into how many parts each side is dealt if it has enough.
SIDE, SIDES = 131_072, 8
#: Rounding of products in single precision.
ROUNDING = 1e-5


def _packed(own: DataFrame, dim: int) -> DataFrame:
    """(node, cell, u): unit vectors in single precision as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = np.ascontiguousarray(unit_rows(b.column(2), dim).astype(np.float32))
            data = pa.py_buffer(u.tobytes())
            ends = pa.py_buffer((np.arange(len(u) + 1) * 4 * dim).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.Array.from_buffers(pa.binary(), len(u), [None, ends, data])], names=["node", "cell", "u"])

    return _mapped(own.select("node", "cell", "v"), run, "node long, cell int, u binary")


class _Linked:
    """Which of numbers 0 to n - 1 are linked already."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.up[i] = j
        return i != j


def near_links(left: DataFrame | None, right: DataFrame, cells: Cells, n_left: int, n_right: int, least: float) -> DataFrame:
    """(a, b): links between nodes of left (node, v; right's own if None) and of right (node, cell, v) that connect all whose vectors have the similarity `least`, or nearly.

    Both sides are dealt out in up to SIDES parts, or more if these had over SIDE vectors, and each two parts are one task, so a vector is sent as often as the other side has parts, however many cells it
    has to look into. Inside, vectors are compared with the cells that may be near enough, and only links between what isn't linked yet become rows.
    """
    dim, alone = cells.centers.shape[1], left is None
    of = lambda n: max(-(-n // SIDE), min(SIDES, -(-n // IN_CELL)), 1)
    lefts, rights = of(n_right if alone else n_left), of(n_right)
    two = _packed(right, dim)
    one = two if alone else _packed(left.withColumn("cell", F.lit(-1)), dim)
    deal = lambda d, name, n, other, first, last: d.withColumn(name, F.pmod("node", F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(first, last)))
    one = deal(one, "_l", lefts, "_r", F.col("_l") if alone else F.lit(0), F.lit(rights - 1))
    two = deal(two, "_r", rights, "_l", F.lit(0), F.col("_r") if alone else F.lit(lefts - 1))

    def vectors(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t["u"].to_pylist()), np.float32).reshape(-1, dim)

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if a.num_rows and b.num_rows:
            b = b.sort_by("cell")
            x, y, n = vectors(a), vectors(b), a.num_rows
            cell = b["cell"].to_numpy()
            begins = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            runs = list(zip(cell[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(cell)], strict=True))
            whole = [(s, min(len(y), s + BLOCK)) for s in range(0, len(y), BLOCK)]
            known = _Linked(n + len(y))
            for start in range(0, n, IN_CELL):
                own = x[start : start + IN_CELL]
                open_ = (np.cos(cells.least_angle(own.astype(np.float64))) >= least - ROUNDING) & np.isfinite(cells.high)
                if open_.mean() > 0.25:
                    todo = [(None, s, e) for s, e in whole]
                else:
                    todo = [(np.flatnonzero(open_[:, c]), s, e) for c, s, e in runs]
                for rows, s, e in todo:
                    if rows is not None and not len(rows):
                        continue
                    near = (own if rows is None else own[rows]) @ y[s:e].T
                    if near.max() < least - ROUNDING:
                        continue
                    i, j = linked(near >= least - ROUNDING)
                    i = (i if rows is None else rows[i]) + start
                    for p, q in zip(i.tolist(), (j + s).tolist(), strict=True):
                        if known.join(p, n + q):
                            out_a.append(p)
                            out_b.append(q)
        return pa.Table.from_arrays([a["node"].take(pa.array(out_a, pa.int64())), b["node"].take(pa.array(out_b, pa.int64()))], names=["a", "b"])

    ship(right.sparkSession)
    return one.groupBy("_l", "_r").cogroup(two.groupBy("_l", "_r")).applyInArrow(compare, "a long, b long").where("a <> b")


def near_pairs(left: DataFrame, right: DataFrame, by: tuple[str, ...], least: float) -> DataFrame:
    """(a columns, b columns, s) of all rows of both sides that share the columns `by` and whose vectors v have the similarity `least` or more.

    left and right: by, v and columns of their own, none of a name that the other has. Keys with more than IN_CELL rows on the right are divided into cells, and there a row meets only members of cells that may be near enough; the few rows of other keys meet all.
    No pair is formed that isn't near. Both sides are used several times and so should be written tables.
    Vectors of another length than the right side's first one are near to none.
    """
    one, two = _prepared(left, right, by, least)
    lefts, rights = [c for c in left.columns if c not in (*by, "v")], [c for c in right.columns if c not in (*by, "v")]
    kinds = {f.name: f.dataType.simpleString() for f in (*left.schema, *right.schema)}
    names = [*by, *lefts, *rights]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            i = j = np.zeros(0, np.int64)
            s = np.zeros(0)
        else:
            dim = len(a["v"][0])
            near = unit_rows(a["v"], dim) @ unit_rows(b["v"], dim).T
            i, j = np.nonzero(near >= least - SLACK)
            s = near[i, j]
        return pa.Table.from_arrays([*(a[c].take(pa.array(i, pa.int64())) for c in (*by, *lefts)), *(b[c].take(pa.array(j, pa.int64())) for c in rights), pa.array(s, pa.float64())], names=[*names, "s"])

    hash = lambda columns: F.xxhash64("v", *columns)
    found = blocks(one, two, (*by, "cell"), hash(lefts), hash(rights), compare, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", s double")
    # As near as doubles tell.
    return found.where(F.col("s") >= least)


def _prepared(left: DataFrame, right: DataFrame, by: tuple[str, ...], least: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with cells, -1 for keys that have none."""
    first = right.select(F.size("v").alias("d")).first()
    dim = first["d"] if first else 0
    left, right = left.where(F.size("v") == dim), right.where(F.size("v") == dim)
    large = written(right.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > IN_CELL), "large", keep=True)
    n = large.agg(F.sum("n")).first()[0]
    none = F.lit(-1).alias("cell")
    if not n:
        return left.select("*", none), right.select("*", none)
    keys = large.select(*by)
    many = right.join(keys, list(by), "left_semi")
    centers = sampled_centers(many, n, dim)
    members = written(assigned(many, centers), "cells", keep=True)
    asked = open_to(left.join(keys, list(by), "left_semi"), cells_of(members, centers), least)
    few = lambda d: d.join(keys, list(by), "left_anti").select(*d.columns, none)
    return asked.unionByName(few(left)), members.drop("angle").unionByName(few(right))


def pairs_compared(left: DataFrame, right: DataFrame, by: tuple[str, ...], least: float) -> int:
    """How many pairs near_pairs() multiplies: a report."""
    one, two = _prepared(left, right, by, least)
    count = lambda d, n: d.groupBy(*by, "cell").agg(F.count("*").alias(n))
    return count(one, "l").join(count(two, "r"), [*by, "cell"]).agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 0


def linked(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links near[i, j] between rows and columns a spanning forest, as (i, j): no more than there are rows and columns, with the same connections."""
    n, m = near.shape
    seen_row, seen_column = np.zeros(n, bool), np.zeros(m, bool)
    left, right = [], []
    for start in np.flatnonzero(near.any(axis=1)).tolist():
        if seen_row[start]:
            continue
        seen_row[start], rows = True, [start]
        while rows:
            i = rows.pop()
            new = np.flatnonzero(near[i] & ~seen_column)
            seen_column[new] = True
            left += [i] * len(new)
            right += new.tolist()
            for j in new.tolist():
                more = np.flatnonzero(near[:, j] & ~seen_row)
                seen_row[more] = True
                left += more.tolist()
                right += [j] * len(more)
                rows += more.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)
