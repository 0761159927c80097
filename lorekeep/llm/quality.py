"""Quality classifier: random-indexing vectors pooled per document, a two-layer network, calibrated probabilities.

Every white-space word of a text gives three units: the word, its shape (letters, digits and marks with runs
collapsed), and a novelty unit (whether the text had the word before, and whether it repeats its
neighbour). Each unit has a sparse random index vector, made from its hash. A unit's vector is its
index vector plus the mean of those of its neighbours in the training texts. A document is the mean of its
units' vectors, one mean for each of the three channels. A network of two layers gives a
logit, and a temperature fitted on held-back rows turns it into a probability.

All labelled documents outside the held-out fold are training texts. Tasks add up their units' neighbours; the pooled
texts are dealt out in parts, in each round every part goes on from the same network, and the mean of
their networks is the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _flat, _words
from ._batches import as_bytes, map_slices, mapped, scratch, slices, written
from ._sample import balanced

#: Most bytes of text that a fit on a given number of rows takes.
TRAIN_BYTES = 32 << 20
#: Labels up to this many are handed to every task; beyond, they meet the documents by a shuffle.
MOST_SHIPPED = 1 << 18
#: Text bytes whose units a task adds up before it sends them, and for each bucket of units.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 1 << 20
#: Rows for each part that the network is trained on, on average.
PART_ROWS = 1 << 14
EPOCHS = 60
ROUNDS = 20
BATCH = 64
#: One row in this many is held back for the temperature.
HOLD = 5
DIM = 32
NONZERO = 4
WINDOW = 2
HIDDEN = 24
#: Units seen fewer times in the training texts keep their index vector alone.
LEAST_COUNT = 3
CHANNELS = 3
FOLDS = 4
HELD_OUT = 2
ACCEPT = 0.7

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("x")
_SHAPE[0x80:] = ord("x")
_SHAPE[ord("A") : ord("Z") + 1] = ord("X")
_SHAPE[ord("0") : ord("9") + 1] = ord("9")


def fold(id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.encode(id.cast("string"), "UTF-8")), F.lit(FOLDS))


def _shapes(words: _words.Words) -> np.ndarray:
    """Hash of each word's shape."""
    one = _words.spaced(words)
    shape = _SHAPE[one.buf]
    n = int(words.lens.sum()) + len(words)
    keep = np.ones(n, dtype=bool)
    keep[1:] = (shape[1:n] != shape[: n - 1]) | (shape[1:n] == 32)
    total = np.concatenate([[0], np.cumsum(keep)])
    starts, ends = total[one.starts], total[one.starts + one.lens]
    return _words.xxh64(np.concatenate([shape[:n][keep], np.zeros(40, np.uint8)]), starts, ends - starts, 1)


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): a row of CHANNELS unit hashes for each word; text i has the rows bounds[i]:bounds[i+1]."""
    raw = _words.split(texts, _words.SPACES, lower=False)
    lower = _words.Words(_words.LOWER[raw.buf], raw.starts, raw.lens, raw.bounds)
    word = lower.hashes()
    n = len(word)
    rows = raw.rows()
    with np.errstate(over="ignore"):
        own = word + rows.astype(np.uint64) * np.uint64(0x9E3779B185EBCA87)
    first = np.zeros(n, dtype=bool)
    first[np.unique(own, return_index=True)[1]] = True
    same = np.zeros(n, dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (rows[1:] == rows[:-1])
    depth = np.log2(1 + np.arange(n) - raw.bounds[rows]).astype(np.int64) // 2 if n else np.zeros(0, np.int64)
    novelty = (depth * 4 + first * 2 + same).astype(np.uint64) + np.uint64(1 << 60)
    return np.stack([word, _shapes(raw) if n else word, novelty], axis=1), raw.bounds


def _signs(hashes: np.ndarray) -> np.ndarray:
    """The sparse random vector of each unit, from its hash alone, before it is scaled."""
    out = np.zeros((len(hashes), DIM), dtype=np.int8)
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64)
        for _ in range(NONZERO):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x165667B19E3779F9)
            at = (x >> np.uint64(40)) % np.uint64(DIM)
            sign = np.where((x >> np.uint64(33)) & np.uint64(1), 1, -1)
            np.add.at(out, (np.arange(len(x)), at.astype(np.int64)), sign.astype(np.int8))
    return out


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """The sparse random vector of each unit."""
    return _signs(hashes) / np.sqrt(NONZERO).astype(np.float32)


@dataclass
class Model:
    """vocab: sorted hashes of known units, with a vector each. The network's weights; mean and scale of its input. units: application and name of the file that has vocab and vectors on its executors, if there is one."""

    vocab: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    units: tuple[str, str] | None = None

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """One vector for each text: the mean over its words in each channel; zeros for a text without words."""
        hashes, bounds = units(texts)
        out = np.zeros((len(texts), CHANNELS * DIM), dtype=np.float32)
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        if not len(some):
            return out
        for c in range(CHANNELS):
            distinct, inverse = np.unique(hashes[:, c], return_inverse=True)
            vectors = index_vectors(distinct) if c == 0 else np.zeros((len(distinct), DIM), np.float32)
            if len(self.vocab):
                at = np.minimum(np.searchsorted(self.vocab, distinct), len(self.vocab) - 1)
                known = self.vocab[at] == distinct
                vectors[known] = self.vectors[at[known]]
            sums = np.add.reduceat(vectors[inverse], bounds[some], axis=0)
            out[some, c * DIM : (c + 1) * DIM] = sums / n[some][:, None]
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        x = (pooled - self.mean) / self.scale
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 of each text."""
        z = self.logits(self.pool(texts)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _untrained(vocab: np.ndarray, vectors: np.ndarray) -> Model:
    return Model(vocab, vectors, np.zeros(CHANNELS * DIM, np.float32), np.ones(CHANNELS * DIM, np.float32), np.zeros((CHANNELS * DIM, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), 0.0, 1.0)


# Units: (sorted hashes, counts, sums of their neighbours' vectors before scaling), in whole numbers, so they add up to the same in any order.
Units = tuple[np.ndarray, np.ndarray, np.ndarray]


def _neighbour_sums(texts: list[bytes]) -> list[Units]:
    """The units of each channel."""
    hashes, bounds = units(texts)
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
    out = []
    for c in range(CHANNELS if len(hashes) else 0):
        distinct, inverse, count = np.unique(hashes[:, c], return_inverse=True, return_counts=True)
        own = _signs(distinct)[inverse]
        around = np.zeros_like(own)
        for step in range(1, WINDOW + 1):
            same = (rows[step:] == rows[:-step])[:, None]
            around[:-step] += own[step:] * same
            around[step:] += own[:-step] * same
        order = np.argsort(inverse, kind="stable")
        out.append((distinct, count, np.add.reduceat(around[order], np.cumsum(count) - count, axis=0, dtype=np.int64)))
    return out


def _added(parts: list[Units]) -> Units:
    """Units of several runs of texts, each unit once."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, DIM), np.int64)
    every = np.concatenate([u for u, _, _ in parts])
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.add.reduceat(np.concatenate([n for _, n, _ in parts])[order], first), np.add.reduceat(np.concatenate([x for _, _, x in parts])[order], first, axis=0)


def _vectors(found: Units) -> tuple[np.ndarray, np.ndarray]:
    """(vocab, vectors) of the units that occur LEAST_COUNT times at least."""
    vocab, count, sums = found
    keep = count >= LEAST_COUNT
    return vocab[keep], (index_vectors(vocab[keep]) + sums[keep] / np.sqrt(NONZERO) / count[keep][:, None]).astype(np.float16)


def random_indexing(texts: list[bytes], at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(vocab, vectors) of the units that occur LEAST_COUNT times at least, gathered over about `at_once` bytes of text at a time."""
    ends = np.cumsum([len(t) for t in texts])
    cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) + at_once, at_once), side="right")) if len(texts) else []
    edges = sorted({0, *(int(c) for c in cuts), len(texts)})
    return _vectors(_added([x for a, b in zip(edges, edges[1:], strict=False) for x in _neighbour_sums(texts[a:b])]))


def _index_all(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """random_indexing() over all rows (t) of a table with `size` bytes of text. The driver gets the model's vectors alone, a task's worth at a time."""
    bits = max(1, (size // BUCKET_BYTES).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Units] = []
        size = 0

        def summed() -> Iterator[pa.RecordBatch]:
            every, count, sums = _added(held)
            edge = np.searchsorted(every >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(edge)).tolist()
            columns = [[x[edge[k] : edge[k + 1]].tobytes() for k in some] for x in (every, count, sums.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], names=["bucket", "u", "n", "x"])

        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                own = as_bytes(part.column(part.schema.get_field_index("t")))
                held.append(_added(_neighbour_sums(own)))
                size += sum(map(len, own))
                if size >= CHUNK_BYTES:
                    yield from summed()
                    held, size = [], 0
        if held:
            yield from summed()

    def added(rows: pa.Table) -> pa.Table:
        parts = zip(*(rows[c].to_pylist() for c in ("u", "n", "x")), strict=True)
        vocab, vectors = _vectors(_added([(np.frombuffer(u, np.uint64), np.frombuffer(n, np.int64), np.frombuffer(x, np.int32).reshape(-1, DIM).astype(np.int64)) for u, n, x in parts]))
        return pa.table([rows["bucket"][:1], pa.array([vocab.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["bucket", "u", "v"])

    found = written(mapped(texts.select("t"), run, "bucket int, u binary, n binary, x binary").groupBy("bucket").applyInArrow(added, "bucket int, u binary, v binary"), "units")
    got = sorted(found.toLocalIterator(), key=lambda r: r["bucket"])
    return np.frombuffer(b"".join(r["u"] for r in got), np.uint64), np.frombuffer(b"".join(r["v"] for r in got), np.float16).reshape(-1, DIM)


#: Weights of the network, their first and second moments, and the steps taken.
State = tuple[dict[str, np.ndarray], dict[str, np.ndarray], dict[str, np.ndarray], int]


def _start(seed: int) -> State:
    rng = np.random.default_rng(seed)
    n = CHANNELS * DIM
    p = {"w1": rng.normal(0, np.sqrt(2 / n), (n, HIDDEN)).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32), "w2": rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN).astype(np.float32), "b2": np.zeros(1, np.float32)}
    return p, {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0


def _weights(y: np.ndarray, share: float) -> np.ndarray:
    """Weight of each row where `share` of all rows have label 1."""
    return np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) ** 0.5


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, state: State, epochs: int, rng: np.random.Generator) -> State:
    """The network after some epochs over these rows."""
    p, m, v = ({k: a.copy() for k, a in s.items()} for s in state[:3])
    t = state[3]
    own = np.arange(len(y))
    for _ in range(epochs):
        rng.shuffle(own)
        for i in range(0, len(own), BATCH):
            b = own[i : i + BATCH]
            h = np.maximum(x[b] @ p["w1"] + p["b1"], 0)
            z = np.clip(h @ p["w2"] + p["b2"], -30, 30)
            d = (1 / (1 + np.exp(-z)) - y[b]) * weight[b] / len(b)
            back = np.outer(d, p["w2"]) * (h > 0)
            grad = {"w1": x[b].T @ back + 1e-4 * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ d + 1e-4 * p["w2"], "b2": d.sum(keepdims=True)}
            t += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = (p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p, m, v, t


_GRID = np.exp(np.linspace(np.log(0.25), np.log(8), 60))


def _grid_losses(model: Model, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed loss of some rows with each temperature of the grid."""
    z = np.maximum(x @ model.w1 + model.b1, 0) @ model.w2 + model.b2
    sign = np.where(y == 1, 1.0, -1.0)
    return np.array([np.logaddexp(0, -sign * z / g).sum() for g in _GRID])


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Fit vectors, network and temperature in one process. With labels of one kind only every text gets 0.982 (for 1) or 0.018 (for 0) as its score, without any labels 0.5."""
    y = np.array(labels, dtype=np.float32)
    model = _untrained(*random_indexing(texts))
    if not len(y) or y.min() == y.max():
        model.b2 = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return model
    x = np.concatenate([model.pool(texts[i : i + 500]) for i in range(0, len(texts), 500)])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - model.mean) / model.scale
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // HOLD], order[len(y) // HOLD :]
    p = _descend(x[own], y[own], _weights(y[own], y[own].mean()), _start(seed), epochs, rng)[0]
    model.w1, model.b1, model.w2, model.b2 = p["w1"], p["b1"], p["w2"], float(p["b2"][0])
    if len(held):
        model.temperature = float(_GRID[int(np.argmin(_grid_losses(model, x[held], y[held])))])
    return model


#: Sums over parts are taken in whole multiples of this, so that they are the same in any order; they stay below 2048.
_STEP = 2.0**-52
#: Steps taken are sent as a share of this.
_MANY = 2.0**40


def _over_parts(parts: DataFrame, work: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of work(part, rows, labels, whether a row is held back) over all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                y = np.frombuffer(y, np.uint8)
                got = work(k, np.frombuffer(x, np.float32).reshape(len(y), -1), y.astype(np.float32), np.arange(len(y)) % HOLD == HOLD - 1)
                yield pa.RecordBatch.from_arrays([pa.array([np.rint(got / _STEP).astype(np.int64)], pa.list_(pa.int64()))], names=["v"])

    rows = mapped(parts, run, "v array<long>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for k, v in rows:
        out[k] = v * _STEP
    return out


def _dealt(pooled: DataFrame, n: int) -> DataFrame:
    """(part, x, y): n rows (i, y, p) in parts of about PART_ROWS, one row for each part, its rows in an order that depends on them alone. Equal rows are told apart by their number."""
    every = pooled.groupBy("i", "y", "p").count().select("y", "p", F.xxhash64("i", "y", "p").alias("g"), F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("c"))
    every = every.select("y", "p", F.xxhash64("g", "c").alias("h")).withColumn("part", F.pmod("h", F.lit(-(-n // PART_ROWS))).cast("int"))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending"), ("y", "ascending"), ("p", "ascending")])
        x, y = b"".join(rows["p"].to_pylist()), rows["y"].to_numpy().astype(np.uint8).tobytes()
        return pa.table([rows["part"][:1], pa.array([x], pa.binary()), pa.array([y], pa.binary())], names=["part", "x", "y"])

    return every.groupBy("part").applyInArrow(packed, "part int, x binary, y binary")


def _train_all(texts: DataFrame, seed: int = 0) -> Model:
    """train() over all rows (i, t, y) of a written table, by rounds over its parts."""
    spark = texts.sparkSession
    size, n, least, most = texts.agg(F.sum(F.octet_length("t")), F.count("*"), F.min("y"), F.max("y")).first()
    model = _untrained(*_index_all(texts, size or 0))
    model.units = (spark.sparkContext.applicationId, _flat.share(spark, {"vocab": model.vocab, "vectors": model.vectors}, "units"))
    if not n or least == most:
        model.b2 = 0.0 if not n else (4.0 if least else -4.0)
        return model
    opened = _opener(spark, model)

    def pooling():
        own = opened()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = own.pool(as_bytes(batch.column(1)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in got], pa.binary())], names=["i", "y", "p"])

        return each

    pooled = map_slices(texts.select("i", "t", "y"), "t", f"i {texts.schema['i'].dataType.simpleString()}, y int, p binary", pooling)
    parts = written(_dealt(pooled, n), "parts")

    def moments(_: int, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> np.ndarray:
        wide = x.astype(np.float64)
        return np.concatenate([wide.sum(axis=0), (wide * wide).sum(axis=0), [(~held).sum(), y[~held].sum()]]) / n

    got = _over_parts(parts, moments)
    mean, square, (own, ones) = got[: CHANNELS * DIM], got[CHANNELS * DIM : -2], got[-2:]
    model.mean, model.scale = mean.astype(np.float32), (np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3).astype(np.float32)
    mean, scale, share = model.mean, model.scale, ones / own
    state = _start(seed)
    for at in range(ROUNDS):

        def descended(k: int, x: np.ndarray, y: np.ndarray, held: np.ndarray, at: int = at, state: State = state) -> np.ndarray:
            x, y = (x[~held] - mean) / scale, y[~held]
            *after, t = _descend(x, y, _weights(y, share), state, EPOCHS // ROUNDS, np.random.default_rng((seed, at, k)))
            # Each part counts by its rows.
            return np.concatenate([*(a.ravel() for s in after for a in s.values()), [t / _MANY]]).astype(np.float64) * (len(y) / (own * n))

        flat = _over_parts(parts, descended)
        cuts = np.cumsum([a.size for s in state[:3] for a in s.values()])
        pieces = iter(np.split(flat, cuts))
        state = (*({k: next(pieces).reshape(a.shape).astype(np.float32) for k, a in s.items()} for s in state[:3]), round(float(flat[-1]) * _MANY))
    p = state[0]
    model.w1, model.b1, model.w2, model.b2 = p["w1"], p["b1"], p["w2"], float(p["b2"][0])
    net = Model(np.zeros(0, np.uint64), np.zeros((0, DIM), np.float16), mean, scale, model.w1, model.b1, model.w2, model.b2, 1.0)
    losses = _over_parts(parts, lambda _, x, y, held: _grid_losses(net, (x[held] - mean) / scale, y[held]) / n)
    if losses.any():
        model.temperature = float(_GRID[int(np.argmin(losses))])
    return model


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", rows: int | None = None) -> Model:
    """Fit on all labelled documents but those of the held-out fold; with `rows`, on that many (all, if there are fewer) and TRAIN_BYTES of text at most, chosen by a hash of id and text.

    Labels whose id or value is null aren't used; repeated labels count once, a document with different labels once for each. Null texts count as
    empty. Repeated documents count as often as they occur, with `rows` as far as they fit. With empty tables there is nothing to learn, see train().
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).where(fold(F.col(id)) != HELD_OUT).select(F.col(id).alias("i"), (F.col(label) == 1).cast("int").alias("y")).distinct()
    own = docs.select(F.col(id).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    if rows is None:
        if known.limit(MOST_SHIPPED + 1).count() <= MOST_SHIPPED:
            known = F.broadcast(known)
        with scratch():
            return _train_all(written(own.join(known, "i"), "labelled"))
    total = known.count()
    if total > 2 * rows:
        known = known.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < int((1 << 30) * 2 * rows / total))
    # About 2 * rows labels, so the documents are read in place rather than dealt out.
    got = balanced(own.withColumn("g", F.lit(0)).join(F.broadcast(known), "i"), rows, TRAIN_BYTES).collect()
    return train([r.t.encode() for r in got for _ in range(r.n)], [r.y for r in got for _ in range(r.n)])


def _opener(spark: SparkSession, model: Model) -> Callable[[], Model]:
    """For workers: the model, with its vocabulary and vectors mapped into memory from one file for each machine."""
    app = spark.sparkContext.applicationId
    name = model.units[1] if model.units and model.units[0] == app else _flat.share(spark, {"vocab": model.vocab, "vectors": model.vectors}, "units")
    net = (model.mean, model.scale, model.w1, model.b1, model.w2, model.b2, model.temperature)

    def opened() -> Model:
        got = _flat.open_mapped(SparkFiles.get(name))
        return Model(got["vocab"], got["vectors"], *net)

    return opened


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id and score (probability of label 1, 0 to 1). Null texts count as empty; a text without words gets the score of the zero vector.

    Texts of any length are read whole. Repeated rows and rows with equal or null ids each get a row, equal texts equal scores. An empty table gives an empty result. Only the columns named are read.
    """
    opened = _opener(docs.sparkSession, model)
    own = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t"))

    def work():
        own = opened()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(as_bytes(batch.column(1))))], names=["i", "score"])

        return each

    return map_slices(own, "t", f"i {own.schema['i'].dataType.simpleString()}, score double", work).withColumnRenamed("i", id)


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = ACCEPT) -> DataFrame:
    """The documents, with all their columns, whose score is at least `least`. Null texts count as empty. Repeated rows and rows without an id are judged each by its text. An empty table gives an empty result."""
    opened = _opener(docs.sparkSession, model)
    where = docs.columns.index(text)

    def work():
        own = opened()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(own.score(as_bytes(batch.column(where))) >= least))

        return each

    return map_slices(docs, text, docs.schema, work)
