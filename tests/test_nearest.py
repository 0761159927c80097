import random

import numpy as np
import pytest
from helpers import cosine, curated_in_order
from pyspark.sql import functions as F
from test_operators import NOW, bullets

from lorekeep import schemas
from lorekeep.operators import curate as U
from lorekeep.operators import nearest
from lorekeep.operators.nearest import VectorIndex


def clustered(n, dim=16, groups=40, spread=0.15, seed=0):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, dim))
    return centers[r.integers(groups, size=n)] + spread * r.normal(size=(n, dim))


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<float>")


def brute(rows, queries, k):
    out = []
    for i, v in queries:
        best = sorted((-round(cosine(v, w), 9), j) for j, w in rows if j != i)[:k]
        out += [(i, n, j) for n, (_, j) in enumerate(best, 1)]
    return out


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(nearest, "IN_CELL", 50)
    monkeypatch.setattr(nearest, "BLOCK", 32)


def test_exact_top_equals_brute_force(spark, small_cells):
    vectors = list(clustered(900, groups=9, spread=0.1)) + [None, [0.0] * 16, [1.0] * 7] + [list(clustered(1, seed=3)[0])] * 30
    own = frame(spark, vectors)
    rows = [(r.id, r.embedding) for r in own.collect() if r.embedding is not None and len(r.embedding) == 16 and any(r.embedding)]
    asked = [r for r in rows if r[0] % 10 == 0]
    index = VectorIndex(own, keep=6)
    got = index.top(own.where("id % 10 = 0"), 5)
    assert sorted((r.id, r["rank"], r.best_id) for r in got.collect()) == sorted(brute(rows, asked, 5))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # Vectors in clusters: a query is compared with a part of them.
    assert got.agg(F.avg("compared")).first()[0] < 350 and len(index.cells.centers) > 10
    with pytest.raises(ValueError, match="few ids"):
        index.top(own, 6)


def test_recall_is_measured(spark, small_cells):
    """Recall at 10 against the exact way, with vectors in clusters and with random directions, and what it costs."""
    for vectors, most in ((clustered(3000, seed=1), 0.5), (np.random.default_rng(2).normal(size=(3000, 32)), 1.0)):
        own = frame(spark, vectors)
        index = VectorIndex(own)
        asked = own.where("id % 20 = 0")
        fast = index.top(asked, 10, exact=False).toPandas()
        want = set(brute(list(enumerate(vectors)), [(i, v) for i, v in enumerate(vectors) if i % 20 == 0], 10))
        found = {(r.id, r.best_id) for r in fast.itertuples()}
        recall = len({(i, j) for i, _, j in want} & found) / len(want)
        compared = fast.groupby("id").compared.max().mean() / len(vectors)
        assert recall >= 0.9 and compared <= most, (recall, compared)


def test_empty_and_few(spark):
    own = frame(spark, [[1.0, 0.0], [0.9, 0.1], None])
    assert [(r.id, r.best_id) for r in VectorIndex(own).top(own, 3).orderBy("id").collect()] == [(0, 1), (1, 0)]
    assert VectorIndex(own.limit(0)).top(own, 3).count() == 0 and VectorIndex(own.where("embedding is null")).top(own, 1).count() == 0
    names = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), (None, [1.0, 0.0])], "id string, embedding array<double>")
    assert [(r.id, r.best_id) for r in VectorIndex(names).top(names, 1).orderBy("id").collect()] == [("a", "b"), ("b", "a")]


def test_spanning_forest():
    r = random.Random(1)
    for _ in range(30):
        near = np.array([[r.random() < 0.15 for _ in range(9)] for _ in range(7)])
        i, j = nearest.linked(near)

        def parts(pairs):
            of = {("l", a): ("l", a) for a in range(7)} | {("r", b): ("r", b) for b in range(9)}
            for a, b in pairs:
                old, new = of["r", b], of["l", a]
                of = {k: new if v == old else v for k, v in of.items()}
            return {frozenset(k for k in of if of[k] == v) for v in of.values()}

        assert parts(zip(i.tolist(), j.tolist(), strict=True)) == parts(zip(*[x.tolist() for x in np.nonzero(near)], strict=True)) and len(i) <= 15


def test_ordered_curate_of_5000_records(spark, monkeypatch):
    """Chains of near vectors, copies, records with and without vectors, contents that grow: as merging one after the other against everything."""
    r = random.Random(5)
    centers = clustered(60, 8, 60, 0, 4)
    vec = lambda: [float(np.float32(x)) for x in centers[r.randrange(60)] + 0.25 * np.array([r.gauss(0, 1) for _ in range(8)])]
    pool = [vec() for _ in range(1500)]
    kept = [{"id": f"r{i:03}", "content": f"c{i % 90}", "embedding": vec() if i % 3 else None, "decay_weight": (i % 5) / 5, "tags": [f"t{i % 4}"]} for i in range(300)]
    own = bullets(spark, *kept)
    rows = []
    for i in range(5000):
        content = [f"c{r.randrange(400)}", f"long content {r.randrange(50)} " + "x" * r.randrange(30), " ", None][r.choices((0, 1, 2, 3), (60, 36, 2, 2))[0]]
        rows.append((i, "global", "knowledge", content, "", None, None, "Knowledge", float(r.randrange(100)), "auto", [f"w{i % 7}"], None, [], [f"t{r.randrange(6)}"], r.choice(pool) if r.random() < 0.6 else None))
    batch = spark.createDataFrame(rows, f"seq int, {schemas.DISTILLED}")
    after, outcome = U.curate(own, batch, NOW)
    known = [x.asDict() for x in own.orderBy("id").collect()]
    state, want = curated_in_order(known, [x.asDict() for x in batch.orderBy("seq").collect()])
    assert [x.outcome for x in outcome.orderBy("seq").collect()] == want and {"added", "merged", "skipped"} == set(want)
    shown = lambda x: repr((x["content"], x["instructivity_score"], x["embedding"], x["tags"], x["related_tools"], x["decay_weight"], x["recall_count"]))
    got = [x.asDict() for x in after.collect()]
    assert {x["id"]: shown(x) for x in got} == {i: shown(x) for i, x in state.items()}
    assert all(x["updated_at"] == x["created_at"] for x in got if len(x["id"]) == 64)
    assert "NestedLoop" not in after._jdf.queryExecution().executedPlan().toString()


def test_links_connect_what_is_near_and_send_no_vector_once_for_each_cell(spark, monkeypatch):
    vectors = [list(map(float, v)) for v in clustered(30, 8, 300, 0.1, 3)] + [[float(x) for x in np.random.default_rng(k).normal(0, 1, 8)] for k in range(200)]
    monkeypatch.setattr(nearest, "IN_CELL", 16)
    index = VectorIndex(frame(spark, vectors), keep=1)
    monkeypatch.setattr(nearest, "asking", None)
    monkeypatch.setattr(nearest, "SIDE", 150)
    members = index.members.select(F.col("ids")[0].alias("node"), "cell", "v")
    asked = [[float(x) for x in np.random.default_rng(1000 + k).normal(0, 1, 8)] for k in range(100)]
    left = spark.createDataFrame([(10_000 + k, v) for k, v in enumerate(asked)], "node long, v array<double>")
    got = nearest.near_links(None, members, index.cells, index.n, index.n, 0.8).unionByName(nearest.near_links(left, members, index.cells, len(asked), index.n, 0.8)).collect()

    def parts(nodes, pairs):
        of = {x: x for x in nodes}

        def top(x):
            while of[x] != x:
                x = of[x]
            return x

        for a, b in pairs:
            of[top(a)] = top(b)
        return sorted(sorted(x for x in nodes if top(x) == t) for t in {top(x) for x in nodes})

    nodes = [*range(len(vectors)), *range(10_000, 10_000 + len(asked))]
    unit = np.array(vectors + asked)
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    want = [(nodes[i], nodes[j]) for i, j in np.argwhere(unit @ unit.T >= 0.8).tolist() if j < len(vectors)]
    assert parts(nodes, [(r.a, r.b) for r in got]) == parts(nodes, want) and len(got) < len(want)


def test_curate_beyond_the_ids_that_are_handed_out(spark, monkeypatch):
    """Bullets that no record meets are told apart by bits and not moved."""
    from lorekeep import shared

    own = bullets(spark, *({"id": f"r{i}", "content": f"c{i}", "embedding": [float(i % 7 == k) for k in range(7)] if i % 2 else None} for i in range(400)), {"id": None, "content": "none"})
    rows = [(i, "global", "knowledge", f"c{i * 2}", "", None, None, "Knowledge", 99.0, "auto", [], None, [], [], [0.0] * 6 + [1.0] if i == 3 else None) for i in range(9)]
    batch = spark.createDataFrame(rows, f"seq int, {schemas.DISTILLED}")
    shown = lambda: sorted(repr(x) for x in U.curate(own, batch, NOW)[0].select("id", "content", "instructivity_score", "embedding").collect())
    want = shown()
    monkeypatch.setattr(U, "MOST_SHIPPED", 0)
    assert shown() == want and len(want) == 401
    ids = spark.createDataFrame([(f"r{i}",) for i in range(0, 400, 40)], "id string")
    may, rest = shared.parted(own, "id", ids, 10)
    kept = {x.id for x in may.collect()}
    assert {f"r{i}" for i in range(0, 400, 40)} <= kept and len(kept) < 40 and rest.count() == 401 - len(kept)
    may, rest = shared.parted(own, "id", ids.limit(0), 0)
    assert may.count() == 0 and rest.count() == 401
