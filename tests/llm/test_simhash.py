import itertools

import numpy as np
import xxhash

from lorekeep.llm import simhash
from lorekeep.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_masks_cover_every_triple():
    masks = simhash.covering_masks()
    assert len(masks) == 15
    for triple in itertools.combinations(range(64), 3):
        assert any(not any(m >> i & 1 for i in triple) for m in masks)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (7, 6), (6, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_buckets_lose_no_link():
    rng = np.random.default_rng(0)
    for k, width in ((900, 12), (1500, 16)):
        f = np.unique(rng.integers(0, 2**width, k, dtype=np.uint64) << np.uint64(9))
        a, b = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, 1))
        x, y = simhash._link_large(f, 3)
        assert roots(len(f), zip(a.tolist(), b.tolist())) == roots(len(f), zip(x.tolist(), y.tolist()))


def test_near_duplicates_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    near = [(10_000 + i, " ".join([*r.text.split()[:-1], "changed"])) for i, r in enumerate(rows) if len(r.text) > 800]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert any(fps[i] != fps[j] for i, j in links)
    top = roots(len(rows), links)
    want = {r.doc_id: (f"{fps[i]:016x}", min(s.doc_id for j, s in enumerate(rows) if top[j] == top[i])) for i, r in enumerate(rows)}
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits("fp").alias("f"), "component_id").collect()
    assert {r.doc_id: (r.f, r.component_id) for r in got} == want
    kept = {r.doc_id for r in simhash.first_of_each(docs).collect()}
    assert kept == {c for _, c in want.values()}


def test_hot_buckets_are_split_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(7)
    # Families of fingerprints that share most bits, so that many share a bucket.
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (rng.integers(0, 2**14, 500, dtype=np.uint64) << np.uint64(7 * k)) for k, b in enumerate(base)]))
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    d = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    number = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    monkeypatch.setattr(simhash, "HOT_BUCKET", 20)
    assert simhash.buckets(d).groupBy("mask", "key").count().where("count > 20").count() == 0
    got = [(number[r.a], number[r.b]) for r in simhash.links(d).collect()]
    assert all((fps[x] ^ fps[y]).bit_count() <= 3 for x, y in got)
    assert roots(len(fps), got) == roots(len(fps), zip(a.tolist(), b.tolist()))


def test_narrower_masks_keep_every_near_pair():
    for mask in (*simhash.covering_masks(), simhash.narrower(simhash.covering_masks()[3])[1]):
        free = [i for i in range(64) if not mask >> i & 1]
        for triple in itertools.combinations(free, 3):
            assert any(not any(m >> i & 1 for i in triple) for m in simhash.narrower(mask))


def test_one_row_of_each_group_stays(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(300))
    near = text("b").replace("b299", "changed")
    rows = [(5, text("a"), "x"), (5, text("b"), "x"), (2, text("b"), "x"), (2, text("b"), "x"), (2, text("b"), "w"), (9, near, "x"), (None, text("b"), "x"), (None, text("c"), "x"), (None, text("c"), None), (7, text("d"), "y"), (7, text("e"), "y"), (3, None, "x"), (3, "", "x")]
    assert (brute_fingerprint(near) ^ brute_fingerprint(text("b"))).bit_count() <= 3
    for schema, cast in (("doc_id long, text string, d_ string", lambda i: i), ("doc_id string, text string, root string", lambda i: i if i is None else f"k{i}")):
        d = spark.createDataFrame([(cast(i), t, x) for i, t, x in rows], schema)
        kept = [tuple(r) for r in simhash.first_of_each(d).collect()]
        want = [(cast(5), text("a"), "x"), (cast(2), text("b"), "w"), (None, text("c"), "x"), (cast(7), text("d"), "y"), (cast(7), text("e"), "y")]
        assert {r for r in kept if r[1]} == set(want)
        assert len(kept) == 6 and [r[0] for r in kept if not r[1]] == [cast(3)]


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == by[8] == {1} and by[2] == by[3] == by[4] == {2} and by[None] == {None}
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i) == [1, 2, 5, 6, 7] and ids.count(None) == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.first_of_each(empty).count() == 0
