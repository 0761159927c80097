import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from lorekeep.llm import queries, sharding


def brute(rows, shards=16):
    """rows: (id, text) to sorted (id, size, crc, shard, slot)."""
    digits = lambda x: hashlib.md5(x).hexdigest()[:16]
    raw = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (digits(raw[i]), digits(("" if rows[i][0] is None else str(rows[i][0])).encode())))
    size = [len(raw[i]) + 1 for i in order]
    total, before = sum(size), [sum(size[:k]) for k in range(len(size))]
    groups = [digits(raw[i]) for i in order]
    bytes_of = Counter()
    for g, s in zip(groups, size, strict=True):
        bytes_of[g] += s
    cuts = []
    for k in range(1, shards):
        c = next((i for i, b in enumerate(before) if b * shards >= k * total), len(order))
        if 0 < c < len(order) and groups[c - 1] == groups[c] and bytes_of[groups[c]] * 64 * shards <= total:
            c = max(i for i, g in enumerate(groups) if g == groups[c]) + 1
        cuts.append(c)
    return sorted(((rows[i][0] is None, rows[i][0]), size[k], zlib.crc32(raw[i]), sum(c <= k for c in cuts), k - max([0, *[c for c in cuts if c <= k]])) for k, i in enumerate(order))


def got(docs, shards=16):
    return sorted(((r.doc_id is None, r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in sharding.assign(docs, shards).collect())


def rows(seed, n=3000):
    r = random.Random(seed)
    copies = ["copy " * 40, "few", ""]
    pick = lambda i: r.choice(copies) if r.random() < 0.4 else None if r.random() < 0.01 else f"text {i} " * r.choice([1, 3, 50])
    return [(i, pick(i)) for i in range(n)] + [(n, "long " * 40000)]


@pytest.mark.parametrize(("least", "shards"), [(256, 16), (8, 16), (2000, 5), (1, 3)])
def test_equals_brute_force(spark, monkeypatch, least, shards):
    """Whatever the number of ranges: they only say how the work is dealt out."""
    monkeypatch.setattr(sharding, "LEAST_RANGES", least)
    own = rows(least)
    assert got(spark.createDataFrame(own, "doc_id long, text string").repartition(3), shards) == brute(own, shards)


def test_layout_and_balance(spark):
    own = rows(1)
    docs = spark.createDataFrame(own, "doc_id long, text string")
    one, nine = got(docs.coalesce(1)), got(docs.repartition(9))
    assert one == nine
    by = defaultdict(list)
    for _, size, _, shard, slot in one:
        by[shard].append((slot, size))
    part = sum(x[1] for x in one) / 16
    longest = max(x[1] for x in one)
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    assert max(sum(s for _, s in v) for v in by.values()) <= part + longest + part / 32


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """With a sample of one key for each range some are too full at first; copies of one row are split as well."""
    monkeypatch.setattr(sharding, "DRAWN", 1)
    own = [(7, "same")] * 3000 + [(i, f"text {i}") for i in range(3000)]
    slim = sharding.keyed(spark.createDataFrame(own, "doc_id long, text string"))
    ranges = sharding.split(sharding.written(slim.select("_size", "_key"), "keys"))
    assert ranges.rows.sum() == 6000 and (ranges.size * 256 <= 2 * ranges.size.sum()).all()


def test_query_equals_its_sql(spark, small, duck):
    found = queries.op12_sharding(spark, small)
    want = duck(small).sql(queries.OP12_SQL)
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(want.fetchall())


def test_written_shards(spark, tmp_path):
    own = rows(5, 800)
    docs = spark.createDataFrame([(*r, i % 7) for i, r in enumerate(own)], "doc_id long, text string, more int").repartition(4)
    sharding.write_shards(docs, str(tmp_path / "out"), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.shard) for r in back.collect()) == sorted((r.doc_id, r.shard) for r in sharding.assign(docs, 8).collect())
    assert sorted(map(repr, back.select("doc_id", "text", "more").collect())) == sorted(map(repr, docs.collect()))
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(docs.selectExpr("*", "1 as shard"), str(tmp_path / "no"))


def test_odd_rows(spark, odd, empty):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert sharding.assign(empty).count() == 0
    strings = [("b", "x"), ("a", "x"), (None, None)]
    assert got(spark.createDataFrame(strings, "doc_id string, text string")) == brute(strings)
    # Columns of the same names as the operator's own don't matter.
    clash = spark.createDataFrame([(1, "t", "c", "c")], "doc_id int, text string, _key string, i string")
    assert got(clash) == brute([(1, "t")])
