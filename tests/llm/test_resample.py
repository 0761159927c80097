import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import queries, resample


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    """docs: (id, text) to sorted (id, n_features, weight, score, rank)."""
    s, t = Counter(b for _, x in docs for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000) / ((s[b] + 1.0) * (t_all + 10000)))) for b in s}
    rows = []
    for name, x in docs:
        n, own = features(x)
        h = int(hashlib.sha256(f"42:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append((name, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {id(r): i for i, r in enumerate(able[: 5 * len(able) // 100], 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=repr)


def texts(seed, n):
    r = random.Random(seed)
    words = ["a", "Bc", "é", "1", "数据", "word" * 20, "dé"]
    return [" ".join(r.choice(words[: r.choice([1, 3, 7])]) for _ in range(r.choice([0, 1, 2, 19, 20, 21, 80]))) + r.choice(["", "."]) for _ in range(n)]


def test_equals_brute_force(spark):
    docs = list(enumerate(texts(1, 300))) + [(1000, None), (1001, "x " * 30), (1002, "x " * 30)]
    target = [*texts(2, 5), None, ""]
    own = spark.createDataFrame(docs, "doc_id long, text string")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for parts in (1, 7):
        got = resample.resample(own.repartition(parts), aim).select("doc_id", "n_features", "weight", "score", "rank")
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target)


def test_query_equals_its_sql(spark, small, duck):
    got = queries.op13_importance_resampling(spark, small)
    want = duck(small).sql(queries.OP13_SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_odd_rows(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    aim = spark.createDataFrame([("one two three",), (None,)], "text string")
    got = resample.resample(odd, aim).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, ["one two three", None])
    assert resample.resample(empty, aim).count() == 0
    assert resample.resample(odd, aim.limit(0)).count() == odd.count()
    # Equal rows and ids that are missing: each draws a rank of its own.
    many = spark.createDataFrame([(None, "a b c d e " * 5)] * 100, "doc_id string, text string")
    assert sorted(r["rank"] for r in resample.resample(many, aim).where("rank is not null").collect()) == [1, 2, 3, 4, 5]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=70), st.binary(max_size=70)), min_size=1, max_size=6))
def test_crc_of_joined_strings(pairs):
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = resample.joined(crc([a for a, _ in pairs]), crc([b for _, b in pairs]), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_a_long_text():
    """Texts of 12 MB: many words, and one word."""
    words, hashed, sizes, scattered = resample.buckets([b"one two " * 1_500_000, b"z" * 12_000_000])
    assert words.counts().tolist() == [3_000_000, 1] and [sum(s.tolist()) for s in sizes] == [3_000_001, 2_999_999, 2_999_998]
    assert hashed[0].tolist().count(zlib.crc32(b"z" * 12_000_000) % 10000) >= 1 and scattered[2][0] == zlib.crc32(b"one two one") % 10000
