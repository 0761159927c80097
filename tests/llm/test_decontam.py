import random
import re

import numpy as np

from lorekeep.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items):
    windows = {}
    for name, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = []
    for d in docs:
        w, found = words_of(d), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    found |= windows[tuple(w[i : i + n])]
                    hit[i : i + n] = [True] * n
        # The longest match that holds a window, as a whole item or as part of one.
        best, at = 0, -1
        for i in range(len(w)):
            for _, t in items:
                v = words_of(t)
                for j in range(len(v)):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if (n >= 10 or 0 < n == len(v)) and n > best:
                        best, at = n, i
        out.append((len(w), sum(hit), sorted(found), best, at))
    return out


def test_contamination_equals_brute_force(spark):
    random.seed(3)
    for trial in range(6):
        alphabet = ["a", "b", "é", "1", "Zz"][: random.choice([1, 2, 5])]
        text = lambda n, a=alphabet: " ".join(random.choice(a) for _ in range(n))
        items = [(str(i), text(random.choice([0, 1, 3, 9, 10, 12, 15]) if trial % 3 else random.choice([10, 11, 14]))) for i in range(6)]
        docs = [text(random.choice([0, 1, 5, 10, 40, 100])) for _ in range(12)]
        d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
        b = spark.createDataFrame(items, "item_id string, text string")
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.longest_match, r.longest_at) for r in decontam.contamination(d, b).collect()}
        want = brute(docs, items)
        assert got == dict(enumerate(want))
        assert {r.doc_id for r in decontam.decontaminate(d, b).collect()} == {i for i, w in enumerate(want) if not w[1]}


def test_benchmark_in_parts_gives_the_same(spark, small, monkeypatch):
    d, b = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    whole = sorted(tuple(map(str, r)) for r in decontam.contamination(d, b).collect())
    monkeypatch.setattr(decontam, "PART_BYTES", 3000)
    assert len(decontam._indexes(b, "item_id", "text", 10)) > 2
    assert sorted(tuple(map(str, r)) for r in decontam.contamination(d, b).collect()) == whole


def test_longest_match(spark):
    d = spark.createDataFrame([(1, "q q one two three four five six x"), (2, "zero one two three")], "doc_id int, text string")
    b = spark.createDataFrame([(9, "zero one two three four five six seven")], "item_id int, text string")
    best = max(decontam.longest_matches(d, b).collect(), key=lambda r: r.length)
    assert (best["item"], best.length, best.doc, best.position) == ("9", 6, 1, 2)


def test_odd_rows(spark, odd, empty):
    b = spark.createDataFrame([(1, "one two three four five six seven"), (None, "a row without id"), (3, None), (4, "")], "item_id int, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontam.contamination(odd, b).collect()}
    assert got[1] == (7, ["1"]) and got[None] == (8, []) and got[2] == got[3] == got[6] == (0, [])
    assert decontam.decontaminate(odd, b).columns == odd.columns
    assert decontam.contamination(odd, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination(empty, b).count() == 0


def test_longest_matches_equal_brute_force(spark):
    random.seed(5)
    passage = " ".join(f"p{i % 90}" for i in range(200))
    for trial in range(3):
        text = lambda n, k=(2, 4, 30)[trial]: " ".join(f"w{random.randrange(k)}" for _ in range(n))
        docs = [f"{text(5)} {passage} {text(9)}", f"x {' '.join(passage.split()[:150])} y", "one", "", *(text(random.choice([1, 30, 200])) for _ in range(8))]
        items = [("whole", f"{passage} z"), ("one", "One"), ("two", "one absent"), ("none", "absent"), *((f"r{i}", text(random.choice([1, 2, 40, 150]))) for i in range(6))]
        d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string").repartition(2)
        best = {}
        for r in decontam.longest_matches(d, spark.createDataFrame(items, "item_id string, text string")).collect():
            best[r["item"]] = max(best.get(r["item"], 0), r.length)
            own, found = words_of(dict(items)[r["item"]]), words_of(docs[r.doc])[r.position : r.position + r.length]
            assert len(found) == r.length and any(own[i : i + r.length] == found for i in range(len(own)))
        padded = [f" {' '.join(words_of(t))} " for t in docs]
        for name, t in items:
            w = words_of(t)
            want = max((n for i in range(len(w)) for n in range(1, len(w) - i + 1) if any(f" {' '.join(w[i : i + n])} " in p for p in padded)), default=0)
            assert best.get(name, 0) == want, name
        assert best["whole"] == 200 and best["one"] == 1


def test_suffix_arrays_are_sorted():
    random.seed(9)
    for _ in range(30):
        texts = [[random.choice("abc") for _ in range(random.choice([0, 1, 5, 40, 90]))] for _ in range(6)]
        texts.append(list(texts[3]))
        flat = [c for t in texts for c in t]
        ids, ends = np.array([ord(c) for c in flat], np.int64), np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
        depth = random.choice([1, 2, 3, 7, 10])
        order, rank = decontam.suffix_array(ids, ends, depth)
        want = lambda n: [flat[p : min(p + n, ends[p])] for p in order]
        assert want(depth) == sorted(want(depth)) and sorted(order.tolist()) == list(range(len(flat)))
        decontam.refine(order, rank, ends, depth, np.arange(len(flat)), 200)
        assert want(200) == sorted(want(200))


def test_words_with_equal_hashes_stay_apart(monkeypatch, spark):
    monkeypatch.setattr(decontam._words, "xxh64", lambda buf, starts, lens, seed=0: (lens.astype(np.uint64) % np.uint64(2)) << np.uint64(50))
    texts = ["aa bb cc dd ee ff gg hh ii jj kk", "aa bb cc dd ee ff gg hh ii jx kk", "bb aa"]
    index = decontam.build_index([("1", texts[0].encode()), ("2", b"bb")])
    found = decontam.find([t.encode() for t in texts], index)
    assert [sorted(x) for x in found.items] == [["1", "2"], ["2"], ["2"]] and found.longest.tolist() == [11, 1, 1]


def test_long_texts_of_one_word(spark):
    index = decontam.build_index([("a", b"a " * 500), ("b", b"a " * 400 + b"b")])
    found = decontam.find([b"a " * 9000, b"b " * 10, b"c " + b"a " * 9], index)
    assert [sorted(x) for x in found.items] == [["a", "b"], [], []] and found.longest.tolist() == [500, 0, 0] and found.longest_at.tolist() == [0, -1, -1]
    assert int(found.hit.sum()) == 9000


def test_many_ids_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART_BYTES", 200)
    b = spark.createDataFrame([(f"item{i}", "one two three") for i in range(100)] + [(None, "one two three")], "item_id string, text string")
    d = spark.createDataFrame([("x", "zero one two three")], "doc_id string, text string")
    (r,) = decontam.contamination(d, b).collect()
    assert r["items"] == sorted(f"item{i}" for i in range(100)) and (r.n_hit, r.longest_match, r.longest_at) == (3, 3, 1)
