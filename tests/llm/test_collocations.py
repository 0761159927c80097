import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorekeep.llm import collocations, queries


def brute(rows, longest=3, least=10, cover=50, top=2000):
    """rows: (lang, text)."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                counts[lang].update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = []
        often = [p for p, a in f.items() if a >= least and " " in p]
        covered = defaultdict(int)
        for p in often:
            w = p.split(" ")
            for n in range(2, len(w)):
                for i in range(len(w) - n + 1):
                    covered[" ".join(w[i : i + n])] = max(covered[" ".join(w[i : i + n])], f[p])
        for p in often:
            if 100 * covered[p] >= cover * f[p]:
                continue
            w, a = p.split(" "), f[p]
            cuts = [(1_000_000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((-score, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def texts(seed, n=60):
    r = random.Random(seed)
    words = ["a", "B", "é", "the", "数据", "x\x00y", "\x01", "\x1f", "tab", "of"]
    marks = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", "! ?"]
    make = lambda k: "".join(r.choice(words[: r.choice([2, 5, 10])]) + r.choice(marks) for _ in range(k))
    langs = ["en", "en", "en", "fr", None, "und", ""]
    return [(r.choice(langs), make(r.choice([0, 1, 2, 30, 200]))) for _ in range(n)] + [("en", None), (None, "")]


@pytest.mark.parametrize(("hot", "at_once", "longest"), [(1 << 22, 1 << 24, 3), (300, 1 << 24, 3), (300, 400, 3), (1 << 22, 60, 3), (200, 500, 5), (1 << 22, 1 << 24, 2)])
def test_equals_brute_force(spark, monkeypatch, hot, at_once, longest):
    """Also with first words in parts, with first words beyond what a task orders at once, and both."""
    monkeypatch.setattr(collocations, "HOT_BYTES", hot)
    monkeypatch.setattr(collocations, "SORTED_BYTES", at_once)
    rows = texts(longest + hot) * (2 if at_once > 1000 else 1)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for least, top in ((10, 2000), (2, 7)):
        assert sorted(map(tuple, collocations.collocations(docs, longest=longest, least=least, top=top).collect())) == brute(rows, longest, least, 50, top)


def test_query_equals_its_sql(spark, small, duck):
    got = queries.op11_phrase_collocations(spark, small)
    want = duck(small).sql(queries.OP11_SQL)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_counts_past_64_bits(spark):
    """a * a * 1000000 of a phrase that occurs 10**10 times."""
    million = 10**10
    counts = spark.createDataFrame([("en", "a b", 2, million), ("en", "a", 1, million + 1), ("en", "b", 1, 3 * million)], "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", 9 * million)], "lang string, n long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(collocations, "phrase_counts", lambda *a: (counts, totals))
        (r,) = collocations.collocations(counts.selectExpr("lang", "phrase as text")).collect()
    assert r.score == 1_000_000 * million * million // ((million + 1) * 3 * million) == 333333


def test_odd_rows(spark, odd, empty):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(map(tuple, collocations.collocations(odd).collect())) == brute(rows)
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(odd.selectExpr("lang", "cast(null as string) as text")).count() == 0


def test_a_long_text():
    """20 MB in one text."""
    got = collocations.suffixes([b"one two three. " * 1_400_000], ["en"])
    n = {bytes(w): (r, c) for w, r, c in zip(got.column(1).to_pylist(), got.column(3).to_pylist(), got.column(4).to_pylist(), strict=True)}
    assert n[b"one"] == (b"two three\n", (1_400_000).to_bytes(4, "little")) and n[b"three"] == (b"\n", (1_400_000).to_bytes(4, "little"))


def test_memory_of_a_run_of_texts():
    """Two such runs at once have to fit beside the executor's heap."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=r.randint(1, 9))) for _ in range(20000)]
    made = [" ".join(r.choices(words, k=300)).encode() for _ in range(1500)]
    tracemalloc.start()
    try:
        collocations.suffixes(made, ["en"] * len(made))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 * sum(map(len, made))


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_stretches_of_a_buffer(monkeypatch, at_once):
    monkeypatch.setattr(collocations, "GATHERED_BYTES", at_once)
    buf = np.frombuffer(b"0123456789" * 3, np.uint8)
    for spans in ([], [(0, 0)], [(0, 30)], [(5, 3), (0, 0), (0, 20), (29, 1), (3, 4), (3, 4)]):
        start, size = (np.array([s[k] for s in spans], np.int32) for k in (0, 1))
        data, to = collocations._gathered(buf, start, size)
        assert data.tobytes() == b"".join(buf[s : s + n].tobytes() for s, n in spans)
        assert to.tolist() == np.cumsum(size).tolist()
