"""The fitted operators: language, quality, cross-entropy difference."""

import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import langid, lmscore, quality, queries
from lorekeep.llm._sample import balanced


def held_out(id):
    return zlib.crc32(str(id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def middle():
    return "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark, middle):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op1_language_id(spark, middle).collect()
    assert len(got) == len(known) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == known[r.doc_id] for r in got if r.held_out]) > 0.98


def test_forward_sums_all_segmentations():
    vocabulary = sorted([b"a", b"ab", b"abc", b"b", b"bc", b"c", langid._START, langid._START + b"a"])
    model = langid.train([b"abc abcb cab", b"bca bbc"], ["x", "y"], vocabulary)
    number = {p: i + 256 for i, p in enumerate(vocabulary)}

    def brute(word, k):
        if not word:
            return 1.0
        out = model.p[word[0], k] * brute(word[1:], k)
        return out + sum(model.p[number[word[:n]], k] * brute(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in number)

    for word in (langid._START + b"abcabc", langid._START + b"z", langid._START):
        buf = np.frombuffer(word + bytes(40), np.uint8)
        got = np.exp(langid.log_probability(model.pieces.lattice(buf, np.array([0]), np.array([len(word)])), model.p))[0]
        assert np.allclose(got, [brute(word, 0), brute(word, 1)], rtol=1e-9)
    assert np.allclose(model.p.sum(axis=0), 1)


def brute_log_probability(word, p, number, longest):
    """The forward sum of one word in one language, position by position, as a log."""
    logs = [0.0]
    for t in range(1, len(word) + 1):
        terms = [logs[t - 1] + math.log(p[word[t - 1]])] + [logs[b] + math.log(p[number[word[b:t]]]) for b in range(max(0, t - longest), t) if word[b:t] in number]
        top = max(terms)
        logs.append(top + math.log(sum(math.exp(x - top) for x in terms)))
    return logs[-1]


@pytest.fixture(scope="module")
def vocabulary():
    return langid.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))


def test_words_of_any_length_sum_all_segmentations(vocabulary):
    model = langid.train([t.encode() for t in ("hello world it is text", "数据库连接数据库 接口", "écrire été à la")], ["en", "zh", "fr"], vocabulary)
    number, longest = {p: i + 256 for i, p in enumerate(vocabulary)}, max(map(len, vocabulary))
    words = ["数据库连接" * 3 + "数据", "据" * 17, "x" * 200, "hello" * 60, "กข" * 40, "aé数" * 50, "q"]
    raw = [langid._START + w.encode() for w in words]
    lens = np.array([len(w) for w in raw])
    got = langid.log_probability(model.pieces.lattice(np.frombuffer(b"".join(raw) + bytes(40), np.uint8), np.cumsum(lens) - lens, lens), model.p)
    for w, row in zip(raw, got):
        assert np.allclose(row, [brute_log_probability(w, model.p[:, k], number, longest) for k in range(3)], rtol=1e-9), w
    names, score = model.predict(["数据库连接".encode() * 20000, b"x" * 100_000, b""])
    assert names[0] == "zh" and names[2] == "und" and (score <= 1).all()


def test_language_query_equals_brute_force(spark, small, vocabulary):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    number, longest = {p: i + 256 for i, p in enumerate(vocabulary)}, max(map(len, vocabulary))
    known = {}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op1_language_id(spark, small).collect():
        words = re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", texts[r.doc_id].encode().lower())
        if len(words) > 3000:
            continue
        for w in set(words) - known.keys():
            known[w] = [brute_log_probability(langid._START + w, model.p[:, k], number, longest) for k in range(len(model.languages))]
        sums = [sum(known[w][k] for w in words) for k in range(len(model.languages))]
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        best = max(range(len(sums)), key=lambda k: sums[k])
        assert r.lang_pred == model.languages[best] and math.isclose(r.score, 1 / sum(math.exp(x - sums[best]) for x in sums), rel_tol=1e-6)


def test_samples_are_bounded_and_leave_no_group_out(spark):
    rows = [(None, "même texte", "fr", 0)] * 1500 + [(None, f"text {i}", "en", 0) for i in range(1500)] + [(7, f"ein {i}", "de", 0) for i in range(900)] + [(i, "x", "es", 0) for i in range(5)]
    known = spark.createDataFrame(rows, "i long, t string, g string, y int").repartition(3)
    got = balanced(known, 300, 1 << 20).collect()
    assert {g: sum(r.n for r in got if r.g == g) for g in ("fr", "en", "de", "es")} == {"fr": 300, "en": 300, "de": 300, "es": 5}
    assert [tuple(r) for r in balanced(known.repartition(7), 300, 1 << 20).collect()] == [tuple(r) for r in got]
    few = balanced(known, 300, 50).collect()
    assert {r.g for r in few} == {"fr", "en", "de", "es"} and all(sum(len(r.t) for r in few if r.g == g) <= 50 for g in ("en", "de"))
    docs = spark.createDataFrame([(1, f"good words here {i}") for i in range(3000)] + [(2, "bad! bad!"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (4, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels, rows=100).temperature > 0


def test_language_of_odd_rows(odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = langid.fit(odd, path)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[6][0] in ("en", "fr")
    assert langid.identify(empty, model).count() == 0
    nothing = langid.fit(empty, path)
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_quality_on_held_out_rows(spark, middle):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{middle}/labels.parquet").collect()}
    got = queries.op8_quality_classifier(spark, middle).collect()
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 and r.held_out == held_out(r.doc_id) for r in got)
    own = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in own]) > 0.95


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    got = quality.score(odd, model)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    kept = quality.accepted(odd, model)
    assert kept.columns == odd.columns
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0
    one_kind = quality.fit(odd, labels.where("quality = 1"))
    assert quality.score(odd, one_kind).where("score < 0.9").count() == 0


def test_quality_query_equals_plain_python(spark, small):
    """Pooling, network and probability, one number after the other, with the fitted weights."""
    import xxhash

    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    vectors = dict(zip(model.vocab.tolist(), model.vectors.astype(float).tolist()))
    mask = 2**64 - 1

    def index_vector(h):
        out = [0.0] * quality.DIM
        for _ in range(quality.NONZERO):
            h = ((h ^ (h >> 31)) * 0x9E3779B97F4A7C15 + 0x165667B19E3779F9) & mask
            out[(h >> 40) % quality.DIM] += 1.0 if h >> 33 & 1 else -1.0
        return [x / math.sqrt(quality.NONZERO) for x in out]

    def shape(w):
        kinds = [ord("x") if 97 <= b <= 122 or b >= 128 else ord("X") if 65 <= b <= 90 else ord("9") if 48 <= b <= 57 else b for b in w]
        return bytes(b for i, b in enumerate(kinds) if not i or kinds[i - 1] != b)

    def pooled(text):
        sums = [[0.0] * quality.DIM for _ in range(quality.CHANNELS)]
        words, seen = re.findall(rb"[^\x20\x09-\x0D]+", text), set()
        for i, w in enumerate(words):
            low = w.lower()
            depth = int(math.log2(i + 1)) // 2
            units = [xxhash.xxh64_intdigest(low), xxhash.xxh64_intdigest(shape(w), 1), depth * 4 + 2 * (low not in seen) + (i > 0 and words[i - 1].lower() == low) + (1 << 60)]
            seen.add(low)
            for c, u in enumerate(units):
                for k, x in enumerate(vectors.get(u) or (index_vector(u) if c == 0 else [0.0] * quality.DIM)):
                    sums[c][k] += x
        return [x / max(1, len(words)) for row in sums for x in row]

    for r, want in zip(queries.op8_quality_classifier(spark, small).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()):
        if len(want.text or "") > 20000:
            continue
        x = [(v - float(m)) / float(s) for v, m, s in zip(pooled((want.text or "").encode()), model.mean, model.scale)]
        h = [max(0.0, sum(x[i] * float(model.w1[i, k]) for i in range(len(x))) + float(model.b1[k])) for k in range(quality.HIDDEN)]
        z = (sum(a * float(b) for a, b in zip(h, model.w2)) + model.b2) / model.temperature
        assert r.doc_id == want.doc_id and abs(r.score - 1 / (1 + math.exp(-max(-60, min(60, z))))) < 2e-4


def test_temperature_doesnt_change_order_but_confidence():
    rng = np.random.default_rng(1)
    texts = [(" ".join(f"w{rng.integers(40)}" for _ in range(30)) if i % 2 else "spam! " * int(rng.integers(5, 30))).encode() for i in range(200)]
    model = quality.train(texts, [i % 2 for i in range(200)], epochs=20)
    score = model.score(texts)
    assert ((score > 0.5) == (np.arange(200) % 2 == 1)).mean() > 0.98 and model.temperature > 0


def brute_losses(docs, inside):
    """The same models from plain dictionaries, each document left out in turn."""
    from lorekeep.llm.lmscore import PAIR_WEIGHT, PRIOR, WORD_BITS, tokens

    parts = [tokens([d.encode()]) for d in docs]
    out = []
    for i, (word, pair, _) in enumerate(parts):
        row = []
        for member in (inside, [True] * len(docs)):
            others = [p for j, p in enumerate(parts) if j != i and member[j]]
            words = np.bincount(np.concatenate([np.zeros(0, np.int64), *(p[0] for p in others)]), minlength=1 << WORD_BITS)
            pairs = {}
            for p in others:
                for x in p[1].tolist():
                    pairs[x] = pairs.get(x, 0) + 1
            loss = []
            for k, w in enumerate(word.tolist()):
                p = (words[w] + PRIOR) / (words.sum() + PRIOR * (1 << WORD_BITS))
                if k and words[word[k - 1]]:
                    p = PAIR_WEIGHT * min(pairs.get(int(pair[k]), 0), words[word[k - 1]]) / words[word[k - 1]] + (1 - PAIR_WEIGHT) * p
                loss.append(-np.log(p))
            row.append(np.mean(loss) if loss else 0.0)
        out.append(row)
    return out


def test_cross_entropy_difference_equals_brute_force(spark):
    docs = ["a b c a b", "a b d", "", "c c c", "b a d a b c", "x"]
    inside = [True, False, True, False, True, False]
    d = spark.createDataFrame([(i, t, "in" if m else "out") for i, (t, m) in enumerate(zip(docs, inside))], "doc_id int, text string, source string")
    target = F.col("source") == "in"
    got = lmscore.score(d, lmscore.fit(d, target), target).orderBy("doc_id").collect()
    assert np.allclose([[r.ce_target, r.ce_background] for r in got], brute_losses(docs, inside), atol=1e-9)
    assert all(abs(r.score - (r.ce_target - r.ce_background)) < 1e-12 for r in got)


def test_cross_entropy_of_odd_rows(odd, empty):
    target = F.col("source") == "src1"
    models = lmscore.fit(odd, target)
    got = {r.doc_id: r for r in lmscore.score(odd, models, target).collect()}
    assert got[2].n_tokens == got[3].n_tokens == 0 and got[2].score == 0.0 and got[5].n_tokens == 60000
    assert lmscore.score(empty, lmscore.fit(empty, target), target).count() == 0


def test_cross_entropy_counts_every_word_apart(spark):
    from lorekeep.llm.lmscore import PAIR_WEIGHT, PRIOR

    # More words than 2 ** 18, and more pairs than 2 ** 20 could hold apart.
    docs = [" ".join(f"w{(7 * i + 1) * (3001 * k + 11) % 400_009}" for i in range(5000)) for k in range(240)]
    inside = [k % 3 == 0 for k in range(len(docs))]
    words, pairs = ({}, {}), ({}, {})
    for d, m in zip(docs, inside):
        w = d.split()
        for k in range(2):
            if k or m:
                for x in w:
                    words[k][x] = words[k].get(x, 0) + 1
                for x in zip(w, w[1:]):
                    pairs[k][x] = pairs[k].get(x, 0) + 1
    assert len(words[1]) > 1 << 18 and len(pairs[1]) > 1 << 20
    d = spark.createDataFrame([(i, t, "in" if m else "out") for i, (t, m) in enumerate(zip(docs, inside))], "doc_id int, text string, source string").repartition(3)
    target = F.col("source") == "in"
    models = lmscore.fit(d, target)
    assert models.totals == (sum(words[0].values()), sum(words[1].values())) and models.vocabulary == len(words[1])
    got = {r.doc_id: r for r in lmscore.score(d, models, target).collect()}
    assert len(got) == len(docs)
    for i in (0, 1, 100, 239):
        w = docs[i].split()
        for k, ce in ((0, got[i].ce_target), (1, got[i].ce_background)):
            mine = k or inside[i]
            own_words, own_pairs = {}, {}
            for x in w if mine else ():
                own_words[x] = own_words.get(x, 0) + 1
            for x in zip(w, w[1:]) if mine else ():
                own_pairs[x] = own_pairs.get(x, 0) + 1
            loss = 0.0
            for j, x in enumerate(w):
                p = (words[k].get(x, 0) - own_words.get(x, 0) + PRIOR) / (models.totals[k] - sum(own_words.values()) + PRIOR * len(words[1]))
                history = words[k].get(w[j - 1], 0) - own_words.get(w[j - 1], 0) if j else 0
                if history:
                    both = pairs[k].get((w[j - 1], x), 0) - own_pairs.get((w[j - 1], x), 0)
                    p = PAIR_WEIGHT * both / history + (1 - PAIR_WEIGHT) * p
                loss -= np.log(p)
            assert abs(ce - loss / len(w)) < 1e-9


def test_quality_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    # Ids of the folds that may be learned from.
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(ids[0], f"text {k}") for k in range(500)] + [(i, f"other {i}") for i in ids[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1), (ids[0], 1), *((i, i % 2) for i in ids[1:])], "doc_id long, quality int")
    monkeypatch.setattr(quality, "train", lambda texts, y: (texts, y))
    texts, y = quality.fit(docs, labels, rows=100)
    assert len(texts) == len(y) == 100 and len(set(texts)) == 100
    texts, _ = quality.fit(docs, labels, rows=1000)
    assert len(texts) == 500 + len(ids) - 1
