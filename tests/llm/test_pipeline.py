"""The pipeline against the plain form of each stage."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from helpers import rows_of
from test_decontam import brute as hits_of
from test_pii import brute as base_of
from test_simhash import brute_fingerprint, roots
from tokenizers import Tokenizer

import corpus_pipeline
from lorekeep.llm import _words, pii, quality, queries


def test_op9_equals_its_sql(spark, small, duck):
    got = queries.op9_benchmark_decontamination(spark, small).toPandas()
    assert rows_of(got) == rows_of(duck(small).sql(queries.oracle_sql()["op9_benchmark_decontamination"]).df())


def test_run_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score([(r.text or "").encode()])[0] >= quality.ACCEPT]
    assert 0 < len(rows) < docs.count()
    fps = [brute_fingerprint(r.text) for r in rows]
    top = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for r, t in zip(rows, top):
        least[t] = min(least.get(t, r.doc_id), r.doc_id)
    rows = [r for r, t in zip(rows, top) if least[t] == r.doc_id]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [r for r, h in zip(rows, hits_of([r.text for r in rows], items)) if not h[1]]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for r in rows:
        (spans,) = pii.spans_of([r.text.encode()], pii._automaton())
        assert [(pii.KINDS[k], s, e) for k, s, e in spans if k < 4] == base_of(r.text)
        clean = pii.masked(r.text, spans)
        ids = library.encode(clean, add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, small).collect()} == want


def test_stages_keep_the_columns(spark, odd, small):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, small).columns == odd.columns


def test_stages_over_odd_rows(spark, odd, small):
    """Rows that stay or change, with nulls, blanks, repeats, a long text, a row without id, and columns of clashing names."""
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted((r.doc_id for r in d.collect()), key=lambda x: (x is None, x))
    assert ids(stages["SimHash near-dedup"](spark, odd, small)) == [1, 2, 5, 6, 7, None]
    clean = stages["benchmark decontamination"](spark, odd, small)
    assert sorted(map(repr, clean.collect())) == sorted(map(repr, odd.collect()))
    masked = stages["PII"](spark, odd, small)
    assert {r.doc_id: r.text for r in masked.collect() if r.doc_id in (2, 3)} == {2: None, 3: ""} and masked.count() == odd.count()
    (seven,) = masked.where("doc_id = 7").collect()
    assert "me@example.com" not in seven.text and "<EMAIL>" in seven.text and seven.n_chars == len(seven.text)
    digests = {(r.doc_id, r.decoded_sha256) for r in stages["BPE encoding and decoding"](spark, odd, small).collect()}
    assert digests == {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect()}
    kept = stages["quality classifier"](spark, odd, small)
    assert {repr(r) for r in kept.collect()} <= {repr(r) for r in odd.collect()}


def test_run_over_empty_tables(spark, small, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_encoding_reads_its_documents_once(spark, odd, small):
    """The last stage counts and samples nothing beforehand, and encodes every row."""
    spark.sparkContext.setJobGroup("encoding", "")
    try:
        found = corpus_pipeline.encode_tokens(spark, odd, small)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("encoding")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(hashlib.sha256(np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in odd.collect())
    assert sorted(r.ids_sha256 for r in found.collect()) == want


def test_quality_learns_from_every_labelled_document(spark, tmp_path, monkeypatch):
    """More labelled documents than a sample of 4000 holds, each with a word of its own that occurs often enough to have a vector. The model depends on the rows alone, however they are dealt out."""
    rows = [(k, f"own{k} " * 3 + ("good words follow" if k % 2 else "bad bad bad!")) for k in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(quality, "PART_ROWS", 2000)
    monkeypatch.setattr(quality, "accepted", lambda docs, model: model)
    model = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    own = lambda chosen: set(_words.split([f"own{k}".encode() for k in chosen], _words.SPACES).hashes().tolist())
    learned = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 != quality.HELD_OUT]
    assert len(learned) > 5000 and own(learned) <= set(model.vocab.tolist())
    assert not own(k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == quality.HELD_OUT) & set(model.vocab.tolist())
    assert ((model.score([t.encode() for _, t in rows]) >= 0.5) == np.array([k % 2 for k, _ in rows])).mean() > 0.99
    monkeypatch.setattr(quality, "MOST_SHIPPED", 0)
    again = corpus_pipeline.keep_quality(spark, docs.repartition(7), str(tmp_path))
    assert all(np.array_equal(getattr(model, k), getattr(again, k)) for k in ("vocab", "vectors", "mean", "scale", "w1", "b1", "w2", "b2", "temperature"))
