import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorekeep.llm import _flat, bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    arrays = bpe.load_vocabulary(PATH)
    entries = sorted({b" the", b"the", b" thing", b"things", " é".encode(), b"ing", b"nothing"})
    ids = [bpe.Encoder(arrays).merge_one(e) for e in entries]
    arrays |= bpe.minimal_automaton(entries) | {"entry_first": np.cumsum([0, *map(len, ids)]), "entry_ids": np.array([x for i in ids for x in i], np.int32)}
    return bpe.Encoder(_flat.open_mapped(_flat.save(arrays)))


def same(encoder, library, texts):
    ids, first = encoder.encode([t.encode() for t in texts])
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == want
    assert [x.decode() for x in encoder.decode(ids, first)] == [library.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=40), min_size=1, max_size=6))
def test_equals_the_library(encoder, library, texts):
    same(encoder, library, texts)


def test_equals_the_library_on_tricky_texts(encoder, library):
    random.seed(5)
    pool = ["a", "the", " the", " ", "  ", "\n", "\t", "'s", "'re", "'", "''", " 's", "'ll", "1", "é", " é", "数据", " ", " ", "!", "<|endoftext|>", "<|endof", "😀", "́", "\r\n", "\u0085", "x" * 40, "ab" * 30, "\x00", "nothing"]
    same(encoder, library, ["".join(random.choice(pool) for _ in range(random.choice([0, 1, 2, 5, 30]))) for _ in range(2000)])


def test_automaton_is_minimal_and_exact():
    entries = sorted({f"{a}{b}ing".encode() for a in "abcdef" for b in "xyz"} | {b"a", b"ab"})
    arrays = bpe.minimal_automaton(entries)
    assert len(arrays["final"]) <= 10
    own = bpe.Encoder(bpe.load_vocabulary(PATH) | arrays)
    words = [*entries, b"ax", b"axin", b"axings", b"zz", b"xing"]
    buf = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    lens = np.array([len(w) for w in words])
    assert own._find(buf, np.cumsum(lens) - lens, lens).tolist() == [*range(len(entries)), -1, -1, -1, -1, -1]


def test_query_on_documents(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op10_bpe_encode_decode(spark, small).collect():
        e = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd, empty, library):
    encoded = bpe.encode(odd, PATH)
    got = {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect()}
    assert all(got[r.doc_id] == (r.text or "") for r in odd.collect())
    assert bpe.encode(empty, PATH).count() == 0


def test_the_lexicon_holds_the_vocabulary(spark, library):
    arrays = bpe.encoder_for(bpe.build_lexicon(spark, PATH)).a
    plain, own = bpe.Encoder(bpe.load_vocabulary(PATH)), bpe.Encoder(arrays)
    tokens = sorted({arrays["token_bytes"][a:b].tobytes() for a, b in zip(arrays["token_first"], arrays["token_first"][1:])} - {b""})
    assert len(tokens) == library.get_vocab_size()
    lens = np.array([len(t) for t in tokens])
    entry = own._find(np.frombuffer(b"".join(tokens) + bytes(40), np.uint8), np.cumsum(lens) - lens, lens)
    assert entry.tolist() == list(range(len(tokens)))
    first = arrays["entry_first"]
    assert all(arrays["entry_ids"][first[i] : first[i + 1]].tolist() == plain.merge_one(tokens[i]) for i in range(0, len(tokens), 7))


def test_no_document_is_read_beforehand(spark, odd, library):
    """Nothing is counted or sampled: the documents are read once, by the encoding itself."""
    spark.sparkContext.setJobGroup("lexicon", "")
    try:
        encoded = bpe.encode(odd, PATH)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lexicon")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = sorted(library.encode(r.text or "", add_special_tokens=False).ids for r in odd.collect())
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()) == want
