import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import _words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=80).map(lambda b: bytes(x % 128 for x in b)), max_size=8), st.integers(0, 2**32))
def test_hashes_and_spans(texts, seed):
    words = _words.split(texts, _words.SPACES)
    hashes = words.hashes(seed)
    for i, t in enumerate(texts):
        own = [xxhash.xxh64_intdigest(w, seed) for w in t.lower().split(None) if w] if not any(c in t for c in b"\x1c\x1d\x1e\x1f") else None
        if own is not None:
            assert hashes[words.bounds[i] : words.bounds[i + 1]].tolist() == own


def test_lengths_around_the_lanes():
    texts = [b"y" * n for n in [*range(1, 140), 511, 512, 513, 5000]]
    words = _words.split(texts, _words.SPACES)
    assert words.hashes(42).tolist() == [xxhash.xxh64_intdigest(t, 42) for t in texts]
    one = _words.spaced(_words.split([b" a  bb\tccc ", b"", b"d"], _words.SPACES))
    assert one.buf[: one.starts[3] + 1].tobytes() == b"a bb ccc d"


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    import re

    texts = [b"one two three one abcdefghi abcdefghj abcdefgh abcdefgh1 two x", b"", b"\xc3\xa9 one abcdefghijklmnopqrstuvw abcdefghijklmnopqrstuvx abcdefghijklmnopqrstuvw"]
    for few in (False, True):
        if few:  # hashes that clash all the time
            monkeypatch.setattr(_words, "xxh64", lambda buf, starts, lens, seed=0: lens.astype(np.uint64) % np.uint64(3))
        words = _words.split(texts, _words.SPACES)
        index, of = _words.distinct(words)
        raw = [w for t in texts for w in re.findall(rb"[^ ]+", t)]
        kinds = [words.buf[words.starts[k] : words.starts[k] + words.lens[k]].tobytes() for k in index]
        assert len(set(kinds)) == len(kinds) == len(set(raw)) and [kinds[k] for k in of] == raw
