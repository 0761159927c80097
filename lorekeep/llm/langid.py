"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary and for every single byte. The
probability of a word in a language is the sum over all its segmentations into pieces, by a forward
algorithm; the probabilities are learned by expectation-maximisation from the words of labelled texts. The words
of a text are independent, so a text's score is a sum over its words. All distinct words of a batch go through
an automaton of the pieces, and through the forward algorithm, side by side.

A word may be of any length, as in scripts without blanks. Where no piece reaches over a place in a word, every segmentation has
a boundary there, so the sum is the product of the sums of both sides: words are cut at such places without any loss. What
is still long goes through the forward algorithm with as many columns as the longest piece has bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._batches import as_bytes, map_slices
from ._sample import balanced
from .bpe import minimal_automaton
from .quality import HELD_OUT, fold

#: Labelled documents of each language, chosen by a hash of id and text, on which the probabilities are fitted, and most of their bytes.
TRAIN_ROWS = 300
TRAIN_BYTES = 8 << 20
ROUNDS = 4
#: Stretches of about equal length, up to the last of these bytes, go through the forward algorithm side by side; longer ones aren't used to learn.
LENGTHS = (4, 8, 16, 32, 64)
#: Bytes of words that are segmented at once.
AT_ONCE = 1 << 17
UNKNOWN = "und"
_START = "▁".encode()
_NOT_LETTERS = _words.table([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Probability that a language gives to a piece it was never seen to use.
_FLOOR = 1e-9


def pieces_of(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model, without control and byte pieces, sorted; letters A-Z in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p.encode().lower() for p in own if p})


@dataclass
class Lattice:
    """All pieces found in some stretches: piece number, stretch, and byte range of each, by end and stretch. word: of each stretch."""

    lens: np.ndarray
    word: np.ndarray
    piece: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def n(self) -> int:
        return len(self.lens)

    def of(self, which: np.ndarray) -> Lattice:
        """Some of its stretches."""
        number = np.full(self.n, -1, np.int32)
        number[which] = np.arange(len(which))
        order = np.flatnonzero(number[self.at] >= 0)
        if (np.diff(which) < 0).any():
            order = order[np.lexsort((number[self.at[order]], self.end[order]))]
        return Lattice(self.lens[which], self.word[which], self.piece[order], number[self.at[order]], self.start[order], self.end[order])

    def by_length(self) -> list[tuple[np.ndarray, Lattice]]:
        """Its stretches of each class of LENGTHS: their numbers, and a lattice of them alone."""
        kind = np.searchsorted(LENGTHS, self.lens)
        return [(which, self.of(which)) for k in range(len(LENGTHS)) if len(which := np.flatnonzero(kind == k))]


class Pieces:
    """The automaton of the vocabulary. Pieces have numbers from 256 on; a number below stands for that single byte."""

    def __init__(self, automaton: dict[str, np.ndarray], size: int):
        self.a = automaton
        self.size = size + 256

    def lattice(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> Lattice:
        a = self.a
        total = int(lens.sum())
        word = np.repeat(np.arange(len(lens)), lens)
        begin = np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)
        place = starts[word] + begin
        found = [(buf[place].astype(np.int64), word, begin, begin + 1)]
        on = np.arange(total)
        state, entry = np.zeros(total, np.int64), np.zeros(total, np.int64)
        step = 0
        while len(on):
            on = on[begin[on] + step < lens[word[on]]]
            e = a["edge"][state[on], a["classes"][buf[place[on] + step]]]
            on, e = on[e > 0], e[e > 0]
            state[on] = a["target"][e]
            entry[on] += a["skip"][e]
            step += 1
            hit = on[a["final"][state[on]]]
            found.append((entry[hit] + 256, word[hit], begin[hit], begin[hit] + step))
        piece, word, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
        # Places inside a word that some piece reaches over.
        first = np.cumsum(lens) - lens
        wide = np.flatnonzero(end - begin > 1)
        over = np.bincount(first[word[wide]] + begin[wide] + 1, minlength=total + 1) - np.bincount(first[word[wide]] + end[wide], minlength=total + 1)
        cut = np.cumsum(over)[:total] == 0
        cut[first] = True
        place = np.flatnonzero(cut)
        number = np.cumsum(cut) - 1
        at = number[first[word] + begin]
        shift = place[at] - first[word]
        order = np.lexsort((at, end - shift))
        rows = (x.astype(np.int32)[order] for x in (piece, at, begin - shift, end - shift))
        return Lattice(np.diff(place, append=total), np.searchsorted(first, place, side="right") - 1, *rows)


def forward(lattice: Lattice, p: np.ndarray, scale: float = 64.0) -> np.ndarray:
    """alpha[stretch, position, language]: sum over the segmentations of each stretch's first bytes, times scale ** position."""
    longest = int(lattice.lens.max()) if lattice.n else 0
    alpha = np.zeros((lattice.n, longest + 1, p.shape[1]))
    alpha[:, 0] = 1
    cut = np.searchsorted(lattice.end, np.arange(1, longest + 2))
    for t in range(1, longest + 1):
        a, b = cut[t - 1], cut[t]
        if a == b:
            continue
        word, begin = lattice.at[a:b], lattice.start[a:b]
        part = alpha[word, begin] * p[lattice.piece[a:b]] * (scale ** (t - begin))[:, None]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        alpha[word[first], t] = np.add.reduceat(part, first, axis=0)
    return alpha


def _forward_long(lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Log of the same sum for whole stretches of any length. Only as many positions are held as a piece has bytes; each new one is made 1 and its log kept aside."""
    width = int((lattice.end - lattice.start).max()) + 1
    out = np.zeros((lattice.n, p.shape[1]))
    held = np.zeros((lattice.n, width, p.shape[1]))
    held[:, 0] = 1
    cut = np.searchsorted(lattice.end, np.arange(1, int(lattice.lens.max()) + 2))
    for t in range(1, len(cut)):
        a, b = cut[t - 1], cut[t]
        at = lattice.at[a:b]
        part = held[at, lattice.start[a:b] % width] * p[lattice.piece[a:b]]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        own, new = at[first], np.maximum(np.add.reduceat(part, first, axis=0), 1e-300)
        out[own] += np.log(new)
        held[own] /= new[:, None]
        held[own, t % width] = 1
    return out


def log_probability(lattice: Lattice, p: np.ndarray, scale: float = 64.0) -> np.ndarray:
    """Log probability of each word in each language: the sum of those of its stretches."""
    each = np.zeros((lattice.n, p.shape[1]))
    for which, own in lattice.by_length():
        alpha = forward(own, p, scale)
        each[which] = np.log(np.maximum(alpha[np.arange(own.n), own.lens], 1e-300)) - (own.lens * np.log(scale))[:, None]
    long = np.flatnonzero(lattice.lens > LENGTHS[-1])
    if len(long):
        # Longest first and some at a time, so that what is held stays small.
        order = long[np.argsort(-lattice.lens[long], kind="stable")]
        for k in range(0, len(order), 2048):
            each[order[k : k + 2048]] = _forward_long(lattice.of(order[k : k + 2048]), p)
    edge = np.flatnonzero(np.concatenate([[True], lattice.word[1:] != lattice.word[:-1]]))
    return np.add.reduceat(each, edge, axis=0)


def _backward(lattice: Lattice, p: np.ndarray, scale: float = 64.0) -> np.ndarray:
    longest = int(lattice.lens.max())
    beta = np.zeros((lattice.n, longest + 1, p.shape[1]))
    beta[np.arange(lattice.n), lattice.lens] = 1
    order = np.lexsort((lattice.at, lattice.start))
    start = lattice.start[order]
    cut = np.searchsorted(start, np.arange(longest + 1))
    for t in range(longest - 1, -1, -1):
        own = order[cut[t] : cut[t + 1]]
        if len(own):
            word, end = lattice.at[own], lattice.end[own]
            part = beta[word, end] * p[lattice.piece[own]] * (scale ** (end - t))[:, None]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            beta[word[first], t] += np.add.reduceat(part, first, axis=0)
    return beta


def _runs(lens: np.ndarray, most: int = AT_ONCE) -> list[slice]:
    """Runs of words of about `most` bytes together; a longer word is alone."""
    edge = np.flatnonzero(np.diff(np.cumsum(lens) // most, prepend=0)) if len(lens) else []
    cuts = sorted({0, *(int(x) for x in edge), len(lens)})
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def learn(pieces: Pieces, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, scale: float = 64.0) -> np.ndarray:
    """Piece probabilities (pieces x languages) by expectation-maximisation over words with counts (words x languages). Stretches longer than LENGTHS has aren't used."""
    p = np.full((pieces.size, counts.shape[1]), 1.0 / pieces.size)
    lattices = []
    for run in _runs(lens):
        lattices += [(counts[run][own.word], own) for _, own in pieces.lattice(buf, starts[run], lens[run]).by_length()]
    for _ in range(rounds):
        seen = np.zeros_like(p)
        for n, lattice in lattices:
            alpha, beta = forward(lattice, p, scale), _backward(lattice, p, scale)
            whole = np.maximum(alpha[np.arange(lattice.n), lattice.lens], 1e-300)
            share = alpha[lattice.at, lattice.start] * beta[lattice.at, lattice.end] * p[lattice.piece] * (scale ** (lattice.end - lattice.start))[:, None]
            share *= (n / whole)[lattice.at]
            for k in range(p.shape[1]):
                seen[:, k] += np.bincount(lattice.piece, weights=share[:, k], minlength=pieces.size)
        total = seen.sum(axis=0)
        p = np.where(total > 0, seen / np.maximum(total, 1e-300), 1.0 / pieces.size)
        p = (p + _FLOOR) / (1 + _FLOOR * pieces.size)
    return p


def _word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buf, starts, lens, of, bounds): distinct words with the mark of a word's start before them, the number of each occurrence's word, and the occurrences of each text."""
    words = _words.split(texts, _NOT_LETTERS)
    index, of = _words.distinct(words)
    starts, lens = words.starts[index], words.lens[index]
    size = lens + len(_START)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()) + 40, dtype=np.uint8)
    for i, b in enumerate(_START):
        out[at + i] = b
    into = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    out[np.repeat(at + len(_START), lens) + into] = words.buf[np.repeat(starts, lens) + into]
    return out, at, size, of, words.bounds


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    p: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """(language, its share of the probability of all languages) of each text; UNKNOWN and 0 for a text without a letter, or if no language was learned."""
        sums = np.zeros((len(texts), max(1, len(self.languages))))
        buf, starts, lens, of, bounds = _word_spans(texts)
        n = np.diff(bounds)
        if len(starts) and self.languages:
            each = np.concatenate([log_probability(self.pieces.lattice(buf, starts[run], lens[run]), self.p) for run in _runs(lens)])
            some = np.flatnonzero(n)
            sums[some] = np.add.reduceat(each[of], bounds[some], axis=0)
        best = sums.argmax(axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        spoken = [bool(self.languages) and k > 0 and _has_letter(t) for t, k in zip(texts, n, strict=True)]
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, spoken, strict=True)], np.where(spoken, share, 0.0)


def _has_letter(text: bytes) -> bool:
    # ASCII letters, or else any other character that is a letter.
    return text.upper() != text.lower() or not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def train(texts: list[bytes], languages: list[str], vocabulary: list[bytes]) -> Model:
    """Fit a model to texts whose languages are known."""
    pieces = Pieces(minimal_automaton(vocabulary), len(vocabulary))
    names = sorted(set(languages))
    buf, starts, lens, of, bounds = _word_spans(texts)
    row = np.repeat(np.array([names.index(x) for x in languages], dtype=np.int64), np.diff(bounds)) if names else np.zeros(0, np.int64)
    counts = np.stack([np.bincount(of[row == k], minlength=len(starts)) for k in range(len(names))], axis=1).astype(np.float64) if names else np.zeros((len(starts), 0))
    return Model(names, pieces, learn(pieces, buf, starts, lens, counts))


def fit(docs: DataFrame, vocabulary_path: str, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit on `rows` documents of each language (all, if it has fewer) and TRAIN_BYTES of text of each at most, chosen by a hash of id and text, none of them from the held-out fold.

    Rows with a null text or language aren't used; rows without an id are like others. Repeated rows count as often as they occur, as far as they fit into `rows`.
    """
    known = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("g"), F.lit(0).alias("y")).where(F.col("g").isNotNull() & F.col("t").isNotNull())
    known = known.where(F.coalesce(fold(F.col("i")), F.lit(0)) != HELD_OUT)
    got = balanced(known, rows, TRAIN_BYTES).collect()
    return train([r.t.encode() for r in got for _ in range(r.n)], [r.g for r in got for _ in range(r.n)], pieces_of(vocabulary_path))


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, lang_pred and score. Null, empty and letterless texts are `und` with score 0; of languages with equal probability the first by name is taken.

    Texts and words of any length are read whole. Repeated rows and rows with equal or null ids each get a row. An empty table gives an empty result. Only the columns named are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t"))

    def work():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = shared.value.predict(as_bytes(batch.column(1)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["i", "lang_pred", "score"])

        return each

    return map_slices(own, "t", f"i {own.schema['i'].dataType.simpleString()}, lang_pred string, score double", work).withColumnRenamed("i", id)
