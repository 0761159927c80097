"""Vectors of contents from a pluggable model: pieces of words in, mean of the token states out."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..ship import ship

MOST_TOKENS = 256
# Ids where a vocabulary doesn't name them.
SPECIAL = {"[UNK]": 100, "[CLS]": 101, "[SEP]": 102, "[PAD]": 0}
_WORD = re.compile(r"[A-Za-z0-9_一-鿿]+|[^\sA-Za-z0-9_一-鿿]")


def load_vocabulary(path: str) -> dict[str, int]:
    """Pieces and ids of a tokenizer file, which lists them as an object or as pairs, in the order of their ids."""
    vocab = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    if isinstance(vocab, dict):
        return vocab
    return {v[0]: v[1] if isinstance(v[1], int) else i for i, v in enumerate(vocab)}


def word_pieces(text: str, vocab: dict[str, int], most: int = MOST_TOKENS) -> list[int]:
    """Ids between a start and an end mark: of each word the longest piece that the vocabulary has, then on behind it.

    Pieces inside a word are listed with ## before them. A character that no piece begins with is itself or unknown. At most `most` ids.
    """
    special = {k: vocab.get(k, v) for k, v in SPECIAL.items()}
    longest = max(map(len, vocab), default=1)
    ids = [special["[CLS]"]]
    for word in _WORD.findall(text.lower()):
        at = 0
        while at < len(word) and len(ids) < most - 1:
            mark = "##" if at else ""
            size = next((n for n in range(min(longest, len(word) - at), 0, -1) if mark + word[at : at + n] in vocab), 0)
            ids.append(vocab[mark + word[at : at + size]] if size else vocab.get(word[at], special["[UNK]"]))
            at += size or 1
        if len(ids) >= most - 1:
            break
    return [*ids, special["[SEP]"]]


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the states (rows x tokens x size) that the mask keeps; zeros where it keeps none."""
    weight = mask.astype(np.float32)
    return (states * weight[:, :, None]).sum(axis=1) / np.maximum(weight.sum(axis=1), 1)[:, None]


def normalized(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows as they are."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.where(size > 0, vectors / np.where(size > 0, size, 1), vectors).astype(np.float32)


def embed(df: DataFrame, make_model: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], vocab: dict[str, int], content: str = "content", into: str = "embedding", rows: int = 64) -> DataFrame:
    """df with a column of vectors. make_model is called once in each task and gives a function from ids and mask (rows x tokens) to states.

    Null contents get null. A model that fails on some rows leaves them without a vector, so that keyword search still has them.
    """
    ship(df.sparkSession)
    own = df.drop(into)
    where = own.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            texts = batch.column(where).to_pylist()
            out: list[list[float] | None] = [None] * len(texts)
            for i in range(0, len(texts), rows):
                some = [k for k in range(i, min(i + rows, len(texts))) if texts[k] is not None]
                if not some:
                    continue
                ids = [word_pieces(texts[k], vocab) for k in some]
                wide = max(map(len, ids))
                mask = np.array([[1] * len(x) + [0] * (wide - len(x)) for x in ids])
                try:
                    states = model(np.array([x + [vocab.get("[PAD]", 0)] * (wide - len(x)) for x in ids]), mask)
                except (ValueError, RuntimeError):
                    continue
                for k, v in zip(some, normalized(mean_pool(states, mask)), strict=True):
                    out[k] = v.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float32()))], names=[*batch.schema.names, into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(run, f"{kinds}, `{into}` array<float>").select(*df.columns, *([] if into in df.columns else [into]))


def onnx_model(path: str) -> Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """A make_model for embed() over an ONNX file that every executor can read."""

    def make() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        return lambda ids, mask: session.run(None, {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)})[0]

    return make
