import json
import struct

import numpy as np

from lorekeep import schemas
from lorekeep.operators import embed as E
from lorekeep.operators.detect import detect
from lorekeep.sources import legacy

VOCAB = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "run": 4, "##ning": 5, "##s": 6, "!": 7, "数": 8, "un": 9, "##ru": 10, "##n": 11}


def test_word_pieces():
    assert E.word_pieces("Running runs!", VOCAB) == [2, 4, 5, 4, 6, 7, 3]
    assert E.word_pieces("unrun 数x", VOCAB) == [2, 9, 10, 11, 8, 1, 3]
    assert E.word_pieces("", VOCAB) == [2, 3]
    assert len(E.word_pieces("run " * 999, VOCAB)) == 256


def test_pool_and_norm():
    states = np.array([[[1.0, 3.0], [3.0, 5.0], [9.0, 9.0]], [[1.0, 1.0]] * 3])
    assert E.mean_pool(states, np.array([[1, 1, 0], [0, 0, 0]])).tolist() == [[2.0, 4.0], [0.0, 0.0]]
    assert np.allclose(np.linalg.norm(E.normalized(np.array([[3.0, 4.0], [0.0, 0.0]])), axis=1), [1, 0])


def test_embed(spark):
    d = spark.createDataFrame([(1, "run"), (2, None), (3, "fail here"), (4, "runs")], "id int, content string")

    def make():
        def model(ids, mask):
            if (ids == 1).any():
                raise ValueError("no")
            return np.stack([ids, mask], axis=2).astype(float)

        return model

    got = {r.id: r.embedding for r in E.embed(d, make, VOCAB, rows=1).collect()}
    assert got[2] is None and got[3] is None and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[1] != got[4]


def test_legacy_rows(spark):
    vector = [0.5, -1.25, 3.0e-40, 1e30, 0.0]
    names = schemas.names(schemas.BULLETS)
    row = {c: None for c in names} | {"id": "a", "scope": "global", "section": "s", "content": "c", "instructivity_score": 1.0, "recall_count": 2, "decay_weight": 0.5, "related_tools": '["x","y"]', "tags": "[]", "embedding": struct.pack("<5f", *vector), "created_at": "2025-01-01T00:00:00.000Z", "updated_at": "2025-01-01T00:00:00.000Z"}
    kinds = {"embedding": "binary", "instructivity_score": "double", "recall_count": "int", "decay_weight": "double"}
    stored = spark.createDataFrame([[row[c] for c in names]], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names))
    got = legacy.decoded(stored).first()
    assert (got.related_tools, got.tags, got.key_entities) == (["x", "y"], [], None)
    assert got.embedding == list(struct.unpack("<5f", row["embedding"])) and got.created_at.year == 2025
    assert json.loads(legacy.encoded(legacy.decoded(stored)).first().related_tools) == ["x", "y"]


def test_events_from_lines(spark):
    lines = spark.createDataFrame([('{"tool_name": "Bash", "tool_input": {"command": "npm run build"}, "tool_response": "ok", "session_id": "s"}',), ("broken",)], "value string")
    assert [r.summary for r in detect(legacy.parse_events(lines)).collect()] == ["Executed: npm run build"]
