import math
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.functions import scoring, secrets, vectors
from lorekeep.functions import text as T
from lorekeep.operators import distill as D
from lorekeep.operators import search as S

STEMS = {
    "running": "runn", "testing": "test", "computing": "comput", "creation": "crea", "compilation": "compila", "compiled": "compil", "tested": "test", "compiler": "compil", "runner": "runn", "quickly": "quick",
    "safely": "safe", "processes": "process", "watches": "watch", "runs": "run", "tests": "test", "process": "process", "go": "go", "do": "do", "is": "is", "a": "a", "Running": "runn",
}


def column(spark, values, kind, of):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(of(F.col("v"))).collect()]


def test_stem(spark):
    assert column(spark, list(STEMS), "string", T.stem) == list(STEMS.values())
    assert [T.py_stem(w) for w in STEMS] == list(STEMS.values())


def test_cjk_ngrams(spark):
    texts = ["数据库", "hello数据库world", "hello world", "数", "", None]
    assert column(spark, texts, "string", lambda c: T.cjk_ngrams(c, 2)) == [["数据", "据库"], ["数据", "据库"], [], [], [], []]
    assert column(spark, ["数据库连接"], "string", lambda c: T.cjk_ngrams(c, 3)) == [["数据库", "据库连", "库连接"]]


def test_tokenize(spark):
    assert column(spark, ["hello, world! test.", "   ", "", "a_b C数d"], "string", T.tokenize) == [["hello", "world", "test"], [], [], ["a_b", "c数d"]]
    assert column(spark, ["The use of Tokens"], "string", T.search_tokens) == [["use", "tokens"]]


def test_paths_and_commands(spark):
    assert column(spark, ["a/b.TS", "x.zsh", "noext", "a.b/c"], "string", T.language_of) == ["typescript", "shell", None, None]
    assert column(spark, ["a.sh", "a.xyz", "noext"], "string", T.block_language_of) == ["bash", "xyz", "noext"]
    assert column(spark, ["a/b\\c.py", "c"], "string", T.basename) == ["c.py", "c"]
    assert column(spark, ["A=1 /usr/bin/git push", "  ls -la", "A=1"], "string", T.base_command) == ["git", "ls", "A=1"]
    assert column(spark, ["abcd", "abcde", "", "a", "😀😀a"], "string", T.estimate_tokens) == [1, 2, 0, 1, 2]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([1.0, 0.0], [0.5, math.sqrt(3) / 2], 0.5)]
    d = spark.createDataFrame(rows, "a array<double>, b array<double>, w double")
    assert all(abs(r.c - r.w) < 1e-9 for r in d.withColumn("c", vectors.cosine(F.col("a"), F.col("b"))).collect())


DECAY = [(8, 0, 0.831238), (30, 0, 0.5), (60, 0, 0.25), (60, 2, 0.4), (100, 14, 0.515905), (169, 0, 0.020146), (170, 0, 0.019686), (300, 0, 0.000977), (365, 0, 0.000218), (400, 15, 1.0), (7, 0, 1.0), (30, 5, 1.0), (60, 3, 0.475), (10, 14, 1.0)]


def test_decay(spark):
    d = spark.createDataFrame(DECAY, "age int, n int, w double")
    made = F.timestamp_micros(F.unix_micros(F.lit("2025-01-01").cast("timestamp")) - F.col("age") * F.lit(86_400_000_000))
    for r in d.withColumn("g", scoring.decay_weight(made, F.col("n"), F.lit("2025-01-01").cast("timestamp"))).collect():
        assert abs(r.g - r.w) < 1e-6, r


GOLDEN = [
    ('When encountering "Error: Build failed", always apply this fix: Command failed: npm run build — Error: Build failed. Ensure you use the correct approach to avoid re-running into the same error.', "Pitfall", 36.886),
    ("In typescript: Added import: import path from 'path'; in a.ts. Apply and use this correctly to ensure good results.", "Knowledge", 34.997),
    ("In typescript: Added error handling in handler.ts. Apply and use this correctly to ensure good results.", "Knowledge", 23.835),
    ("In json: Modified config: tsconfig.json. Apply and use this correctly to ensure good results.", "Knowledge", 23.882),
    ("Always run `npm run build` to npm run build. Use this command when you need to execute this operation.", "Preference", 34.741),
    ("Always run `npm install express` to npm install express. Use this command when you need to execute this operation.", "Preference", 34.979),
    ("Always run `docker build -t x .` to docker build -t x .. Use this command when you need to execute this operation.", "Preference", 23.456),
    ("Always create src/new-module.ts using this approach: Created file: new-module.ts (10 lines). Apply this approach consistently.", "Method", 24.111),
    ("Always use bun instead of npm", "Trick", 18.034),
    ("When you see ECONNRESET, retry with exponential backoff", "Knowledge", 5.0),
]


def test_patterns_of_several_words_want_their_blanks(spark):
    texts = ["Whenever it breaks thenceforth try it", "iffy lengthen", "A useful thing, it is nothing", "we use tabs not spaces", "When it breaks then try it"]
    assert column(spark, texts, "string", scoring.knowledge_type) == ["Knowledge", "Knowledge", "Knowledge", "Preference", "Knowledge"]
    assert [x > 5 for x in column(spark, texts, "string", scoring.instructivity)] == [False, False, False, True, True]


def test_classifier_golden_values(spark):
    d = spark.createDataFrame(GOLDEN, "c string, k string, s double").select("*", scoring.knowledge_type(F.col("c")).alias("kind"), scoring.instructivity(F.col("c")).alias("score"))
    for r in d.collect():
        assert (r.kind, round(r.score, 3)) == (r.k, r.s), r.c


def test_entities_and_code(spark):
    got = column(spark, ["MyClass uses `foo bar` and import 'x' from \"y\" require('z') MyClass"], "string", D.entities)
    assert got == [["MyClass", "foo bar", "x", "y", "z"]]


def test_secret_reasons_never_show_the_secret(spark):
    secret = "sk-abcdefghijklmnopqrstuvwxyz"
    (got,) = column(spark, [f"key={secret} ghp_{'a' * 36}"], "string", secrets.reasons)
    assert len(got) == 3 and not any(secret in g for g in got)


def test_answers_are_validated(spark):
    texts = ['```json\n{"should_record": true, "score": 120, "category": "Odd"}\n```', '{"should_record": false, "score": -3, "category": "Trick"}', '{"score": 3}', '{"should_record": true}', "nonsense", None]
    got = column(spark, texts, "string", D.parse_evaluation)
    assert [g and (g.record, g.score, g.type) for g in got] == [(True, 100.0, "Knowledge"), (False, 0.0, "Trick"), None, None, None, None]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab 数据é-", max_size=14), st.text(alphabet="ab数据", min_size=1, max_size=3)), min_size=1, max_size=20))
def test_occurrences_follow_ascii_boundaries(spark, pairs):
    import re

    d = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(pairs)], "i int, c string")
    for i, (content, token) in enumerate(pairs):
        want = len(re.findall(rf"\b{token}\b", content, re.ASCII | re.IGNORECASE))
        got = d.where(f"i = {i}").select(F.regexp_count("c", F.lit(T.occurrence_pattern(token)))).first()[0]
        assert got == want, (content, token)
        if i > 2:
            break


def test_header_tokens():
    head = f'<recall-log role="reference">\n{S.NOTICE}\n'
    assert -(-len(head.encode("utf-16-le")) // 8) == S.HEADER_TOKENS


def test_recency(spark):
    at = lambda d: datetime(2025, 1, d)
    rows = spark.createDataFrame([(None, at(1)), (at(20), at(1)), (at(1), at(25))], "l timestamp, c timestamp")
    got = [r[0] for r in rows.select(scoring.recency_boost(F.col("l"), F.col("c"), F.lit(at(26)).cast("timestamp"))).collect()]
    assert got == [1.0, 1.2, 1.2]


@pytest.mark.parametrize("text,want", [("true", True), ("3", 3), ("0.5", 0.5), ("abc", "abc")])
def test_settings_literals(text, want):
    from lorekeep import config

    assert config.literal(text) == want
    assert config.with_value(config.DEFAULTS, "search.max_results", "7")["search"]["max_results"] == 7
    with pytest.raises(KeyError):
        config.with_value(config.DEFAULTS, "search.nope", "1")
