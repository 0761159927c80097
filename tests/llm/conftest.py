import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [
        (1, "one two three four five six seven", "en", "src1", 1), (1, "one two three four five six seven", "en", "src1", 1), (2, None, None, None, None), (3, "", "en", "src1", 0), (4, " \t\n ", "fr", "src0", 4),
        (5, "word " * 60000, "en", "src1", 0), (6, "x" * 300000, None, "src2", 0), (None, "a row without id a row without id", "en", "src1", 0), (7, "数据库 émile 😀 mail me@example.com +1 (555) 123-4567", "fr", "src3", 0),
        (8, "one two three four five six seven", "en", "src1", 1),
    ]
    d = spark.createDataFrame(rows, SCHEMA)
    for name in ("fp", "i", "t", "k0", "h", "root", "spans", "score", "n_tokens", "media", "ids", "component_id", "id", "x"):
        d = d.selectExpr("*", f"'clash' as {name}")
    return d


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
