"""Inputs for rules that the test tables seldom meet: stated texts dealt over the rows of the tables by arithmetic, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from . import fixtures
from .testviews import table

#: Records of one scope among the rivals, so that their pairs grow with the records.
RIVALS_IN_SCOPE = 26


def _dealt(values: list[str | None], number: Column) -> Column:
    """The value whose turn it is."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _dealt_sql(values: list[str | None], number: str) -> str:
    return "[" + ", ".join(fixtures._text(v) for v in values) + f"][{number} % {len(values)} + 1]"


def texts(spark: SparkSession, sf_dir: str, values: tuple[str, ...]) -> DataFrame:
    """(id, content): each document's whole text behind one of the stated ones."""
    own = table(spark, sf_dir, "documents", True)
    return own.select(F.col("doc_id").alias("id"), F.concat(_dealt(list(values), F.col("doc_id")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("content"))


def texts_sql(values: tuple[str, ...]) -> str:
    return f"(SELECT doc_id AS id, {_dealt_sql(list(values), 'doc_id')} || ' ' || coalesce(text, '') AS content FROM documents)"


_FIELDS = ("command", "file_path", "old_string", "new_string", "content")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool event for each document: the stated ones in turn. Commands get the document's source, new code its text, responses and every second written file a new line and its text."""
    rows = fixtures._EVENTS
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    of = {f: _dealt([(given or {}).get(f) for _, given, _ in rows], n) for f in _FIELDS}
    of["command"] = F.when(of["command"] == "", "").otherwise(F.concat(of["command"], F.lit(" "), F.coalesce("source", F.lit(""))))
    of["new_string"] = F.concat(of["new_string"], F.lit("\n"), text)
    of["content"] = F.when(n % 2 == 0, F.concat(of["content"], F.lit("\n"), text)).otherwise(of["content"])
    given = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f), c) for f, c in of.items()]), lambda x: x["col2"].isNotNull()))
    has = _dealt(["y" if g is not None else "n" for _, g, _ in rows], n) == "y"
    response = _dealt([r for _, _, r in rows], n)
    return table(spark, sf_dir, "documents", True).select(
        n.alias("id"), _dealt([t for t, _, _ in rows], n).alias("tool_name"), F.when(has, given).alias("tool_input"), F.concat(response, F.lit("\n"), text).alias("tool_response"), F.lit("s").alias("session_id"),
    )


def events_sql() -> str:
    """The same with the fields of the input as columns."""
    rows = fixtures._EVENTS
    of = {f: _dealt_sql([(given or {}).get(f) for _, given, _ in rows], "doc_id") for f in _FIELDS}
    text = "coalesce(text, '')"
    return f"""(SELECT doc_id AS id, {_dealt_sql([t for t, _, _ in rows], 'doc_id')} AS tool, {_dealt_sql(['y' if g is not None else 'n' for _, g, _ in rows], 'doc_id')} = 'y' AS given,
    coalesce(CASE WHEN {of['command']} = '' THEN '' ELSE {of['command']} || ' ' || coalesce(source, '') END, '') AS command, coalesce({of['file_path']}, '') AS path, coalesce({of['old_string']}, '') AS old, coalesce({of['new_string']} || chr(10) || {text}, '') AS new,
    coalesce(CASE WHEN doc_id % 2 = 0 THEN {of['content']} || chr(10) || {text} ELSE {of['content']} END, '') AS content, {_dealt_sql([r for _, _, r in rows], 'doc_id')} || chr(10) || {text} AS response FROM documents)"""


def rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each document: the stated rivals in turn, RIVALS_IN_SCOPE of them in a scope, with the whole text behind. Those that have a vector get one of the embeddings, the same for each run of as many as there are rivals."""
    rows, n = fixtures._RIVALS, F.col("doc_id")
    names = F.element_at(F.array(*[F.array(*[F.lit(e) for e in r[4]]).cast("array<string>") for r in rows]), (n % len(rows) + 1).cast("int"))
    placed = _dealt([None if r[5] is None else "y" for r in rows], n) == "y"
    docs = table(spark, sf_dir, "documents", True).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_vec"), F.col("embedding").alias("_e")), F.floor(n / len(rows)) == F.col("_vec"), "left")
    made = {
        "id": n.cast("string"), "scope": F.concat(F.lit("project:p"), F.floor(n / RIVALS_IN_SCOPE).cast("string")), "section": _dealt([r[2] for r in rows], n),
        "content": F.concat(_dealt([r[3] for r in rows], n), F.lit(" "), F.coalesce("text", F.lit(""))), "key_entities": names, "embedding": F.when(placed, F.col("_e")),
        "decay_weight": F.lit(1.0), "instructivity_score": F.lit(50.0), "recall_count": F.lit(3), "knowledge_type": F.lit("Knowledge"), "source_type": F.lit("auto"),
    }
    return docs.select(*[made.get(c, F.lit(None).cast(t)).alias(c) for c, t in (x.strip().split(" ", 1) for x in schemas.BULLETS.split(","))])


def rivals_sql() -> str:
    rows = fixtures._RIVALS
    lists = "[" + ", ".join("[" + ", ".join(fixtures._text(e) for e in r[4]) + "]::VARCHAR[]" for r in rows) + "]"
    return f"""(SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, 'project:p' || (doc_id // {RIVALS_IN_SCOPE}) AS scope, {_dealt_sql([r[2] for r in rows], 'doc_id')} AS section, {_dealt_sql([r[3] for r in rows], 'doc_id')} || ' ' || coalesce(text, '') AS content,
    {lists}[doc_id % {len(rows)} + 1] AS key_entities, CASE WHEN {_dealt_sql([None if r[5] is None else 'y' for r in rows], 'doc_id')} = 'y' THEN embedding END AS embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id // {len(rows)})"""
