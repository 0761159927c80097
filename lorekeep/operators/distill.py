"""From queued candidates to clean, typed, scored records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import scoring, secrets
from ..functions import text as T

# Names in camel case, in backticks, and imported; fenced code.
CAMEL_CASE = r"[A-Z][a-z]+(?:[A-Z][a-z]+)+"
QUOTED = r"`([^`]+)`"
IMPORTED = r"(?:import|from)\s+['\"]([^'\"]+)['\"]|require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
FENCED = r"(?s)```(?:[A-Za-z0-9_]+)?\n?(.*?)```"
MANUAL_FLOOR = 50


def entities(content: Column) -> Column:
    """CamelCase words, texts in backticks, then imported names; each once."""
    every = lambda p, g: F.regexp_extract_all(content, F.lit(p), F.lit(g))
    imported = F.zip_with(every(IMPORTED, 1), every(IMPORTED, 2), lambda a, b: F.when(a != "", a).otherwise(b))
    return F.array_distinct(F.concat(every(CAMEL_CASE, 0), every(QUOTED, 1), F.filter(imported, lambda x: x != "")))


def template(most: int = DEFAULTS["reflector"]["max_content_length"]) -> Column:
    """The sentence for a queue entry, cut to its greatest length."""
    of = lambda field, other: F.coalesce(F.nullif(F.col(f"context.{field}"), F.lit("")), other)
    summary = F.coalesce("summary", F.lit(""))
    # The sentences.
    text = (
        F.when(F.col("tool_name") == "manual", summary)
        .when(F.col("pattern_type") == "error_fix", F.concat(F.lit('When encountering "'), of("error_message", F.lit("an error")), F.lit('", always apply this fix: '), summary, F.lit(". Ensure you use the correct approach to avoid re-running into the same error.")))
        .when(F.col("pattern_type") == "code_pattern", F.concat(F.lit("In "), of("language", F.lit("coding")), F.lit(": "), summary, F.lit(". Apply and use this correctly to ensure good results.")))
        .when(F.col("pattern_type") == "command_usage", F.concat(F.lit("Always run `"), of("command", F.col("tool_name")), F.lit("` to "), F.regexp_replace(summary, r"^Executed:\s*", ""), F.lit(". Use this command when you need to execute this operation.")))
        .when(F.col("pattern_type") == "file_creation", F.concat(F.lit("Always create "), of("file", F.lit("file")), F.lit(" using this approach: "), summary, F.lit(". Apply this approach consistently.")))
        .otherwise(summary)
    )
    return F.substring(text, 1, most)


def scope_of(project: str) -> Column:
    """The project's scope if the file or summary points to it, else global."""
    file = F.coalesce("context.file", F.lit(""))
    own = (file != "") & (file.contains(project) | file.startswith(".") | file.startswith("src/"))
    return F.when(own | F.coalesce("summary", F.lit("")).contains(project), F.lit(f"project:{project}")).otherwise("global")


def code_of(most_lines: int = DEFAULTS["reflector"]["max_code_lines"]) -> Column:
    """The first fenced block of the summary, its first lines; null without one."""
    block = T.trimmed(F.regexp_extract("summary", FENCED, 1))
    return F.when(F.col("pattern_type").isin("code_pattern", "file_creation") & F.col("summary").rlike(FENCED), F.array_join(F.slice(F.split(block, "\n"), 1, most_lines), "\n"))


def distill(entries: DataFrame, project: str = "", settings: dict = DEFAULTS["reflector"], evaluate: Callable[[DataFrame], DataFrame] | None = None, refine: Callable[[DataFrame], DataFrame] | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records in the distilled layout, and the columns `keep` of the entries.

    Entries with a secret go, and those that score too low unless they were made by hand. The three optional
    steps take and return a DataFrame: evaluate may fill llm_type, llm_score and llm_record beside content;
    refine may replace distilled_rule of records whose score is above the setting; embed fills embedding. One pass without a shuffle.
    """
    project = project or "unknown"
    least = settings["min_quality_score"] * 100
    # A generator over the texts without secrets: the template stays in the plan once.
    own = entries.withColumn("_text", F.explode(F.filter(F.array(template(settings["max_content_length"])), lambda t: F.size(secrets.reasons(t)) == 0)))
    own = own.withColumn("content", secrets.anonymized(F.col("_text"))).withColumn("_score", scoring.instructivity(F.col("content")))
    kind, score, rejected = scoring.knowledge_type(F.col("content")), F.round("_score"), F.col("_score") < least
    if evaluate:
        own = evaluate(own)
        judged = F.col("llm_record").isNotNull()
        kind, score, rejected = F.when(judged, F.col("llm_type")).otherwise(kind), F.when(judged, F.col("llm_score")).otherwise(score), F.when(judged, ~F.col("llm_record")).otherwise(rejected)
    manual = F.col("tool_name") == "manual"
    own = own.withColumn("knowledge_type", kind).withColumn("_rejected", rejected)
    own = own.withColumn("instructivity_score", F.when(F.col("_rejected") & manual, F.greatest(score, F.lit(float(MANUAL_FLOOR)))).otherwise(score).cast("double")).where(~F.col("_rejected") | manual)
    file = F.nullif(F.col("context.file"), F.lit(""))
    empty = F.array().cast("array<string>")
    coded = F.col("pattern_type").isin("code_pattern", "file_creation")
    own = own.select(
        *keep, scope_of(project).alias("scope"), scoring.section_of(F.col("knowledge_type")).alias("section"), "content", F.col("content").alias("distilled_rule"),
        code_of(settings["max_code_lines"]).alias("code_content"), F.when(coded, F.coalesce(F.nullif(F.col("context.language"), F.lit("")), T.block_language_of(file))).alias("code_language"),
        "knowledge_type", "instructivity_score", F.lit("auto").alias("source_type"), F.array("tool_name").alias("related_tools"), F.when(file.isNotNull(), F.array(file)).otherwise(empty).alias("related_files"),
        entities(F.col("content")).alias("key_entities"), F.array_compact(F.array("pattern_type", F.nullif(F.col("context.language"), F.lit("")))).alias("tags"), F.lit(None).cast("array<float>").alias("embedding"),
    )
    if refine:
        high = F.col("instructivity_score") > settings["llm_min_score"]
        own = own.where(~high).unionByName(refine(own.where(high)))
    return embed(own) if embed else own


def parse_evaluation(answer: Column) -> Column:
    """(record, score, type, reason) from an evaluator's JSON answer, in a code fence or not; null if it has no flag or score. The score is cut to 0 to 100, an unknown type becomes Knowledge."""
    plain = F.regexp_replace(F.regexp_replace(T.trimmed(answer), r"^```(?:json)?\s*", ""), r"\s*```\z", "")
    got = F.from_json(plain, "should_record boolean, score double, category string, reason string")
    kinds = ("Method", "Trick", "Pitfall", "Preference", "Knowledge")
    return T.bound(
        got,
        lambda g: F.when(
            g["should_record"].isNotNull() & g["score"].isNotNull(),
            F.struct(g["should_record"].alias("record"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), g["score"])).alias("score"), F.when(g["category"].isin(*kinds), g["category"]).otherwise("Knowledge").alias("type"), F.coalesce(g["reason"], F.lit("")).alias("reason")),
        ),
    )
