"""Which tool events hold something worth learning: at most one candidate for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MOST_RESPONSE = 100_000
# Commands too common to learn from, commands worth it, and signs of errors.
TRIVIAL = ("ls", "dir", "cd", "cat", "echo", "pwd", "head", "tail", "wc", "which", "whoami", "date", "clear", "true", "false", "type")
NOTABLE = (
    r"(npm|npx|pnpm|yarn|bun)\s+(run|test|build|start|install|ci|publish|exec)(?![A-Za-z0-9_])",
    r"cargo\s+(build|test|run|bench|check|clippy|publish)(?![A-Za-z0-9_])",
    r"go\s+(build|test|run|vet|generate)(?![A-Za-z0-9_])",
    r"(python|python3|pip|pip3)\s",
    r"(docker|docker-compose|podman)\s",
    r"git\s+(push|pull|merge|rebase|cherry-pick|tag)(?![A-Za-z0-9_])",
    r"(make|cmake|msbuild)(?![A-Za-z0-9_])",
    r"(vitest|jest|mocha|pytest|cargo\s+test)(?![A-Za-z0-9_])",
    r"(tsc|tsup|esbuild|vite|webpack|rollup)(?![A-Za-z0-9_])",
    r"(deploy|migrate|seed|prisma|typeorm|knex)(?![A-Za-z0-9_])",
    r"(curl|wget|ssh|scp|rsync)(?![A-Za-z0-9_])",
)
# Signs of errors, as written.
ERROR_WORDS = (
    "error", "Error", "ERROR", "not found", "Not found", "cannot", "Cannot", "TypeError", "ReferenceError", "SyntaxError", "ENOENT", "EACCES", "EPERM", "fatal", "Fatal", "exception", "Exception",
)
ERROR = f"{T.words(*ERROR_WORDS)}|(?<!0 ){T.words('failed', 'Failed', 'FAILED')}|{T.BEFORE}(?:panic|PANIC)|TS[0-9]{{4}}"
# Signs of imports, error handling, settings and types in code.
IMPORT_LINE = r"(?m)^[+]?\s*(?:import\s+.+|const\s+[A-Za-z0-9_]+\s*=\s*require\(.+\)|from\s+['\"]).*"
# A boundary before a dot needs a word character on its left.
HANDLING = r"(?<![A-Za-z0-9_])(?:try\s*\{|catch\s*\(|if\s*\(\s*err)|(?<=[A-Za-z0-9_])(?:\.catch\s*\(|\.on\s*\(\s*['\"]error)"
CONFIG_PATH = r"(?i)\.(?:json|yaml|yml|toml|ini|env|config\.[A-Za-z0-9_]+)\z|config|settings|\.rc\z"
TYPE_DEFINITION = T.BEFORE + r"(?:interface|type|enum)\s+[A-Za-z0-9_]+"
CONTEXT = ("file", "language", "error_message", "command")


def is_error(text: Column) -> Column:
    return text.rlike(ERROR)


def error_line(text: Column, most: int = 200) -> Column:
    """The first trimmed line that looks like an error, else the first that isn't empty, else ''."""
    return T.bound(
        F.filter(F.transform(F.split(text, "\n"), T.trimmed), lambda x: x != ""),
        lambda lines: F.coalesce(F.substring(F.get(F.filter(lines, is_error), F.lit(0)), 1, most), F.substring(F.get(lines, F.lit(0)), 1, most), F.lit("")),
    )


def code_change(new: Column, old: Column, path: Column) -> Column:
    """What a change of code adds, in words; null for nothing of note."""
    name = T.basename(path)
    added = new.rlike(IMPORT_LINE) & ((old == "") | ~old.rlike(IMPORT_LINE))
    return (
        F.when(added, F.concat(F.lit("Added import: "), F.substring(T.trimmed(F.regexp_extract(new, IMPORT_LINE, 0)), 1, 120), F.lit(" in "), name))
        .when(new.rlike(HANDLING) & ~old.rlike(HANDLING), F.concat(F.lit("Added error handling in "), name))
        .when(path.rlike(CONFIG_PATH) & (F.length(new) > 10), F.concat(F.lit("Modified config: "), name))
        .when(new.rlike(TYPE_DEFINITION) & ~old.rlike(TYPE_DEFINITION), F.concat(F.lit("Added type definition: "), F.regexp_extract(new, TYPE_DEFINITION, 0), F.lit(" in "), name))
    )


def _context(**values: Column) -> Column:
    return F.struct(*[values.get(k, F.lit(None).cast("string")).alias(k) for k in CONTEXT])


def detect(events: DataFrame) -> DataFrame:
    """The events that give a candidate, with pattern_type, summary and context added.

    events: tool_name, tool_input (a map), tool_response and any other columns. One pass without a shuffle. A null input gives nothing; a null response counts as empty.
    """
    given = lambda k: F.coalesce(F.try_element_at(F.col("tool_input"), F.lit(k)), F.lit(""))
    command, path, new, old, content = (given(k) for k in ("command", "file_path", "new_string", "old_string", "content"))
    response = F.substring(F.coalesce("tool_response", F.lit("")), 1, MOST_RESPONSE)
    line = error_line(response)
    null = F.lit(None)
    make = lambda kind, summary, context: F.struct(F.lit(kind).alias("pattern_type"), summary.alias("summary"), context.alias("context"))
    failed = make("error_fix", F.concat(F.lit("Command failed: "), F.substring(command, 1, 100), F.lit(" — "), line), _context(command=F.substring(command, 1, 300), error_message=line))
    notable = F.reduce(F.array(*[command.rlike(T.BEFORE + "(?:" + p + ")") for p in NOTABLE]), F.lit(False), lambda a, x: a | x)
    ran = make("command_usage", F.concat(F.lit("Executed: "), F.substring(command, 1, 200)), _context(command=F.substring(command, 1, 300)))
    bash = F.when(command == "", null).when(is_error(response) & (line != ""), failed).when(~is_error(response) & ~T.base_command(command).isin(*TRIVIAL) & notable, ran)
    lines = F.size(F.split(content, "\n"))
    created = make("file_creation", F.concat(F.lit("Created file: "), T.basename(path), F.lit(" ("), lines.cast("string"), F.lit(" lines)")), _context(file=path, language=T.language_of(path)))
    pattern = lambda text: make("code_pattern", text, _context(file=path, language=T.language_of(path)))
    written, edited = code_change(content, F.lit(""), path), code_change(new, old, path)
    write = F.when((path == "") | (content == ""), null).when((lines > 5) | (F.length(content) > 100), created).when(written.isNotNull(), pattern(written))
    edit = F.when((path == "") | (new == ""), null).when(edited.isNotNull(), pattern(edited))
    found = F.when(F.col("tool_input").isNull(), null).when(F.col("tool_name") == "Bash", bash).when(F.col("tool_name") == "Write", write).when(F.col("tool_name") == "Edit", edit)
    # A generator instead of a filter: conditions that follow aren't pushed through it, so the rules above stay in the plan once.
    return events.withColumn("_found", F.explode(F.array_compact(F.array(found)))).select(*events.columns, "_found.pattern_type", "_found.summary", "_found.context")
