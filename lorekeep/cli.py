"""Command line: python -m lorekeep.cli --store PATH VERB ..."""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from . import config
from .engine import Engine
from .operators import maintain as M
from .sources import exchange


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lorekeep")
    out.add_argument("--store", required=True, help="folder of the store")
    out.add_argument("--settings", help="JSON file with settings")
    out.add_argument("--as-of", help="time to work at, ISO 8601; now by default")
    verbs = out.add_subparsers(dest="verb", required=True)
    for name in ("status", "health", "clear", "decay"):
        verbs.add_parser(name)
    for name in ("search", "learn"):
        v = verbs.add_parser(name)
        v.add_argument("text")
    verbs.choices["search"].add_argument("--limit", type=int, default=10)
    verbs.choices["learn"].add_argument("--project", default="")
    v = verbs.add_parser("config")
    v.add_argument("path", nargs="?")
    v.add_argument("value", nargs="?")
    v = verbs.add_parser("conflicts")
    v.add_argument("--resolve")
    v.add_argument("--keep", choices=("keep_a", "keep_b", "keep_both"), default="keep_both")
    v = verbs.add_parser("export")
    v.add_argument("--format", choices=("json", "markdown"), default="json")
    v.add_argument("--scope")
    v.add_argument("--output")
    v = verbs.add_parser("import")
    v.add_argument("path")
    v = verbs.add_parser("projects")
    v.add_argument("scope", nargs="?")
    v = verbs.add_parser("promote")
    v.add_argument("project")
    v.add_argument("--id")
    v.add_argument("--min-score", type=float)
    v.add_argument("--all", action="store_true")
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """What a verb prints."""
    settings = config.load(args.settings) if args.settings else config.DEFAULTS
    now = datetime.fromisoformat(args.as_of) if args.as_of else datetime.now(timezone.utc).replace(tzinfo=None)
    table = lambda df: "\n".join(json.dumps(r.asDict(), default=str, ensure_ascii=False) for r in df.toLocalIterator())
    if args.verb == "config":
        if args.value is not None:
            settings = config.with_value(settings, args.path, args.value)
            if args.settings:
                Path(args.settings).write_text(json.dumps(settings, indent=2))
        found = settings
        for k in (args.path or "").split(".") if args.path else []:
            found = found[k]
        return json.dumps(found, indent=2)
    e = Engine(spark, args.store, settings)
    if args.verb in ("status", "health"):
        return json.dumps(getattr(e, args.verb)())
    if args.verb == "clear":
        e.clear()
    elif args.verb == "decay":
        return json.dumps(e.decay_update(now))
    elif args.verb == "search":
        return table(e.search(args.text, args.limit))
    elif args.verb == "learn":
        return json.dumps(e.learn(args.text, now, args.project))
    elif args.verb == "conflicts":
        if args.resolve:
            e.resolve(args.resolve, args.keep, now)
        return table(M.listing(e.conflicts_list(False), "id", "conflict_type", "description", "created_at"))
    elif args.verb == "export":
        scopes = [args.scope] if args.scope else None
        text = e.export_json(now.isoformat(), scopes) if args.format == "json" else e.export_markdown(now.date().isoformat(), scopes)
        if not args.output:
            return text
        exchange.save(spark, text, args.output)
    elif args.verb == "import":
        return json.dumps(e.import_json(args.path, now))
    elif args.verb == "projects":
        return table(M.listing(M.by_scope(e.store.bullets, args.scope)) if args.scope else e.projects())
    elif args.verb == "promote":
        scope = f"project:{args.project}"
        if args.id or args.min_score is not None or args.all:
            e.promote(now, scope=scope, id=args.id, min_score=args.min_score)
        return table(M.listing(M.by_scope(e.store.bullets, scope), "id", "content", "knowledge_type", "instructivity_score"))
    return ""


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("lorekeep").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(run(spark, args))


if __name__ == "__main__":
    main()
