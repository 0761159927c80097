import json
from datetime import datetime, timedelta

import pytest
from helpers import cosine, curated_in_order
from pyspark.sql import functions as F

from lorekeep import schemas
from lorekeep.engine import Engine
from lorekeep.operators import conflicts as C
from lorekeep.operators import curate as U
from lorekeep.operators import distill as D
from lorekeep.operators import maintain as M
from lorekeep.operators import nearest
from lorekeep.operators import search as S
from lorekeep.operators.detect import detect
from lorekeep.plans import fixtures
from lorekeep.sources import exchange, queue
from lorekeep.sources.store import Store
from lorekeep.streaming import queue as stream

NOW = datetime(2025, 1, 1)
AT = None


@pytest.fixture(autouse=True, scope="module")
def _at(spark):
    global AT
    AT = F.lit("2025-01-01").cast("timestamp")


def bullets(spark, *rows):
    base = {"scope": "global", "section": "techniques", "content": "Test content", "instructivity_score": 50.0, "knowledge_type": "Knowledge", "source_type": "auto", "recall_count": 0, "decay_weight": 1.0, "related_tools": [], "related_files": [], "key_entities": [], "tags": [], "created_at": NOW, "updated_at": NOW}
    return spark.createDataFrame([[(base | r).get(c) for c in schemas.names(schemas.BULLETS)] for r in rows], schemas.BULLETS)


def unit(k, n=4):
    return [float(i == k) for i in range(n)]


def test_detect(spark):
    got = {r.id: (r.pattern_type, r.summary) for r in detect(fixtures.events(spark)).collect()}
    assert got == {
        0: ("error_fix", "Command failed: npx tsc --noEmit — src/a.ts(1,2): error TS2339: Property 'x' does not exist"), 1: ("command_usage", "Executed: cargo test"), 3: ("error_fix", "Command failed: cat x — cannot open x"),
        5: ("command_usage", "Executed: npm run build"), 7: ("command_usage", "Executed: CI=1 /usr/bin/docker build -t x ."), 8: ("command_usage", "Executed: vitest run"),
        10: ("code_pattern", "Added import: import path from 'path'; in a.ts"), 11: ("code_pattern", "Added error handling in a.py"), 12: ("code_pattern", "Added error handling in handler.ts"), 13: ("code_pattern", "Modified config: tsconfig.json"),
        14: ("code_pattern", "Added type definition: interface User in models.ts"), 16: ("file_creation", "Created file: new-module.ts (10 lines)"), 17: ("file_creation", "Created file: b.rs (1 lines)"),
        19: ("code_pattern", "Added import: const x = require('x') in d.js"), 22: ("command_usage", "Executed: make all"),
    }


def entry(spark, *rows):
    return spark.createDataFrame([(str(i), r.get("tool", "Bash"), r.get("kind", "command_usage"), r["summary"], {k: r.get(k) for k in ("file", "language", "error_message", "command")}, False, "s") for i, r in enumerate(rows)], f"{schemas.QUEUE}, session_id string")


def test_distill(spark):
    own = entry(spark, {"tool": "manual", "kind": "manual", "summary": "Always use bun instead of npm"}, {"summary": "Executed: docker build -t x .", "command": "docker build -t x ."}, {"summary": "Executed: npm run build", "command": "npm run build"}, {"tool": "manual", "kind": "manual", "summary": "password=abcdefghijklmnopqrstuvwxyz"}, {"kind": "code_pattern", "tool": "Edit", "summary": "Added import: import path from 'path'; in a.ts", "file": "myapp/a.ts", "language": "typescript"})
    got = {r.timestamp: r for r in D.distill(own, "myapp", keep=("timestamp",)).collect()}
    assert set(got) == {"0", "2", "4"}
    assert (got["0"].knowledge_type, got["0"].instructivity_score, got["0"].scope) == ("Trick", 50.0, "global")
    assert (got["2"].instructivity_score, got["2"].section) == (35.0, "preferences")
    assert (got["4"].scope, got["4"].tags, got["4"].related_files, got["4"].code_language) == ("project:myapp", ["code_pattern", "typescript"], ["myapp/a.ts"], "typescript")
    assert got["4"].source_type == "auto" and got["4"].distilled_rule == got["4"].content


def test_hooks_of_distill(spark):
    own = entry(spark, {"summary": "Executed: docker build -t x .", "command": "docker build -t x ."})
    judged = D.distill(own, "p", evaluate=lambda d: d.withColumns({"llm_record": F.lit(True), "llm_type": F.lit("Method"), "llm_score": F.lit(90.0)}), refine=lambda d: d.withColumn("distilled_rule", F.lit("refined")), embed=lambda d: d.withColumn("embedding", F.array(F.lit(1.0).cast("float")))).first()
    assert (judged.section, judged.instructivity_score, judged.distilled_rule, judged.embedding) == ("methods", 90.0, "refined", [1.0])


def test_curate_in_order(spark):
    own = bullets(spark, {"id": "a", "content": "Short", "embedding": unit(0), "recall_count": 10, "tags": ["x"]}, {"id": "b", "content": "same text"})
    make = lambda i, t, v, score=60.0: (i, "global", "knowledge", t, t, None, None, "Knowledge", score, "auto", ["Bash"], [], [], ["y"], v)
    batch = spark.createDataFrame([make(0, "Longer content", unit(0)), make(1, "same text", None), make(2, " ", None), make(3, "new one", unit(1)), make(4, "new one again", unit(1)), make(5, "tail", [0.0] * 4)], f"seq int, {schemas.DISTILLED}")
    after, outcome = U.curate(own, batch, NOW)
    assert [r.outcome for r in outcome.orderBy("seq").collect()] == ["merged", "merged", "skipped", "added", "merged", "added"]
    got = {r.id: r for r in after.collect()}
    assert len(got) == 4 and (got["a"].content, got["a"].instructivity_score, got["a"].recall_count, got["a"].tags) == ("Longer content", 60.0, 10, ["x", "y"])
    exact, outcome = U.curate_exact(own, batch, AT)
    assert [r.outcome for r in outcome.orderBy("seq").collect()] == ["added", "merged", "skipped", "added", "added", "added"]
    assert exact.count() == 6


def test_curate_equals_a_scan_of_everything(spark):
    import random

    random.seed(4)
    vec = lambda: [random.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]
    own = bullets(spark, *({"id": f"r{i:02}", "content": f"c{i % 9}", "embedding": vec() if i % 4 else None, "decay_weight": (i % 5) / 5} for i in range(30)))
    rows = [(i, "global", "knowledge", f"c{i % 13}" * (1 + i % 3), "", None, None, "Knowledge", float(i), "auto", [], [], [], [], vec() if i % 3 else None) for i in range(25)]
    batch = spark.createDataFrame(rows, f"seq int, {schemas.DISTILLED}")
    after, outcome = U.curate(own, batch, NOW)
    known = {r.id: r.asDict() for r in own.orderBy("id").collect()}
    state, want = curated_in_order(list(known.values()), [r.asDict() for r in batch.orderBy("seq").collect()])
    assert [r.outcome for r in outcome.orderBy("seq").collect()] == want
    got = {r.id: (r.content, r.instructivity_score, r.embedding) for r in after.collect()}
    shown = lambda r: (r["content"], r["instructivity_score"], r["embedding"])
    assert {i: x for i, x in got.items() if i in known} == {i: shown(r) for i, r in state.items() if i in known}
    assert sorted(map(repr, got.values())) == sorted(repr(shown(r)) for r in state.values())


def test_conflicts(spark):
    got = {(r.bullet_id_a, r.bullet_id_b): r.conflict_type for r in C.all_conflicts(fixtures.rivals(spark), AT).collect()}
    assert got == {("a1", "a2"): "semantic", ("b1", "b2"): "negation", ("c1", "c2"): "negation", ("d1", "d2"): "negation", ("e1", "e2"): "version", ("e1", "e3"): "version", ("e2", "e3"): "version"}
    one = C.detect_conflicts(fixtures.rivals(spark).where("id = 'a2'"), fixtures.rivals(spark), AT).collect()
    assert [(r.bullet_id_a, r.bullet_id_b) for r in one] == [("a2", "a1")]


def test_records_of_one_side_never_meet(spark):
    many = spark.range(100_000).select(F.col("id").cast("string").alias("id"), F.lit("global").alias("scope"), F.lit("techniques").alias("section"), F.lit("use node 18").alias("content"), F.array(F.lit("Node")).alias("key_entities"), F.array(F.lit(1.0)).alias("embedding"))
    assert C.all_conflicts(many, AT).count() == 0
    other = many.limit(1).withColumn("id", F.lit("x")).withColumn("content", F.lit("avoid node 20"))
    assert C.detect_conflicts(other, many, AT).count() == 100_000


def test_exact_merge_keeps_adds_and_ranks(spark):
    own = bullets(spark, {"id": "a", "content": "t", "decay_weight": 0.5}, {"id": "b", "content": "t", "decay_weight": 0.9}, {"id": "c", "content": "t", "decay_weight": 0.9}, {"id": "d", "content": "other", "tags": ["k"]}, {"id": "e", "content": None})
    make = lambda i, t, tag: (i, "global", "knowledge", t, t, None, None, "Knowledge", 70.0 + i, "auto", [], [], [], [tag], None)
    batch = spark.createDataFrame([make(0, "t", "x"), make(1, "n", "y"), make(2, "n", "z"), make(3, None, "q")], f"seq int, {schemas.DISTILLED}")
    after, outcome = U.curate_exact(own, batch, AT)
    got = {r.id: r for r in after.collect()}
    assert {i: r.tags for i, r in got.items() if i in "abcde"} == {"a": got["a"].tags, "b": got["b"].tags, "c": got["c"].tags, "d": ["k"], "e": got["e"].tags}
    assert "x" in got["b"].tags and "x" not in got["a"].tags + got["c"].tags and got["b"].instructivity_score == 70.0
    new = [r for i, r in got.items() if i not in "abcde"]
    assert [(r.content, r.instructivity_score, r.tags, r.recall_count) for r in new] == [("n", 72.0, ["y", "z"], 0)]
    assert [r.outcome for r in outcome.orderBy("seq").collect()] == ["merged", "added", "merged", "skipped"]
    again, outcome = U.curate_exact(after, batch, AT)
    assert again.count() == 6 and [r.outcome for r in outcome.orderBy("seq").collect()] == ["merged", "merged", "merged", "skipped"]
    empty, _ = U.curate_exact(own.limit(0), batch, AT)
    assert empty.count() == 2 and U.curate_exact(own, batch.limit(0), AT)[0].count() == 5


def test_a_queue_is_one_commit(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "b"))
    own = entry(spark, *({"summary": f"Executed: npm run build{i % 3}", "command": f"npm run build{i % 3}"} for i in range(5)))
    assert e.curate(own, NOW) == {"added": 3, "merged": 2, "skipped": 0}
    assert e.stats()["total"] == 3 and e.store.state()["version"] == 2
    assert e.curate(own.limit(0), NOW) == {"added": 0, "merged": 0, "skipped": 0}


def test_archive_promote_resolve(spark):
    own = bullets(spark, {"id": "a", "scope": "project:p", "instructivity_score": 90.0}, {"id": "b", "scope": "project:p", "instructivity_score": 10.0})
    none = spark.createDataFrame([], schemas.ARCHIVE)
    clash = spark.createDataFrame([("c", "a", "b", "version", "", 0, None, NOW)], schemas.CONFLICTS)
    for keep, left in (("keep_a", {"a"}), ("keep_b", {"b"}), ("keep_both", {"a", "b"})):
        after, archive, settled = M.settle(own, none, clash, "c", keep, AT)
        assert {r.id for r in after.collect()} == left and {r.id for r in archive.collect()} == {"a", "b"} - left
        assert settled.first().resolved == 1 and settled.first().resolved_at == NOW
    assert {r.id: r.scope for r in M.promoted(own, AT, "project:p", min_score=50).collect()} == {"a": "global", "b": "project:p"}
    with pytest.raises(ValueError):
        M.inserted(own, own.limit(1))
    assert M.updated(own, spark.createDataFrame([("a", None)], "id string, content string")).where("content is null").count() == 1
    assert M.with_conflicts(clash, clash.withColumn("description", F.lit("new"))).first().description == ""


def test_decay_archives_and_updates(spark):
    days = lambda n: NOW - timedelta(days=n)
    own = bullets(spark, {"id": "fresh"}, {"id": "permanent", "recall_count": 20, "created_at": days(500)}, {"id": "decaying", "created_at": days(40)}, {"id": "ancient", "created_at": days(300)})
    marks = {r.id: (r.is_update, r.is_faded) for r in M.aged(own, AT).collect()}
    assert marks == {"fresh": (False, False), "permanent": (False, False), "decaying": (True, False), "ancient": (True, True)}
    after, archive = M.decay_update(own, spark.createDataFrame([], schemas.ARCHIVE), AT)
    assert after.count() == 3 and archive.first().id == "ancient" and archive.first().decay_weight < 0.02


def test_search_and_budget(spark):
    own = bullets(spark, {"id": "k", "content": "pnpm installs things"}, {"id": "v", "content": "unrelated", "embedding": unit(0)}, {"id": "p", "scope": "project:other", "content": "pnpm"}, {"id": "z", "content": "数据库连接池"})
    got = S.recall(own, S.Query("pnpm install", None, tuple(unit(0))), AT, limit=10).collect()
    assert [r.id for r in got] == ["k", "v"] and got[0].keyword_score == 25.0
    assert S.keyword_search(own, "数据库").first().id == "z"
    assert S.keyword_search(own, "  ").count() == 0
    assert S.nearest(own, tuple(unit(0)), 3).first().id == "v"
    ranked = own.withColumn("rank", F.row_number().over(S.Window.partitionBy(F.lit(0)).orderBy("id")))
    assert S.within_budget(ranked, 36).count() == 1
    assert S.format_context(ranked, 2000).count("\n---\n") == 4


def test_nearest_of_each_in_blocks(spark, monkeypatch):
    own = bullets(spark, *({"id": f"v{i:02}", "embedding": [float(i % 7), 1.0, float(i % 3), 0.5] if i != 9 else None} for i in range(40)))
    rows = {r.id: r.embedding for r in own.collect() if r.embedding is not None}
    want = {i: min((round(-cosine(v, w), 9), j) for j, w in rows.items() if i != j) for i, v in rows.items()}
    for block in (5, 4096):
        monkeypatch.setattr(nearest, "BLOCK", block)
        got = S.nearest_of_each(own, own)
        assert {r.id: (round(-r.similarity, 9), r.best_id) for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert S.nearest_of_each(own.limit(0), own).count() == 0


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [("a", "2025-01-01 00:00:00"), ("a", "2025-01-01 00:04:00"), ("a", "2025-01-01 00:20:00"), ("b", "2025-01-01 00:00:00"), ("z", "2025-01-02 00:00:00")]
    own = spark.createDataFrame(rows, "session_id string, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    assert sorted((r.session_id, r.n) for r in stream.sessions(own).collect()) == [("a", 1), ("a", 2), ("b", 1), ("z", 1)]
    own.write.parquet(str(tmp_path / "e"))
    got = []
    live = stream.sessions(spark.readStream.schema(own.schema).parquet(str(tmp_path / "e")).withWatermark("timestamp", "1 minute"))
    live.writeStream.foreachBatch(lambda d, n: got.extend(d.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    # The newest session stays open.
    assert sorted((r.session_id, r.n) for r in got) == [("a", 1), ("a", 2), ("b", 1)]


def test_plans_have_no_surprises(spark, small):
    from lorekeep.plans import queries

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    own = plan(queries.recall_keyword_topk(spark, small))
    # One count for each of the query's six words: the filter on the score doesn't compute it again.
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    logical = queries.recall_keyword_topk(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert logical.count("regexp_extract_all(") == 6
    assert "TakeOrderedAndProject" in own and "CartesianProduct" not in own and "Python" not in own
    assert "PushedFilters" in plan(M.by_scope(spark.read.schema(schemas.BULLETS).parquet(f"{small}/documents.parquet").select("scope", "instructivity_score", "id"), "global"))
    assert "CartesianProduct" not in plan(queries.conflicts_version(spark, small)) and "NestedLoop" not in plan(queries.conflicts_version(spark, small))


def test_store_export_import(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    own = bullets(spark, {"id": "a", "content": "one | two", "tags": ["t"]}, {"id": "b", "section": "pitfalls", "instructivity_score": 12.5, "code_content": "x\ny"})
    first = store.commit({"bullets": own})
    assert store.bullets.count() == 2 and store.archive.count() == 0
    store.commit({"bullets": store.bullets.where("id = 'a'")})
    assert store.bullets.count() == 1 and first == store.state()["version"] - 1
    before = store.bullets.collect()
    assert store.vacuum(1) == 2 and store.vacuum(1) == 0 and store.bullets.collect() == before
    with pytest.raises(ValueError):
        store.vacuum(0)
    text = exchange.export_json(own, "2025-01-01T00:00:00.000Z", "p")
    got = json.loads(text)
    assert (got["export_version"], got["bullet_count"], "embedding" in got["bullets"][0]) == (1, 2, False)
    (tmp_path / "e.json").write_text(text)
    back = exchange.import_json(spark, str(tmp_path / "e.json"))
    assert {(r.seq, r.content, r.source_type) for r in back.collect()} == {(0, "one | two", "imported"), (1, "Test content", "imported")}
    for bad in ("[]x", '{"bullets": []}', '{"export_version": 1}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            exchange.import_json(spark, str(tmp_path / "bad.json"))
    shown = exchange.export_markdown(own, "2025-01-01", "p")
    assert "## Techniques\n- **[Knowledge]** one \\| two (score: 50, recalled 0x)" in shown and "  > `x y`" in shown and "score: 12.5" in shown


def test_engine_end_to_end(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    own = entry(spark, {"summary": "Executed: npm run build", "command": "npm run build"}, {"summary": "Executed: npm run build", "command": "npm run build"}, {"summary": "sk-" + "a" * 30, "kind": "other"})
    assert e.curate(own, NOW) == {"added": 1, "merged": 1, "skipped": 1}
    assert e.stats()["total"] == 1
    assert e.recall("npm build", NOW)[0]["recall_count"] == 0
    assert e.store.bullets.first().recall_count == 1
    assert "npm run build" in e.context("npm build", NOW)
    e.export_files(str(tmp_path / "json"), "2025-01-01T00:00:00.000Z")
    e.export_files(str(tmp_path / "md"), "2025-01-01", markdown=True)
    other = Engine(spark, str(tmp_path / "other"))
    assert other.import_json(str(tmp_path / "json"), NOW) == {"added": 1, "merged": 0, "skipped": 0} and other.import_json(str(tmp_path / "json"), NOW) == {"added": 0, "merged": 1, "skipped": 0}
    assert "".join(f.read_text() for f in sorted((tmp_path / "md").glob("part-*"))).rstrip("\n") == e.export_markdown("2025-01-01").rstrip("\n")
    assert e.decay_update(NOW + timedelta(days=400)) == {"updated": 1, "archived": 1}
    assert e.recall("npm build", NOW) == []


def test_queue_and_stream(spark, tmp_path):
    path = str(tmp_path / "q")
    assert queue.read(spark, path).count() == 0
    rows = [(f"{i:02}", "Bash", "command_usage", f"Executed: {i}", {"file": None, "language": None, "error_message": None, "command": "x"}, False, "s1" if i < 4 else "s2") for i in range(5)]
    queue.append(spark.createDataFrame(rows, f"{schemas.QUEUE}, session_id string"), path)
    own = queue.read(spark, path)
    assert queue.unprocessed(queue.marked(own, own.where("timestamp < '02'").select("timestamp"))).count() == 3
    got = []
    run = lambda: stream.run_curate(stream.gathered(stream.entry_stream(spark, path)), lambda d, n: got.extend(d.collect()), str(tmp_path / "c")).awaitTermination()
    run()
    assert {r.session_id for r in got} == {"s1"} and len(got) == 4 and len({r.batch_id for r in got}) == 1
    queue.append(spark.createDataFrame([("99", "x", stream.END, "", None, False, "s2")], f"{schemas.QUEUE}, session_id string"), path)
    run()
    assert [r.session_id for r in got].count("s2") == 1
    queue.cleanup(spark, path, "s1")
    assert queue.read(spark, path).where("session_id = 's1'").count() == 0
    many = spark.createDataFrame([("s", i) for i in range(45)], "session_id string, timestamp int")
    assert sorted(r["count"] for r in queue.batches(many).groupBy("batch").count().collect()) == [5, 20, 20]


def test_documents_of_any_size(spark, tmp_path):
    """Numbered lines are those of the driver's documents; a document of many splits comes back in order."""
    rows = [{"id": f"{i:03}", "section": ("pitfalls", "knowledge", "methods")[i % 3], "decay_weight": (i * 7 % 10) / 10, "content": f"one | two {i}\nand \"three\"\n    }},\n    {{\n", "code_content": "x\ny" if i % 4 else None, "tags": ["t"]} for i in range(60)]
    own = bullets(spark, *rows)
    for project in (None, "p"):
        got = exchange.markdown_rows(own.repartition(5), "2025-01-01", project).orderBy("n").collect()
        assert [r.n for r in got] == list(range(len(got))) and "\n".join(r.line for r in got) == exchange.export_markdown(own, "2025-01-01", project)
    assert [r.line for r in exchange.markdown_rows(own.limit(0), "2025-01-01").orderBy("n").collect()] == exchange.export_markdown(own.limit(0), "2025-01-01").split("\n")
    lines, pretty = str(tmp_path / "lines"), str(tmp_path / "pretty.json")
    exchange.write_lines(exchange.json_rows(own.repartition(7), "2025-01-01T00:00:00.000Z", "p"), lines)
    text = "".join(f.read_text() for f in sorted((tmp_path / "lines").glob("part-*")))
    assert json.loads(text) == json.loads(exchange.export_json(own, "2025-01-01T00:00:00.000Z", "p"))
    exchange.save(spark, exchange.export_json(own, "2025-01-01T00:00:00.000Z", "p"), pretty)
    whole = tmp_path / "compact.json"
    whole.write_text(json.dumps(json.loads(text)))
    assert exchange.import_split(spark, str(whole)) is None
    shown = lambda d: sorted((r.seq, r.content, r.section, r.instructivity_score, r.tags, r.code_content) for r in d.collect())
    want = shown(exchange.import_json(spark, str(whole)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for path in (lines, pretty):
            assert exchange.import_split(spark, path) is not None and shown(exchange.import_json(spark, path)) == want
        assert spark.read.option("lineSep", exchange._BETWEEN).text(pretty).rdd.getNumPartitions() >= 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for bare in ([], [bullets(spark, {"id": "x"})]):
        d = bare[0] if bare else own.limit(0)
        exchange.save(spark, exchange.export_json(d, "t"), str(tmp_path / "few.json"))
        assert exchange.import_json(spark, str(tmp_path / "few.json")).count() == len(bare)


def test_semantic_pairs_are_few(spark, monkeypatch):
    """Opposite sides meet in cells: with vectors in clusters most pairs are never multiplied."""
    import numpy as np

    monkeypatch.setattr(nearest, "IN_CELL", 30)
    r = np.random.default_rng(3)
    centers = r.normal(size=(12, 16))
    vector = lambda i: [float(x) for x in centers[i % 12] + 0.05 * r.normal(size=16)]
    own = bullets(spark, *({"id": f"r{i:03}", "content": ("Always x", "Never x")[i % 2] + f" {i}", "embedding": vector(i // 2)} for i in range(600))).persist()
    rows = {x.id: (x.content[:5], x.embedding) for x in own.collect()}
    want = {(a, b) for a, x in rows.items() for b, y in rows.items() if a < b and x[0] != y[0] and cosine(x[1], y[1]) >= 0.75}
    got = C.all_conflicts(own, AT).where("conflict_type = 'semantic'")
    assert {(x.bullet_id_a, x.bullet_id_b) for x in got.collect()} == want and want
    sides = C._sides(own)
    ends = C.semantic_ends(own, own, sides, sides)
    compared = nearest.pairs_compared(*ends, ("scope", "key", "meets"), 0.75)
    assert 2 * len(want) <= compared < 2 * 300 * 300 / 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stated_rows(spark):
    """The inline rows that the queries deal over the tables, by themselves."""
    from lorekeep.functions import scoring, secrets
    from lorekeep.functions import text as T

    assert [r.g for r in fixtures.frame(spark, fixtures.CJK).orderBy("id").select(F.array_join(T.cjk_ngrams(F.col("content"), 2), ",").alias("g")).collect()] == ["数据,据库", "数据,据库", "", "", "数据,据库,库连,连接,接池"]
    kinds = [r.k for r in fixtures.frame(spark, fixtures.SENTENCES).orderBy("id").select(scoring.knowledge_type(F.col("content")).alias("k")).collect()]
    assert kinds == ["Pitfall", "Method", "Trick", "Preference", "Knowledge", "Knowledge", "Knowledge", "Preference", "Preference", "Knowledge"]
    assert [r.n for r in fixtures.frame(spark, fixtures.SECRETS).orderBy("id").select(F.size(secrets.reasons(F.col("content"))).alias("n")).collect()] == [2, 3, 1, 1, 0, 1, 0, 0]
    found = {r.id: r.pattern_type for r in detect(fixtures.events(spark)).collect()}
    assert found == {0: "error_fix", 3: "error_fix", 5: "command_usage", 7: "command_usage", 8: "command_usage", 10: "code_pattern", 11: "code_pattern", 12: "code_pattern", 13: "code_pattern", 14: "code_pattern", 16: "file_creation", 17: "file_creation", 19: "code_pattern", 22: "command_usage", **{k: v for k, v in found.items() if k in (1, 6)}}


def test_small_commits_write_their_buckets(spark, tmp_path):
    """Five raised counters write five folders at most, whatever the store holds; old folders go with their last snapshot."""
    path = str(tmp_path / "s")
    store = Store(spark, path, 16)
    own = bullets(spark, *({"id": f"r{i:03}", "content": f"c {i}", "scope": ("global", "project:p")[i % 2], "decay_weight": 1.0} for i in range(400)))
    store.commit({"bullets": own})
    files = lambda: {f for f in (tmp_path / "s" / "data").rglob("*.parquet")}
    assert len(files()) == 16 and store.bullets.count() == 400
    state = {r.id: r.recall_count for r in store.bullets.collect()}
    for k in range(12):
        before = files()
        ids = [f"r{(k * 37 + j * 11) % 400:03}" for j in range(5)]
        hit = store.bullets.where(F.col("id").isin(ids))
        store.commit({}, upserts={"bullets": M.recalled(hit, hit.select("id"), AT)})
        assert 1 <= len(files() - before) <= 5
        state |= {i: state[i] + 1 for i in ids}
    assert {r.id: r.recall_count for r in store.bullets.collect()} == state
    gone = spark.createDataFrame([("r000",), ("r001",), ("nowhere",)], "id string")
    store.commit({}, upserts={"bullets": own.limit(1).withColumn("id", F.lit("new"))}, deletes={"bullets": gone})
    assert {r.id for r in store.bullets.collect()} == set(state) - {"r000", "r001"} | {"new"}
    rows = sorted(map(repr, store.bullets.collect()))
    assert len(files()) > 16 and store.vacuum(1) > 0 and len(files()) == 16 and sorted(map(repr, store.bullets.collect())) == rows
    # All rows of a bucket, then of all, may go; an id list without rows changes nothing.
    store.commit({}, deletes={"bullets": store.bullets.select("id")})
    assert store.bullets.count() == 0
    store.commit({}, upserts={"bullets": own.limit(0)})
    assert store.bullets.count() == 0 and Store(spark, path).state()["buckets"] == 16


def test_a_store_of_the_first_layout(spark, tmp_path):
    own = bullets(spark, {"id": "a"}, {"id": "b"})
    own.write.partitionBy("scope").parquet(str(tmp_path / "s" / "data" / "bullets-1-x"))
    (tmp_path / "s" / "pointers").mkdir()
    (tmp_path / "s" / "pointers" / "1").write_text(json.dumps({"version": 1, "layout": 1, "tables": {"bullets": "data/bullets-1-x"}}))
    store = Store(spark, str(tmp_path / "s"), 4)
    assert store.bullets.count() == 2
    store.commit({}, upserts={"bullets": own.where("id = 'b'").withColumn("content", F.lit("changed"))})
    assert {r.id: r.content for r in store.bullets.collect()} == {"a": own.first().content, "b": "changed"} and store.vacuum(1) == 1
    assert store.bullets.count() == 2


def _entries(spark, path, rows):
    queue.append(spark.createDataFrame([(t, "Bash", k, f"Executed: npm run {x}", {"file": None, "language": None, "error_message": None, "command": f"npm run {x}"}, False, s) for t, k, x, s in rows], f"{schemas.QUEUE}, session_id string").coalesce(1), path)


def test_idle_sessions_hand_over(spark, tmp_path):
    """Event time decides: a session's few entries go once the stream is five minutes beyond them, and no state is left."""
    path, got = str(tmp_path / "q"), []

    def play(rows):
        _entries(spark, path, rows)
        batches = stream.gathered(stream.entry_stream(spark, path), idle="5 minutes")
        q = stream.run_curate(batches, lambda d, n: got.extend(d.collect()), str(tmp_path / "c"))
        q.awaitTermination()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    at = lambda m: f"2025-01-01 00:{m:02}:00"
    kind = "command_usage"
    play([(at(0), kind, "a", "few"), (at(1), kind, "b", "few"), (at(1), kind, "c", "slow"), *((at(2), kind, f"m{i}", "many") for i in range(4))])
    assert {r.session_id for r in got} == {"many"} and len({r.batch_id for r in got}) == 1
    # Ten minutes later in another session: both idle ones hand over.
    play([(at(12), kind, "d", "other")])
    assert sorted((r.session_id, r.summary[-1]) for r in got if r.session_id != "many") == [("few", "a"), ("few", "b"), ("slow", "c")]
    assert {r.batch_id for r in got if r.session_id == "few"} == {f"few-{at(0)}-0"}
    # A session that comes back begins anew; the end row of another pushes the time.
    left = play([(at(13), kind, "e", "few"), (at(59), stream.END, "", "clock")])
    assert ("few", f"few-{at(13)}-0") in {(r.session_id, r.batch_id) for r in got} and ("other", "d") in {(r.session_id, r.summary[-1]) for r in got}
    assert left == 0 and len(got) == 9


def test_a_batch_is_taken_once(spark, tmp_path):
    """A batch that comes again changes nothing, and one that fails is passed over."""
    path, e = str(tmp_path / "q"), Engine(spark, str(tmp_path / "e"))
    at = lambda m: f"2025-01-01 00:{m:02}:00"
    _entries(spark, path, [(at(i), "command_usage", f"build{i}", "s") for i in range(3)])
    seen = []

    def curate(d, n):
        # Handed over twice, as after a stop behind the commit and before the checkpoint.
        seen.extend(e.curate(d, NOW, stream=("main", n)) for _ in range(2))

    stream.run_curate(stream.gathered(stream.entry_stream(spark, path)), curate, str(tmp_path / "c")).awaitTermination()
    assert seen == [{"added": 3, "merged": 0, "skipped": 0}, {"added": 0, "merged": 0, "skipped": 0}]
    assert e.stats()["total"] == 3 and e.store.state()["streams"] == {"main": 0} and e.curate(entry(spark, {"summary": "Executed: npm run build9", "command": "npm run build9"}), NOW, stream=("other", 0)) == {"added": 1, "merged": 0, "skipped": 0}
    _entries(spark, path, [(at(9), "command_usage", f"late{i}", "t") for i in range(3)])
    wrong = []

    def broken(d, n):
        raise ValueError("no")

    stream.run_curate(stream.gathered(stream.entry_stream(spark, path)), broken, str(tmp_path / "c"), failed=lambda d, n, x: wrong.append((n, d.count(), str(x)))).awaitTermination()
    assert wrong == [(1, 3, "no")] and e.stats()["total"] == 4
