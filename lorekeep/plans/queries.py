"""Named queries over whole tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scoring, secrets, vectors
from ..functions import text as T
from ..operators import conflicts as C
from ..operators import curate as U
from ..operators import distill as D
from ..operators import maintain as M
from ..operators import search as S
from ..operators.nearest import VectorIndex
from ..operators.postings import InvertedIndex, recall_joined
from ..operators.detect import detect
from ..shared import parted, written
from ..sources import exchange, queue
from ..streaming.queue import sessions
from . import fixtures, made
from .testviews import as_of, bullets, scratch, table

TEXT = "rewh orre thatin fr src3 lang"
TEXTS = (("rewh orre thatin fr src3 lang", "src5"), ("de ciónosta running oninning", "src7"), ("lang en", None))
PROJECT = "src5"


def _r(c, name: str):
    return F.round(c, 6).alias(name)


def _us(c: str):
    """Microseconds; 0 for null, as a whole number that may be null has no plain type in pandas."""
    return F.coalesce(F.unix_micros(c), F.lit(0).cast("long"))


def _vector(spark: SparkSession, sf_dir: str) -> tuple[float, ...]:
    """The stated query vector: that of the smallest id."""
    return tuple(table(spark, sf_dir, "embeddings").orderBy("vec_id").first().embedding)


def recall_keyword_topk(spark, sf_dir):
    return S.keyword_search(S.visible(bullets(spark, sf_dir, spread=True), ["global", f"project:{PROJECT}"]), TEXT, 10).select("id", "scope", _r("score", "score"))


def recall_hybrid_topk(spark, sf_dir):
    found = S.recall(bullets(spark, sf_dir, True, True), S.Query(TEXT, PROJECT, _vector(spark, sf_dir)), as_of(), limit=10)
    return found.select("id", "scope", _r("keyword_score", "keyword_score"), _r("semantic_score", "semantic_score"), _r("final_score", "final_score"))


def recall_multi_query(spark, sf_dir):
    found = S.recall_many(bullets(spark, sf_dir, spread=True), [S.Query(t, p) for t, p in TEXTS], as_of(), limit=5)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", _r("final_score", "final_score"))


def knn_topk(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return S.nearest(own, _vector(spark, sf_dir), 10).select("id", _r("similarity", "similarity"))


def knn_self_top1(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    # The stated query set of a search: ids divisible by 100.
    return S.nearest_of_each(own.where("id % 100 = 0"), own).select("id", "best_id", _r("similarity", "similarity"))


def knn_top10(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return VectorIndex(own).top(own.where("id % 100 = 0"), 10).select("id", F.col("rank").cast("long").alias("rank"), "best_id", _r("similarity", "similarity"))


def recall_index_topk(spark, sf_dir):
    """The rows of recall_keyword_topk from a stored index of all records."""
    index = InvertedIndex(spark, scratch(spark, "index")).build(bullets(spark, sf_dir, spread=True))
    return index.search(S.Query(TEXT, PROJECT), 10).select("id", "scope", _r("score", "score"))


def recall_conversations(spark, sf_dir):
    """The best records for every turn of the conversations whose number is divisible by 100, each with the whole text of the turn as its query."""
    asked = table(spark, sf_dir, "conversations").where("conv_id % 100 = 0")
    queries = asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text", F.concat(F.lit("src"), (F.col("turn") % 12).cast("string")).alias("project"))
    found = recall_joined(bullets(spark, sf_dir, spread=True), queries, as_of(), limit=5)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "keyword_score", _r("final_score", "final_score"))


def filter_bullets_combo(spark, sf_dir):
    found = M.select_bullets(bullets(spark, sf_dir), ["global", "project:src5"], "pitfalls", "Pitfall", 0.1)
    return found.select("id", "scope", _r("decay_weight", "decay_weight"))


def filter_page(spark, sf_dir):
    return M.select_bullets(bullets(spark, sf_dir), limit=25, offset=50).select("id", _r("decay_weight", "decay_weight"))


def scope_listing(spark, sf_dir):
    return M.listing(M.by_scope(bullets(spark, sf_dir), "global", 40, 20), "id", "knowledge_type", "instructivity_score")


def stats_grouping_sets(spark, sf_dir):
    return M.stats(bullets(spark, sf_dir))


def project_stats(spark, sf_dir):
    return M.project_stats(bullets(spark, sf_dir)).select("scope", "n", _r("avg_weight", "avg_weight"))


def decay_weights(spark, sf_dir):
    return M.aged(bullets(spark, sf_dir), as_of()).select("id", _r("new_weight", "new_weight"))


def _stale(spark, sf_dir) -> DataFrame:
    """Records with weights of 1, as before any ageing."""
    return bullets(spark, sf_dir).withColumn("decay_weight", F.lit(1.0))


def decay_updates(spark, sf_dir):
    return M.aged(_stale(spark, sf_dir), as_of()).where("is_update").select("id", _r("new_weight", "new_weight"))


def _no_archive(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.ARCHIVE)


def decay_archive(spark, sf_dir):
    return M.decay_update(_stale(spark, sf_dir), _no_archive(spark), as_of())[1].select("id", "scope", "recall_count", _r("decay_weight", "decay_weight"), F.unix_micros("archived_at").alias("archived_us"))


def bullets_after_decay(spark, sf_dir):
    return M.decay_update(_stale(spark, sf_dir), _no_archive(spark), as_of())[0].select("id", "scope", _r("decay_weight", "decay_weight"))


def recency_boost(spark, sf_dir):
    return bullets(spark, sf_dir).select("id", scoring.recency_boost(F.col("last_recall"), F.col("created_at"), as_of()).alias("boost"))


def context_budget(spark, sf_dir):
    """Each scope's records by falling score, as far as they fit a budget of 4000 tokens."""
    rank = F.row_number().over(S.Window.partitionBy("scope").orderBy(F.desc("instructivity_score"), "id"))
    return S.within_budget(bullets(spark, sf_dir).withColumn("rank", rank), 4000, ("scope",)).select("id", "scope", F.col("rank").cast("long").alias("rank"), "tokens", "total_tokens")


def tokenize_docs(spark, sf_dir):
    own = table(spark, sf_dir, "documents", True).select("doc_id", T.search_tokens(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.encode(F.array_join("t", " "), "UTF-8")).alias("tokens_md5"))


def stem_tokens(spark, sf_dir):
    words = table(spark, sf_dir, "documents", True).select(F.explode(T.tokenize(F.col("text"))).alias("token")).groupBy("token").count()
    return words.groupBy(T.stem(F.col("token")).alias("stem")).agg(F.sum("count").alias("n"), F.count("*").alias("n_forms"))


def cjk_ngrams_docs(spark, sf_dir):
    own = made.texts(spark, sf_dir, fixtures.CJK)
    return own.select("id", *[F.array_join(T.cjk_ngrams(F.col("content"), n), ",").alias(f"grams{n}") for n in (2, 3)])


def content_density(spark, sf_dir):
    return table(spark, sf_dir, "documents", True).select("doc_id", _r(scoring.content_density(F.col("text")), "density"))


def _classified(own: DataFrame, id: str, content: str) -> DataFrame:
    c = F.col(content)
    return own.select(id, scoring.knowledge_type(c).alias("knowledge_type"), _r(scoring.instructivity(c), "score"), (scoring.instructivity(c) < 30).alias("rejected"))


def classify_docs(spark, sf_dir):
    return _classified(table(spark, sf_dir, "documents", True), "doc_id", "text")


def classify_sentences(spark, sf_dir):
    return _classified(made.texts(spark, sf_dir, fixtures.SENTENCES), "id", "content")


def _sanitized(own: DataFrame, id: str, content: str) -> DataFrame:
    found = secrets.reasons(F.col(content))
    return own.select(id, F.size(found).cast("long").alias("n_reasons"), F.array_join(F.array_sort(found), ";").alias("reasons"), F.md5(F.encode(secrets.anonymized(F.col(content)), "UTF-8")).alias("clean_md5"))


def sanitize_docs(spark, sf_dir):
    return _sanitized(table(spark, sf_dir, "documents", True), "doc_id", "text")


def sanitize_secrets(spark, sf_dir):
    return _sanitized(made.texts(spark, sf_dir, fixtures.SECRETS), "id", "content")


def entities_sentences(spark, sf_dir):
    return made.texts(spark, sf_dir, fixtures.SENTENCES).select("id", F.array_join(D.entities(F.col("content")), "|").alias("entities"))


def versions_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", True).select("doc_id", F.explode(C.versions(F.col("text"))).alias("v")).select("doc_id", "v.name", "v.version")


def detect_events(spark, sf_dir):
    return detect(made.events(spark, sf_dir)).select("id", "pattern_type", "summary", *[F.coalesce(f"context.{c}", F.lit("")).alias(c) for c in ("file", "language", "error_message", "command")])


def distill_events(spark, sf_dir):
    entries = detect(made.events(spark, sf_dir))
    found = D.distill(entries, "myapp", keep=("id",))
    return found.select("id", "scope", "section", "knowledge_type", "content", "instructivity_score", F.array_join("tags", ",").alias("tags"), F.array_join("key_entities", "|").alias("entities"), F.coalesce("code_language", F.lit("")).alias("code_language"))


def _records(spark, sf_dir) -> DataFrame:
    """Records to curate: the labelled documents, whose contents are known, and all turns of conversations."""
    empty = F.array().cast("array<string>")
    make = lambda d, seq, content, score, tools, tags: d.select(
        seq.alias("seq"), F.lit("global").alias("scope"), F.lit("knowledge").alias("section"), content.alias("content"), content.alias("distilled_rule"), F.lit(None).cast("string").alias("code_content"),
        F.lit(None).cast("string").alias("code_language"), F.lit("Knowledge").alias("knowledge_type"), score.cast("double").alias("instructivity_score"), F.lit("auto").alias("source_type"),
        F.array(tools).alias("related_tools"), empty.alias("related_files"), empty.alias("key_entities"), F.array(tags).alias("tags"), F.lit(None).cast("array<float>").alias("embedding"),
    )
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    talk = table(spark, sf_dir, "conversations")
    one = make(docs, F.col("doc_id"), F.col("text"), (F.col("doc_id") * 13) % 101, F.lit("label"), F.concat(F.lit("q"), F.col("quality").cast("string")))
    two = make(talk, F.lit(1_000_000_000_000) + F.col("conv_id") * 1000 + F.col("turn"), F.col("text"), F.col("turn") % 101, F.col("role"), F.lit("talk"))
    return one.unionByName(two)


def curate_exact(spark, sf_dir):
    after, _ = U.curate_exact(bullets(spark, sf_dir), _records(spark, sf_dir), as_of())
    return after.select("id", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), "instructivity_score", "recall_count", F.array_join(F.array_sort("related_tools"), ",").alias("tools"), F.array_join(F.array_sort("tags"), ",").alias("tags"))


def curate_outcomes(spark, sf_dir):
    return U.counts(U.curate_exact(bullets(spark, sf_dir), _records(spark, sf_dir), as_of())[1]).select("outcome", F.col("count").alias("n"))


def curate_semantic(spark, sf_dir):
    """A batch with vectors against all records, one record after the other."""
    from datetime import datetime

    after, outcome = U.curate(bullets(spark, sf_dir, True), fixtures.batch(spark, _vector(spark, sf_dir)), datetime(2025, 1, 1))
    return outcome.select("seq", "outcome")


def curate_ordered(spark, sf_dir):
    """Four records for each embedding, in order: near the record of that number and longer, far from all, far again and longer, and one that goes by content.

    Far from all is a direction that a hash of the number chooses: of two such of 64 dimensions about one pair in 10^15 is as near as 0.8. The opposite of the embedding isn't far where embeddings have near copies, whose opposites are near each other.
    """
    from datetime import datetime

    i, v = F.col("vec_id"), F.col("embedding")
    far = F.transform(v, lambda _, k: (F.pmod(F.xxhash64(i, k), F.lit(1 << 24)) / F.lit(float(1 << 23)) - 1.0).cast("float"))
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    vecs = table(spark, sf_dir, "embeddings")
    texts, _ = parted(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", vecs.select("vec_id"), vecs.count())
    own = vecs.join(texts, "vec_id", "left")
    number = i.cast("string")
    made_of = (
        (0, F.concat(F.coalesce("text", F.lit("")), F.lit(" near "), number), (i * 13) % 101, F.concat(F.lit("q"), (i % 3).cast("string")), v), (1, F.concat(F.lit("far "), number), (i * 7) % 101, F.lit("far"), far),
        (2, F.concat(F.lit("far and longer "), number), (i * 11) % 101, F.lit("again"), far), (3, F.concat(F.lit("plain "), (i % 50).cast("string")), i % 101, F.concat(F.lit("p"), (i % 3).cast("string")), F.lit(None).cast("array<float>")),
    )
    rows = F.array(*[F.struct((i * 4 + k).alias("seq"), c.alias("content"), s.cast("double").alias("score"), t.alias("tag"), e.alias("embedding")) for k, c, s, t, e in made_of])
    records = own.select(F.explode(rows).alias("r")).select(
        "r.seq", F.lit("global").alias("scope"), F.lit("knowledge").alias("section"), "r.content", F.col("r.content").alias("distilled_rule"), none.alias("code_content"), none.alias("code_language"), F.lit("Knowledge").alias("knowledge_type"),
        F.col("r.score").alias("instructivity_score"), F.lit("auto").alias("source_type"), empty.alias("related_tools"), empty.alias("related_files"), empty.alias("key_entities"), F.array("r.tag").alias("tags"), "r.embedding",
    )
    after, _ = U.curate(bullets(spark, sf_dir, True), records, datetime(2025, 1, 1))
    return after.select("id", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), "instructivity_score", "recall_count", F.array_join("tags", ",").alias("tags"))


def conflicts_version(spark, sf_dir):
    return C.all_conflicts(bullets(spark, sf_dir, spread=True), as_of()).where("conflict_type = 'version'").select("bullet_id_a", "bullet_id_b", "description")


def conflicts_kinds(spark, sf_dir):
    return C.all_conflicts(made.rivals(spark, sf_dir), as_of()).select("bullet_id_a", "bullet_id_b", "conflict_type", "description")


def promote_min_score(spark, sf_dir):
    return M.promoted(bullets(spark, sf_dir), as_of(), min_score=80).select("id", "scope", F.unix_micros("updated_at").alias("updated_us"))


def conflict_keep_a(spark, sf_dir):
    own = bullets(spark, sf_dir)
    pair = own.orderBy("id").limit(2).agg(F.min("id").alias("bullet_id_a"), F.max("id").alias("bullet_id_b"))
    null = lambda kind: F.lit(None).cast(kind)
    rows = pair.select(F.lit("c").alias("id"), "bullet_id_a", "bullet_id_b", F.lit("version").alias("conflict_type"), F.lit("").alias("description"), F.lit(0).alias("resolved"), null("timestamp").alias("resolved_at"), as_of().alias("created_at"))
    after, archive, _ = M.settle(own, _no_archive(spark), rows, "c", "keep_a", as_of())
    return after.select("id", F.lit("kept").alias("state")).unionByName(archive.select("id", F.lit("archived").alias("state")))


def export_rows(spark, sf_dir):
    got = exchange.export_rows(bullets(spark, sf_dir))
    return got.select("id", *[F.get_json_object("json", f"$.{c}").alias(c) for c in ("scope", "section", "knowledge_type")], F.md5(F.encode(F.get_json_object("json", "$.content"), "UTF-8")).alias("content_md5"), F.get_json_object("json", "$.embedding").isNull().alias("stripped"))


def export_markdown(spark, sf_dir):
    return exchange.export_markdown_rows(bullets(spark, sf_dir)).select("id", "section", F.md5(F.encode("line", "UTF-8")).alias("line_md5"))


def import_roundtrip(spark, sf_dir):
    """All records out as JSON objects and back in the distilled layout."""
    rows = exchange.export_rows(bullets(spark, sf_dir)).select(F.from_json("json", ", ".join(exchange._FIELDS)).alias("r")).select("r.*")
    return exchange.distilled_from(rows, ("id",)).select("id", "scope", "section", "source_type", "instructivity_score", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), F.array_join("tags", ",").alias("tags"))


def queue_trigger_batches(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("o"))
    return queue.batches(own, order="o").select("event_id", "session_id", F.col("place").cast("long").alias("place"), "batch")


def vectors_norm(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    return own.select("vec_id", _r(vectors.norm(F.col("embedding")), "norm"), F.round(vectors.norm(vectors.l2_normalized(F.col("embedding"))), 4).alias("unit_norm"))


def deletes(spark, sf_dir):
    """Records without those whose document is labelled as bad."""
    bad = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("id"))
    return M.deleted(bullets(spark, sf_dir), bad).select("id", "scope")


def updates(spark, sf_dir):
    """Records with the score of labelled documents set, nulls for toxic ones."""
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 0, F.col("quality") * 100.0).alias("instructivity_score"))
    return M.updated(bullets(spark, sf_dir), new).select("id", "instructivity_score")


def recall_cjk(spark, sf_dir):
    """Keyword points of a text with ideographs: whole words, stems and bigrams."""
    empty = F.array().cast("array<string>")
    own = made.texts(spark, sf_dir, fixtures.CJK).withColumns({"decay_weight": F.lit(1.0), "related_tools": empty, "tags": empty, "key_entities": empty})
    return S.keyword_search(own, "数据库 连接池 hello", 10).select("id", "score")


def recall_bump(spark, sf_dir):
    """All records after one recall's results were counted."""
    hit = S.keyword_search(S.visible(bullets(spark, sf_dir, spread=True), ["global", f"project:{PROJECT}"]), TEXT, 10)
    return M.recalled(bullets(spark, sf_dir), hit, as_of()).select("id", "recall_count", _us("last_recall").alias("last_us"))


def bullet_by_id(spark, sf_dir):
    return M.by_id(bullets(spark, sf_dir), "7").select("id", "scope", "section", "recall_count")


def embeddings_listing(spark, sf_dir):
    return M.embeddings(bullets(spark, sf_dir, True)).select("id", _r(vectors.norm(F.col("embedding")), "norm"))


def insert_rows(spark, sf_dir):
    own = bullets(spark, sf_dir)
    return M.inserted(own, own.where("section = 'methods'").withColumn("id", F.concat(F.lit("new|"), "id"))).select("id", "section")


def clear_rows(spark, sf_dir):
    return M.cleared(bullets(spark, sf_dir)).agg(F.count("*").alias("n"))


def archive_move(spark, sf_dir):
    """Records of toxic documents to the archive; an id that isn't known is passed over."""
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id")).unionByName(spark.createDataFrame([("nowhere",)], "id string"))
    after, archive = M.moved_to_archive(bullets(spark, sf_dir), _no_archive(spark), bad, as_of())
    return after.select("id", F.lit("kept").alias("state"), F.lit(0).cast("long").alias("archived_us")).unionByName(archive.select("id", F.lit("archived").alias("state"), _us("archived_at").alias("archived_us")))


def _conflicts(spark, sf_dir) -> DataFrame:
    """Half of some conflicts first, then all of them, then those of bad documents resolved."""
    rows = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("c"), "doc_id").alias("id"), F.col("doc_id").cast("string").alias("bullet_id_a"), (F.col("doc_id") + 1).cast("string").alias("bullet_id_b"), F.lit("version").alias("conflict_type"),
        F.lit("").alias("description"), F.lit(0).alias("resolved"), F.lit(None).cast("timestamp").alias("resolved_at"), as_of().alias("created_at"), "doc_id", "quality",
    )
    names = schemas.names(schemas.CONFLICTS)
    every = M.with_conflicts(rows.where("doc_id % 2 = 0").select(*names), rows.select(*names))
    return M.resolved(every, rows.where("quality = 0"), as_of())


def conflicts_insert_resolve(spark, sf_dir):
    return _conflicts(spark, sf_dir).select("id", "resolved", _us("resolved_at").alias("resolved_us"))


def conflicts_open(spark, sf_dir):
    return M.conflicts_by(_conflicts(spark, sf_dir), False).select("id", "bullet_id_a", "bullet_id_b")


def _settled(spark, sf_dir, keep: str) -> DataFrame:
    """All rivals after the conflict of the first two is settled: records, archive and conflicts."""
    own = made.rivals(spark, sf_dir)
    found = written(C.all_conflicts(own, as_of()), "conflicts", keep=True)
    id = found.where("bullet_id_a = '0' and bullet_id_b = '1'").first().id
    after, archive, conflicts = M.settle(own, _no_archive(spark), found, id, keep, as_of())
    named = conflicts.select(F.concat_ws("+", "bullet_id_a", "bullet_id_b").alias("id"), F.when(F.col("resolved") == 1, "resolved").otherwise("open").alias("state"))
    return after.select("id", F.lit("kept").alias("state")).unionByName(archive.select("id", F.lit("archived").alias("state"))).unionByName(named)


def conflict_keep_b(spark, sf_dir):
    return _settled(spark, sf_dir, "keep_b")


def conflict_keep_both(spark, sf_dir):
    return _settled(spark, sf_dir, "keep_both")


def promote_one(spark, sf_dir):
    return M.promoted(bullets(spark, sf_dir), as_of(), id="4").select("id", "scope", F.unix_micros("updated_at").alias("updated_us"))


def promote_scope(spark, sf_dir):
    return M.promoted(bullets(spark, sf_dir), as_of(), scope=f"project:{PROJECT}").select("id", "scope", F.unix_micros("updated_at").alias("updated_us"))


def promote_scope_min_score(spark, sf_dir):
    return M.promoted(bullets(spark, sf_dir), as_of(), scope=f"project:{PROJECT}", min_score=50).select("id", "scope", F.unix_micros("updated_at").alias("updated_us"))


def entities_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", True).select("doc_id", F.array_join(D.entities(F.col("text")), "|").alias("entities"))


def event_sessions(spark, sf_dir):
    """Runs of a user's events without a pause of an hour."""
    own = sessions(table(spark, sf_dir, "events"), "1 hour", "user_id", "ts")
    return own.select("user_id", F.unix_micros(F.col("started").cast("timestamp")).alias("started_us"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended_us"), "n")


def queue_roundtrip(spark, sf_dir):
    """Events as queue entries, written to the sessions' folders and read back; those about errors are marked as done."""
    null = F.lit(None).cast("string")
    entries = table(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("timestamp"), F.col("event_type").alias("tool_name"), F.lit("command_usage").alias("pattern_type"), F.concat(F.lit("Executed: "), "event_type").alias("summary"),
        F.struct(*[null.alias(c) for c in ("file", "language", "error_message", "command")]).alias("context"), F.lit(False).alias("processed"), F.concat(F.lit("s"), F.col("user_id") % 16).alias("session_id"),
    )
    path = scratch(spark, "queue")
    queue.append(entries, path)
    own = queue.read(spark, path)
    return queue.unprocessed(queue.marked(own, own.where("tool_name = 'error'"))).select("timestamp", "session_id", "summary")


def markdown_document(spark, sf_dir):
    """The document of all records, line by line."""
    return exchange.markdown_rows(bullets(spark, sf_dir), "2025-01-01", "p").select("n", F.md5(F.encode("line", "UTF-8")).alias("line_md5"))


def context_document(spark, sf_dir):
    """The context text of a recall over all visible records, as far as the token budget goes."""
    best = S.keyword_search(S.visible(bullets(spark, sf_dir, spread=True), ["global", f"project:{PROJECT}"]), TEXT, 10)
    ranked = best.withColumn("rank", F.row_number().over(S.Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.desc("decay_weight"), "id")))
    text = S.format_context(ranked, 4000)
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, line string")


def _exported(spark, sf_dir) -> DataFrame:
    """All records as one JSON document, written and read back by tasks and validated."""
    path = scratch(spark, "export")
    exchange.write_lines(exchange.json_rows(made.rivals(spark, sf_dir), "2025-01-01T00:00:00.000Z"), path)
    return exchange.import_json(spark, path)


def import_document(spark, sf_dir):
    return _exported(spark, sf_dir).select("seq", "scope", "section", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), "source_type", "instructivity_score", F.array_join("key_entities", ",").alias("entities"))


def import_merge(spark, sf_dir):
    """The document merged into a part of its records."""
    known = made.rivals(spark, sf_dir).where("id % 3 <> 0")
    after, _ = U.curate_exact(known, _exported(spark, sf_dir), as_of())
    return after.select(F.md5(F.encode("content", "UTF-8")).alias("content_md5"), F.when(F.length("id") < 64, F.col("id")).otherwise("new").alias("from_id"), "source_type", _us("updated_at").alias("updated_us"))


_ALL = (
    recall_keyword_topk, recall_hybrid_topk, recall_multi_query, knn_topk, knn_self_top1, knn_top10, recall_index_topk, recall_conversations, filter_bullets_combo, filter_page, scope_listing, stats_grouping_sets, project_stats, decay_weights, decay_updates,
    decay_archive, bullets_after_decay, recency_boost, context_budget, tokenize_docs, stem_tokens, cjk_ngrams_docs, content_density, classify_docs, classify_sentences, sanitize_docs, sanitize_secrets, entities_sentences,
    versions_docs, detect_events, distill_events, curate_exact, curate_outcomes, curate_semantic, curate_ordered, conflicts_version, conflicts_kinds, promote_min_score, conflict_keep_a, export_rows, export_markdown,
    import_roundtrip, queue_trigger_batches, vectors_norm, deletes, updates, recall_cjk, recall_bump, bullet_by_id, embeddings_listing, insert_rows, clear_rows, archive_move, conflicts_insert_resolve,
    conflicts_open, conflict_keep_b, conflict_keep_both, promote_one, promote_scope, promote_scope_min_score, entities_docs, event_sessions, queue_roundtrip, markdown_document, context_document,
    import_document, import_merge,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
