"""Filters, statistics, ageing, and changes of the stored tables: DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import DECAY_DELTA, DEFAULTS
from ..functions import scoring


# Filters


def select_bullets(bullets: DataFrame, scopes: list[str] | None = None, section: str | None = None, knowledge_type: str | None = None, min_decay_weight: float | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Records that meet all conditions given, by falling weight, then id. Empty lists and texts are no condition; a least weight of 0 is one."""
    out = bullets
    if scopes:
        out = out.where(F.col("scope").isin(*scopes))
    if section:
        out = out.where(F.col("section") == section)
    if knowledge_type:
        out = out.where(F.col("knowledge_type") == knowledge_type)
    if min_decay_weight is not None:
        out = out.where(F.col("decay_weight") >= min_decay_weight)
    out = out.orderBy(F.desc("decay_weight"), "id")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def by_id(bullets: DataFrame, id: str) -> DataFrame:
    return bullets.where(F.col("id") == id)


def by_scope(bullets: DataFrame, scope: str, min_score: float | None = None, limit: int | None = None) -> DataFrame:
    """A scope's records by falling score."""
    out = bullets.where(F.col("scope") == scope)
    out = out if min_score is None else out.where(F.col("instructivity_score") >= min_score)
    out = out.orderBy(F.desc("instructivity_score"), "id")
    return out.limit(limit) if limit is not None else out


def embeddings(bullets: DataFrame) -> DataFrame:
    return bullets.select("id", "embedding").where(F.col("embedding").isNotNull())


def listing(bullets: DataFrame, *columns: str) -> DataFrame:
    """Columns of a report: by default id, content, knowledge_type, instructivity_score and decay_weight."""
    return bullets.select(*(columns or ("id", "content", "knowledge_type", "instructivity_score", "decay_weight")))


def conflicts_by(conflicts: DataFrame, resolved: bool | None = None) -> DataFrame:
    """All conflicts, the resolved ones, or the open ones."""
    return conflicts if resolved is None else conflicts.where(F.col("resolved") == int(resolved))


# Statistics


def stats(bullets: DataFrame) -> DataFrame:
    """(dimension, value, n) for the total and each scope, knowledge type and section: one scan, one aggregation over grouping sets."""
    keys = [F.col(c) for c in ("scope", "knowledge_type", "section")]
    got = bullets.groupingSets([[], [keys[0]], [keys[1]], [keys[2]]], *keys).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "scope").when(F.col("g") == 5, "knowledge_type").otherwise("section")
    return got.select(name.alias("dimension"), F.coalesce("scope", "knowledge_type", "section").alias("value"), "n")


def project_stats(bullets: DataFrame) -> DataFrame:
    """Count and mean weight of each scope, by falling count."""
    return bullets.groupBy("scope").agg(F.count("*").alias("n"), F.avg("decay_weight").alias("avg_weight")).orderBy(F.desc("n"), "scope")


# Ageing


def aged(bullets: DataFrame, as_of: Column, c: dict = DEFAULTS["decay"]) -> DataFrame:
    """Records with new_weight, is_update (the weight moves) and is_faded (it falls below the archive's threshold)."""
    out = bullets.withColumn("new_weight", scoring.decay_weight(F.col("created_at"), F.col("recall_count"), as_of, c))
    return out.withColumn("is_update", F.abs(F.col("new_weight") - F.col("decay_weight")) > DECAY_DELTA).withColumn("is_faded", F.col("new_weight") < c["archive_threshold"])


def decay_update(bullets: DataFrame, archive: DataFrame, as_of: Column, c: dict = DEFAULTS["decay"]) -> tuple[DataFrame, DataFrame]:
    """(bullets, archive) after ageing: weights that move are set, then faded records go to the archive with their new weight. A map over the records, no shuffle."""
    got = aged(bullets, as_of, c).withColumn("decay_weight", F.when(F.col("is_update"), F.col("new_weight")).otherwise(F.col("decay_weight")))
    return got.where(~F.col("is_faded")).select(*bullets.columns), archive.unionByName(archived(got.where("is_faded"), as_of))


# Changes


def inserted(bullets: DataFrame, new: DataFrame) -> DataFrame:
    """With new records; raises if an id is known or comes twice."""
    ids = new.select("id")
    if ids.join(bullets.select("id"), "id", "left_semi").limit(1).count() or ids.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("an id occurs twice")
    return bullets.unionByName(new)


def updated(bullets: DataFrame, changes: DataFrame) -> DataFrame:
    """With the columns of `changes` set where ids match, nulls too. A table of changes without other columns changes nothing."""
    columns = [c for c in changes.columns if c != "id"]
    new = changes.select("id", F.struct(F.lit(1).alias("_"), *columns).alias("_new"))
    return bullets.join(new, "id", "left").select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in bullets.columns])


def deleted(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the rows whose id is listed."""
    return table.join(ids.select("id"), "id", "left_anti")


def archived(bullets: DataFrame, as_of: Column) -> DataFrame:
    """Rows of the archive for these records."""
    return bullets.select(*[as_of.cast("timestamp").alias(c) if c == "archived_at" else F.col(c) for c in schemas.names(schemas.ARCHIVE)])


def moved_to_archive(bullets: DataFrame, archive: DataFrame, ids: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(bullets, archive) after a move; unknown ids are passed over. Both belong in one commit."""
    return deleted(bullets, ids), archive.unionByName(archived(bullets.join(ids.select("id"), "id", "left_semi"), as_of))


def with_conflicts(conflicts: DataFrame, new: DataFrame) -> DataFrame:
    """With new conflicts; those whose id is known are passed over."""
    return conflicts.unionByName(new.join(conflicts.select("id"), "id", "left_anti").dropDuplicates(["id"]))


def resolved(conflicts: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    out = conflicts.join(hit, "id", "left")
    return out.select(*[F.when(F.col("_hit"), F.lit(1) if c == "resolved" else as_of.cast("timestamp")).otherwise(F.col(c)).alias(c) if c in ("resolved", "resolved_at") else F.col(c) for c in conflicts.columns])


def settle(bullets: DataFrame, archive: DataFrame, conflicts: DataFrame, id: str, keep: str, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bullets, archive, conflicts) after a conflict is settled: keep is keep_a, keep_b or keep_both; the other side is archived."""
    if keep not in ("keep_a", "keep_b", "keep_both"):
        raise ValueError(keep)
    found = conflicts.where(F.col("id") == id)
    if keep != "keep_both":
        loser = found.select(F.col("bullet_id_b" if keep == "keep_a" else "bullet_id_a").alias("id"))
        bullets, archive = moved_to_archive(bullets, archive, loser, as_of)
    return bullets, archive, resolved(conflicts, found.select("id"), as_of)


def promoted(bullets: DataFrame, as_of: Column, scope: str | None = None, id: str | None = None, min_score: float | None = None) -> DataFrame:
    """With records made global: one by its id, a scope's with a least score, or all of a scope."""
    hit = F.lit(True) if id is None else F.col("id") == id
    hit = hit if scope is None else hit & (F.col("scope") == scope)
    hit = hit if min_score is None else hit & (F.col("instructivity_score") >= min_score)
    return bullets.withColumns({"scope": F.when(hit, "global").otherwise(F.col("scope")), "updated_at": F.when(hit, as_of.cast("timestamp")).otherwise(F.col("updated_at"))})


def recalled(bullets: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """With the counters of returned records raised by one. The ids are one recall's results, which are few."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    out = bullets.join(F.broadcast(hit), "id", "left")
    return out.withColumns({"recall_count": F.when(F.col("_hit"), F.col("recall_count") + 1).otherwise(F.col("recall_count")), "last_recall": F.when(F.col("_hit"), as_of.cast("timestamp")).otherwise(F.col("last_recall"))}).select(*bullets.columns)


def cleared(bullets: DataFrame) -> DataFrame:
    """No records; archive and conflicts stay."""
    return bullets.limit(0)
