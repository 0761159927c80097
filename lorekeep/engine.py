"""One object for all operations over a store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import schemas
from .config import CURATE_THRESHOLD, DEFAULTS
from .operators import conflicts as C
from .operators import curate as U
from .operators import distill as D
from .operators import maintain as M
from .operators import search as S

from .shared import numbered, written
from .sources import exchange
from .sources.store import TABLES, Store


class Engine:
    """Every operation takes its time as a parameter; those that change something commit one snapshot."""

    def __init__(self, spark: SparkSession, path: str, settings: dict = DEFAULTS):
        self.spark, self.store, self.settings = spark, Store(spark, path), settings

    def _at(self, as_of: datetime) -> Column:
        return F.lit(as_of).cast("timestamp")

    def recall(self, text: str, as_of: datetime, project: str | None = None, vector: tuple[float, ...] | None = None, limit: int | None = None, bump: bool = True) -> list[dict]:
        """The best records as they were before this recall; their counters are raised unless bump is off."""
        bullets = self.store.bullets
        rows = [r.asDict() for r in S.recall(bullets, S.Query(text, project, vector), self._at(as_of), self.settings["search"], limit).collect()]
        if rows and bump:
            ids = [r["id"] for r in rows]
            hit = self.spark.createDataFrame([(i,) for i in ids], "id string")
            self.store.commit({}, upserts={"bullets": M.recalled(bullets.where(F.col("id").isin(ids)), hit, self._at(as_of))})
        return rows

    def context(self, text: str, as_of: datetime, project: str | None = None, vector: tuple[float, ...] | None = None) -> str:
        """The recall's context text within the token budget."""
        rows = self.recall(text, as_of, project, vector)
        if not rows:
            return ""
        ranked = self.spark.createDataFrame([(i, r["knowledge_type"], r["content"], r["recall_count"]) for i, r in enumerate(rows)], "rank int, knowledge_type string, content string, recall_count int")
        return S.format_context(ranked, self.settings["search"]["max_tokens"])

    def curate(self, entries: DataFrame, as_of: datetime, project: str = "", cached: bool = True, detect: bool = False, order: str = "timestamp", stream: tuple[str, int] | None = None) -> dict[str, int]:
        """Distill queue entries and merge them in, in order; the counts of added, merged and skipped records.

        A queue of any length is one commit: its entries are numbered and merged by tasks, and the counts alone come to the driver.
        stream: a stream's name and the number of its batch; one that was committed before changes nothing.
        """
        if stream and self.store.state().get("streams", {}).get(stream[0], -1) >= stream[1]:
            return {"added": 0, "merged": 0, "skipped": 0}
        numbers = numbered(entries, F.col(order), F.xxhash64(*entries.columns), name="seq")
        records = D.distill(numbers, project, self.settings["reflector"], keep=("seq",))
        before = self.store.bullets
        changed, outcome = U.curate_changes(before, records, self._at(as_of), CURATE_THRESHOLD, cached)
        upserts = {"bullets": changed}
        if detect:
            new = changed.join(before.select("id"), "id", "left_anti")
            after = before.join(changed.select("id"), "id", "left_anti").unionByName(changed)
            found = written(C.detect_conflicts(new, after, self._at(as_of)), "conflicts", keep=True)
            upserts["conflicts"] = found.join(self.store.conflicts.select("id"), "id", "left_anti").dropDuplicates(["id"]).select(*found.columns)
        got = {r["outcome"]: r["count"] for r in U.counts(outcome).collect()}
        self.store.commit({}, upserts=upserts, streams=dict([stream]) if stream else None)
        added, merged = got.get("added", 0), got.get("merged", 0)
        return {"added": added, "merged": merged, "skipped": numbers.count() - added - merged}

    def learn(self, text: str, as_of: datetime, project: str = "", session_id: str = "manual") -> dict[str, int]:
        """Record a sentence by hand; it is kept however it scores, unless it holds a secret."""
        row = (as_of.isoformat(), "manual", "manual", text, {"file": None, "language": None, "error_message": None, "command": None}, False, session_id)
        return self.curate(self.spark.createDataFrame([row], f"{schemas.QUEUE}, session_id string"), as_of, project)

    def search(self, text: str, limit: int = 10) -> DataFrame:
        """Records of all scopes by keyword points."""
        found = S.keyword_search(self.store.bullets, text, limit)
        return M.listing(found, "id", "content", "scope", "section", "knowledge_type", "score")

    def status(self) -> dict:
        """Counts by kind, and the snapshot's version and layout."""
        now = self.store.state()
        return self.stats() | {"version": now["version"], "layout": now["layout"], "archived": self.store.archive.count(), "open_conflicts": self.conflicts_list(False).count()}

    def health(self) -> dict[str, bool]:
        """Whether each table of the newest snapshot can be read."""
        out = {}
        for name in TABLES:
            try:
                self.store.table(name).limit(1).collect()
                out[name] = True
            except AnalysisException:
                out[name] = False
        return out

    def stats(self) -> dict:
        out: dict = {"total": 0, "scope": {}, "knowledge_type": {}, "section": {}}
        for r in M.stats(self.store.bullets).collect():
            if r.dimension == "total":
                out["total"] = r.n
            else:
                out[r.dimension][r.value] = r.n
        return out

    def projects(self) -> DataFrame:
        return M.project_stats(self.store.bullets)

    def decay_update(self, as_of: datetime) -> dict[str, int]:
        bullets = self.store.bullets
        aged = M.aged(bullets, self._at(as_of), self.settings["decay"])
        marks = aged.agg(F.count_if("is_update").alias("u"), F.count_if("is_faded").alias("f")).first()
        moved = aged.withColumn("decay_weight", F.when(F.col("is_update"), F.col("new_weight")).otherwise(F.col("decay_weight")))
        faded = moved.where("is_faded")
        self.store.commit({}, upserts={"bullets": moved.where("is_update and not is_faded").select(*bullets.columns), "archive": M.archived(faded, self._at(as_of))}, deletes={"bullets": faded.select("id")})
        return {"updated": marks.u, "archived": marks.f}

    def conflicts_check(self, id: str, as_of: datetime) -> DataFrame:
        """Conflicts of one record, stored and returned."""
        bullets = self.store.bullets
        found = C.detect_conflicts(M.by_id(bullets, id), bullets, self._at(as_of))
        self.store.commit({"conflicts": M.with_conflicts(self.store.conflicts, found)})
        return found

    def conflicts_list(self, resolved: bool | None = None) -> DataFrame:
        return M.conflicts_by(self.store.conflicts, resolved)

    def resolve(self, id: str, keep: str, as_of: datetime) -> None:
        s = self.store
        bullets, archive, conflicts = M.settle(s.bullets, s.archive, s.conflicts, id, keep, self._at(as_of))
        s.commit({"bullets": bullets, "archive": archive, "conflicts": conflicts})

    def promote(self, as_of: datetime, **which) -> None:
        self.store.commit({"bullets": M.promoted(self.store.bullets, self._at(as_of), **which)})

    def export_json(self, exported_at: str, scopes: list[str] | None = None, project: str | None = None) -> str:
        return exchange.export_json(M.select_bullets(self.store.bullets, scopes), exported_at, project)

    def export_markdown(self, exported_on: str, scopes: list[str] | None = None, project: str | None = None) -> str:
        return exchange.export_markdown(M.select_bullets(self.store.bullets, scopes), exported_on, project)

    def export_files(self, path: str, exported_at: str, scopes: list[str] | None = None, project: str | None = None, markdown: bool = False) -> None:
        """An export of any size as a folder of text files, made by tasks: in the order of their names they are the document."""
        own = M.select_bullets(self.store.bullets, scopes)
        exchange.write_lines(exchange.markdown_rows(own, exported_at, project) if markdown else exchange.json_rows(own, exported_at, project), path)

    def import_json(self, path: str, as_of: datetime) -> dict[str, int]:
        """Merge an export in, by content; the counts of added, merged and skipped records."""
        after, outcome = U.curate_exact(self.store.bullets, exchange.import_json(self.spark, path), self._at(as_of))
        got = {r["outcome"]: r["count"] for r in U.counts(outcome).collect()}
        self.store.commit({"bullets": after})
        return {k: got.get(k, 0) for k in ("added", "merged", "skipped")}

    def clear(self) -> None:
        self.store.commit({"bullets": M.cleared(self.store.bullets)})
