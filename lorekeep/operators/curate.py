"""Upserts: records merge into ones with the same content or a near vector, else they are added."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas
from ..config import CURATE_THRESHOLD
from ..functions import text as T
from ..shared import parted, written
from ..ship import ship
from .components import components
from .nearest import VectorIndex, near_links, usable

ARRAYS = ("related_tools", "related_files", "key_entities", "tags")


#: Ids of bullets that are handed to every task, so that the bullets themselves stay where they are; of more, bits are handed out that tell apart the bullets that have to be moved.
MOST_SHIPPED = 200_000


def _few(ids: DataFrame) -> bool:
    return ids.limit(MOST_SHIPPED + 1).count() <= MOST_SHIPPED


def _met(bullets: DataFrame, of: DataFrame) -> DataFrame:
    """The bullets whose id is in a table, with its columns."""
    if _few(of):
        return bullets.join(F.broadcast(of), "id")
    return parted(bullets, "id", of.select("id"), of.count())[0].join(of, "id")


def _without(bullets: DataFrame, ids: DataFrame) -> DataFrame:
    """The bullets of other ids."""
    if _few(ids):
        return bullets.join(F.broadcast(ids), "id", "left_anti")
    may, rest = parted(bullets, "id", ids, ids.count())
    return may.join(ids, "id", "left_anti").unionByName(rest)


def new_id(content: Column, scope: Column, seq: Column) -> Column:
    """A stable id in place of a random one, so that a replay gives the same rows."""
    return F.sha2(F.encode(F.concat_ws("|", content, scope, seq.cast("string")), "UTF-8"), 256)


def _blank(content: Column) -> Column:
    return content.isNull() | (T.trimmed(content) == "")


def curate_exact(bullets: DataFrame, records: DataFrame, as_of: Column, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(bullets after, outcome of each record) when records are matched by content alone.

    Merging equal contents is associative, so any number of records is merged at once: scores by max, arrays by
    the first place of each distinct element, which needs an aggregation by content and element and no list of a
    group's records; only a content's distinct elements are listed, as the merged row holds them. Of several bullets with one content the one with the greatest weight, then the smallest id, takes the merge.
    """
    own = records.where(~_blank(F.col("content")))
    first = own.groupBy("content").agg(F.min(seq).alias("_first"), F.max("instructivity_score").alias("_score"), F.min_by(F.struct(*[c for c in schemas.names(schemas.DISTILLED) if c != "content"]), seq).alias("_r"))

    def listed(c: str) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(c).alias("a"), x.alias("x"), i.alias("i")))

    parts = F.concat(*[listed(c) for c in ARRAYS])
    elements = own.select("content", seq, F.explode(parts).alias("e")).groupBy("content", "e.a", "e.x").agg(F.min(F.struct(seq, "e.i")).alias("at"))
    lists = elements.groupBy("content").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("a") == c, F.struct("at", "x")))), lambda s: s["x"]).alias(f"_{c}") for c in ARRAYS])
    # The record that takes each content's merge; only contents that the batch has are ranked.
    place = F.struct(F.coalesce(-F.col("decay_weight"), F.lit(float("inf"))).alias("w"), "id")
    holder = bullets.join(first.select("content"), "content", "left_semi").groupBy("content").agg(F.min_by("id", place).alias("_old"))
    made_id = new_id(F.col("content"), F.col("_r.scope"), F.col("_first"))
    batch = first.join(lists, "content", "left").join(holder, "content", "left")
    # New rows have keys of their own, so that one full join by key keeps, merges and adds, and no key is shared by all of them.
    keyed = batch.withColumn("_key", F.coalesce("_old", F.concat(F.lit("new|"), made_id))).withColumn("_made", made_id).withColumnRenamed("content", "_content")
    union = lambda c, old: F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(f"_{c}", F.array().cast("array<string>")))
    now = as_of.cast("timestamp")
    merged = {"instructivity_score": F.greatest("instructivity_score", "_score"), "embedding": F.coalesce(F.col("_r.embedding"), F.col("embedding")), "updated_at": now} | {c: union(c, F.col(c)) for c in ARRAYS}
    made = {c: F.col(f"_r.{c}") for c in schemas.names(schemas.DISTILLED) if c != "content"} | {
        "id": F.col("_made"), "content": F.col("_content"), "instructivity_score": F.col("_score"), "recall_count": F.lit(0), "last_recall": F.lit(None).cast("timestamp"), "decay_weight": F.lit(1.0), "created_at": now, "updated_at": now,
    } | {c: union(c, F.array().cast("array<string>")) for c in ARRAYS}
    joined = bullets.join(keyed, F.col("id") == F.col("_key"), "full")
    after = joined.select(*[F.when(F.col("_key").isNull(), F.col(c)).when(F.col("_old").isNull(), made.get(c, F.lit(None))).otherwise(merged.get(c, F.col(c))).alias(c) for c in bullets.columns])
    outcome = records.join(batch.select("content", "_first", "_old"), "content", "left")
    outcome = outcome.select(seq, F.when(_blank(F.col("content")), "skipped").when(F.col("_old").isNull() & (F.col(seq) == F.col("_first")), "added").otherwise("merged").alias("outcome"))
    return after, outcome


# In order: a record can merge into what the records before it left


class _Group:
    """The bullets of one group while its records are taken in order: rows in the order in which they came, and their unit vectors."""

    def __init__(self, columns: list[str], threshold: float, cached: bool):
        self.columns, self.threshold, self.cached = columns, threshold, cached
        self.rows: list[dict] = []
        self.places: list[int] = []
        self.vectors = np.zeros((0, 0))
        self.n = 0
        self.by_content: dict[str, list[int]] = {}
        self.changed: dict[int, bool] = {}

    def _set_vector(self, k: int, vector: list[float] | None) -> None:
        unit = None if vector is None else np.array(vector, np.float64)
        size = 0.0 if unit is None else float(np.sqrt(unit @ unit))
        if not size or not np.isfinite(size):
            return
        place = next((p for p in (self.rows[k].get("_place"),) if p is not None), None)
        if place is None:
            if not self.n:
                self.vectors = np.zeros((4, len(unit)))
            if len(unit) != self.vectors.shape[1]:
                return
            if self.n == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            place = self.rows[k]["_place"] = self.n
            self.places.append(k)
            self.n += 1
        if len(unit) == self.vectors.shape[1]:
            self.vectors[place] = unit / size

    def add(self, row: dict, new: bool) -> None:
        k = len(self.rows)
        self.rows.append(row)
        self.by_content.setdefault(row["content"], []).append(k)
        self._set_vector(k, row["embedding"])
        if new:
            self.changed[k] = True

    def find(self, record: dict) -> int | None:
        """The bullet that takes the record: by vector the nearest one, if near enough, and the first of equally near ones; else of equal contents the one with the greatest weight, then the smallest id."""
        if self.cached and record["embedding"] is not None:
            unit = np.array(record["embedding"], np.float64)
            size = float(np.sqrt(unit @ unit))
            if not self.n or not size or not np.isfinite(size) or len(unit) != self.vectors.shape[1]:
                return None
            # Rounded, so that equal vectors are equally near.
            near = np.round(self.vectors[: self.n] @ (unit / size), 12)
            best = float(near.max())
            # Vectors stand in the order of their first use, bullets in that of their coming.
            return min(self.places[p] for p in np.flatnonzero(near == best).tolist()) if best >= self.threshold else None
        same = self.by_content.get(record["content"], [])
        return min(same, key=lambda k: (-(self.rows[k]["decay_weight"] or 0.0), self.rows[k]["id"]), default=None)

    def take(self, record: dict) -> str:
        k = self.find(record)
        union = lambda *lists: list(dict.fromkeys(x for own in lists for x in own or []))
        if k is None:
            id = hashlib.sha256("|".join([record["content"], record["scope"] or "", str(record["_seq"])]).encode()).hexdigest()
            row = {c: record.get(c) for c in self.columns} | {c: union(record[c]) for c in ARRAYS} | {"id": id, "recall_count": 0, "last_recall": None, "decay_weight": 1.0}
            self.add(row, True)
            return "added"
        row = self.rows[k]
        if len(record["content"]) > len(row["content"] or ""):
            self.by_content[row["content"]].remove(k)
            self.by_content.setdefault(record["content"], []).append(k)
            row["content"] = record["content"]
        row["instructivity_score"] = max((x for x in (row["instructivity_score"], record["instructivity_score"]) if x is not None), default=None)
        if record["embedding"] is not None:
            row["embedding"] = record["embedding"]
            self._set_vector(k, record["embedding"])
        for c in ARRAYS:
            row[c] = union(row[c], record[c])
        self.changed.setdefault(k, False)
        return "merged"


def _in_groups(columns: list[str], threshold: float, cached: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Groups one after the other, each with its bullets first. A task holds one group's bullets, never its records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, group, out = None, None, []

        def done() -> None:
            for k, made in group.changed.items() if group else ():
                out.append({c: group.rows[k].get(c) for c in columns} | {"_new": made})

        for b in batches:
            for r in b.to_pylist():
                if r["_root"] != root:
                    done()
                    root, group = r["_root"], _Group(columns, threshold, cached)
                if r["_seq"] is None:
                    group.add(r, False)
                else:
                    out.append({"_seq": r["_seq"], "_outcome": group.take(r)})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _node(kind: str, name: Column) -> Column:
    """A number for each thing of a kind. Two that share one by chance are in one group, which changes no result."""
    return F.xxhash64(F.lit(kind), name)


def _links(bullets: DataFrame, own: DataFrame, by_vector: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links, ids of the bullets in them). Links (a, b) connect what a record or bullet could merge with, however the ones before it change it: each with its vector or its content, and near vectors with one another, for each member and not for each pair."""
    index = VectorIndex(own.where(by_vector).select("_seq", "embedding"), "_seq", keep=1)
    of_vector = _node("v", F.col("v"))
    members = index.members.select(of_vector.alias("node"), "cell", "v")
    nodes = members.select("node")
    placed = usable(bullets, "id", index.dim).select(F.col("i").alias("id"), of_vector.alias("node"), "v")
    # Bullets with a record's vector are near what it is near to; the others ask for themselves.
    others = written(placed.join(nodes, "node", "left_anti").dropDuplicates(["node"]).select("node", "v"), "others", keep=True)
    n = others.count()
    near = near_links(None, members, index.cells, index.n, index.n, threshold)
    if n:
        near = near.unionByName(near_links(others, members, index.cells, n, index.n, threshold))
    near = written(near, "near", keep=True)
    met = nodes.unionByName(near.select(F.col("a").alias("node"))).distinct()
    by_place = placed.select("id", "node").join(met, "node", "left_semi")
    records = usable(own.where(by_vector), "_seq", index.dim).select(_node("r", F.col("i")).alias("a"), of_vector.alias("b"))
    # Records that go by content, with everything of that content.
    digest = _node("c", F.col("content")).alias("node")
    asked = written(own.where(~by_vector).select(digest).distinct(), "asked", keep=True)
    asked = F.broadcast(asked) if _few(asked) else asked
    said = own.select(_node("r", F.col("_seq")).alias("a"), digest).join(asked, "node", "left_semi").select("a", F.col("node").alias("b"))
    known = bullets.select("id", digest).join(asked, "node", "left_semi")
    of_bullets = written(by_place.select("id", "node").unionByName(known.select("id", "node")), "of_bullets", keep=True)
    links = near.unionByName(records).unionByName(said).unionByName(of_bullets.select(_node("b", F.col("id")).alias("a"), F.col("node").alias("b")))
    return links, of_bullets.select("id").distinct()


def curate_changes(bullets: DataFrame, records: DataFrame, as_of: datetime | Column, threshold: float = CURATE_THRESHOLD, cached: bool = True, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(bullets that are new or changed, outcome of each record), records taken in the order of `seq`, each seeing what the ones before it changed.

    A record can only meet records and bullets that it is linked to, by a vector that is near enough or by content, over any number of steps. So the groups that
    are linked are found first, and each is taken in order by a task of its own, which streams the group's records and holds its bullets. The largest group is the longest task, as its order is
    the result. Nothing comes to the driver. Blank contents are skipped; seq must be a number that no two records share. Where bullets' vectors differ in length from the records' they are near to none. An empty batch changes nothing.
    """
    spark = bullets.sparkSession
    kind = records.schema[seq].dataType
    own = records.withColumn("_seq", F.col(seq).cast("long"))
    # Read several times below.
    wanted = written(own.where(~_blank(F.col("content"))), "records", keep=True)
    by_vector = F.col("embedding").isNotNull() & F.lit(cached)
    columns = bullets.columns
    links, linked = _links(bullets, wanted, by_vector, threshold)
    groups = components(links)
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    # A record in no link is a group of its own.
    of = lambda d, node: d.withColumn("node", node).join(groups, "node", "left").withColumn("_root", F.coalesce("root", "node"))
    rows = of(wanted, _node("r", F.col("_seq"))).select("_root", "_seq", *[F.col(c) if c in wanted.columns else F.lit(None).cast(bullets.schema[c].dataType).alias(c) for c in columns])
    of_bullets = written(linked.withColumn("node", _node("b", F.col("id"))).join(groups, "node").select("id", F.col("root").alias("_root")), "met", keep=True)
    met = _met(bullets, of_bullets).select("_root", F.lit(None).cast("long").alias("_seq"), *columns)
    both = met.unionByName(rows).repartition("_root").sortWithinPartitions("_root", F.asc_nulls_first("_seq"), "id")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bullets.schema)
    schema = f"{kinds}, _new boolean, _seq long, _outcome string"
    ship(spark)
    done = both.mapInArrow(_in_groups(columns, threshold, cached, to_arrow_schema(spark.createDataFrame([], schema).schema)), schema)
    done = written(done, "curated", keep=True)
    at = (F.lit(as_of) if isinstance(as_of, datetime) else as_of).cast("timestamp")
    changed = done.where("_outcome is null").withColumn("updated_at", at).withColumn("created_at", F.when(F.col("_new"), at).otherwise(F.col("created_at")))
    outcome = done.where("_outcome is not null").select(F.col("_seq").cast(kind).alias(seq), F.col("_outcome").alias("outcome"))
    return changed.select(*columns), outcome.unionByName(own.where(_blank(F.col("content"))).select(seq, F.lit("skipped").alias("outcome")))


def curate(bullets: DataFrame, records: DataFrame, as_of: datetime | Column, threshold: float = CURATE_THRESHOLD, cached: bool = True, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(bullets after, outcome of each record): curate_changes() put in place."""
    changed, outcome = curate_changes(bullets, records, as_of, threshold, cached, seq)
    return _without(bullets, changed.select("id")).select(*bullets.columns).unionByName(changed), outcome


def counts(outcome: DataFrame) -> DataFrame:
    """How many records were added, merged and skipped."""
    return outcome.groupBy("outcome").count()
