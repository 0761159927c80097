"""A store of immutable snapshots: every commit writes new folders and then moves one pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

TABLES = {"bullets": schemas.BULLETS, "archive": schemas.ARCHIVE, "conflicts": schemas.CONFLICTS}
#: Buckets of ids that a new store divides each table into. A small commit rewrites the buckets that it touches.
BUCKETS = 64
#: What the rows of a bucket are sorted by, so that filters on it skip row groups.
_SORTED = {"bullets": ("scope", "id"), "archive": ("id",), "conflicts": ("id",)}


class Store:
    """One writer, any number of readers. The pointer names the folder of each bucket of each table; what a commit doesn't touch keeps its folder.

    Readers of an older snapshot aren't disturbed. A table's bucket is a hash of the id, and a bucket's rows are sorted by scope, so a recall reads row groups of its scopes only.
    buckets counts for a new store; one that exists keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._new_buckets = buckets
        if self._latest() is None:
            self.commit({})

    def _latest(self) -> int | None:
        if not self._fs.exists(self._at("pointers")):
            return None
        found = [int(f.getPath().getName()) for f in self._fs.listStatus(self._at("pointers")) if f.getPath().getName().isdigit()]
        return max(found, default=None)

    def _pointer(self, n: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{n}", wholetext=True).first()[0])

    def state(self) -> dict:
        """version, layout, buckets, and of each table of the newest snapshot the commit that each bucket's folder comes from. A store of layout 1 names one folder for a table."""
        n = self._latest()
        if n is None:
            return {"version": 0, "layout": schemas.VERSION, "buckets": self._new_buckets, "tables": {}}
        return {"buckets": self._new_buckets} | self._pointer(n)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")

    def _read(self, name: str, now: dict, only: set[int] | None = None) -> DataFrame:
        kept, names = now["tables"].get(name), schemas.names(TABLES[name])
        if isinstance(kept, str):
            out = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{kept}").select(*names)
            return out if only is None else out.where(self._bucket(now["buckets"]).isin(sorted(only)))
        folders = [f"{self.path}/data/{name}/commit={c}/bucket={k}" for k, c in sorted((kept or {}).items()) if only is None or int(k) in only]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).option("basePath", f"{self.path}/data/{name}").parquet(*folders).select(*names)

    def table(self, name: str) -> DataFrame:
        return self._read(name, self.state())

    def _write(self, name: str, df: DataFrame, n: int, buckets: int) -> dict[str, str]:
        """Write rows into their buckets' folders of a new commit; the buckets that have any."""
        commit = f"{n}-{uuid.uuid4().hex}"
        to = f"{self.path}/data/{name}/commit={commit}"
        rows = df.select(*schemas.names(TABLES[name]), self._bucket(buckets).alias("bucket"))
        rows.repartition("bucket").sortWithinPartitions("bucket", *_SORTED[name]).write.partitionBy("bucket").parquet(to)
        where = self._at(f"data/{name}/commit={commit}")
        return {f.getPath().getName().split("=")[1]: commit for f in self._fs.listStatus(where) if f.getPath().getName().startswith("bucket=")}

    def commit(self, changed: dict[str, DataFrame], upserts: dict[str, DataFrame] | None = None, deletes: dict[str, DataFrame] | None = None, streams: dict[str, int] | None = None) -> int:
        """Make a new snapshot: whole tables in `changed`; in the others the rows of `upserts` replace those of their ids or are added, and the ids of `deletes` go.

        Upserts and deletes write the buckets of their ids and no other. They are read twice, so a table that is dear to make should be a written one. Ids of upserts are unique.
        streams: numbers of the batches that this commit takes in, kept in the pointer, so they stand or fall with it.
        """
        now = self.state()
        n = now["version"] + 1
        for name, df in changed.items():
            now["tables"][name] = self._write(name, df, n, now["buckets"])
        for name in {*(upserts or {}), *(deletes or {})} - set(changed):
            new, gone = (upserts or {}).get(name), (deletes or {}).get(name)
            ids = [d.select("id") for d in (new, gone) if d is not None]
            ids = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
            # As many rows as there are buckets at most.
            touched = {r["b"] for r in ids.select(self._bucket(now["buckets"]).alias("b")).distinct().collect()}
            if not touched:
                continue
            if isinstance(now["tables"].get(name), str):
                touched = set(range(now["buckets"]))
            rows = self._read(name, now, touched).join(ids.distinct(), "id", "left_anti")
            rows = rows.select(*schemas.names(TABLES[name]))
            rows = rows if new is None else rows.unionByName(new.select(*rows.columns))
            kept = now["tables"].get(name) or {}
            kept = {} if isinstance(kept, str) else {k: c for k, c in kept.items() if int(k) not in touched}
            now["tables"][name] = kept | self._write(name, rows, n, now["buckets"])
        now |= {"version": n, "layout": schemas.VERSION, "streams": now.get("streams", {}) | (streams or {})}
        # The pointer appears at once, under a name that doesn't exist yet: a second writer fails.
        aside = self._at(f"aside-{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        self._fs.mkdirs(self._at("pointers"))
        if self._fs.exists(self._at(f"pointers/{n}")) or not self._fs.rename(aside, self._at(f"pointers/{n}")):
            raise RuntimeError("another writer made this version")
        return n

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that none of the newest `keep` snapshots names, and older pointers; the number of folders, each of a bucket. For the writer, once readers of those are done."""
        if keep < 1:
            raise ValueError("the newest snapshot stays")
        pointers = sorted((int(f.getPath().getName()) for f in self._fs.listStatus(self._at("pointers")) if f.getPath().getName().isdigit()), reverse=True)
        named = set()
        for n in pointers[:keep]:
            for name, kept in self._pointer(n)["tables"].items():
                named |= {kept} if isinstance(kept, str) else {f"data/{name}/commit={c}/bucket={k}" for k, c in kept.items()}
        for n in pointers[keep:]:
            self._fs.delete(self._at(f"pointers/{n}"), False)
        gone = 0
        # A folder of a version still to come belongs to a commit under way.
        old = lambda version: int(version.split("-")[0]) <= pointers[0]
        listed = lambda p: [f.getPath().getName() for f in self._fs.listStatus(self._at(p))] if self._fs.exists(self._at(p)) else []
        for name in listed("data"):
            if name not in TABLES:
                if f"data/{name}" not in named and old(name.split("-", 1)[1]):
                    gone += self._fs.delete(self._at(f"data/{name}"), True)
                continue
            for commit in (c for c in listed(f"data/{name}") if c.startswith("commit=") and old(c.split("=")[1])):
                own = [b for b in listed(f"data/{name}/{commit}") if b.startswith("bucket=")]
                stay = [b for b in own if f"data/{name}/{commit}/{b}" in named]
                for b in set(own) - set(stay):
                    gone += self._fs.delete(self._at(f"data/{name}/{commit}/{b}"), True)
                if not stay:
                    self._fs.delete(self._at(f"data/{name}/{commit}"), True)
        return gone

    bullets = property(lambda self: self.table("bullets"))
    archive = property(lambda self: self.table("archive"))
    conflicts = property(lambda self: self.table("conflicts"))
