"""A deterministic table of records over the test tables, in Spark and in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scoring
from ..shared import parted

AS_OF = "2025-01-01 00:00:00"
SECTIONS = ("techniques", "pitfalls", "preferences", "knowledge", "methods")
KINDS = ("Trick", "Pitfall", "Preference", "Knowledge", "Method")
GLOBAL_SOURCES = ("src0", "src1", "src2", "src3")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names; in a machine-local one only where none is named, as in tests."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='spark-')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A test table. spread: for work that is heavy on the CPU, deal the rows out if the files give fewer tasks than there are cores; larger tables stay as they are."""
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return out.repartition(cores) if spread and out.rdd.getNumPartitions() < cores else out


def bullets(spark: SparkSession, sf_dir: str, vectors: bool = False, spread: bool = False) -> DataFrame:
    """One record for each document, with ages, counts and kinds by arithmetic on its id; vectors joins the embeddings by id."""
    n = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % 5 + 1).cast("int"))
    created = F.timestamp_micros(F.unix_micros(as_of()) - (n % 400) * F.lit(86_400_000_000))
    recalls = (n % 20).cast("int")
    empty = F.array().cast("array<string>")
    docs = table(spark, sf_dir, "documents", spread)
    vector = F.lit(None).cast("array<float>")
    if vectors:
        # Only documents that have a vector are moved for it.
        known, vector = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), F.col("embedding")
        may, rest = parted(docs, "doc_id", known.select("doc_id"), known.count())
        docs = may.join(known, "doc_id", "left").unionByName(rest.withColumn("embedding", F.lit(None).cast(known.schema["embedding"].dataType)))
    out = docs.select(
        n.cast("string").alias("id"), F.when(F.col("source").isin(*GLOBAL_SOURCES), "global").otherwise(F.concat(F.lit("project:"), "source")).alias("scope"), pick(SECTIONS).alias("section"),
        F.col("text").alias("content"), F.lit(None).cast("string").alias("distilled_rule"), F.lit(None).cast("string").alias("code_content"), F.lit(None).cast("string").alias("code_language"),
        ((n * 37) % 101).cast("double").alias("instructivity_score"), pick(KINDS).alias("knowledge_type"), F.lit("auto").alias("source_type"), recalls.alias("recall_count"),
        F.when(recalls > 0, F.timestamp_micros(F.unix_micros(created) + (n % 30) * F.lit(86_400_000_000))).alias("last_recall"),
        scoring.decay_weight(created, recalls, as_of()).alias("decay_weight"), F.array("source").alias("related_tools"), empty.alias("related_files"), F.array(F.concat(F.lit("Lang-"), "lang")).alias("key_entities"),
        F.array("lang", "source").alias("tags"), vector.alias("embedding"), created.alias("created_at"), created.alias("updated_at"),
    )
    return out.select(*schemas.names(schemas.BULLETS))


def _pick_sql(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "][doc_id % 5 + 1]"


#: The same table as common table expressions; weight_of stands for the ageing formula.
AGE_SQL = "(epoch_us(TIMESTAMP '2025-01-01') - epoch_us(created_at)) / 86400000000.0"
WEIGHT_SQL = f"CASE WHEN recall_count >= 15 OR {AGE_SQL} <= 7 THEN 1.0 ELSE greatest(0.0, least(1.0, power(2.0, -({AGE_SQL}) / 30.0) * (1.0 + 0.3 * recall_count))) END"
BULLETS_SQL = f"""
made AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'global' ELSE 'project:' || source END AS scope,
    {_pick_sql(SECTIONS)} AS section, text AS content, CAST((doc_id * 37) % 101 AS DOUBLE) AS instructivity_score, {_pick_sql(KINDS)} AS knowledge_type,
    CAST(doc_id % 20 AS INTEGER) AS recall_count, TIMESTAMP '2025-01-01' - to_days(CAST(doc_id % 400 AS INTEGER)) AS created_at, [source] AS related_tools, ['Lang-' || lang] AS key_entities, [lang, source] AS tags, lang, source
  FROM documents
), bullets AS (
  SELECT *, CASE WHEN recall_count > 0 THEN created_at + to_days(CAST(doc_id % 30 AS INTEGER)) END AS last_recall, CAST({WEIGHT_SQL} AS DOUBLE) AS decay_weight FROM made
)"""
