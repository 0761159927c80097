"""From raw documents to token ids: quality, near-duplicates, benchmark passages, personal data, encoding.

Each stage works on all documents that the one before it kept, and its result is written and read again, so a lost
executor costs one stage at most.

In every stage a null text counts as an empty one, rows with a null id or equal ids are rows like any others, texts of any length are worked on whole, columns that the stages don't
name are carried along whatever they are called (but for the last stage, which returns digests), and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import decontam, pii, quality, simhash
from lorekeep.llm._batches import written
from lorekeep.llm.queries import encoded


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Repeated rows share their score, so all or none of them stay; a text without words has the score of the zero vector."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, one row of it if the id is repeated. Rows without an id stand behind those with one."""
    return simhash.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; those without words stay, and so do all if the benchmark is empty."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars to match. Null texts stay null."""
    return pii.redact(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the digests of its token ids and of the text that they decode to; repeated documents each get a row."""
    return encoded(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("BPE encoding and decoding", encode_tokens),
]

#: No stage but the third can be put into SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
