"""One query for each corpus operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontam, html_extract, langid, lmscore, media, packing, pii, quality, resample, sharding, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out() -> Column:
    return F.coalesce(quality.fold(F.col("doc_id")) == quality.HELD_OUT, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs, _vocabulary("piece_bpe_32k.model")))
    return found.select("doc_id", _held_out(), "lang_pred", "score")


def op2_media_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.from_media(media.to_media(_table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        "feature", F.sha2("rgb", 256).alias("rgb_sha256"),
    )


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op5_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(F.encode(pii.listed(base), "UTF-8"), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_match", "longest_at",
    )


#: The target domain of op6: the documents of this source.
OP6_TARGET = "src1"


def op6_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    target = F.col("source") == OP6_TARGET
    return lmscore.score(docs, lmscore.fit(docs, target), target)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), pad=50257, end=50256)
    return found.select("block", "row_in_block", "n_tokens", "doc_ids", "doc_starts", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", _held_out(), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0
), windows AS (
  SELECT item_id, n, j, w[j : j + n - 1] AS win FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS j FROM sized)
), lens AS (
  SELECT DISTINCT n FROM windows
), spots AS (
  SELECT doc_id, n, i, w[i : i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lens)
), found AS (
  SELECT s.doc_id, s.i, s.n, x.item_id, x.j FROM spots s JOIN windows x ON s.n = x.n AND s.win = x.win
), runs AS (
  SELECT doc_id, count(*) + any_value(n) - 1 AS length, min(i) AS start
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM (SELECT DISTINCT doc_id, item_id, n, i, j FROM found)) GROUP BY doc_id, item_id, i - j, island
), longest AS (
  SELECT doc_id, max(length) AS longest_match, arg_min(start, (-length, start)) - 1 AS longest_at FROM runs GROUP BY doc_id
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.listed, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, CAST(coalesce(l.longest_match, 0) AS BIGINT) AS longest_match, CAST(coalesce(l.longest_at, -1) AS BIGINT) AS longest_at
FROM words w LEFT JOIN hits h USING (doc_id) LEFT JOIN named m USING (doc_id) LEFT JOIN longest l USING (doc_id)
"""

#: CRC-32 of a list of bytes, from a table that the rule of its polynomial gives.
CRC_SQL = """
crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs FROM (SELECT unnest(range(256)) AS i)
)"""
#: Bytes of a text's UTF-8 form, as numbers.
BYTES_SQL = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc_sql(text: str) -> str:
    """CRC-32 of a text, where crc_table is at hand as `crcs`."""
    return f"xor(list_reduce(list_prepend(4294967295, {BYTES_SQL.format(text)}), lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1])), 4294967295)"


OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER_SQL}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS size))
  ) GROUP BY lang, size, phrase
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2 AND f >= 10
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : size], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM candidates WHERE size = 3
), longer AS (
  SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY lang, phrase
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank FROM best b LEFT JOIN longer g USING (lang, phrase) WHERE g.most IS NULL OR 100 * g.most < 50 * b.a
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(t.n AS BIGINT) AS n, r.score FROM ranked r JOIN totals t USING (lang) WHERE r.rank <= 2000
"""

OP12_SQL = f"""
WITH {CRC_SQL}, sized AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, substr(md5(coalesce(text, '')), 1, 16) AS g, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS h FROM documents
), placed AS (
  SELECT *, row_number() OVER (ORDER BY g, h) - 1 AS i, sum(size) OVER (ORDER BY g, h ROWS UNBOUNDED PRECEDING) - size AS before FROM sized
), total AS (
  SELECT sum(size) AS bytes, count(*) AS n FROM sized
), groups AS (
  SELECT g, sum(size) AS bytes, min(i) AS low, max(i) AS high FROM placed GROUP BY g
), cuts AS (
  SELECT k, coalesce((SELECT min(i) FROM placed WHERE before * 16 >= k * (SELECT bytes FROM total)), (SELECT n FROM total)) AS c FROM (SELECT unnest(range(1, 16)) AS k)
), moved AS (
  SELECT k, CASE WHEN g.low < c AND g.bytes * 1024 <= (SELECT bytes FROM total) THEN g.high + 1 ELSE c END AS c FROM cuts LEFT JOIN groups g ON g.low <= c AND c <= g.high
), sharded AS (
  SELECT p.*, (SELECT count(*) FROM moved WHERE c <= i) AS shard FROM placed p
)
SELECT doc_id, size, CAST({crc_sql("t")} AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, i - min(i) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM sharded, crc_table
"""

OP13_SQL = rf"""
WITH {CRC_SQL}, words AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), target AS (
  SELECT regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sizes AS (
  SELECT unnest([1, 2, 3]) AS size
), own AS (
  SELECT doc_id, array_to_string(w[i : i + size - 1], ' ') AS f FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes)
), wanted AS (
  SELECT array_to_string(w[i : i + size - 1], ' ') AS f FROM (SELECT w, size, unnest(range(1, len(w) - size + 2)) AS i FROM target, sizes)
), hashed AS (
  SELECT f, {crc_sql("f")} % 10000 AS bucket FROM (SELECT f FROM own UNION SELECT f FROM wanted), crc_table
), own_counts AS (
  SELECT bucket, count(*) AS s FROM own JOIN hashed USING (f) GROUP BY bucket
), wanted_counts AS (
  SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM own) + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM wanted) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM own_counts FULL JOIN wanted_counts USING (bucket)
), weights AS (
  SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM own JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (doc_id)
), able AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT s.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN a.rank <= 5 * a.n // 100 THEN a.rank END AS rank FROM scored s LEFT JOIN able a USING (doc_id)
"""


def encoded(docs: DataFrame) -> DataFrame:
    """The digests of bpe.encode() over a table of documents."""
    found = bpe.encode(docs, _vocabulary("byte_bpe_50k.json"), decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_media_progressive_jpeg": op2_media_progressive_jpeg,
        "op3_html_main_text": op3_html_main_text,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_pii_anchor_expansion": op5_pii_anchor_expansion,
        "op6_cross_entropy_difference": op6_cross_entropy_difference,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_bpe_encode_decode": op10_bpe_encode_decode,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_sharding": op12_sharding,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_benchmark_decontamination": OP9_SQL, "op11_phrase_collocations": OP11_SQL, "op12_sharding": OP12_SQL, "op13_importance_resampling": OP13_SQL}
