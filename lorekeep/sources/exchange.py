"""Export as JSON or Markdown and import of JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..shared import numbered

EXPORT_VERSION = 1
_FIELDS = [f"{n} {t}" for n, t in ((c.strip().split(" ", 1)) for c in schemas.BULLETS.split(",")) if n != "embedding"]
ENVELOPE = f"export_version int, exported_at string, source_project string, bullet_count int, bullets array<struct<{', '.join(f.replace(' ', ': ', 1) for f in _FIELDS)}>>"


def export_rows(bullets: DataFrame) -> DataFrame:
    """One JSON object for each record, without its vector: for exports of any size, written by the tasks."""
    return bullets.select("id", F.to_json(F.struct(*[c for c in bullets.columns if c != "embedding"]), {"ignoreNullFields": "false"}).alias("json"))


def export_json(bullets: DataFrame, exported_at: str, project: str | None = None) -> str:
    """The envelope with all records as indented JSON text: a document for people, made on the driver. Use export_rows() for large tables."""
    rows = [json.loads(r.json) for r in export_rows(bullets).orderBy("id").select("json").toLocalIterator()]
    return json.dumps({"export_version": EXPORT_VERSION, "exported_at": exported_at, "source_project": project or "unknown", "bullet_count": len(rows), "bullets": rows}, indent=2, ensure_ascii=False)


def save(spark: SparkSession, text: str, path: str) -> None:
    """Write an export's text to a path of any file system that Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def markdown_lines() -> Column:
    """A record's line, and a second one for its code."""
    content = F.regexp_replace("content", r"([|#])", r"\\$1")
    # Whole scores are written without decimals.
    score = F.when(F.col("instructivity_score") == F.floor("instructivity_score"), F.col("instructivity_score").cast("long").cast("string")).otherwise(F.col("instructivity_score").cast("string"))
    line = F.concat(F.lit("- **["), F.col("knowledge_type"), F.lit("]** "), content, F.lit(" (score: "), score, F.lit(", recalled "), F.col("recall_count").cast("string"), F.lit("x)"))
    code = F.when(F.coalesce("code_content", F.lit("")) != "", F.concat(F.lit("\n  > `"), F.regexp_replace("code_content", "\n", " "), F.lit("`"))).otherwise("")
    return F.concat(line, code)


def export_markdown_rows(bullets: DataFrame) -> DataFrame:
    """(id, section, decay_weight, line) of each record."""
    return bullets.select("id", "section", "decay_weight", markdown_lines().alias("line"))


def export_markdown(bullets: DataFrame, exported_on: str, project: str | None = None, title: str = "Playbook Export") -> str:
    """Records by section, sections in the order in which the ranking by weight meets them first."""
    rows = list(export_markdown_rows(bullets).orderBy(F.desc("decay_weight"), "id").toLocalIterator())
    out = [f"# {title}", f"> Exported: {exported_on} | Bullets: {len(rows)}" + (f" | Project: {project}" if project else ""), ""]
    groups: dict[str, list[str]] = {}
    for r in rows:
        groups.setdefault(r.section, []).append(r.line)
    for section, lines in groups.items():
        out += [f"## {section[:1].upper()}{section[1:]}", *lines, ""]
    return "\n".join(out)


# Documents of any size: their lines are rows with a number, made and written by tasks


def markdown_rows(bullets: DataFrame, exported_on: str, project: str | None = None, title: str = "Playbook Export") -> DataFrame:
    """(n, line): the lines of export_markdown(), numbered from 0, for any number of records. The count is the only thing that comes to the driver."""
    own = export_markdown_rows(bullets)
    place = F.struct((-F.col("decay_weight")).alias("w"), F.col("id").alias("id"))
    # A section stands where its first record would.
    met = own.groupBy("section").agg(F.min(place).alias("first"))
    nothing = own.select(place.alias("p")).limit(0).schema["p"].dataType
    null = F.lit(None).cast(nothing)
    row = lambda first, part, place, k, line: [first.alias("first"), F.lit(part).alias("part"), place.alias("place"), k.cast("int").alias("k"), line.alias("line")]
    zero = F.lit(0)
    heads = met.select(*row(F.col("first"), 0, null, zero, F.concat(F.lit("## "), F.upper(F.substring("section", 1, 1)), F.expr("substring(section, 2)"))))
    ends = met.select(*row(F.col("first"), 2, null, zero, F.lit("")))
    firsts = met.select(F.col("section").alias("of"), "first")
    body = own.join(firsts, F.col("section").eqNullSafe(F.col("of"))).select("first", place.alias("place"), F.posexplode(F.split("line", "\n")).alias("k", "line"))
    body = body.select(*row(F.col("first"), 1, F.col("place"), F.col("k"), F.col("line")))
    total = bullets.count()
    top = [f"# {title}", f"> Exported: {exported_on} | Bullets: {total}" + (f" | Project: {project}" if project else ""), ""]
    head = bullets.sparkSession.createDataFrame(list(enumerate(top)), "k int, line string").select(*row(null, 0, null, F.col("k"), F.col("line")))
    every = head.unionByName(heads).unionByName(body).unionByName(ends)
    order = [F.asc_nulls_first("first"), F.asc("part"), F.asc_nulls_first("place"), F.asc("k")]
    return numbered(every, *order).select("n", "line")


def json_rows(bullets: DataFrame, exported_at: str, project: str | None = None) -> DataFrame:
    """(n, line): the envelope of export_json() with a line for each record, in the order of the ids, for any number of records."""
    total = bullets.count()
    own = numbered(export_rows(bullets), F.asc("id")).select((F.col("n") + 1).alias("n"), F.concat(F.lit("    "), F.col("json"), F.when(F.col("n") < total - 1, ",").otherwise("")).alias("line"))
    head = json.dumps({"export_version": EXPORT_VERSION, "exported_at": exported_at, "source_project": project or "unknown", "bullet_count": total}, ensure_ascii=False)[:-1] + ', "bullets": ['
    return own.unionByName(bullets.sparkSession.createDataFrame([(0, head), (total + 1, "]}")], "n long, line string"))


def write_lines(rows: DataFrame, path: str) -> None:
    """Write numbered lines as text: the part files in the order of their names are the document."""
    rows.repartitionByRange("n").sortWithinPartitions("n").select("line").write.text(path)


def distilled_from(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exported records in the distilled layout, with the columns `keep`; missing, empty and zero values get their defaults."""
    other = {"scope": "global", "section": "knowledge", "content": "", "knowledge_type": "Knowledge"}
    empty = F.array().cast("array<string>")
    made = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in other.items()}
    made |= {"instructivity_score": F.coalesce("instructivity_score", F.lit(0.0)), "source_type": F.lit("imported"), "embedding": F.lit(None).cast("array<float>")}
    made |= {c: F.coalesce(c, empty) for c in ("related_tools", "related_files", "key_entities", "tags")}
    return rows.select(*keep, *[made.get(c, F.col(c)).alias(c) for c in schemas.names(schemas.DISTILLED)])


#: Between two records of an envelope with an indent of two; line breaks inside texts are escaped, so it stands nowhere else.
_BETWEEN = "\n    },\n    {\n"


def _start(spark: SparkSession, path: str, most: int = 65536) -> str:
    """The first bytes of a file, or of the first part file of a folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        parts = sorted(str(f.getPath().toString()) for f in fs.listStatus(where) if f.getPath().getName().startswith("part-") and f.getLen())
        if not parts:
            return ""
        where = jvm.org.apache.hadoop.fs.Path(parts[0])
    source = fs.open(where)
    try:
        return bytes(source.readNBytes(most)).decode("utf-8", "replace")
    finally:
        source.close()


def import_split(spark: SparkSession, path: str) -> DataFrame | None:
    """Records of an export in the distilled layout, with seq, read by as many tasks as the document has splits; None if it has neither a line for each record nor an indent of two.

    The document is cut at record ends by Spark's reader of texts, whose splits are ranges of bytes. Raises for a record that isn't an object.
    """
    start = _start(spark, path)
    head, found, rest = start.partition('"bullets": [')
    version = json.loads(head.rstrip().rstrip(",") + "}").get("export_version") if found and head.strip().startswith("{") else None
    if not found or version is None:
        return None
    rest = rest.lstrip("\n")
    if rest.startswith("    {\n"):
        lines = spark.read.option("lineSep", _BETWEEN).text(path)
        text = F.concat(F.lit("{"), F.regexp_replace(F.regexp_replace("value", r'(?s)\A\{\s*"export_version".*?"bullets": \[\n    \{\n', ""), r"\n    \}\n  \]\n\}\s*\z", ""), F.lit("}"))
    elif rest.startswith("    {") or rest.startswith("]}"):
        lines = spark.read.text(path).where(F.col("value").startswith("    {"))
        text = F.regexp_replace(F.substring("value", 5, 2**31 - 1), r",\z", "")
    else:
        return None
    # Lines of a split keep their order, and splits are told apart by file and place.
    own = lines.select(F.from_json(text, ", ".join(_FIELDS) + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("b"), F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    own = numbered(own, F.asc("f"), F.asc("at"), F.asc("k"), name="seq").select("seq", "b.*")
    bad = F.when(F.col("_bad").isNotNull(), F.raise_error("not a record: " + "see the export's text")).otherwise(F.col("seq"))
    return distilled_from(own.withColumn("seq", bad.cast("int")), ("seq",))


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of an export in the distilled layout, with seq, their place in it. Raises if the file isn't an export. One in a form that can be split is read by many tasks."""
    try:
        split = import_split(spark, path)
    except (json.JSONDecodeError, UnicodeDecodeError):
        split = None
    if split is not None:
        return split
    got = spark.read.schema(ENVELOPE + ", _bad string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    head = got.select("_bad", "export_version", F.col("bullets").isNotNull().alias("listed")).collect()
    if not head or head[0]["_bad"] is not None:
        raise ValueError("not a JSON object")
    if head[0]["export_version"] is None:
        raise ValueError("export_version is missing")
    if not head[0]["listed"]:
        raise ValueError("bullets is missing")
    return distilled_from(got.select(F.posexplode("bullets").alias("seq", "b")).select("seq", "b.*"), ("seq",))
