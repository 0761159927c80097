"""Records of one scope that contradict each other.

Each record lists the sides it takes: of antonyms in its section, of negations in its section and for
each entity, and of versions of a thing. Contradictions are equal keys with different sides, so finding them is an
equi-join on scope, key and side, not a comparison of all pairs of a scope. The sides are made once, as ids alone; texts and vectors are
fetched for those that need them. Every pair that opposite sides form is a result, but for the semantic kind: there the vectors of both sides meet
in cells that may be near enough, and only pairs that are near are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFLICT_SIMILARITY
from ..functions import text as T
from ..shared import written
from .nearest import near_pairs, usable

# Antonyms, in the order in which they are tried.
ANTONYMS = (("always", "never"), ("use", "avoid"), ("enable", "disable"), ("must", "must not"), ("recommend", "discourage"), ("始终", "不要"), ("使用", "避免"), ("开启", "关闭"))
# What speaks for something and against it: whole English words, and CJK words anywhere.
NEGATIONS = (
    (("always", "must"), ("始终",), ("never", "must not"), ("不要",)),
    (("use",), ("使用",), ("avoid", "don't use"), ("避免",)),
    (("enable",), ("开启",), ("disable",), ("关闭",)),
    (("recommend",), ("推荐",), ("discourage",), ("不推荐",)),
)
VERSION = T.BEFORE + r"([A-Za-z0-9_]+)\s+[vV]?([0-9]+(?:\.[0-9]+)*)" + T.BEHIND
KINDS = ("semantic", "negation", "version")


def versions(content: Column) -> Column:
    """(name in lower case, version) of each thing with a version: the last version of each, in the order of first mention."""
    # The text is searched once; a match's name and version are told apart in the match.
    every = F.regexp_extract_all(content, F.lit(VERSION), F.lit(0))
    pairs = F.transform(every, lambda m: F.struct(F.lower(F.regexp_extract(m, r"^([A-Za-z0-9_]+)", 1)).alias("name"), F.regexp_extract(m, r"([0-9]+(?:\.[0-9]+)*)\z", 1).alias("version")))
    return T.bound(pairs, lambda p: F.transform(F.array_distinct(F.transform(p, lambda x: x["name"])), lambda n: F.element_at(F.filter(p, lambda x: x["name"] == n), -1)))


def _side(kind: int, order: int | Column, key: Column, side: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(order) if isinstance(order, int) else order).cast("int").alias("ord"), key.alias("key"), side.alias("side"))


_SIDES = "array<struct<kind:int,ord:int,key:string,side:string>>"


def _antonym_sides() -> Column:
    low = F.col("_low")
    sides = [F.when(low.contains(w), _side(0, i, F.concat_ws("|", "section", F.lit(str(i))), F.lit(s))) for i, pair in enumerate(ANTONYMS) for s, w in zip("ab", pair, strict=True)]
    return F.when(F.col("embedding").isNotNull(), F.array_compact(F.array(*sides))).otherwise(F.array().cast(_SIDES))


def _negation_sides() -> Column:
    out = []
    names = F.array_distinct(F.concat(F.array(F.concat(F.lit("s|"), F.col("section"))), F.transform(F.coalesce("key_entities", F.array().cast("array<string>")), lambda e: F.concat(F.lit("e|"), F.lower(e)))))

    def taking(i: int, side: str) -> Column:
        return F.transform(names, lambda n: _side(1, i, F.concat_ws("|", n, F.lit(str(i))), F.lit(side)))

    for i, (words, cjk, against, against_cjk) in enumerate(NEGATIONS):
        for side, english, other in (("a", words, cjk), ("b", against, against_cjk)):
            # Most texts have none of the words at all, which is quicker to see than where words begin and end.
            some = F.reduce(F.array(*[F.contains(F.col("_low"), F.lit(w)) for w in (*english, *other)]), F.lit(False), lambda x, y: x | y)
            taken = some & F.col("content").rlike("(?i)" + "|".join([T.words(*english), *other]))
            out.append(F.when(taken, taking(i, side)).otherwise(F.array().cast(_SIDES)))
    return F.flatten(F.array(*out))


def _version_sides() -> Column:
    return F.transform(versions(F.col("content")), lambda v, i: _side(2, i, v["name"], v["version"]))


def _sides(d: DataFrame) -> DataFrame:
    """(scope, id, kind, ord, key, side): one scan of the records, written, as every join below reads them."""
    made = d.withColumn("_low", F.lower("content")).select("scope", "id", F.explode(F.concat(_antonym_sides(), _negation_sides(), _version_sides())).alias("x")).select("scope", "id", "x.*")
    return written(made, "sides", keep=True)


def _apart(both: bool) -> Column:
    return (F.col("a_id") < F.col("b_id")) if both else (F.col("a_id") != F.col("b_id"))


def _end(sides: DataFrame, kind: int, p: str, opposite: bool = False) -> DataFrame:
    """One end of a pair. meets: the side, or of the other end the one that it's opposite to, so that records of one side never meet, however many share it."""
    own = F.col("side")
    meets = F.when(own == "a", "b").otherwise("a") if opposite else own
    return sides.where(F.col("kind") == kind).select("scope", "key", meets.alias("meets"), F.col("id").alias(f"{p}_id"), F.col("ord").alias(f"{p}_ord"))


def semantic_ends(a: DataFrame, b: DataFrame, a_sides: DataFrame, b_sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both ends of the semantic kind with their vectors: what near_pairs() compares."""
    vectors = lambda d, p: usable(d, "id").select(F.col("i").alias(f"{p}_id"), "v")
    mine = written(_end(a_sides, 0, "a").join(vectors(a, "a"), "a_id"), "ends", keep=True)
    return mine, written(_end(b_sides, 0, "b", True).join(vectors(b, "b"), "b_id"), "ends", keep=True)


def _between(a: DataFrame, b: DataFrame, as_of: Column, similarity: float, both: bool) -> DataFrame:
    mine = _sides(a)
    theirs = mine if both else _sides(b)
    ends = ["scope", "key", "meets"]
    row = lambda kind, s, detail: [F.struct(F.lit(kind).alias("k"), F.col("a_ord").alias("o")).alias("first"), "a_id", "b_id", s.alias("s"), detail.alias("detail")]
    none = F.lit(None).cast("string")
    near = near_pairs(*semantic_ends(a, b, mine, theirs), tuple(ends), similarity)
    found = near.where(_apart(both)).select(*row(0, F.col("s"), none))
    negation = _end(mine, 1, "a").join(_end(theirs, 1, "b", True), ends).where(_apart(both))
    found = found.unionByName(negation.select(*row(1, F.lit(None).cast("double"), none)))
    # Distinct versions are paired first and the records joined to these, so equal ones never meet.
    one, two = _end(mine, 2, "a").withColumnRenamed("meets", "a_side"), _end(theirs, 2, "b").withColumnRenamed("meets", "b_side")
    values = one.select("scope", "key", "a_side").distinct().join(two.select("scope", "key", "b_side").distinct(), ["scope", "key"]).where("a_side <> b_side")
    version = values.join(one, ["scope", "key", "a_side"]).join(two, ["scope", "key", "b_side"]).where(_apart(both))
    found = found.unionByName(version.select(*row(2, F.lit(None).cast("double"), F.concat_ws(" ", F.lit("Version mismatch:"), "key", "a_side", F.lit("vs"), "b_side"))))
    # One row for each pair: the first kind, and of it the first cause.
    best = found.groupBy("a_id", "b_id").agg(F.min(F.struct("first", "detail", "s")).alias("m"))
    texts = lambda d, p: d.select(F.col("id").alias(f"{p}_id"), F.substring("content", 1, 80).alias(f"{p}_text"))
    quoted = best.join(texts(a, "a"), "a_id").join(texts(b, "b"), "b_id")
    quote = lambda p: F.concat(F.lit('"'), F.col(f"{p}_text"), F.lit('"'))
    names = F.element_at(F.array(*[F.lit("/".join(p)) for p in ANTONYMS]), F.col("m.first.o") + 1)
    said = (
        F.when(F.col("m.first.k") == 0, F.concat(F.format_string("Semantic contradiction (similarity: %.2f, antonyms: ", F.col("m.s")), names, F.lit("): "), quote("a"), F.lit(" vs "), quote("b")))
        .when(F.col("m.first.k") == 1, F.concat(F.lit("Direct negation: "), quote("a"), F.lit(" vs "), quote("b")))
        .otherwise(F.col("m.detail"))
    )
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("m.first.k") + 1)
    id = F.sha2(F.encode(F.concat_ws("|", F.least("a_id", "b_id"), F.greatest("a_id", "b_id"), kind), "UTF-8"), 256)
    return quoted.select(
        id.alias("id"), F.col("a_id").alias("bullet_id_a"), F.col("b_id").alias("bullet_id_b"), kind.alias("conflict_type"), said.alias("description"), F.lit(0).alias("resolved"),
        F.lit(None).cast("timestamp").alias("resolved_at"), as_of.cast("timestamp").alias("created_at"),
    )


def detect_conflicts(new: DataFrame, bullets: DataFrame, as_of: Column, similarity: float = CONFLICT_SIMILARITY) -> DataFrame:
    """Conflicts of new records with others, at most one for each pair, the new one first. Pairs among the new ones come once."""
    out = _between(new, bullets, as_of, similarity, False)
    return out.withColumn("_lo", F.least("bullet_id_a", "bullet_id_b")).withColumn("_hi", F.greatest("bullet_id_a", "bullet_id_b")).groupBy("_lo", "_hi").agg(F.min_by(F.struct(*out.columns), "bullet_id_a").alias("c")).select("c.*")


def all_conflicts(bullets: DataFrame, as_of: Column, similarity: float = CONFLICT_SIMILARITY) -> DataFrame:
    """Conflicts between all records of each scope; of a pair the smaller id comes first."""
    return _between(bullets, bullets, as_of, similarity, True)
