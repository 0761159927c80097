"""Bounded samples of labelled texts for the fitted operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balanced(known: DataFrame, rows: int, most_bytes: int) -> DataFrame:
    """(g, y, t, n): texts of each group, in an order that only depends on the rows, n of each.

    known: (i, t, g, y) with a group, a text and something to go with it in each row. Each group gives `rows` rows, or all if it has fewer, and texts of `most_bytes` together at most
    (one text at least). Rows are taken in the order of a hash of id and text, and equal rows are counted before anything is shuffled, so
    neither null or repeated ids nor copies of one text can flood or empty the sample.
    """
    space = 1 << 40
    hashed = known.withColumn("h", F.pmod(F.xxhash64("i", "t"), F.lit(space)))
    sizes = hashed.groupBy("g").agg(F.approx_count_distinct("h", 0.02).alias("d"), F.min("h").alias("m"))
    # Twice as many different rows as needed, and the first one in any case.
    sizes = sizes.select("g", F.greatest("m", F.least(F.lit(float(space)), F.lit(2.0 * rows * space) / F.col("d"))).alias("least"))
    near = hashed.join(F.broadcast(sizes), "g").where(F.col("h") <= F.col("least"))
    each = near.groupBy("g", "y", "t").agg(F.min("h").alias("h"), F.count("*").alias("n"))
    before = Window.partitionBy("g").orderBy("h", "t", "y").rowsBetween(Window.unboundedPreceding, -1)
    taken = each.withColumn("b", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("s", F.coalesce(F.sum(F.octet_length("t")).over(before), F.lit(0)))
    taken = taken.where((F.col("b") < rows) & ((F.col("b") == 0) | (F.col("s") + F.octet_length("t") <= most_bytes)))
    return taken.select("g", "y", "t", F.least(F.col("n"), F.lit(rows) - F.col("b")).cast("int").alias("n")).orderBy("g", "t", "y")
