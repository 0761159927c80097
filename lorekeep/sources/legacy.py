"""Rows as a row store keeps them: arrays as JSON text, vectors as raw 32-bit floats, times as ISO text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas

ARRAYS = ("related_tools", "related_files", "key_entities", "tags")


def decoded(rows: DataFrame) -> DataFrame:
    """Records from stored rows. Text that isn't a JSON array becomes null, a vector's bytes that don't make up whole floats are cut."""
    hexed = F.hex("embedding")
    n = F.floor(F.octet_length("embedding") / 4).cast("int")
    # Four bytes, last first, are sign, exponent and fraction.
    value = lambda h: F.conv(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")

    def number(h):
        bits = value(h)
        sign = F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0)
        power, part = F.shiftright(bits, 23).bitwiseAND(0xFF), bits.bitwiseAND(0x7FFFFF)
        small = F.pow(F.lit(2.0), F.lit(-149.0)) * part
        normal = F.pow(F.lit(2.0), (power - 150).cast("double")) * (part + 0x800000)
        special = F.when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
        return (sign * F.when(power == 0, small).when(power == 255, special).otherwise(normal)).cast("float")

    vector = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: number(F.substring(hexed, i * 8 + 1, F.lit(8))))).when(n == 0, F.array().cast("array<float>"))
    kinds = {f.name: f.dataType for f in StructType.fromDDL(schemas.BULLETS)}
    own = {c: F.from_json(c, "array<string>") for c in ARRAYS} | {"embedding": vector} | {c: F.try_to_timestamp(c) for c in ("last_recall", "created_at", "updated_at")}
    return rows.select(*[own.get(c, F.col(c)).cast(k).alias(c) for c, k in kinds.items()])


def encoded(bullets: DataFrame) -> DataFrame:
    """Stored rows from records, without their vectors."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    own = {c: F.to_json(F.coalesce(c, F.array().cast("array<string>"))) for c in ARRAYS} | {c: iso(c) for c in ("last_recall", "created_at", "updated_at")}
    return bullets.select(*[own.get(c, F.col(c)).alias(c) for c in bullets.columns if c != "embedding"])


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tool events from lines of JSON; lines that can't be parsed give a row of nulls, which detection passes over."""
    return lines.select(F.from_json(column, schemas.EVENTS, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
