"""Sets of ids: distinct tables for semi-joins, and a compact bitmap form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosift.staging import unused


def id_set(ids: DataFrame, *columns: str) -> DataFrame:
    """The distinct non-null ids."""
    return ids.select(*columns).dropna().distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def members(rows: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in the set."""
    return rows.join(ids, on, "left_semi")


def non_members(rows: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(ids, on, "left_anti")


def bitmap(ids: DataFrame, column: str = "id") -> DataFrame:
    """bucket, bits: one bitmap for each 32,768 ids; any bigint is allowed, negative ones included."""
    c = F.col(column)
    return ids.where(c.isNotNull()).groupBy(F.bitmap_bucket_number(c).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(c)).alias("bits"))


def bitmap_union(*bitmaps: DataFrame) -> DataFrame:
    rows = bitmaps[0]
    for b in bitmaps[1:]:
        rows = rows.unionByName(b)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_counts(bits: DataFrame) -> DataFrame:
    return bits.select("bucket", F.bitmap_count("bits").alias("n"))


def bitmap_members(rows: DataFrame, bits: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id has its bit set: an equi-join on the bucket, then one byte is looked at."""
    pos = F.bitmap_bit_position(F.col(column))
    bucket, own = unused("bucket", rows), unused("bits", rows)
    keyed = rows.withColumn(bucket, F.bitmap_bucket_number(F.col(column)))
    joined = keyed.join(bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(own)), bucket)
    byte = F.conv(F.hex(F.substring(own, (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.where(F.call_function("shiftright", byte, (pos % 8).cast("int")).bitwiseAND(1) == 1).select(*rows.columns)
