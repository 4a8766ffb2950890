"""One row per key without moving the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many repeated keys are broadcast.
BROADCAST_KEYS = 1_000_000
#: 64-bit words of a table of bits, at most.
WORDS = 1 << 21


def once_per_key(rows: DataFrame, key: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` with one row for each value of ``key`` (null is one), any one of those that share it.

    Only keys are shuffled to find the repeated ones. Rows of other keys stay
    where they are, so wide rows (texts) aren't moved; those of repeated keys are
    set apart, and of them one each is kept. Beyond ``most`` repeated keys all
    rows are shuffled.
    """
    keys = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").select("_k")
    many = keys.count()
    if not many:
        return rows
    if many > most:
        return rows.dropDuplicates([key])
    same = lambda how: rows.join(F.broadcast(keys), F.col(key).eqNullSafe(F.col("_k")), how)
    return same("left_anti").unionByName(same("left_semi").dropDuplicates([key]))


def maybe_in(rows: DataFrame, column: Column, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: false only if ``keys`` (64-bit hashes ``k``) don't have the value of ``column``, without moving the rows.

    The keys set bits of a table that is broadcast; with many keys more rows are
    let in, never fewer.
    """
    words = min(WORDS, max(64, keys.count() // 2))
    spot = lambda x: F.pmod(x, F.lit(words * 64))
    table = keys.select(spot(F.col("k")).alias("_s")).groupBy(F.expr("shiftright(_s, 6)").alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_s & 63 as int)))").alias("_bits"))
    met = rows.withColumn("_s", spot(column)).withColumn("_w", F.expr("shiftright(_s, 6)")).join(F.broadcast(table), "_w", "left")
    return met.withColumn(name, F.expr("coalesce(shiftrightunsigned(_bits, cast(_s & 63 as int)) & 1 = 1, false)")).drop("_w", "_s", "_bits")
