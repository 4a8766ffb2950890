"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, small

#: A key with more rows than this is joined by broadcast. N rows hold fewer than
#: N / HOT_ROWS such keys, so 10**11 rows bring at most 10**5 broadcast entries.
HOT_ROWS = 1_000_000
#: Blocks of more pairs than this are dealt to several tasks.
HOT_PAIRS = 1_000_000


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner equi-join of ``rows`` with ``keyed``, which is unique on ``on``.

    ``keyed[count]`` is the number of rows of each key in ``rows``. Rows of a key
    with more than ``hot_rows`` are dealt to several parts, and the key's entry is
    repeated for each, so no task receives all rows of a hot key; which keys those
    are is broadcast, provably few. ``rows`` are read once. Null keys match
    nothing. The count column is dropped from the result.
    """
    parts = F.ceil(F.col(count) / hot_rows).cast("int")
    hot = keyed.where(F.col(count) > hot_rows).select(*on, parts.alias("_parts"))
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.col("_parts"))).otherwise(0).cast("int")
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_part", part).drop("_parts")
    repeated = keyed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(count)
    return dealt.join(repeated, [*on, "_part"]).drop("_part")


def join_blocks(left: DataFrame, right: DataFrame, key: str, most: int = HOT_PAIRS) -> DataFrame:
    """Inner equi-join that pairs all rows of ``left`` and ``right`` with one ``key``, of equal names no other column.

    The rows of ``right`` of a block with more than ``most`` pairs are dealt to
    several parts and those of ``left`` are repeated for each, so no task
    compares a large block alone. Both are read twice.
    """
    size = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    pairs = F.col("_l") * F.col("_r")
    hot = small(durable(size(left, "_l").join(size(right, "_r"), key).where(pairs > most).select(key, F.ceil(pairs / most).cast("int").alias("_parts"))))
    parts = F.coalesce("_parts", F.lit(1))
    repeated = left.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    dealt = right.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*right.columns), parts).cast("int")).drop("_parts")
    return repeated.join(dealt, [key, "_part"]).drop("_part")
