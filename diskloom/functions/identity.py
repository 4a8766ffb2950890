"""Content hashes and short ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small
from .naming import UID_LENGTH


def hashes(content: Column) -> list[Column]:
    """sha1, md5 and crc32 of a binary column, lower-case hex."""
    return [F.sha1(content).alias("sha1"), F.md5(content).alias("md5"), F.lower(F.lpad(F.hex(F.crc32(content)), 8, "0")).alias("crc32")]


def short_id(sha1: Column, length: int = UID_LENGTH) -> Column:
    return F.substring(sha1, 1, length)


def normalized_hash(x: Column) -> Column:
    return F.nullif(F.lower(F.trim(x)), F.lit(""))


def walk_prefix(group: pd.DataFrame) -> pd.DataFrame:
    """Ids of one prefix: rows that have one keep it, the others get the shortest that no earlier content owns, in order of arrival."""
    owned = set(group["uid"].dropna())
    out = []
    fresh = group[group["uid"].isna()].sort_values(["seq", "sha1"])
    for sha1 in fresh["sha1"]:
        n = UID_LENGTH
        while n < len(sha1) and sha1[:n] in owned:
            n += 1
        owned.add(sha1[:n])
        out.append((sha1, sha1[:n]))
    return pd.DataFrame(out, columns=["sha1", "uid"])


def assign_uids(rows: DataFrame, order: str = "ingest_seq", stored: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``uid``: the shortest prefix of ten or more digits that no earlier sha1 owns, ``stored`` (``sha1``, ``uid``) being earlier than all.

    ``rows`` has distinct ``sha1`` that ``stored`` lacks. A longer uid keeps its
    first ten digits, so prefixes never meet across groups. Only prefixes are
    counted; nearly all are single and are the uid, and only the contents of the
    others are walked, a handful for each by the uniformity of the hash.
    """
    fresh = rows.select("sha1", F.col(order).alias("seq"), F.lit(None).cast("string").alias("uid"))
    known = fresh if stored is None else fresh.unionByName(stored.select("sha1", F.lit(None).cast(fresh.schema["seq"].dataType).alias("seq"), "uid"))
    known = known.withColumn("_prefix", short_id(F.col("sha1")))
    shared = small(known.groupBy("_prefix").agg(F.count("*").alias("_n")).where("_n > 1").select("_prefix"))
    walked = known.join(shared, "_prefix", "left_semi").groupBy("_prefix").applyInPandas(walk_prefix, "sha1 string, uid string").withColumnRenamed("uid", "_walked")
    return rows.join(small(walked), "sha1", "left").withColumn("uid", F.coalesce("_walked", short_id(F.col("sha1")))).drop("_walked")
