"""Uploads to identified artifacts: exact duplicates, ids, hash match against a reference list, name grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flags, identity, naming
from ..session import durable, small

HASHES = ("sha1", "md5", "crc32")
INFO = ("dump_type", "crack_group", "trainer", "bad", "virus", "over", "under", "alt_index", "modifications", "verified_good", "lineage")
NAMED = ("title", "version", "language", "publisher", "year", "disk_no", "disk_count", "qualifier", "flags")


def first_of_each(images: DataFrame) -> DataFrame:
    """One row per content (sha1): the first to arrive keeps its name; later ones are duplicates whatever they are called.

    Only contents are shuffled to find those that came more than once; rows of
    all others stay where they are. Of one content under several names in one
    upload the first name by code point counts.
    """
    rest = [c for c in images.columns if c not in ("sha1", "ingest_seq")]
    repeated = images.groupBy("sha1").agg(F.count("*").alias("_n")).where("_n > 1").select("sha1")
    if repeated.isEmpty():
        return images.select("sha1", "ingest_seq", *rest)
    repeated = small(repeated)
    first = images.join(repeated, "sha1", "left_semi").groupBy("sha1").agg(F.min_by(F.struct("ingest_seq", *rest), F.struct("ingest_seq", "filename")).alias("_r")).select("sha1", "_r.*")
    return images.join(repeated, "sha1", "left_anti").select("sha1", "ingest_seq", *rest).unionByName(first)


def new_contents(images: DataFrame, stored: DataFrame) -> DataFrame:
    """Contents that the catalog doesn't hold yet."""
    return first_of_each(images).join(stored.select("sha1"), "sha1", "left_anti")


def hash_match(items: DataFrame, entries: DataFrame, key: str = "uid", strict: bool = False) -> DataFrame:
    """``key``, ``dat_id``: the list entry that shares a hash with each item, if any.

    An OR over three hashes would be a Cartesian product, so both sides are
    unpivoted to (kind, hash) and joined on equality. Order of hits: same sha1
    (entries without one come last, behind those with another), then same md5
    (likewise), then the lowest dat_id; with ``strict`` simply sha1, md5, crc32.
    """
    def side(df: DataFrame, k: str, *flags: Column) -> DataFrame:
        return df.select(k, *flags, F.explode(F.array(*(F.struct(F.lit(h).alias("kind"), F.col(h).alias("hash")) for h in HASHES))).alias("x")).select("*", "x.*").drop("x").where(F.col("hash").isNotNull())

    # Which hashes either side lacks goes along with each of its hashes.
    lacks = lambda prefix: [F.col(h).isNull().alias(f"{prefix}_no_{h}") for h in ("sha1", "md5")]
    listed = small(side(entries.select("dat_id", *HASHES), "dat_id", *lacks("their")).distinct())
    hits = side(items.select(key, *HASHES).distinct(), key, *lacks("own")).join(listed, ["kind", "hash"])
    per_hit = hits.groupBy(key, "dat_id").agg(*(F.max(F.col("kind") == h).alias(f"same_{h}") for h in HASHES), *(F.max(f"{p}_no_{h}").alias(f"{p}_no_{h}") for p in ("own", "their") for h in ("sha1", "md5")))
    if strict:
        order = F.struct(~F.col("same_sha1"), ~F.col("same_md5"), "dat_id")
    else:
        place = lambda h: F.when(F.col(f"own_no_{h}"), 2).when(F.col(f"same_{h}"), 0).when(F.col(f"their_no_{h}"), 2).otherwise(1)
        order = F.struct(place("sha1").alias("a"), place("md5").alias("b"), "dat_id")
    return per_hit.groupBy(key).agg(F.min_by("dat_id", order).alias("dat_id"))


def identified(images: DataFrame, entries: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Images (``sha1``, ``md5``, ``crc32``, ``filename``, ``ingest_seq``, ...) with identity, dump info, category, ``verified`` and ``tosec_name``.

    A hash match takes the list's name (its own fields if that doesn't parse),
    else the file name is parsed, else the title stays null (quarantine).
    ``images`` are read several times: write them down before, without content.
    ``stored`` (``sha1``, ``uid``) are the ids already given.
    """
    return naming.expand(named(identity.assign_uids(images, stored=stored), entries), flags.dump_info(F.col("flags")))


def named(rows: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Rows (``uid`` where there are ``entries``, hashes, ``filename``) with identity, category, ``verified`` and ``tosec_name``, as ``identified``."""
    parsed = naming.parse_name(F.col("filename"))
    if entries is None:
        rows = naming.expand(rows, parsed).withColumns({"verified": F.lit(False), "tosec_name": F.when(F.col("title").isNotNull(), F.col("filename")), "_source": F.lit(None).cast("string")})
    else:
        fallback = F.struct(
            F.coalesce("title", "name").alias("title"), F.col("version"), F.col("language"), F.col("publisher"), F.col("year").cast("int").alias("year"), F.col("disk_no").cast("long").alias("disk_no"),
            F.col("disk_count").cast("long").alias("disk_count"), F.lit(None).cast("string").alias("qualifier"), F.array().cast("array<string>").alias("flags"),
        )
        listed = entries.select("dat_id", F.col("name").alias("_list_name"), F.col("source").alias("_source"), F.coalesce(naming.parse_name(F.col("name")), fallback).alias("_listed"))
        match = small(durable(hash_match(rows, entries).join(listed, "dat_id")))
        rows = rows.join(match, "uid", "left")
        rows = naming.expand(rows, F.when(F.col("_listed").isNotNull(), F.col("_listed")).otherwise(parsed))
        rows = rows.withColumns({"verified": F.col("dat_id").isNotNull(), "tosec_name": F.when(F.col("dat_id").isNotNull(), F.col("_list_name")).when(F.col("title").isNotNull(), F.col("filename"))}).drop("dat_id", "_list_name", "_listed")
    return rows.withColumn("category", F.when(F.col("title").isNotNull(), flags.category(F.col("qualifier"), F.col("_source")))).drop("_source")
