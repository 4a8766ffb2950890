"""Catalog reads over the stored tables: browse, variants, lookups, quarantine, exports, media, upload tally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming


def like_title(name: Column, q: str | None) -> Column:
    """ASCII-case-insensitive substring search in which % and _ of the query stay wildcards and a backslash is itself."""
    pattern = "%" + (q or "").replace("\\", "\\\\") + "%" if q is not None else "%"
    return naming.ascii_lower(name).like("".join(c.lower() if c.isascii() else c for c in pattern))


def browse(title: DataFrame, edition: DataFrame, artifact: DataFrame, q: str | None = None, category: str | None = None, language: str | None = None, status: str | None = None) -> DataFrame:
    """Editions with their title, earliest year and number of variants; empty parameters don't filter.

    ``status`` verified or unverified keeps editions with or without a verified
    variant; any other value, quarantined too, keeps all.
    """
    t = title.select(F.col("id").alias("title_id"), F.col("name").alias("title"), "category")
    e = edition
    if q:
        t = t.where(like_title(F.col("title"), q))
    if category:
        t = t.where(F.col("category") == category)
    if language:
        e = e.where(F.col("language") == language)
    if status in ("verified", "unverified"):
        seen = artifact.where("verified").select(F.col("edition_id").alias("id"))
        e = e.join(seen, "id", "left_semi" if status == "verified" else "left_anti")
    # One row per variant first, so that a variant logged many times counts once.
    variants = artifact.where(F.col("edition_id").isNotNull()).groupBy("edition_id", "uid").agg(F.min("year").alias("year")).groupBy("edition_id").agg(F.count("*").alias("variant_count"), F.min("year").alias("year"))
    return e.join(t, "title_id").join(variants.withColumnRenamed("edition_id", "id"), "id", "left").select(
        "id", "title_id", "title", "category", "version", "language", "publisher", "qualifier", "disk_no", "disk_count", "year", F.coalesce("variant_count", F.lit(0).cast("long")).alias("variant_count"), "primary_artifact_uid",
    )


def browse_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("title", "language", "disk_no")


def variants(artifact: DataFrame, edition: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """Artifacts with edition fields, canonical name, size and whether they are their edition's primary; artifacts without edition stay."""
    e = edition.select(F.col("id").alias("edition_id"), "version", "language", "disk_no", "disk_count", "primary_artifact_uid")
    rows = artifact.join(e, "edition_id", "left").withColumn("is_primary", F.coalesce(F.col("uid") == F.col("primary_artifact_uid"), F.lit(False)))
    rows = rows.withColumn("canonical", naming.canonical_name(F.col("display_title"), F.col("version"), F.col("language"), F.col("disk_no"), F.col("disk_count"), F.col("uid"))).drop("primary_artifact_uid")
    return rows if blobs is None else rows.join(blobs.select(F.col("sha1").alias("blob_sha1"), "byte_len"), "blob_sha1", "left")


def lookup(artifact: DataFrame, wanted: DataFrame, key: str = "uid") -> DataFrame:
    """Artifacts of the wanted keys (uid, sha1 or edition_id)."""
    return artifact.join(wanted.select(key).distinct(), key, "left_semi")


def quarantine_list(quarantine: DataFrame, artifact: DataFrame) -> DataFrame:
    """``uid``, hashes and reason of what awaits a decision; repeats once."""
    q = quarantine.select(F.col("artifact_uid").alias("uid"), "reason").distinct()
    return artifact.select("uid", "sha1", "crc32", "md5").distinct().join(q, "uid")


def missing_editions(edition: DataFrame, artifact: DataFrame) -> DataFrame:
    """Editions without any artifact."""
    return edition.join(artifact.where(F.col("edition_id").isNotNull()).select(F.col("edition_id").alias("id")), "id", "left_anti")


def missing_titles(title: DataFrame, edition: DataFrame) -> DataFrame:
    """Titles without any edition."""
    return title.join(edition.select(F.col("title_id").alias("id")), "id", "left_anti")


def without_empties(catalog: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``catalog`` without editions that have no artifact, titles that then have no edition, and metadata and images of titles that are gone."""
    out = dict(catalog)
    out["edition"] = catalog["edition"].join(catalog["artifact"].where(F.col("edition_id").isNotNull()).select(F.col("edition_id").alias("id")), "id", "left_semi")
    out["title"] = catalog["title"].join(out["edition"].select(F.col("title_id").alias("id")), "id", "left_semi")
    for name in ("title_meta", "title_screenshot"):
        if name in catalog:
            out[name] = catalog[name].join(out["title"].select(F.col("id").alias("title_id")), "title_id", "left_semi")
    return out


def json_view(rows: DataFrame, name: str, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` as JSON texts, nulls kept: one object per row, or, with ``by``, one ``{name: [...]}`` per group in ``order``."""
    options = {"ignoreNullFields": "false"}
    if not by:
        return rows.select(F.to_json(F.struct(*rows.columns), options).alias("json"))
    fields = [c for c in rows.columns if c not in by]
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("r")))), lambda x: x["r"])
    return rows.groupBy(*by).agg(F.to_json(F.struct(listed.alias(name)), options).alias("json"))


def download(variants: DataFrame, blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``uid``, ``canonical``, ``content`` of the wanted uids: each once, under its canonical name, bytes unchanged."""
    one = lookup(variants, wanted).select("uid", "canonical", "blob_sha1").dropDuplicates(["uid"])
    return one.join(blobs.select(F.col("sha1").alias("blob_sha1"), "content"), "blob_sha1").select("uid", "canonical", "content")


def html_escaped(text: Column) -> Column:
    """Text with &, <, > and the double quote written out; null gives the empty text."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(F.coalesce(text, F.lit("")), F.lit(a), F.lit(b))
    return text


def admissible(filename: Column) -> Column:
    return F.coalesce(filename.rlike(r"(?i)\.(adf|adz|dms|zip)\z"), F.lit(False))


def upload_tally(uploads: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Uploads counted by outcome. ``uploads``: ``seq``, ``filename``, ``uid`` (of its content).

    Names of other kinds are rejected; the first admitted upload of a content is
    stored or quarantined, later ones are duplicates.
    """
    u = uploads.withColumn("ok", admissible(F.col("filename")))
    first = u.where("ok").groupBy("uid").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    held = quarantine.select(F.col("artifact_uid").alias("uid")).distinct().withColumn("q", F.lit(True))
    stored = first.join(held, "uid", "left").agg(F.count_if(F.coalesce("q", F.lit(False))).alias("quarantined"), F.count_if(F.col("q").isNull()).alias("stored"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate"))
    rejected = u.agg(F.count_if(~F.col("ok")).alias("rejected"))
    pick = lambda df, *names: df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("outcome"), F.col(n).cast("long").alias("uploads")) for n in names))).alias("x")).select("x.*")
    return pick(stored, "stored", "duplicate", "quarantined").unionByName(pick(rejected, "rejected")).where("uploads > 0")


def title_meta(meta: DataFrame, screenshots: DataFrame) -> DataFrame:
    """Metadata of titles with their images nested: the last cover by (ord, content) and all others in that order."""
    order = F.struct("ord", "blob_sha1")
    images = screenshots.groupBy("title_id").agg(
        F.max_by("blob_sha1", F.when(F.col("kind") == "cover", order)).alias("cover_sha1"), F.array_sort(F.collect_list(F.when(F.col("kind") != "cover", order))).alias("_s"),
    )
    return meta.join(images, "title_id", "left").withColumn("screenshots", F.coalesce(F.transform("_s", lambda s: s["blob_sha1"]), F.array().cast("array<string>"))).drop("_s")


def media(screenshots: DataFrame, blobs: DataFrame) -> DataFrame:
    """``sha1``, ``mime``, ``content`` of every stored image once."""
    one = screenshots.groupBy(F.col("blob_sha1").alias("sha1")).agg(F.min_by("mime", F.struct("title_id", "ord")).alias("mime"))
    return one.join(blobs.select("sha1", "content"), "sha1")
