"""Ingest of a batch of uploads into the catalog: decode, hash, deduplicate, identify, file, choose primaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..schema import TABLES
from ..session import durable, spread
from ..sources.containers import decode
from . import identify, maintain, sets
from .once import maybe_in

#: Why a content is put in quarantine.
REASON = "no list match and no name that parses"


def empty(spark, name: str) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([], TABLES[name])


def images_of(uploads: DataFrame, raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images without content, failed uploads with ``error``), written down once.

    ``raw`` uploads are plain images already, told by their name, and aren't decoded.
    """
    if raw:
        decoded = spread(uploads).select("ingest_seq", F.col("filename").alias("name"), F.lit("adf").alias("container"), "content", F.lit(None).cast("string").alias("error"))
    else:
        decoded = decode(uploads)
    narrow = durable(decoded.select("ingest_seq", F.col("name").alias("filename"), "container", *identity.hashes(F.col("content")), F.length("content").cast("long").alias("byte_len"), "error"))
    return narrow.where(F.col("error").isNull()).drop("error"), narrow.where(F.col("error").isNotNull()).select("ingest_seq", "filename", "error")


def known_flags(artifact: DataFrame) -> DataFrame:
    """``artifact`` with unknown flags false and unknown counts 0."""
    return artifact.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("bad", "virus", "over", "under", "verified_good")} | {c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("alt_index", "modifications")})


def stored_members(title: DataFrame, edition: DataFrame, artifact: DataFrame) -> DataFrame:
    """Artifacts with the identity of their edition, as the operators on sets take them; unknown flags are false, unknown counts 0."""
    known = edition.select(F.col("id").alias("edition_id"), *maintain.KEY).join(title.select(F.col("id").alias("title_id"), F.col("name").alias("title"), "category"), "title_id")
    return known_flags(artifact).join(known, "edition_id")


def primaries_of(edition: DataFrame, artifact: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """``edition_id``, ``uid``: the primary of every edition with artifacts (null if none is sound) in the sets of the ``touched`` editions (``edition_id``), or in all."""
    keys = tuple(k for k in maintain.KEY if k != "disk_no")
    numbered = edition.groupBy(*keys).agg(F.min("id").alias("set"))
    if touched is not None:
        hit = edition.join(touched.select(F.col("edition_id").alias("id")).distinct(), "id", "left_semi").select(*keys).distinct()
        numbered = numbered.alias("n").join(hit.alias("h"), maintain.null_safe("n", "h", keys), "left_semi")
    numbered = durable(edition.alias("e").join(numbered.alias("n"), maintain.null_safe("e", "n", keys)).select(F.col("e.id").alias("edition_id"), "n.set", "e.disk_no", "e.disk_count"))
    # A set's number stands for its key, so members are grouped and joined on numbers.
    blank = F.lit(None).cast("string")
    members = known_flags(artifact).join(numbered, "edition_id").select(
        F.col("set").alias("title"), *(blank.alias(k) for k in sets.SET if k not in ("title", "disk_count")), "disk_no", "disk_count", "uid", "trainer", "dump_type", "lineage", "bad", "virus", "over", "under", "verified_good", "alt_index", "modifications",
    )
    chosen = sets.coherent_primaries(durable(members)).select(F.col("title").alias("set"), "disk_no", "primary_uid")
    return numbered.alias("n").join(chosen.alias("c"), (F.col("n.set") == F.col("c.set")) & F.col("n.disk_no").eqNullSafe(F.col("c.disk_no"))).select("n.edition_id", F.col("c.primary_uid").alias("uid"))


def ingest(catalog: dict[str, DataFrame], uploads: DataFrame, entries: DataFrame | None = None, raw: bool = False, primaries: bool = True) -> dict[str, DataFrame]:
    """What a batch of uploads (``ingest_seq``, ``filename``, ``content``) adds to ``catalog`` (title, edition, artifact).

    New rows of title, edition, artifact and quarantine; ``primary`` (edition,
    uid) of every edition in a set that got an artifact; ``outcome`` of each
    image (stored, verified or quarantined, or duplicate, with the uid that holds
    its content); ``error`` of uploads that can't be decoded. Within the batch and
    against the catalog the first to arrive keeps its name. Ids already given
    count in the new ones. A list imported later (``entries``) doesn't change what
    is stored. Without ``primaries`` none are chosen and ``primary`` is empty;
    nothing else depends on them.
    """
    title, edition, artifact = (catalog[n] for n in ("title", "edition", "artifact"))
    images, failed = images_of(uploads, raw)
    owners = artifact.select("sha1", "uid")
    fresh = identify.first_of_each(images).join(owners.select("sha1"), "sha1", "left_anti")
    rows = durable(identify.identified(durable(fresh), entries, owners))
    named = rows.where(F.col("title").isNotNull())
    last = lambda df: df.agg(F.max("id")).first()[0] or 0
    new_titles = durable(maintain.new_titles(title, named.select(F.col("title").alias("name"), "category", F.col("ingest_seq").alias("seq")), last(title)))
    titles = title.select("id", "name", "category").unionByName(new_titles)
    keyed = named.join(titles.select(F.col("id").alias("title_id"), F.col("name").alias("title"), "category"), ["title", "category"])
    new_editions = durable(maintain.new_editions(edition, keyed.select(*maintain.KEY, F.col("ingest_seq").alias("seq")), last(edition)))
    editions = edition.select(*new_editions.columns).unionByName(new_editions)
    filed = keyed.alias("k").join(editions.alias("e"), maintain.null_safe("k", "e", maintain.KEY)).select("k.uid", F.col("e.id").alias("edition_id"))
    stored = rows.join(filed, "uid", "left").select(
        "uid", "sha1", "crc32", "md5", "edition_id", F.col("title").alias("display_title"), "year", *(F.when(F.col("title").isNotNull(), F.col(c)).alias(c) if c in ("dump_type", "crack_group", "trainer", "lineage") else c for c in identify.INFO),
        "verified", "tosec_name", F.col("filename").alias("orig_filename"), "container", F.lit(None).cast("string").alias("decoded_sha1"), F.col("sha1").alias("blob_sha1"),
    )
    stored = durable(stored)
    every = artifact.select(*stored.columns).unionByName(stored)
    outcome = (
        images.select("ingest_seq", "filename", "sha1").join(every.select("sha1", "uid", "verified", "edition_id", "orig_filename"), "sha1")
        .join(rows.select("sha1", F.col("ingest_seq").alias("_first"), F.col("filename").alias("_name")), "sha1", "left")
        .withColumn("_copy", F.row_number().over(Window.partitionBy("sha1", "ingest_seq", "filename").orderBy("uid")))
        .withColumn("kind", F.when((F.col("_first") == F.col("ingest_seq")) & (F.col("_name") == F.col("filename")) & (F.col("_copy") == 1), "stored").otherwise("duplicate"))
        .select("ingest_seq", "filename", "uid", "kind", F.when(F.col("kind") == "stored", F.col("verified")).alias("verified"), F.when(F.col("kind") == "stored", F.col("edition_id").isNull()).alias("quarantined"))
    )
    touched = stored.where(F.col("edition_id").isNotNull()).select("edition_id")
    chosen = durable(primaries_of(editions, every, touched)) if primaries else touched.sparkSession.createDataFrame([], "edition_id long, uid string")
    return {
        "title": new_titles, "edition": new_editions, "artifact": stored, "quarantine": stored.where(F.col("edition_id").isNull()).select(F.col("uid").alias("artifact_uid"), F.lit(REASON).alias("reason")),
        "primary": chosen, "outcome": outcome, "error": failed,
    }


def numbered(catalog: dict[str, DataFrame], uploads: DataFrame, entries: DataFrame | None = None) -> dict[str, DataFrame]:
    """New rows of title and edition as ``ingest`` gives them for raw uploads, and the contents (``sha1``) of the batch as ``artifact``.

    Only what ids depend on is worked out, and neither images nor artifacts are
    written down: hashes are counted, rows that may repeat a content or be on the
    list are set apart by tables of bits, and all others go where they are into
    the least ``ingest_seq`` of their title and edition. Of ``entries`` the
    ``dat_id`` says which of several hits comes first.
    """
    title, edition, owners = catalog["title"], catalog["edition"], catalog["artifact"].select("sha1")
    images = uploads.select("ingest_seq", "filename", *identity.hashes(F.col("content")))
    key = F.xxhash64("sha1")
    seen = images.select(key.alias("k")).unionByName(owners.select(key.alias("k")))
    repeated = durable(seen.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"))
    fresh, cols = images, (*sets.EDITION, "ingest_seq")
    if not repeated.isEmpty():
        told = maybe_in(images, key, repeated, "_again")
        doubt = told.where("_again").groupBy("sha1").agg(F.min_by(F.struct("ingest_seq", "filename", "md5", "crc32"), F.struct("ingest_seq", "filename")).alias("_r")).select("sha1", "_r.*")
        doubt = doubt.join(maybe_in(owners, key, repeated, "_again").where("_again").select("sha1"), "sha1", "left_anti")
        fresh = told.where("NOT _again").drop("_again").unionByName(doubt)
    if entries is None:
        named = identify.named(fresh).select(*cols)
    else:
        listed = entries.select(F.explode(F.array(*(F.when(F.col(h).isNotNull(), F.xxhash64(F.lit(h), h)) for h in identify.HASHES))).alias("k")).where("k IS NOT NULL")
        listed = durable(listed)
        for h in identify.HASHES:
            fresh = maybe_in(fresh, F.xxhash64(F.lit(h), h), listed, f"_{h}")
        hit = F.col("_sha1") | F.col("_md5") | F.col("_crc32")
        far, near = (fresh.where(x).drop(*(f"_{h}" for h in identify.HASHES)) for x in (~hit, hit))
        named = identify.named(far).select(*cols).unionByName(identify.named(near.withColumn("uid", F.col("sha1")), entries).select(*cols))
    # Keys are few beside contents: they are counted where the rows are.
    kept = durable(named.where(F.col("title").isNotNull()).groupBy(*sets.EDITION).agg(F.min("ingest_seq").alias("seq")))
    last = lambda df: df.agg(F.max("id")).first()[0] or 0
    new_titles = durable(maintain.new_titles(title, kept.select(F.col("title").alias("name"), "category", "seq"), last(title)))
    titles = title.select("id", "name", "category").unionByName(new_titles)
    keyed = kept.join(titles.select(F.col("id").alias("title_id"), F.col("name").alias("title"), "category"), ["title", "category"])
    return {"title": new_titles, "edition": durable(maintain.new_editions(edition, keyed.select(*maintain.KEY, "seq"), last(edition))), "artifact": images.select("sha1")}


def add(catalog: dict[str, DataFrame], changes: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``catalog`` with the changes of a batch; later primaries of an edition replace earlier ones."""
    out = dict(catalog)
    for name in ("title", "edition", "artifact", "quarantine"):
        out[name] = catalog[name].select(*changes[name].columns).unionByName(changes[name])
    fresh = changes["primary"].select(F.col("edition_id").alias("id"), F.col("uid").alias("_p"), F.lit(True).alias("_set"))
    out["edition"] = out["edition"].join(fresh, "id", "left").withColumn("primary_artifact_uid", F.when(F.col("_set"), F.col("_p")).otherwise(F.col("primary_artifact_uid"))).drop("_p", "_set")
    return out


def resolve(catalog: dict[str, DataFrame], resolutions: DataFrame) -> dict[str, DataFrame]:
    """``catalog`` after ``resolutions`` (``uid``, ``seq``, title and edition fields) of quarantined contents.

    Each gets its edition, made where it is missing, even for a uid that isn't
    there; its artifact moves to it and is shown under the title as given; the
    primaries of the sets concerned are chosen anew. Other fields stay as they are.
    """
    done, left = maintain.resolve(catalog["quarantine"], resolutions)
    title, edition, artifact = (catalog[n] for n in ("title", "edition", "artifact"))
    done = done.join(resolutions.select("uid", "seq"), "uid")
    last = lambda df: df.agg(F.max("id")).first()[0] or 0
    titles = durable(title.unionByName(maintain.new_titles(title, done.select(F.col("title").alias("name"), "category", "seq"), last(title))))
    keyed = done.join(titles.select(F.col("id").alias("title_id"), F.col("name").alias("title"), "category"), ["title", "category"])
    editions = durable(edition.unionByName(maintain.new_editions(edition, keyed.select(*maintain.KEY, "seq"), last(edition))))
    to = keyed.alias("k").join(editions.alias("e"), maintain.null_safe("k", "e", maintain.KEY)).select("k.uid", F.col("e.id").alias("_edition"), F.col("k.display_title").alias("_shown"))
    moved = artifact.join(to, "uid", "left").withColumns({"edition_id": F.coalesce("_edition", "edition_id"), "display_title": F.coalesce("_shown", "display_title")}).drop("_edition", "_shown")
    out = catalog | {"title": titles, "edition": editions, "artifact": durable(moved), "quarantine": left}
    fresh = primaries_of(editions, out["artifact"], to.select(F.col("_edition").alias("edition_id")))
    none = {n: out[n].limit(0) for n in ("title", "edition", "artifact", "quarantine")}
    return add(out, none | {"primary": fresh})
