"""Changes to the catalog as new snapshots: upserts, resolving, re-identifying, cleaning, overriding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming
from ..session import durable
from .sets import EDITION, same_set

KEY = ("title_id", "version", "language", "publisher", "qualifier", "disk_no", "disk_count")


def null_safe(a: str, b: str, keys: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def with_new_ids(rows: DataFrame, order: str, start: int, key: str = "id") -> DataFrame:
    """Dense ids after ``start`` in order of ``order`` (unique): counted per range partition, then shifted by the partitions' totals.

    The ranged rows are written down once, so both passes see the same partitions.
    """
    ranged = durable(rows.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    # The totals table has one row per partition.
    return ranged.join(F.broadcast(before), "_p").withColumn(key, F.lit(start) + F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(order))).drop("_p", "_before")


def new_titles(title: DataFrame, wanted: DataFrame, start: int) -> DataFrame:
    """The (name, category) of ``wanted`` (with ``seq``) that ``title`` lacks, in order of arrival; ids follow ``start``."""
    fresh = wanted.groupBy("name", "category").agg(F.min("seq").alias("seq")).join(title.select("name", "category"), ["name", "category"], "left_anti")
    return with_new_ids(fresh.withColumn("_o", F.struct("seq", "name", "category")), "_o", start).select("id", "name", "category")


def new_editions(edition: DataFrame, wanted: DataFrame, start: int) -> DataFrame:
    """The keys of ``wanted`` (with ``seq``) that ``edition`` lacks, in order of arrival; keys compare null-safe."""
    fresh = wanted.groupBy(*KEY).agg(F.min("seq").alias("seq")).alias("w").join(edition.select(*KEY).alias("e"), null_safe("w", "e", KEY), "left_anti")
    made = with_new_ids(fresh.withColumn("_o", F.struct("seq", *KEY)), "_o", start)
    return made.select("id", *KEY, F.lit(None).cast("string").alias("primary_artifact_uid"))


def upsert_titles(title: DataFrame, wanted: DataFrame, start: int) -> DataFrame:
    return title.unionByName(new_titles(title, wanted, start))


def upsert_editions(edition: DataFrame, wanted: DataFrame, start: int) -> DataFrame:
    return edition.unionByName(new_editions(edition, wanted, start))


def import_entries(entries: DataFrame, fresh: DataFrame, order: str = "position") -> DataFrame:
    """``fresh`` list entries numbered after the ones there in list order, to append: nothing is dropped as a repeat. Batches ingested before aren't touched."""
    last = entries.agg(F.max("dat_id")).first()[0] or 0
    made = with_new_ids(fresh.withColumn("_o", F.struct("source", F.col(order), "name", "sha1", "md5", "crc32")), "_o", last, "dat_id")
    return made.select(*(c for c in entries.columns))


def resolve(quarantine: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(identities of resolved uids, quarantine that is left).

    Titles are trimmed, an empty category is game, the qualifier is always null.
    A resolution of a uid that isn't in quarantine still makes its edition.
    """
    done = resolutions.select(
        "uid", naming.trimmed(F.col("title")).alias("title"), F.coalesce(F.nullif("category", F.lit("")), F.lit("game")).alias("category"), "version", "language", "publisher",
        F.lit(None).cast("string").alias("qualifier"), "disk_no", "disk_count", F.col("title").alias("display_title"),
    )
    left = quarantine.join(resolutions.select(F.col("uid").alias("artifact_uid")), "artifact_uid", "left_anti")
    return done, left


def reidentify(artifacts: DataFrame) -> DataFrame:
    """Artifacts with the identity their retained name now gives, and ``moved``.

    A name can only raise the category to demo; else the current one stays, and
    one that isn't tool or demo is game. Names that don't parse, and rows
    without one, keep everything.
    """
    rows = artifacts.select("*", F.inline_outer(F.array(F.struct(naming.parse_name(F.col("tosec_name")).alias("_n")))))
    demo = F.coalesce(F.col("_n.qualifier").contains("demo") | (F.col("_n.qualifier") == "preview"), F.lit(False))
    kept = F.when(F.col("category").isin("tool", "demo"), F.col("category")).otherwise("game")
    fresh = {k: F.when(F.col("_n").isNotNull(), F.col(f"_n.{k}")).otherwise(F.col(k)) for k in EDITION if k != "category"}
    fresh["category"] = F.when(F.col("_n").isNull(), F.col("category")).when(demo, "demo").otherwise(kept)
    moved = reduce(lambda x, y: x | y, (~F.col(k).eqNullSafe(v) for k, v in fresh.items()))
    return rows.withColumn("moved", moved).withColumns({f"_{k}": v for k, v in fresh.items()}).drop(*EDITION, "_n").withColumnsRenamed({f"_{k}": k for k in EDITION})


def reidentify_report(artifacts: DataFrame) -> DataFrame:
    """``scanned``, ``moved``, ``editions_removed``, ``titles_removed`` of a pass over all artifacts."""
    after = reidentify(artifacts)
    counts = after.agg(F.count_if(F.col("tosec_name").isNotNull()).alias("scanned"), F.count_if("moved").alias("moved"))

    def gone(keys: tuple[str, ...], name: str) -> DataFrame:
        old, new = artifacts.select(*keys).distinct(), after.select(*keys).distinct()
        return old.alias("o").join(new.alias("n"), null_safe("o", "n", keys), "left_anti").agg(F.count("*").alias(name))

    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(counts).join(one(gone(EDITION, "editions_removed")), "_one").join(one(gone(("title", "category"), "titles_removed")), "_one").drop("_one")


def override_primaries(primaries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Primaries with manual choices (edition key, ``uid``) on top; a choice isn't checked against the edition."""
    return primaries.alias("p").join(overrides.alias("o"), same_set("p", "o", EDITION), "left").select(*(F.col(f"p.{k}").alias(k) for k in EDITION), F.coalesce("o.uid", "p.primary_uid").alias("primary_uid"))


