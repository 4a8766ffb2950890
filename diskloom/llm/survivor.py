"""Best record of each group: a consensus of its values, then the best dump of each edition.

All eight fields are settled by the weighted token vote of ``consensus``, flags
and numbers as texts. The stated result weighs records by arrival, so that each
outweighs all earlier ones together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import consensus

FLAGS = ("verified_good", "bad", "virus", "over", "under")
COUNTS = ("modifications", "alt_index")


def arrival_key(at: Column, row_id: Column) -> Column:
    """(at, row_id) packed into one number that orders alike, null times and ids first.

    A decimal lives in a fixed-width aggregation buffer, so the heaviest record of
    each value stays in the hash aggregate; a struct key would force a sort.
    """
    micros = F.coalesce(F.unix_micros(F.to_timestamp(at)), F.lit(-(1 << 61))).cast("decimal(20,0)")
    return (micros * F.lit(str(1 << 63)).cast("decimal(19,0)") + F.coalesce(row_id, F.lit(-1)).cast("decimal(20,0)")).cast("decimal(38,0)")


def consolidated(rows: DataFrame) -> DataFrame:
    """The record of each uid: flags default to false, counts to 0, trainer to null. Each field is settled by the consensus, its values as texts."""
    rows = rows.where(F.col("uid").isNotNull())
    # Arrival keys are made positive weights; records that arrive later outweigh all before.
    arrival = arrival_key(F.col("recorded_at"), F.col("record_id")) + F.lit(str(1 << 125)).cast("decimal(38,0)")
    fields = (*FLAGS, *COUNTS, "trainer")
    voted = consensus.consensus(rows.withColumns({f: F.col(f).cast("string") for f in (*FLAGS, *COUNTS)}), "uid", fields, arrival, latest=True)
    settled = voted.groupBy("uid").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))
    return rows.groupBy("uid").agg(F.max("edition_id").alias("edition_id")).join(settled, "uid", "left").select(
        "uid", "edition_id",
        *(F.coalesce(F.col(f).cast("boolean"), F.lit(False)).alias(f) for f in FLAGS),
        *(F.coalesce(F.col(f).cast("long"), F.lit(0)).alias(f) for f in COUNTS),
        "trainer",
    )


#: Text fields of which a dump has one spelling.
SPELLED = ("display_title", "tosec_name", "crack_group", "trainer")


def spellings(rows: DataFrame) -> DataFrame:
    """``uid``, ``field``, ``value``: the spelling of each text field that the reports on a dump agree on best.

    Every report counts once, one that found the dump in a list twice. Exact
    repeats of a row count once.
    """
    once = rows.select("uid", "record_id", "verified", *SPELLED).distinct()
    return consensus.consensus(once, "uid", SPELLED, F.when(F.col("verified"), 2).otherwise(1))


def edition_primaries(rows: DataFrame) -> DataFrame:
    """``edition_id``, ``primary_uid`` of every edition with a dump that isn't disqualified.

    Dumps rank by clean first, then fewest modifications, no trainer, lowest
    alternate, uid. Editions without a sound dump have no row.
    """
    records = consolidated(rows)
    unclean = ~(F.col("verified_good") | (F.col("modifications") == 0))
    return (
        records.where(F.col("edition_id").isNotNull() & ~(F.col("bad") | F.col("virus") | F.col("over") | F.col("under")))
        .groupBy("edition_id")
        .agg(F.min_by("uid", F.struct(unclean.alias("unclean"), F.col("modifications").alias("mods"), F.col("trainer").isNotNull().alias("trained"), F.col("alt_index").alias("alt"), F.col("uid"))).alias("primary_uid"))
    )
