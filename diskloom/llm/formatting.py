"""Duplicates hidden by formatting: dictionary-encoded keys, grouped as integer tuples.

Every distinct raw cell is canonicalised once, every distinct canonical value
gets an integer, and a record becomes the sorted tuple of its field-value
integers. Records group on those compact tuples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import HOT_ROWS, join_counted
from ..session import durable

FIELDS = ("title", "publisher", "version", "language", "qualifier", "disk_no", "disk_count")
#: Fields whose neighbouring numbers stay apart.
NUMBERED = ("version",)
#: Canonical values are numbered within this many hash buckets (id = bucket, rank).
BUCKETS = 1 << 14


def canonical_text(x: Column) -> Column:
    """Lower case, letters and digits only; null if none is left."""
    return F.nullif(F.regexp_replace(F.lower(x), r"[^\p{L}\p{Nd}]", ""), F.lit(""))


def canonical_numbered(x: Column) -> Column:
    """As canonical_text, but what parts two digits stays as one point: v1.10, v11.0."""
    x = F.regexp_replace(F.lower(x), r"[^\p{L}\p{Nd}]+", ".")
    x = F.regexp_replace(F.regexp_replace(x, r"(\p{L})\.", "$1"), r"\.(\p{L})", "$1")
    return F.nullif(F.regexp_replace(x, r"^\.|\.$", ""), F.lit(""))


def record_field(record: Column, field: str) -> Column:
    """Value of ``field`` in ``field=value`` pairs parted by ; or |; the first one counts, null if absent."""
    return F.nullif(F.regexp_extract(record, rf"(?is)(?:^|[;|])[^\p{{L}}\p{{Nd}};|=_]*{field}[^\p{{L}}\p{{Nd}};|=_]*=([^;|]*)", 1), F.lit(""))


def copies(rows: DataFrame, key: str = "key_id", fields: tuple[str, ...] = FIELDS, record: str | None = "record",
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """Membership of every key: ``key``, ``first_id`` (smallest key of its group), ``copies`` (keys in the group).

    Nulls and values without letter or digit are missing, and missing agrees
    only with missing; rows with no field at all form one group. Rows whose
    ``record`` isn't null take all fields from it. Exact repeats of a row count
    once. Rows with a null key are left out. An empty input gives an empty
    result; columns other than the named ones are ignored, of any name or type.
    """
    value = {f: F.col(f).cast("string") for f in fields}
    if record:
        value = {f: F.when(F.col(record).isNotNull(), record_field(F.col(record), f)).otherwise(v) for f, v in value.items()}
    cells = durable(
        rows.where(F.col(key).isNotNull())
        .select(F.col(key).alias("k"), F.explode(F.array(*(F.struct(F.lit(n).alias("f"), F.lit(f in NUMBERED).alias("num"), value[f].alias("raw")) for n, f in enumerate(fields, 1)))).alias("c"))
        .select("k", "c.*")
        .where(F.col("raw").isNotNull())
    )
    raws = cells.groupBy("num", "raw").agg(F.count("*").alias("n"))
    raws = durable(raws.withColumn("canon", F.when(F.col("num"), canonical_numbered(F.col("raw"))).otherwise(canonical_text(F.col("raw")))).where(F.col("canon").isNotNull()))
    canons = raws.groupBy("num", "canon").agg(F.count("*").alias("spellings")).withColumn("bucket", F.pmod(F.xxhash64("num", "canon"), F.lit(BUCKETS)))
    ids = canons.select(
        "num", "canon", "spellings",
        (F.shiftleft(F.col("bucket"), 32) + F.row_number().over(Window.partitionBy("bucket").orderBy("num", "canon"))).alias("id"),
    )
    dictionary = join_counted(raws, ids, ["num", "canon"], "spellings", hot_rows).select("num", "raw", "n", "id")
    coded = join_counted(cells, dictionary, ["num", "raw"], "n", hot_rows).select("k", (F.shiftleft(F.col("f").cast("long"), 56) + F.col("id")).alias("code"))
    every = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.lit(0).cast("long").alias("code"))  # keeps rows without any field
    tuples = durable(coded.unionByName(every).groupBy("k").agg(F.array_sort(F.collect_set("code")).alias("tuple")))
    groups = tuples.groupBy("tuple").agg(F.min("k").alias("first_id"), F.count("*").alias("copies")).withColumn("n", F.col("copies"))
    return join_counted(tuples, groups, ["tuple"], "n", hot_rows).select(F.col("k").alias(key), "first_id", "copies")


def repeats(rows: DataFrame, key: str = "key_id", **options) -> DataFrame:
    """``first_id``, ``key``: every key that repeats an earlier one of the same canonical fields."""
    return copies(rows, key, **options).where(F.col(key) > F.col("first_id")).select("first_id", key)
