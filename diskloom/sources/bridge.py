"""Uploads derived from the line items and parts of a snapshot, as expressions both engines understand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small, table

# Parts of an upload name; the same text runs in Spark SQL and in other SQL engines.
VERSION = "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'v1.' || CAST(p_size % 3 AS STRING) END"
YEAR = "1985 + p_size % 10"
LANGUAGE = "CASE l_partkey % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE NULL END"
QUALIFIER = "CASE WHEN l_partkey % 9 = 0 THEN 'demo-playable' ELSE NULL END"
DISK = "l_linenumber % 3 + 1"
LINEAGE = "CASE l_returnflag WHEN 'A' THEN 'CSL' WHEN 'R' THEN 'QTX' ELSE NULL END"
DUMP = "CASE l_returnflag WHEN 'A' THEN '[cr CSL]' WHEN 'R' THEN '[h QTX]' ELSE '' END"
TRAINED, BAD, ALTERNATE = "l_discount >= 0.09", "l_tax >= 0.08", "l_linestatus = 'O'"
NAME = (
    f"p_name || coalesce(' ' || {VERSION}, '') || CASE WHEN l_partkey % 9 = 0 THEN ' (demo-playable)' ELSE '' END || ' (' || CAST({YEAR} AS STRING) || ')(' || p_brand || ')'"
    f" || coalesce('(' || upper({LANGUAGE}) || ')', '') || '(Disk ' || CAST({DISK} AS STRING) || ' of 3)' || {DUMP}"
    f" || CASE WHEN {TRAINED} THEN '[t +3 DC]' ELSE '' END || CASE WHEN {BAD} THEN '[b corrupt]' ELSE '' END || CASE WHEN {ALTERNATE} THEN '[a2]' ELSE '' END || '.adf'"
)
CONTENT = f"{NAME} || '#' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"


def lines_of_parts(spark: SparkSession, folder: str, most: int = 0) -> DataFrame:
    """Line items with their parts, of which up to ``most`` are broadcast."""
    lines, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    if most:
        parts = small(parts.select("p_partkey", "p_name", "p_brand", "p_size"), most)
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"])


def uploads(spark: SparkSession, folder: str, most: int = 0) -> DataFrame:
    """``ingest_seq``, ``filename``, ``content``: one upload per line item; up to ``most`` parts are broadcast."""
    rows = lines_of_parts(spark, folder, most)
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingest_seq"), F.expr(NAME).alias("filename"), F.expr(CONTENT).cast("binary").alias("content"))
