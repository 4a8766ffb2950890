"""The pN_ queries over their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import abuse, canonical, formatting, leakage, linkage, survivor, tokens, variants


def p1_ties(spark: SparkSession, folder: str) -> DataFrame:
    found = linkage.ties(linkage.work_rows(table(spark, folder, "title_query")), linkage.page_rows(table(spark, folder, "provider_results")))
    return found.select(found["work"].alias("title_id"), found["page"].alias("result_id"), "confidence")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_ties(spark, folder).select("title_id", "result_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    typed = canonical.quarantined_names(table(spark, folder, "quarantine"), table(spark, folder, "artifact"))
    return canonical.map_names(typed, table(spark, folder, "dat_entry"))


def typed_names(spark: SparkSession, folder: str) -> DataFrame:
    parsed = variants.distinct_strings(table(spark, folder, "tosec_name"), {"publisher": "publisher", "title": "title"})
    return parsed.unionByName(variants.distinct_strings(table(spark, folder, "artifact"), {"crack_group": "crack_group"}))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variant_pairs(typed_names(spark, folder), frozenset(("title",)))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    return variants.classes(typed_names(spark, folder), frozenset(("title",)))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return formatting.repeats(table(spark, folder, "edition_key"))


def p4_copies(spark: SparkSession, folder: str) -> DataFrame:
    return formatting.copies(table(spark, folder, "edition_key"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.edition_primaries(table(spark, folder, "artifact"))


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.consolidated(table(spark, folder, "artifact"))


def p5_spellings(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.spellings(table(spark, folder, "artifact"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_texts(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.cases(table(spark, folder, "documents"), table(spark, folder, "content_label"))


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return abuse.scores(docs, abuse.train(docs, table(spark, folder, "content_label")))


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.source_rates(table(spark, folder, "documents"), table(spark, folder, "content_label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_ties": p1_ties,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_copies": p4_copies,
    "p5_found": p5_found,
    "p5_records": p5_records,
    "p5_spellings": p5_spellings,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

_FIELDS = ("title", "publisher", "version", "language", "qualifier", "disk_no", "disk_count")


def _cell(field: str) -> str:
    raw = f"""CASE WHEN record IS NULL THEN CAST({field} AS VARCHAR) ELSE regexp_extract(record, '(?is)(?:^|[;|])[^\\p{{L}}\\p{{Nd}};|=_]*{field}[^\\p{{L}}\\p{{Nd}};|=_]*=([^;|]*)', 1) END"""
    if field != "version":
        return f"""nullif(regexp_replace(lower({raw}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'), '') AS {field}"""
    dotted = f"""regexp_replace(lower({raw}), '[^\\p{{L}}\\p{{Nd}}]+', '.', 'g')"""
    joined = f"""regexp_replace(regexp_replace({dotted}, '(\\p{{L}})\\.', '\\1', 'g'), '\\.(\\p{{L}})', '\\1', 'g')"""
    return f"""nullif(regexp_replace({joined}, '^\\.|\\.$', '', 'g'), '') AS {field}"""


_KEYS = f"""WITH k AS (SELECT DISTINCT key_id, {", ".join(map(_cell, _FIELDS))} FROM edition_key),
g AS (SELECT key_id, min(key_id) OVER w AS first_id, count(*) OVER w AS copies FROM k WINDOW w AS (PARTITION BY {", ".join(_FIELDS)}))"""

_LATEST = """WITH a AS (SELECT DISTINCT * FROM artifact), r AS (SELECT uid, max(edition_id) AS edition_id, """ + ", ".join(
    f"coalesce(first({f} ORDER BY recorded_at DESC NULLS LAST, record_id DESC) FILTER (WHERE {f} IS NOT NULL), {z}) AS {f}"
    for f, z in (("verified_good", "false"), ("bad", "false"), ("virus", "false"), ("over", "false"), ("under", "false"), ("modifications", "0"), ("alt_index", "0"), ("trainer", "NULL"))
) + " FROM a GROUP BY uid)"

ORACLE: dict[str, str] = {
    "p4_found": f"{_KEYS} SELECT first_id, key_id FROM g WHERE key_id > first_id",
    "p4_copies": f"{_KEYS} SELECT key_id, first_id, copies FROM g",
    "p5_found": f"""{_LATEST}, ranked AS (SELECT edition_id, uid, row_number() OVER (PARTITION BY edition_id ORDER BY
        CASE WHEN verified_good OR modifications = 0 THEN 0 ELSE 1 END, modifications, CASE WHEN trainer IS NULL THEN 0 ELSE 1 END, alt_index, uid) AS n
        FROM r WHERE edition_id IS NOT NULL AND NOT (bad OR virus OR "over" OR "under")) SELECT edition_id, uid AS primary_uid FROM ranked WHERE n = 1""",
    "p5_records": f"{_LATEST} SELECT * FROM r",
}
