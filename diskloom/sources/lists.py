"""Reference lists in their XML form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flags, naming
from ..functions.identity import normalized_hash


def _attribute(fragment: Column, key: str) -> Column:
    """Value after the first ``key="`` (also at the end of a longer attribute name), up to the next quote; null if there is none."""
    pattern = rf'(?s){key}="([^"]*)"'
    return F.when(fragment.rlike(pattern), F.regexp_extract(fragment, pattern, 1))


def parse_list(lists: DataFrame, xml: str = "xml", source: str = "source") -> DataFrame:
    """Entries of lists (``source``, ``xml``) in order: ``source``, ``position``, name, hashes, parsed fields.

    A game's head ends at its first >, entities stay as written, only the first
    rom counts; games without name or rom are left out.
    """
    games = lists.select(F.col(source).alias("source"), F.posexplode(F.slice(F.split(F.col(xml), "<game"), 2, 1 << 30)).alias("position", "g"))
    head = F.regexp_extract("g", r"(?s)^([^>]*)", 1)
    rom = F.regexp_extract("g", r"(?s)<rom([^>]*)", 1)
    rows = games.withColumns({"name": _attribute(head, "name"), "_rom": F.when(F.col("g").contains("<rom"), rom)}).where(F.col("name").isNotNull() & F.col("_rom").isNotNull())
    rows = naming.expand(naming.expand(rows, naming.parse_name(F.col("name"))), flags.dump_info(F.col("flags")))
    known = F.col("title").isNotNull()
    return rows.select(
        "source", "position", "name", *(normalized_hash(_attribute(F.col("_rom"), k)).alias(a) for a, k in (("sha1", "sha1"), ("crc32", "crc"), ("md5", "md5"))),
        "title", "version", "language", "publisher", "year", "disk_no", "disk_count", F.when(known, F.col("dump_type")).alias("dump_type"), F.when(known, F.col("crack_group")).alias("crack_group"),
    )
