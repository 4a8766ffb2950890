"""Dump flags, dump classes and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .naming import U32, let


def _split(flag: Column) -> Column:
    """A flag's tag and what follows its first space."""
    return F.struct(F.regexp_extract(flag, r"(?s)^([^ ]*)", 1).alias("tag"), F.regexp_replace(F.regexp_extract(flag, r"(?s)^[^ ]* (.*)\z", 1), r"(?U)^\s+|\s+$", "").alias("argument"))


def dump_info(flags: Column) -> Column:
    """Dump type, groups, defects and counts told by the flags of a name; an empty or null list is an original dump."""
    def info(pairs: Column) -> Column:
        having = lambda *tags: F.filter(pairs, lambda f: f["tag"].isin(*tags))
        has = lambda *tags: F.exists(pairs, lambda f: f["tag"].isin(*tags))
        first_argument = lambda *tags: F.try_element_at(F.filter(pairs, lambda f: f["tag"].isin(*tags) & (f["argument"] != "")), F.lit(1))["argument"]
        last_alternate = F.try_element_at(F.filter(pairs, lambda f: f["tag"].startswith("a")), F.lit(-1))["tag"]
        digits = F.regexp_extract(last_alternate, "^a([0-9]*)", 1)
        number = F.when(F.length(digits) <= 38, digits.try_cast("decimal(38,0)"))
        alternate = F.when(last_alternate.isNull(), F.lit(0)).when(number <= U32, number.cast("long")).otherwise(F.lit(1))
        kind = F.when(has("cr"), "cracked").when(has("h"), "hacked").when(has("f", "m"), "modified").when(has("t"), "trainer").otherwise("original")
        return F.struct(
            kind.alias("dump_type"), first_argument("cr").alias("crack_group"), F.try_element_at(having("t"), F.lit(-1))["argument"].alias("trainer"),
            has("b").alias("bad"), has("v").alias("virus"), has("o").alias("over"), has("u").alias("under"), alternate.cast("long").alias("alt_index"),
            F.size(having("cr", "h", "f", "m", "t")).cast("long").alias("modifications"), has("!").alias("verified_good"), first_argument("cr", "h", "f").alias("lineage"),
        )

    return let(F.transform(F.coalesce(flags, F.array().cast("array<string>")), _split), info)


def disqualified(bad: Column, virus: Column, over: Column, under: Column) -> Column:
    return bad | virus | over | under


def class3(dump_type: Column) -> Column:
    """original, cracked or hacked; unknown types are original."""
    return F.when(dump_type == "cracked", "cracked").when(dump_type.isin("hacked", "modified", "trainer"), "hacked").otherwise("original")


def category(qualifier: Column, list_source: Column) -> Column:
    """demo by qualifier or list, tool by list, else game."""
    source = F.lower(list_source)
    return (
        F.when(qualifier.contains("demo") | (qualifier == "preview"), "demo")
        .when(source.contains("demo"), "demo")
        .when(source.contains("application") | source.contains("tool") | source.contains("util"), "tool")
        .otherwise("game")
    )


def alternate_badge(alt_index: Column) -> Column:
    """base, [a], [a2]..."""
    return F.when(alt_index == 0, "base").when(alt_index == 1, "[a]").otherwise(F.concat(F.lit("[a"), alt_index.cast("string"), F.lit("]")))


def hue(name: Column) -> Column:
    """A stable hue in degrees: characters folded by 31 modulo 2**32."""
    return F.pmod(F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32))), F.lit(360)).cast("int")


def rank(verified_good: Column, modifications: Column, trainer: Column, alt_index: Column) -> list[Column]:
    """Sort columns of a dump, best first: clean, few changes, no trainer, low alternate."""
    return [(~(verified_good | (modifications == 0))).alias("unclean"), modifications.alias("mods"), trainer.isNotNull().alias("trained"), alt_index.alias("alt")]


def image_type(content: Column, header: Column) -> Column:
    """Image type by leading bytes, else the header's image type, else image/jpeg."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(header.startswith("image/"), header).otherwise("image/jpeg")
    )
