"""File-name grammar, canonical names, versions: Column to Column, without Python workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Language codes and qualifier words of the name grammar.
LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "se", "da", "pl", "cs", "pt", "fi", "no", "gr", "hu", "ru", "us", "uk", "au", "jp", "mul")
QUALIFIERS = ("demo", "demo-playable", "demo-rolling", "demo-slideshow", "demo-kus", "playable demo", "rolling demo", "preview", "prerelease", "proto", "prototype")
# Letters written out in sanitised titles; all other non-ASCII letters are dropped.
LETTERS = {
    "ä": "ae", "Ä": "Ae", "ö": "oe", "Ö": "Oe", "ü": "ue", "Ü": "Ue", "ß": "ss", "é": "e", "è": "e", "ê": "e", "É": "E", "È": "E", "Ê": "E", "á": "a", "à": "a", "â": "a", "Á": "A", "À": "A", "Â": "A",
    "ó": "o", "ò": "o", "ô": "o", "Ó": "O", "Ò": "O", "Ô": "O", "í": "i", "ì": "i", "î": "i", "ú": "u", "ù": "u", "û": "u", "ñ": "n", "Ñ": "N",
}
U32 = 4294967295
UID_LENGTH = 10
VERSION_WIDTH = 6


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trimmed(x: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stem(filename: Column) -> Column:
    """Without an extension of up to four ASCII letters and digits, or none after a last point."""
    return F.regexp_replace(filename, r"(?s)\.[A-Za-z0-9]{0,4}\z", "")


def bracket_groups(x: Column) -> Column:
    """Groups in () and [] as strings that start with their opening bracket, in order.

    Depth counts only the kind that opened a group; an unclosed group runs to the
    end. Names without a bracket of one kind inside another of that kind take a
    single regular expression, the rest a fold over characters.
    """
    nested = x.rlike(r"(?s)\([^)]*\(|\[[^\]]*\[")
    flat = F.transform(
        F.regexp_extract_all(x, F.lit(r"(?s)\([^()]*(?:\)|\z)|\[[^\[\]]*(?:\]|\z)"), F.lit(0)),
        lambda g: F.when((g.startswith("(") & g.endswith(")")) | (g.startswith("[") & g.endswith("]")), g.substr(F.lit(1), F.length(g) - 1)).otherwise(g),
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("buffer"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        opened = s["buffer"].substr(1, 1)
        opens, closes = c == opened, ((opened == "(") & (c == ")")) | ((opened == "[") & (c == "]"))
        grown = F.concat(s["buffer"], c)
        make = lambda depth, buffer, out: F.struct(depth.alias("depth"), buffer.alias("buffer"), out.alias("out"))
        outside = F.when(c.isin("(", "["), make(F.lit(1), c, s["out"])).otherwise(s)
        inside = (
            F.when(closes & (s["depth"] == 1), make(F.lit(0), F.lit(""), F.concat(s["out"], F.array(s["buffer"]))))
            .otherwise(make(s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0), grown, s["out"]))
        )
        return F.when(s["depth"] == 0, outside).otherwise(inside)

    folded = F.aggregate(F.split(x, ""), start, step, lambda s: F.when(s["depth"] > 0, F.concat(s["out"], F.array(s["buffer"]))).otherwise(s["out"]))
    return F.when(nested, folded).otherwise(flat)


def _u32(text: Column) -> Column:
    """A number up to 2**32 - 1 as its digits say, null if it isn't one."""
    return let(F.when(text.rlike(r"^\+?[0-9]{1,40}$"), text.try_cast("decimal(38,0)")), lambda n: F.when(n <= U32, n.cast("long")))


def disk_numbers(content: Column) -> Column:
    """``no``, ``count`` of ``Disk N of M``; null if it isn't one."""
    def numbers(low: Column) -> Column:
        part = lambda n: _u32(trimmed(F.regexp_extract(low, r"(?s)^disk (.*?) of (.*)\z", n)))
        return let(F.struct(part(1).alias("no"), part(2).alias("count")), lambda d: F.when(d["no"].isNotNull() & d["count"].isNotNull(), d))

    return F.when(ascii_lower(F.substring(content, 1, 5)) == "disk ", numbers(ascii_lower(content)))


def year_of(content: Column) -> Column:
    """Leading year of exactly four digits."""
    return F.nullif(F.regexp_extract(content, r"^([0-9]{4})(?![0-9])", 1), F.lit("")).cast("int")


def is_version(token: Column) -> Column:
    return token.rlike(r"^[vV][0-9]")


def _classified(group: Column) -> Column:
    """A group with its kind: flag, disk, year, language, qualifier or publisher."""
    def sort(c: Column, flag: Column) -> Column:
        return let(
            F.struct(F.when(~flag, disk_numbers(c)).alias("disk"), F.when(~flag, year_of(c)).alias("year"), ascii_lower(c).alias("low")),
            lambda x: F.struct(
                F.when(flag, "flag").when(x["disk"].isNotNull(), "disk").when(x["year"].isNotNull(), "year").when(x["low"].isin(*LANGUAGES), "language").when(x["low"].isin(*QUALIFIERS), "qualifier").otherwise("publisher").alias("kind"),
                c.alias("text"), x["low"].alias("low"), x["disk"].alias("disk"), x["year"].alias("year"),
            ),
        )

    return let(trimmed(group.substr(F.lit(2), F.length(group))), lambda c: sort(c, group.startswith("[")))


def parse_name(filename: Column) -> Column:
    """Fields of a catalog file name as one struct, null if it has no groups or no title.

    Every step is bound once; callers that need several fields should expand the
    struct with ``expand`` so that it isn't computed for each of them.
    """
    def titled(head: Column, groups: Column) -> Column:
        versioned = head.rlike(r"(?s) [vV][0-9][^ ]*\z")
        version = F.when(versioned, F.regexp_extract(head, r"(?s) ([vV][0-9][^ ]*)\z", 1))
        title = F.when(versioned, F.regexp_replace(F.regexp_extract(head, r"(?s)^(.*) [vV][0-9][^ ]*\z", 1), r"(?U)\s+\z", "")).otherwise(head)
        pick = lambda kind, place: F.try_element_at(F.filter(groups, lambda g: g["kind"] == kind), F.lit(place))
        return F.struct(
            title.alias("title"), version.alias("version"), pick("language", -1)["low"].alias("language"), pick("publisher", 1)["text"].alias("publisher"), pick("year", -1)["year"].alias("year"),
            pick("disk", -1)["disk"]["no"].alias("disk_no"), pick("disk", -1)["disk"]["count"].alias("disk_count"), pick("qualifier", 1)["low"].alias("qualifier"),
            F.transform(F.filter(groups, lambda g: g["kind"] == "flag"), lambda g: g["text"]).alias("flags"),
        )

    def parse(base: Column) -> Column:
        head = trimmed(F.regexp_extract(base, r"(?s)^([^(\[]*)[(\[]", 1))
        tail = F.regexp_extract(base, r"(?s)^[^(\[]*(.*)\z", 1)
        groups = let(tail, lambda t: F.transform(bracket_groups(t), _classified))
        return let(F.struct(head.alias("head"), groups.alias("groups")), lambda x: F.when((F.size(x["groups"]) > 0) & (x["head"] != ""), titled(x["head"], x["groups"])))

    return F.when(filename.isNotNull(), let(stem(filename), parse))


def expand(rows: DataFrame, struct: Column) -> DataFrame:
    """``rows`` with the fields of ``struct`` as columns (nulls for a null struct), computed once per row."""
    return rows.select("*", F.inline_outer(F.array(struct)))


def sanitize_title(title: Column) -> Column:
    """Kebab form of a title: letters written out, & as and, punctuation dropped, case kept."""
    x = F.replace(title, F.lit("&"), F.lit("-and-"))
    for letter, written in LETTERS.items():
        if len(written) > 1:
            x = F.replace(x, F.lit(letter), F.lit(written))
    single = {a: b for a, b in LETTERS.items() if len(b) == 1}
    x = F.translate(x, "".join(single) + " _", "".join(single.values()) + "--")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9-]", ""), "-+", "-"), "^-|-$", "")


def version_field(part: Column) -> Column:
    """A part of a version with its leading number padded; numbers beyond 64 bits stay as they are."""
    digits = F.regexp_extract(part, "^[0-9]*", 0)
    number = F.when((digits != "") & (F.length(digits) <= 38), digits.try_cast("decimal(38,0)"))
    plain = F.when(number <= F.lit("18446744073709551615").cast("decimal(38,0)"), number).cast("string")
    padded = F.lpad(plain, F.greatest(F.lit(VERSION_WIDTH), F.length(plain)), F.lit("0"))
    return F.when(plain.isNotNull(), F.concat(padded, ascii_lower(F.regexp_replace(part, "^[0-9]*", "")))).otherwise(ascii_lower(part))


def version_key(version: Column) -> Column:
    """Sortable form of a version: v1.9 before v1.10; v1, v1.0 and v1.00 alike."""
    parts = F.transform(F.filter(F.split(F.regexp_replace(trimmed(version), "^[vV]", ""), "[^A-Za-z0-9]+"), lambda p: p != ""), version_field)
    return F.regexp_replace(F.array_join(parts, "."), r"(?:\.0+)+\z", "")


def normalize_version(version: Column) -> Column:
    return F.concat(F.lit("v"), F.regexp_replace(trimmed(version), "^[vV]", ""))


def canonical_name(title: Column, version: Column, language: Column, disk_no: Column, disk_count: Column, uid: Column) -> Column:
    """Title[_vX][_lang][_dNNofMM]_uid.adf; title defaults to Unknown, the disk needs both numbers."""
    two = lambda n: F.lpad(n.cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), F.lit("0"))
    disk = F.concat(F.lit("d"), two(disk_no), F.lit("of"), two(disk_count))
    return F.concat(F.concat_ws("_", sanitize_title(F.coalesce(title, F.lit("Unknown"))), normalize_version(version), ascii_lower(language), disk, uid), F.lit(".adf"))


def parse_canonical(filename: Column) -> Column:
    """Fields of a canonical name by their shape, the last of a shape counts; null without a uid."""
    disk_shape = r"^d\+?([0-9]+)of\+?([0-9]+)$"

    def field(p: Column) -> Column:
        number = lambda n: _u32(F.regexp_extract(p, disk_shape, n))
        disk = F.when(p.rlike(disk_shape), F.struct(number(1).alias("no"), number(2).alias("count")))
        return let(disk, lambda d: F.struct(
            F.when(is_version(p), "version").when(d["no"].isNotNull() & d["count"].isNotNull(), "disk").when(p.rlike("^[a-z]{2}$") | (p == "mul"), "language").when(p.rlike(rf"^[0-9A-Fa-f]{{{UID_LENGTH},}}$"), "uid").alias("kind"),
            p.alias("text"), d.alias("disk"),
        ))

    def fields(parts: Column, rest: Column) -> Column:
        last = lambda kind: F.try_element_at(F.filter(rest, lambda f: f["kind"] == kind), F.lit(-1))
        return F.when(
            last("uid").isNotNull(),
            F.struct(
                F.element_at(parts, 1).alias("title"), normalize_version(last("version")["text"]).alias("version"), last("language")["text"].alias("language"),
                last("disk")["disk"]["no"].alias("disk_no"), last("disk")["disk"]["count"].alias("disk_count"), last("uid")["text"].alias("uid"),
            ),
        )

    return let(F.split(F.regexp_replace(filename, r"\.adf\z", ""), "_", -1), lambda parts: let(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), field), lambda rest: fields(parts, rest)))


def safe_name(tag: Column) -> Column:
    """A lineage tag as a file name; the empty tag is original."""
    return F.coalesce(F.nullif(F.regexp_replace(tag, "[^A-Za-z0-9]", "_"), F.lit("")), F.lit("original"))
