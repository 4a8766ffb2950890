"""Fuzzy title comparison from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .naming import ascii_lower, sanitize_title

#: Least similarity of an accepted match.
FLOOR = 0.55


def words(name: Column) -> Column:
    """Normalised words of a title, without a leading the unless it stands alone."""
    w = F.filter(F.split(ascii_lower(sanitize_title(name)), "-"), lambda x: x != "")
    return F.when((F.size(w) > 1) & (F.try_element_at(w, F.lit(1)) == "the"), F.slice(w, F.lit(2), F.size(w))).otherwise(w)


def normalize(name: Column) -> Column:
    return F.array_join(words(name), " ")


def slug(name: Column) -> Column:
    return ascii_lower(sanitize_title(name))


def index_letter(name: Column) -> Column:
    """First letter of the normalised title, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(normalize(name), "[a-z]", 0), F.lit("")), F.lit("0"))


def word_bits(words_: Column) -> Column:
    """64 bits of distinct words; a bit that another title lacks stands for a word or more that it lacks."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    return F.aggregate(words_, F.lit(0).cast("long"), lambda bits, w: bits.bitwiseOR(bit(w)))


def letter_bits(text: Column) -> Column:
    """64 bits of the letters that a text has once or more and twice or more; each that another text lacks costs an edit."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(F.substring(text, k, F.lit(1))) % 32)
    step = lambda s, b: F.struct(s["once"].bitwiseOR(b).alias("once"), s["twice"].bitwiseOR(s["once"].bitwiseAND(b)).alias("twice"))
    none = F.lit(0).cast("long")
    bits = F.transform(F.sequence(F.lit(1), F.length(text)), bit)
    return F.aggregate(bits, F.struct(none.alias("once"), none.alias("twice")), step, lambda s: s["once"].bitwiseOR(F.shiftleft(s["twice"], 32)))


def similarity(a: Column, b: Column) -> Column:
    """Half Jaccard of the words, half edit ratio of the run-together forms; equal forms 1, empty ones 0. Single precision."""
    wa, wb = words(a), words(b)
    ja, jb = F.array_join(wa, ""), F.array_join(wb, "")
    da, db = F.array_distinct(wa), F.array_distinct(wb)
    jaccard = F.size(F.array_intersect(da, db)) / F.size(F.array_union(da, db))
    edit = 1 - F.levenshtein(ja, jb) / F.greatest(F.length(ja), F.length(jb))
    return F.when((ja == "") | (jb == ""), F.lit(0.0)).when(ja == jb, F.lit(1.0)).otherwise(0.5 * jaccard + 0.5 * F.greatest(edit, F.lit(0.0))).cast("float")
