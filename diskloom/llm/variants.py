"""Variant spellings: suffix blocking, comparison by longest common subsequence, linked classes.

Every distinct string is indexed by its tokens' suffixes (and, read backwards,
prefixes) of a minimum length. Overly common suffixes, those of words that occur
in many names, give way to those of the other tokens of the name. All strings
that share one are compared, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_classes
from ..session import durable, parallelism, small
from . import bounds, names

#: Length of the suffixes in the index.
MIN_SUFFIX = 5
#: A word is common if it occurs in this share of a field's distinct strings (and at least in LEAST of them), beside as many other words.
#: Words count as standing beside each other up to this distance.
NEAR, COMMON_SHARE, COMMON_LEAST = 8, 0.01, 8
#: Strings of a block that one task meets with all of the block.
HOT_BLOCK = 2_000
#: Two strings are linked from this similarity on.
ACCEPT = 0.84


def distinct_strings(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``field``, ``name``, ``n``: distinct non-null strings of each column (field name to column name)."""
    out = None
    for label, column in columns.items():
        part = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(F.lit(label).alias("field"), "name", "n")
        out = part if out is None else out.unionByName(part)
    return out


def vocabularies(strings: DataFrame, series: frozenset[str]) -> dict[str, names.Vocabulary]:
    """Common words of each field. A share of the strings bounds their number, so they fit on the driver at any size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for f, s in zip(frame["field"], frame["name"], strict=True):
                tokens = names.parse(s, f in series).tokens
                # Each word with those up to NEAR places away, so a name of many words gives rows in proportion to them.
                near = {pair for k, a in enumerate(tokens) for b in tokens[k + 1:k + 1 + NEAR] for pair in ((a, b), (b, a))} | {(t, "") for t in tokens}
                out += [(f, t, u) for t, u in near if len(t) > 3 and t != u]
            yield pd.DataFrame(out, columns=["field", "token", "beside"])

    sizes = strings.groupBy("field").agg(F.count("*").alias("strings"))
    beside = strings.select("field", "name").mapInPandas(run, "field string, token string, beside string").groupBy("field", "token", "beside").agg(F.count("*").alias("n"))
    seen = beside.groupBy("field", "token").agg(F.max(F.when(F.col("beside") == "", F.col("n"))).alias("n"), (F.count("*") - 1).alias("others"))
    common = (
        seen.join(F.broadcast(sizes), "field")
        .where((F.col("n") >= COMMON_LEAST) & (F.col("n") >= F.col("strings") * COMMON_SHARE) & (F.col("others") >= F.col("n") / 2))
        .select("field", "token")
        .collect()
    )
    fields = {r["field"] for r in common}
    return {f: names.Vocabulary(r["token"] for r in common if r["field"] == f) for f in fields}


def suffix_keys(parsed: names.Name, vocabulary: names.Vocabulary | None) -> set[str]:
    """The shortest suffix and prefix in the index of each of a name's tokens, short tokens whole, and the name's consonants.

    Suffixes of common words would be common too; they are refined by the rest of
    the name, which leaves the tokens that tell names apart. A name of common
    words only is indexed whole, and meets only its like.
    """
    out = set()
    telling = vocabulary.stands_out(parsed) if vocabulary else parsed.tokens
    for t in {*telling, "".join(telling)}:
        if len(t) >= MIN_SUFFIX:
            out |= {f">{t[-MIN_SUFFIX:]}", f"<{t[::-1][-MIN_SUFFIX:]}"}
        elif len(t) > 1:
            out.add(f"={t}")
    for c in {names.consonants("".join(telling)), names.consonants(parsed.joined)}:
        if len(c) >= 4:
            out.add(f"~{names.fold(c)}")
    return out


def blocks(strings: DataFrame, series: frozenset[str], shared: Broadcast) -> DataFrame:
    """``field``, ``name``, ``key`` of the blocks to compare within, and the name's ``core`` and ``common`` words, parted by spaces.

    Longer suffixes in common imply the shortest, so every pair that shares one meets.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = shared.value
        for frame in frames:
            out = []
            for f, s in zip(frame["field"], frame["name"], strict=True):
                p = names.parse(s, f in series)
                core, common = map(" ".join, vocabulary[f].split(p) if f in vocabulary else (p.tokens, []))
                out += [(f, s, f"{p.number}#{key}", core, common) for key in suffix_keys(p, vocabulary.get(f))]
            yield pd.DataFrame(out, columns=["field", "name", "key", "core", "common"])

    return strings.select("field", "name").repartition(parallelism(strings.sparkSession), "name").mapInPandas(run, "field string, name string, key string, core string, common string")


def dealt(keyed: DataFrame, hot: int = HOT_BLOCK) -> DataFrame:
    """``keyed`` with the ``share`` of its block a row is in, rows of one share in one task and beside each other by name.

    A block of more than ``hot`` strings is dealt to several tasks: each takes a
    share of the strings, which are ``mine``, and meets them with all of the block.
    """
    large = small(durable(keyed.groupBy("field", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("field", "key", F.ceil(F.col("n") / hot).cast("int").alias("shares"))))
    shares = F.coalesce("shares", F.lit(1))
    return (
        keyed.join(large, ["field", "key"], "left")
        .withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
        .withColumn("mine", F.pmod(F.xxhash64("name"), shares) == F.col("share"))
        .drop("shares")
        .repartition(parallelism(keyed.sparkSession), "field", "key", "share")
        .sortWithinPartitions("field", "key", "share", "name")
    )


def block_starts(frame: pd.DataFrame) -> np.ndarray:
    """Which rows are of another share of a block than the row before."""
    out = np.zeros(len(frame), bool)
    out[:1] = True
    for column in ("field", "key", "share"):
        values = frame[column].to_numpy()
        out[1:] |= values[1:] != values[:-1]
    return out


def whole_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows, those of a block in one frame."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        last = int(np.flatnonzero(block_starts(frame))[-1])
        if last or held and block_starts(pd.concat([held[-1].tail(1), frame.head(1)]))[1]:
            yield pd.concat([*held, frame.head(last)], ignore_index=True)
            held = []
        held.append(frame.tail(len(frame) - last))
    if held:
        yield pd.concat(held, ignore_index=True)


def links(strings: DataFrame, series: frozenset[str], accept: float = ACCEPT, hot: int = HOT_BLOCK) -> DataFrame:
    """``field``, ``name_a``, ``name_b``, ``score`` of strings of one block that are alike; in ``series`` fields only within one number.

    Every pair of a block is held against an upper bound of its similarity, in
    arrays; only pairs that can be alike are compared, and only those that are
    leave the task.
    """
    shared = strings.sparkSession.sparkContext.broadcast(vocabularies(strings, series))
    keyed = durable(blocks(strings, series, shared))
    least = (accept - (1 - names.CORE)) / names.CORE

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_blocks(frames):
            cores = bounds.Cores(frame["core"].tolist())
            fields, strs = frame["field"].tolist(), frame["name"].tolist()
            parts = [(core.split(), common.split()) for core, common in zip(cores.core, frame["common"], strict=True)]
            for a, b in bounds.pairs_of(block_starts(frame), frame["mine"].to_numpy(bool)):
                near = cores.may_reach(a, b, least)
                out = []
                for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
                    if strs[i] != strs[j] and (s := names.similarity(parts[i], parts[j], accept)) >= accept:
                        out.append((fields[i], strs[i], strs[j], s))
                yield pd.DataFrame(out, columns=["field", "name_a", "name_b", "score"])

    return dealt(keyed, hot).mapInPandas(run, "field string, name_a string, name_b string, score double").distinct()


def classes(strings: DataFrame, series: frozenset[str], accept: float = ACCEPT) -> DataFrame:
    """``field``, ``name``, ``class``: the class (its first string by code point) of every distinct string."""
    found = links(strings, series, accept).select(F.struct("field", F.col("name_a").alias("name")).alias("a"), F.struct("field", F.col("name_b").alias("name")).alias("b"))
    members = connected_classes(found, "a", "b")
    return (
        strings.select("field", "name")
        .join(members.select("node.field", "node.name", F.col("class.name").alias("class")), ["field", "name"], "left")
        .withColumn("class", F.coalesce("class", "name"))
    )


def variant_pairs(strings: DataFrame, series: frozenset[str] = frozenset(), accept: float = ACCEPT) -> DataFrame:
    """``field``, ``name_a``, ``name_b``: all pairs of different strings of one entity, name_a < name_b by code point.

    ``strings`` has distinct ``field``, ``name``. Strings of a series agree in
    their number (none is 1). Null strings are left out, strings without a
    letter or digit have no variants, repeats count once, very long strings are
    compared whole; an empty input gives an empty result.
    """
    return pairs_within(durable(classes(strings, series, accept)))


def pairs_within(members: DataFrame, hot: int = HOT_BLOCK) -> DataFrame:
    """``field``, ``name_a``, ``name_b``: the pairs of names of one ``class``, name_a < name_b; those of more than ``hot`` names are dealt to several tasks."""
    counted = members.groupBy("field", "class").agg(F.count("*").alias("n")).where("n > 1").withColumn("shares", F.ceil(F.col("n") / hot).cast("int")).drop("n")
    many = members.join(counted, ["field", "class"])
    mine = many.withColumn("share", F.pmod(F.xxhash64("name"), F.col("shares")).cast("int"))
    every = many.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return (
        mine.alias("a")
        .join(every.alias("b"), [F.col("a.field") == F.col("b.field"), F.col("a.class") == F.col("b.class"), F.col("a.share") == F.col("b.share"), F.col("a.name") < F.col("b.name")])
        .select(F.col("a.field").alias("field"), F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
    )
