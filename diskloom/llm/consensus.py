"""Token-level consensus of a group's values: progressive alignment, weighted vote per column, closest existing value.

Distinct values are aligned one after the other, heaviest first, to a profile: a
list of columns, each with the weight of every token (and of a gap) in it. The
heaviest of each column makes the consensus; the existing value closest to it is
emitted. Weights add up, or, with arrival keys, the greatest counts: then each
record outweighs all earlier ones together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_counted
from ..session import durable
from . import names

#: Distinct values of a group aligned in one piece; of larger groups the pieces' profiles are aligned in turn.
PIECE = 500
#: Cost of a gap, and likeness from which two tokens may stand in one column though they differ.
GAP, ALIKE = 0.4, 0.6
#: Key of a gap in a column.
NONE = ""

_TOKEN = re.compile(r"\w+|[^\w\s]")

Profile = list[dict[str, int]]
Combine = Callable[[int, int], int]


def tokens(value: str) -> list[str]:
    return _TOKEN.findall(value)


def total(a: int, b: int) -> int:
    return a + b


def _alike(a: dict[str, int], b: dict[str, int]) -> float:
    """How well two columns go together: 1 if they share a token, else the best likeness of their tokens, -1 if that is low."""
    if any(t in a for t in b if t):
        return 1.0
    best = max((names.ratio(x.lower(), y.lower()) for x in a if x for y in b if y), default=0.0)
    return 0.9 * best if best >= ALIKE else -1.0


def align(a: Profile, weight_a: int, b: Profile, weight_b: int, combine: Combine) -> Profile:
    """Two profiles and the weights of all their values as one profile: global alignment of their columns."""
    n, m = len(a), len(b)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        best[i][0] = -GAP * i
    for j in range(1, m + 1):
        best[0][j] = -GAP * j
    alike = [[_alike(x, y) for y in b] for x in a]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j - 1] + alike[i - 1][j - 1], best[i - 1][j] - GAP, best[i][j - 1] - GAP)
    out: Profile = []
    i, j = n, m
    while i or j:
        if i and j and alike[i - 1][j - 1] > -1 and best[i][j] == best[i - 1][j - 1] + alike[i - 1][j - 1]:
            i, j = i - 1, j - 1
            column = dict(a[i])
            for t, w in b[j].items():
                column[t] = combine(column[t], w) if t in column else w
        elif i and (not j or best[i][j] <= best[i - 1][j] - GAP + 1e-9 or best[i - 1][j] >= best[i][j - 1]):
            i -= 1
            column = dict(a[i])
            column[NONE] = combine(column[NONE], weight_b) if NONE in column else weight_b
        else:
            j -= 1
            column = dict(b[j])
            column[NONE] = combine(column[NONE], weight_a) if NONE in column else weight_a
        out.append(column)
    return out[::-1]


def profile(values: list[tuple[str, int]], combine: Combine) -> tuple[Profile, int]:
    """Profile and weight of (value, weight) pairs, aligned heaviest first."""
    made: Profile | None = None
    weight = 0
    for value, w in sorted(values, key=lambda x: (-x[1], x[0])):
        own: Profile = [{t: w} for t in tokens(value)]
        made, weight = (own, w) if made is None else (align(made, weight, own, w, combine), combine(weight, w))
    return made or [], weight


def vote(made: Profile) -> list[str]:
    """The heaviest token of each column (of equals the first by code point, a gap last); columns won by a gap are left out."""
    return [t for t in (min(c, key=lambda t, c=c: (-c[t], t == NONE, t)) for c in made) if t]


def distance(a: list[str], b: list[str]) -> int:
    """Tokens changed, missing or added."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def closest(values: list[tuple[str, int]], consensus: list[str]) -> str:
    """The value nearest to the consensus; of equals the heaviest, then the first by code point."""
    return min(values, key=lambda x: (distance(tokens(x[0]), consensus), -x[1], x[0]))[0]


def consensus(rows: DataFrame, group: str, fields: tuple[str, ...], weight: Column, latest: bool = False, piece: int = PIECE) -> DataFrame:
    """``group``, ``field``, ``value``: of each group and text field the existing value closest to the token consensus.

    ``weight`` (a whole number above 0) tells how much a row counts; weights of
    equal values add up, or with ``latest`` the greatest counts. Null values and
    null groups are left out, a group without any value has no row, repeated rows
    count as often as they stand there (the caller drops them if they mean
    nothing), an empty text is a value without tokens. Equal values are added up
    before any group is brought together, and groups of more than ``piece``
    distinct values are aligned piece by piece, so no task holds an unbounded group.
    """
    combine: Combine = max if latest else total
    kind = "decimal(38,0)"
    cells = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), weight.cast(kind).alias("w"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("c"))
    values = durable(cells.select("g", "c.*", "w").where(F.col("value").isNotNull()).groupBy("g", "field", "value").agg((F.max("w") if latest else F.sum("w").cast(kind)).alias("w")))
    sizes = values.groupBy("g", "field").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    alone = sizes.where("n = 1").select("g", "field", "value")
    several = sizes.where("n > 1").select("g", "field", "n")
    held = F.collect_list(F.struct("value", F.col("w").cast("string").alias("w")))
    pairs = lambda x: [(v["value"], int(v["w"])) for v in x]

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"g": f["g"], "field": f["field"], "value": [closest(p, vote(profile(p, combine)[0])) for p in map(pairs, f["held"])]})

    small = values.join(several.where(F.col("n") <= piece).select("g", "field"), ["g", "field"]).groupBy("g", "field").agg(held.alias("held"))
    result = alone.unionByName(small.mapInPandas(settle, alone.schema))
    most = several.agg(F.max("n")).first()[0] or 0
    if most > piece:
        result = result.unionByName(_large(values, several.where(F.col("n") > piece), most, piece, combine, held, pairs, alone))
    return result.select(F.col("g").alias(group), "field", "value")


def _large(values: DataFrame, several: DataFrame, most: int, piece: int, combine: Combine, held: Column, pairs: Callable, like: DataFrame) -> DataFrame:
    """The closest values of groups of more than one piece: profiles of pieces, aligned piece by piece until one is left."""
    kind = f"g {like.schema['g'].dataType.simpleString()}, field string, slot long, made string"

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"g": f["g"], "field": f["field"], "slot": f["slot"], "made": [json.dumps(profile(p, combine)) for p in map(pairs, f["held"])]})

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for parts in f["parts"]:
                made, weight = json.loads(parts[0])
                for other in map(json.loads, parts[1:]):
                    made, weight = align(made, weight, *other, combine), combine(weight, other[1])
                out.append(json.dumps((made, weight)))
            yield pd.DataFrame({"g": f["g"], "field": f["field"], "slot": f["slot"], "made": out})

    counted = several.withColumn("slots", F.ceil(F.col("n") / piece).cast("long"))
    members = durable(join_counted(values, counted.withColumn("count", F.col("n")), ["g", "field"], "count"))
    slots = members.withColumn("slot", F.pmod(F.xxhash64("value"), F.col("slots")))
    made = durable(slots.groupBy("g", "field", "slot").agg(F.array_sort(held).alias("held")).mapInPandas(start, kind))
    width = -(-most // piece)
    while width > 1:
        width = -(-width // 16)
        made = durable(made.groupBy("g", "field", F.floor(F.col("slot") / 16).alias("slot")).agg(F.array_sort(F.collect_list("made")).alias("parts")).mapInPandas(join, kind))
    consensus_of = made.join(several, ["g", "field"]).select("g", "field", "n", "made")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        for f in frames:
            far = []
            for value, text in zip(f["value"], f["made"], strict=True):
                if text not in known:
                    known.clear()
                    known[text] = vote(json.loads(text)[0])
                far.append(distance(tokens(value), known[text]))
            yield pd.DataFrame({"g": f["g"], "field": f["field"], "value": f["value"], "w": f["w"], "far": far})

    near = join_counted(members.select("g", "field", "value", "w"), consensus_of, ["g", "field"], "n")
    rated = near.mapInPandas(measure, f"g {like.schema['g'].dataType.simpleString()}, field string, value string, w decimal(38,0), far int")
    return rated.groupBy("g", "field").agg(F.min_by("value", F.struct("far", -F.col("w"), "value")).alias("value"))
