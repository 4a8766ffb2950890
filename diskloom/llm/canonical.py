"""Typed names mapped to the entries of a reference list, or reported as unmatched.

Distinct names are normalised once; an inverted index of character n-grams over
the list's titles, a table of postings, gives every title that shares one, the
weighted cosine ranks them, and the best is accepted above a threshold and with
a margin over the next title. Parts of the name that tell entries of one title
apart then choose the entry.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import LANGUAGES
from ..session import durable, parallelism, small
from . import names

GRAM = 3
#: Weighted cosine from which a title is meant, and its lead over the next one.
ACCEPT, MARGIN = 0.33, 0.08
#: A title under this cosine must also show its words in the typed name, to this degree.
SURE, SHOWN = 0.65, 0.8
#: A word of the list is common if it stands in this share of the titles, and at least in LEAST of them.
COMMON_SHARE, COMMON_LEAST = 0.008, 5
#: Tables of up to this many rows are broadcast; larger ones are joined by a shuffle, with the same result.
BROADCAST_ROWS = 1_000_000

# Words for languages in typed names beside their codes.
LANGUAGE_WORDS = {
    "en": ("eng", "english", "uk version"), "de": ("ger", "german", "deutsch"), "fr": ("fre", "fra", "french", "francais"), "es": ("esp", "spa", "spanish", "espanol"), "it": ("ita", "italian", "italiano"),
    "nl": ("dutch", "nederlands"), "se": ("swedish", "svenska"), "da": ("danish", "dansk"), "pl": ("polish", "polski"), "cs": ("czech", "cesky"), "pt": ("portuguese", "portugues"), "fi": ("finnish", "suomi"),
    "no": ("norwegian", "norsk"), "gr": ("greek",), "hu": ("hungarian", "magyar"), "ru": ("russian",), "us": ("american", "us version"), "au": ("australian",), "jp": ("japanese",), "mul": ("multilingual",),
}
#: Codes of one language in several countries.
ENGLISH = frozenset(("en", "uk", "us", "au"))
_LANGUAGE_OF = {code: code for code in LANGUAGES} | {w: code for code, many in LANGUAGE_WORDS.items() for w in many}

_FOLDER = re.compile(r"^.*[/\\]")
_EXTENSION = re.compile(r"(?:\s*-\s*copy|\.(?:adf|adz|dms|zip|bak|ipf|gz|lha))+$", re.I)
_VERSION = re.compile(r"(?<![a-z])v(?:ersion|er)?[ ._\-]*(?!(?:19|20)\d\d)(\d+(?:[.,]\d+)*[a-z]?)(?![a-z0-9])", re.I)
_DISK = re.compile(r"(?<![a-z])(?:dis[kc]|dsk|diskette|disquette|disco|dischetto)[ ._\-]*(?:0*(\d{1,2})|([a-d])(?![a-z]))(?:[ ._\-]*(?:of|von|de|di|sur|/)[ ._\-]*\d{1,2})?|(?<![a-z0-9])d0*(\d{1,2})(?![a-z0-9])|(?<![a-z0-9.])0*(\d{1,2})[ ._\-]*of[ ._\-]*0*\d{1,2}(?![a-z0-9])", re.I)
_YEAR = re.compile(r"(?<!\d)(?:19\d\d|20\d\d|19xx)(?!\d)|'\d\d(?!\d)", re.I)
_CRACK = re.compile(r"\[cr[ _.\-]+([^\]]*)\]?|\(([^()]*?)[ _.\-]crack(?:ed)?\)|(?<![a-z])crack(?:ed)?[ _.\-]+by[ _.\-]+([^()\[\]]*)|(?<![a-z])cr[ _.\-]+([^()\[\]]*)", re.I)
_LANG_WORD = re.compile(r"(?<![a-z])(?:" + "|".join(re.escape(w).replace(r"\ ", "[ ._\\-]") for w in sorted(_LANGUAGE_OF, key=len, reverse=True)) + r")(?![a-z])", re.I)
_DEMO = re.compile(r"(?<![a-z])(?:demo[ ._\-]?playable|playable[ ._\-]?demo|demo|preview)(?![a-z])", re.I)
_BY = re.compile(r"(?<![a-z])by (?=[^ ]).*$| -(?=[^ \-\d])[^\-]*$", re.I)
_GROUP = re.compile(r"\([^()]*\)?|\[[^\[\]]*\]?")


@dataclass
class Typed:
    """A typed name taken apart; None where it doesn't say."""

    title: str
    version: str | None = None
    disk: int | None = None
    language: str | None = None
    crack: str | None = None
    demo: bool = False


def take_apart(name: str) -> Typed:
    """Parts of a typed file name; what is left is its title."""
    s = _EXTENSION.sub("", _FOLDER.sub("", names.base_letters(name).strip()))
    out = Typed("")

    def crack(m: re.Match) -> str:
        out.crack = re.split(r"(?<![a-z])by(?![a-z])", next((g for g in m.groups() if g), "").replace("_", " "), flags=re.I)[0].strip()
        return " "

    def version(m: re.Match) -> str:
        out.version = m.group(1).replace(",", ".").lower()
        return " "

    def disk(m: re.Match) -> str:
        n = next((g for g in m.groups() if g), None)
        if out.disk is None and n:
            out.disk = int(n) if n.isdigit() else ord(n.lower()) - 96
        return " "

    def language(m: re.Match) -> str:
        word = re.sub(r"[ ._\-]+", " ", m.group().lower())
        bare = word in LANGUAGES and s[max(0, m.start() - 1):m.start()] not in ("[", "(")
        if bare:
            return m.group()
        out.language = _LANGUAGE_OF.get(word, out.language)
        return " "

    def demo(_: re.Match) -> str:
        out.demo = True
        return " "

    s = _VERSION.sub(version, s)
    s = _CRACK.sub(crack, s)
    s = _DISK.sub(disk, s)
    s = _YEAR.sub(" ", s)
    s = _LANG_WORD.sub(language, s)
    s = _DEMO.sub(demo, s)
    s = _GROUP.sub(" ", s).replace("_", " ")
    if " " not in s.strip():
        s = s.replace(".", " ").replace("-", " ")
    s = re.sub(r"\.(?=[A-Za-z]{2})", ". ", s)
    cut = _BY.sub(" ", s)
    out.title = (cut if len(cut.strip()) >= 4 else s).strip(" -,./")
    return out


_ENTRY_DISK = re.compile(r"^disk (\d+) of \d+$", re.I)
_LISTED = re.compile(r"\(([^()]*)\)|\[([^\[\]]*)\]")


def listed(name: str) -> Typed:
    """Parts of a list name: title without subtitle, version, groups in parentheses, dump tags."""
    head = re.split(r"[(\[]", name, maxsplit=1)[0].strip()
    e = Typed("")
    m = re.search(r"(?:^| )[vV](\d\S*)$", head)
    if m:
        e.version, head = m.group(1).lower(), head[:m.start()].strip()
    for a, b in _LISTED.findall(name):
        a = a.strip()
        if b:
            if b.startswith("cr"):
                e.crack = b[2:].strip()
        elif d := _ENTRY_DISK.match(a):
            e.disk = int(d.group(1))
        elif a.lower() in LANGUAGES:
            e.language = a.lower()
        elif _DEMO.fullmatch(a):
            e.demo = True
    e.title = re.split(r": | - ", head)[0].strip() or name
    return e


def grams(text: str) -> list[int]:
    """Distinct n-grams of a text with its ends marked, each as one number."""
    x = [2, *map(ord, text), 3]
    return sorted({sum(c << 21 * (GRAM - 1 - k) for k, c in enumerate(x[at:at + GRAM])) for at in range(len(x) - GRAM + 1)}) if text else []


def shown(tokens: list[str], short: list[bool], core: list[str], common: list[str]) -> float:
    """How much of a title's core and common words a typed name shows, the core weighing more."""
    text = "".join(tokens)
    total = 0.0
    for t in core:
        best = 1.0 if t in text and len(t) > 4 else 0.0
        for k, u in enumerate(tokens):
            if best == 1.0:
                break
            s = names.likeness(t, u, False, short[k])
            best = max(best, s if len(u) > 1 or t == u else 0.0)
            if best < 0.9 and len(u) > len(t) + 2:  # words run together
                best = max(best, names.lcs(t, u[:len(t) + 1]) / len(t) * 0.97, names.lcs(t, u[-len(t) - 1:]) / len(t) * 0.97)
            if best < 0.9 and k + 1 < len(tokens):  # a word torn apart
                best = max(best, names.ratio(t, u + tokens[k + 1]))
        total += len(t) * best
    words = sorted((max([1.0 if len(w) > 4 and w in text else 0.0, *(names.likeness(w, u, False, short[k]) if len(u) > 1 else float(u == w[0]) for k, u in enumerate(tokens))]) for w in common), reverse=True)
    whole = total / (sum(map(len, core)) or 1)
    return 0.85 * whole + 0.15 * words[:2][-1] if words else whole


class ReferenceList:
    """A list as tables: ``entries`` of titles, ``titles`` with core and common words, ``postings`` (gram, title, weight squared), ``norms``."""

    def __init__(self, rows: DataFrame, key: str, name: str, most: int):
        spark = rows.sparkSession

        def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for k, s in zip(frame["k"], frame["s"], strict=True):
                    e = listed(s)
                    p = names.parse(e.title, True)
                    out.append((k, " ".join(p.tokens), p.number, e.version, e.disk, e.language, e.crack, e.demo))
                yield pd.DataFrame(out, columns=["dat_id", "base", "number", "version", "disk", "language", "crack", "demo"])

        kept = rows.select(F.col(key).cast("long").alias("k"), F.col(name).alias("s")).where(F.col("k").isNotNull() & F.col("s").isNotNull()).distinct()
        entries = durable(kept.mapInPandas(take, "dat_id long, base string, number int, version string, disk int, language string, crack string, demo boolean"))
        # Every list title once, numbered by hash bucket and place in it.
        bases = entries.where("base <> ''").select("base").distinct().withColumn("bucket", F.pmod(F.xxhash64("base"), F.lit(1 << 16)))
        bases = durable(bases.select("base", (F.shiftleft(F.col("bucket"), 32) + F.row_number().over(Window.partitionBy("bucket").orderBy("base"))).alias("title")))
        self.size = bases.count()
        tokens = bases.select("title", F.explode(F.array_distinct(F.split("base", " "))).alias("t")).where("length(t) > 3").groupBy("t").agg(F.count("*").alias("n"))
        # The share bounds the number of common words, whatever the size of the list.
        common = [r["t"] for r in tokens.where(F.col("n") >= max(COMMON_LEAST, COMMON_SHARE * self.size)).collect()]
        shared = spark.sparkContext.broadcast(names.Vocabulary(common))

        def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                split = [shared.value.split(names.Name(1, b.split(), [False] * len(b.split()))) for b in frame["base"]]
                yield pd.DataFrame({"title": frame["title"], "base": frame["base"], "core": [" ".join(c) for c, _ in split], "common": [" ".join(c) for _, c in split], "grams": [grams("".join(b.split())) for b in frame["base"]]})

        titles = durable(bases.mapInPandas(cut, "title long, base string, core string, common string, grams array<long>"))
        each = titles.select("title", F.explode("grams").alias("gram"))
        weights = each.groupBy("gram").agg((F.log(1 + F.lit(float(self.size)) / F.count("*")) ** 2).alias("w"))
        self.weights = small(durable(weights), most)
        postings = durable(each.join(self.weights, "gram"))
        self.norms = postings.groupBy("title").agg(F.sqrt(F.sum("w")).alias("norm"))
        self.postings = small(postings, most)
        self.titles = titles.drop("grams", "base").join(self.norms, "title")
        # Of entries that nothing tells apart the first is meant.
        details = ("core", "number", "version", "disk", "language", "crack", "demo")
        self.entries = entries.join(titles.select("base", "core"), "base").groupBy(*details).agg(F.min("dat_id").alias("dat_id"))
        self.rare = float(math.log(1 + self.size) ** 2)

    def cosines(self, queries: DataFrame) -> DataFrame:
        """``query``, ``title``, ``cosine`` of every title that shares a gram with a query (``query``, ``grams``)."""
        own = queries.repartition(parallelism(queries.sparkSession), "query").select("query", F.explode("grams").alias("gram"))
        lengths = own.join(self.weights, "gram", "left").groupBy("query").agg(F.sqrt(F.sum(F.coalesce("w", F.lit(self.rare)))).alias("length"))
        dots = own.join(self.postings, "gram").groupBy("query", "title").agg(F.sum("w").alias("dot"))
        return dots.join(lengths, "query").join(small(self.norms, BROADCAST_ROWS), "title").select("query", "title", (F.col("dot") / F.col("length") / F.col("norm")).alias("cosine"))


_TYPED = "name string, tokens string, short string, grams array<long>, number int, version string, disk int, language string, crack string, demo boolean"
_DETAILS = ("number", "version", "disk", "language", "crack", "demo")


def _fit(mine: Column, theirs: Column) -> Column:
    return F.when(mine.isNull(), 0.0).when(mine.eqNullSafe(theirs), 1.0).otherwise(-1.0)


def map_names(typed: DataFrame, entries: DataFrame, uid: str = "uid", name: str = "name", entry_key: str = "dat_id", entry_name: str = "name", accept: float = ACCEPT, margin: float = MARGIN,
              broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``uid``, ``dat_id`` of every uid in ``typed`` (rows ``uid``, ``name``, several names each): the entry its names mean, 0 for none.

    Null, empty and letterless names mean nothing; a uid that has only such
    names gets 0; null uids are left out; repeats change nothing; an empty list
    gives 0 throughout. Names of one uid that mean the same title complete each
    other's details. The list may be of any size: tables beyond
    ``broadcast_rows`` rows take shuffle joins.
    """
    reference = ReferenceList(entries, entry_key, entry_name, broadcast_rows)
    pairs = durable(typed.where(F.col(uid).isNotNull()).select(F.col(uid).alias("uid"), F.col(name).alias("name")).distinct())

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for s in frame["name"]:
                t = take_apart(s)
                p = names.parse(t.title, True)
                out.append((s, " ".join(p.tokens), "".join("01"[x] for x in p.short), grams(p.joined), p.number, t.version, t.disk, t.language, t.crack, t.demo))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _TYPED.split(", ")])

    distinct = pairs.where(F.col("name").isNotNull()).select("name").distinct().repartition(parallelism(typed.sparkSession))
    taken = durable(distinct.mapInPandas(take, _TYPED).withColumn("query", F.monotonically_increasing_id()))
    close = reference.cosines(taken.select("query", "grams")).where(F.col("cosine") >= accept - margin).join(reference.titles, "title")
    # Titles of one core are one series; the next best of another core is the rival.
    series = close.groupBy("query", "core").agg(F.max("cosine").alias("cosine"), F.max_by("common", "cosine").alias("common"))
    place = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "core")
    first = series.withColumns({"place": F.row_number().over(place), "next": F.coalesce(F.lead("cosine").over(place), F.lit(0.0))}).where((F.col("place") == 1) & (F.col("cosine") >= accept) & (F.col("cosine") - F.col("next") >= margin))
    ranked = durable(taken.drop("grams").join(first.select("query", "core", "common", "cosine"), "query"))

    def confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[shown(r.tokens.split(), [x == "1" for x in r.short], r.core.split(), r.common.split()) >= SHOWN for r in frame.itertuples(index=False)]]

    doubtful = ranked.where(F.col("cosine") < SURE)
    sure = ranked.where(F.col("cosine") >= SURE).unionByName(doubtful.mapInPandas(confirm, doubtful.schema)).select("name", "core", "cosine", *_DETAILS)
    meant = pairs.join(sure, "name")
    title = meant.groupBy("uid").agg(F.max_by("core", F.struct("cosine", "core")).alias("title"))
    details = (
        meant.join(title, "uid")
        .where(F.col("core") == F.col("title"))
        .groupBy("uid", "core")
        .agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("cosine", "name"))).alias(c) for c in ("version", "disk", "language", "crack")), F.max("number").alias("number"), F.max("demo").alias("demo"))
    )
    offered = details.alias("t").join(reference.entries.alias("e"), [F.col("t.core") == F.col("e.core"), F.col("t.number") == F.col("e.number")])
    offered = offered.select("uid", "dat_id", *(F.col(f"t.{c}").alias(f"my_{c}") for c in _DETAILS[1:]), *(F.col(f"e.{c}").alias(c) for c in _DETAILS[1:]))

    def cracks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        likeness = lambda a, b: names.ratio(names.parse(a, False).joined, names.parse(b, False).joined) if a and b else 0.5
        for frame in frames:
            yield frame.assign(crack_fit=[0.0 if a is None or b is None else likeness(a, b) for a, b in zip(frame["my_crack"], frame["crack"], strict=True)])

    both = F.col("my_crack").isNotNull() & F.col("crack").isNotNull()
    named = offered.where(both).mapInPandas(cracks, offered.withColumn("crack_fit", F.lit(0.0)).schema)
    rated = offered.where(~both).withColumn("crack_fit", F.when(F.col("my_crack").isNull() & F.col("crack").isNotNull(), -1.0).otherwise(0.0)).unionByName(named)
    english = F.col("my_language").isin(*ENGLISH) & F.col("language").isin(*ENGLISH) & (F.col("my_language") != F.col("language"))
    agreement = (
        _fit(F.col("my_disk"), F.col("disk")) + _fit(F.col("my_version"), F.col("version")) + F.when(english, 0.9).otherwise(_fit(F.col("my_language"), F.col("language")))
        + F.col("crack_fit") + F.when(F.col("my_demo") == F.col("demo"), 0.5).otherwise(0.0)
    )
    # Of entries that fit alike the lowest disk, then one without version, without language or in English, then the first is meant.
    order = F.struct(agreement.alias("a"), (-F.coalesce("disk", F.lit(0))).alias("d"), F.col("version").isNull().alias("v"), F.coalesce(F.col("language") == "en", F.lit(True)).alias("l"), (-F.col("dat_id")).alias("i"))
    entry = rated.groupBy("uid").agg(F.max_by("dat_id", order).alias("_id"))
    return pairs.select("uid").distinct().join(entry, "uid", "left").select(F.col("uid").alias(uid), F.coalesce("_id", F.lit(0).cast("long")).alias(entry_key))


def quarantined_names(quarantine: DataFrame, artifact: DataFrame) -> DataFrame:
    """``uid``, ``name``: the names given to each quarantined uid, a null for each that has none."""
    uids = quarantine.where(F.col("artifact_uid").isNotNull()).select(F.col("artifact_uid").alias("uid")).distinct()
    given = artifact.select("uid", F.explode(F.array("orig_filename", "tosec_name")).alias("name")).where(F.col("name").isNotNull())
    return given.join(uids, "uid", "left_semi").unionByName(uids.withColumn("name", F.lit(None).cast("string")))
