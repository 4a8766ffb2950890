"""Metadata enrichment: targets, fuzzy page match, merge of providers, image replacement."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flags, naming
from ..functions import similarity as sim
from ..session import durable, small
from ..sources.pages import scan_pages
from .skew import join_blocks

#: Most screenshots kept per title.
MOST_SHOTS = 6
#: Word overlap and edit ratio of a pair whose similarity is the floor when rounded to four places add up to this at least.
LEAST = 2 * sim.FLOOR - 0.001
#: A word or gram of up to so many titles is a key by itself; letters of a gram; common words of a title from which it is indexed by each.
RARE, GRAM, WIDE = 200, 4, 24


class Provider(Protocol):
    """A metadata source: results for titles (``title_id``, ``name``), with ``priority``, ``result_id``, ``source`` and the columns that ``merge`` reads."""

    name: str

    def results(self, titles: DataFrame) -> DataFrame: ...


class TableProvider:
    """Results that lie in a table under the page titles of their sources."""

    def __init__(self, name: str, rows: DataFrame):
        self.name, self.rows = name, rows

    def results(self, titles: DataFrame) -> DataFrame:
        """Each source's results on the page that a title leads to: the page of its own slug, else the best fuzzy match, if any."""
        rows = self.rows.distinct().withColumn("slug", sim.slug(F.col("page_title")))
        links = rows.where(F.col("page_title").isNotNull()).select("source", F.col("page_title").alias("label"), "slug").distinct()
        hits = pages_for(titles, links, ("source",)).drop("exact")
        return hits.alias("h").join(rows.alias("r"), F.col("h.source").eqNullSafe(F.col("r.source")) & (F.col("h.slug") == F.col("r.slug"))).select("h.title_id", "r.*")


class PageProvider:
    """A site whose pages lie in a table (``url``, ``label``, ``html``): they are found by name and scanned; a page that isn't there has no result."""

    def __init__(self, name: str, priority: int, rows: DataFrame):
        self.name, self.priority, self.rows = name, priority, rows

    def results(self, titles: DataFrame) -> DataFrame:
        links = self.rows.select("label", sim.slug(F.col("label")).alias("slug")).distinct()
        hits = pages_for(titles, links).drop("exact").join(titles.select("title_id", "name"), "title_id")
        found = hits.join(self.rows.select("url", "html", sim.slug(F.col("label")).alias("slug")), "slug").where(F.col("html").isNotNull())
        read = scan_pages(found.select("url", "html").distinct())
        picture = lambda h: F.struct(h.alias("url"), F.lit(None).cast("string").alias("caption"), F.lit(self.name).alias("source"))
        return found.drop("html").join(read, "url").select(
            "title_id", F.lit(self.priority).alias("priority"), F.xxhash64("url").alias("result_id"), F.lit(self.name).alias("source"), F.col("url").alias("external_url"), "description", "genre", F.lit(None).cast("int").alias("year"),
            F.when(F.col("cover").isNotNull(), picture(F.col("cover"))).alias("cover"), F.transform("shots", picture).alias("shots"), sim.similarity(F.col("name"), F.col("title")).alias("score"),
        )


def targets(title: DataFrame, edition: DataFrame, artifact: DataFrame, fetched: DataFrame | None = None, only: int | None = None) -> DataFrame:
    """Titles to look up with the earliest year of their artifacts; ``fetched`` (``title_id``) are skipped, ``only`` one id may be asked for, 0 too."""
    if only is not None:
        title = title.where(F.col("id") == only)
    if fetched is not None:
        title = title.join(fetched.select(F.col("title_id").alias("id")), "id", "left_anti")
    years = artifact.groupBy(F.col("edition_id").alias("eid")).agg(F.min("year").alias("year")).join(edition.select(F.col("id").alias("eid"), F.col("title_id").alias("id")), "eid").groupBy("id").agg(F.min("year").alias("year"))
    return title.join(years, "id", "left").select(F.col("id").alias("title_id"), "name", "category", "year")


def by_slug(titles: DataFrame, pages: DataFrame) -> DataFrame:
    """Titles (``title_id``, ``name``) joined to pages (``slug``, ...) of their own slug."""
    return titles.withColumn("slug", sim.slug(F.col("name"))).join(pages, "slug")


def fuzzy_matches(titles: DataFrame, links: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Best link (``label``, ``slug``) of each title (``title_id``, ``name``) within its index letter, from the floor on; ties fall to the least slug. With ``by``, columns of links, the best for each of their values.

    No pair that could be accepted is left out; titles alike in their words are compared once.
    """
    named = titles.select("title_id", sim.normalize(F.col("name")).alias("_a"))
    linked = links.select("label", "slug", *by, sim.normalize(F.col("label")).alias("_b")).distinct()
    scored = alike(named.select("_a"), linked.select("_b")).where(F.col("score") >= F.lit(sim.FLOOR).cast("float")).join(linked, "_b")
    best = scored.groupBy("_a", *by).agg(F.min_by(F.struct("slug", "label", "score"), F.struct(-F.col("score"), F.col("slug"))).alias("_b")).select("_a", *by, "_b.*")
    return named.distinct().join(best, "_a").drop("_a")


def similar_pairs(titles: DataFrame, links: DataFrame, label: str, same_letter: bool = True) -> DataFrame:
    """Titles and links (of one index letter) with ``score``: all pairs that reach the floor, rounded to four places, and some below it."""
    named = titles.select("title_id", "name", sim.normalize(F.col("name")).alias("_a")).distinct()
    linked = links.withColumn("_b", sim.normalize(F.col(label))).distinct()
    return named.join(alike(named.select("_a"), linked.select("_b"), same_letter), "_a").join(linked, "_b").drop("_a", "_b")


def alike(left: DataFrame, right: DataFrame, same_letter: bool = True) -> DataFrame:
    """``_a``, ``_b``, ``score``: the normalised titles of ``left`` (its only column) and ``right`` (of one index letter) whose similarity reaches the floor within a margin for rounding.

    With shared words s of a and b distinct ones, a similarity of the floor needs
    s / (a + b - s) + edit ratio of at least LEAST, so a pair has equal run-together
    forms, or shares a word, and
    - that word is rare (in up to RARE titles): it is the key, or
    - two common words are shared: the key are both (each word, where one of the titles has very many), or
    - one common word is shared and a + b is up to 5: the key is the word with both sizes, or
    - one is shared and a + b is 6 or more: then the edit ratio is over LEAST - 0.2, the edits k are at most k of the
      length, and of the rarest GRAM * k + 1 letter grams of both one is shared: that is the key.
    No pair is left out. Titles are distinct, scored where they meet, and only those that pass are moved.
    """
    side = lambda df, right_: df.select(F.col(df.columns[0]).alias("_t"), F.lit(right_).alias("_right")).where("_t <> ''").distinct()
    words = F.split("_t", " ")
    forms = durable(side(left, False).unionByName(side(right, True)).select(F.monotonically_increasing_id().alias("_id"), "_t", "_right", F.array_sort(F.array_distinct(words)).alias("_w"), F.array_join(words, "").alias("_j")))
    length = F.length("_j")
    grams = F.when(length >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), length - GRAM + 1), lambda k: F.substring(F.col("_j"), k, F.lit(GRAM)))))

    def counted(values: Column) -> DataFrame:
        """``_id``, ``_v``: values of each title in order of their number in all titles, rarest first, as structs (``n``, ``v``); 0 stands for up to RARE."""
        each = forms.select("_id", F.explode(values).alias("v"))
        often = small(durable(each.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > RARE)))
        return each.join(often, "v", "left").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "v"))).alias("_v"))

    edits = F.floor(length * (1.2 - LEAST) / (LEAST - 0.2) + 1e-6).cast("int")
    known = forms.join(counted(F.col("_w")), "_id").join(counted(grams).withColumnRenamed("_v", "_g"), "_id", "left")
    marked = lambda mark, v: F.concat(F.lit(mark), v)
    common = F.array_sort(F.transform(F.filter("_v", lambda x: x["n"] > 0), lambda x: x["v"]))
    known = known.select("*", common.alias("_c"), F.size("_w").alias("_n")).withColumn("_wide", F.size("_c") > WIDE)
    none = F.array().cast("array<string>")
    sizes = F.filter(F.array(*(F.lit(k) for k in range(1, 5))), lambda k: k + F.col("_n") <= 5)
    sized = F.flatten(F.transform(sizes, lambda k: F.transform("_c", lambda w: F.concat_ws(":", F.lit("s"), F.when(F.col("_right"), k).otherwise(F.col("_n")).cast("string"), F.when(F.col("_right"), F.col("_n")).otherwise(k).cast("string"), w))))
    pairs = F.flatten(F.transform("_c", lambda w, k: F.transform(F.slice("_c", k + 2, F.size("_c")), lambda x: F.concat_ws(" ", F.lit("p"), w, x))))
    wide = F.flatten(F.transform("_c", lambda w: F.when(F.col("_wide"), F.array(marked("l:", w), marked("r:", w))).otherwise(F.array(F.concat(F.when(F.col("_right"), "l:").otherwise("r:"), w)))))
    keys = F.concat(
        F.array(marked("=", F.col("_j"))), F.transform(F.filter("_v", lambda x: x["n"] == 0), lambda x: marked("w:", x["v"])), sized, F.when(F.col("_wide"), none).otherwise(pairs), wide,
        F.when((F.size("_c") > 0) & F.col("_g").isNotNull(), F.transform(F.slice("_g", F.lit(1), edits * GRAM + 1), lambda x: marked("g:", x["v"]))).otherwise(none),
    )
    letter = F.coalesce(F.nullif(F.regexp_extract("_t", "[a-z]", 0), F.lit("")), F.lit("0")) if same_letter else F.lit("")
    indexed = durable(known.select("_id", "_right", "_w", "_j", sim.word_bits(F.col("_w")).alias("_x"), sim.letter_bits(F.col("_j")).alias("_y"), F.transform(keys, lambda k: F.concat(letter, k)).alias("_keys")))
    keyed = lambda right_, x: indexed.where(F.col("_right") == right_).select(F.col("_id").alias(f"_i{x}"), F.col("_w").alias(f"_w{x}"), F.col("_j").alias(f"_j{x}"), F.col("_x").alias(f"_x{x}"), F.col("_y").alias(f"_y{x}"), F.explode("_keys").alias("_key"))
    longest = F.greatest(F.length("_ja"), F.length("_jb"))
    lengths = F.least(F.length("_ja"), F.length("_jb")) / longest
    # What the bits of two titles allow is at least their word overlap and edit ratio; few pairs are left to be compared.
    lost = lambda bits, a, b: F.bit_count(F.col(bits + a).bitwiseAND(F.bitwise_not(F.col(bits + b))))
    most = F.least(F.size("_wa") - lost("_x", "a", "b"), F.size("_wb") - lost("_x", "b", "a"))
    bound = most / (F.size("_wa") + F.size("_wb") - most) + 1 - F.greatest(lost("_y", "a", "b"), lost("_y", "b", "a"), F.abs(F.length("_ja") - F.length("_jb"))) / longest
    met = join_blocks(keyed(False, "a"), keyed(True, "b"), "_key").where((bound >= LEAST) | (F.col("_ja") == F.col("_jb"))).select("_ia", "_ib", "_wa", "_wb", "_ja", "_jb")
    met = naming.expand(met, F.struct(F.size(F.array_intersect("_wa", "_wb")).alias("_s")))
    met = naming.expand(met, F.struct((F.col("_s") / (F.size("_wa") + F.size("_wb") - F.col("_s"))).alias("_jaccard"))).where((F.col("_jaccard") + lengths >= LEAST) | (F.col("_ja") == F.col("_jb")))
    allowed = F.greatest(F.floor((1 - LEAST + F.col("_jaccard")) * longest + 1e-6).cast("int"), F.lit(0))
    met = naming.expand(met, F.struct(F.call_function("levenshtein", "_ja", "_jb", allowed).alias("_edits"))).where("_edits >= 0")
    score = F.when(F.col("_ja") == F.col("_jb"), F.lit(1.0)).otherwise(0.5 * F.col("_jaccard") + 0.5 * F.greatest(1 - F.col("_edits") / longest, F.lit(0.0))).cast("float")
    passed = met.select("_ia", "_ib", score.alias("score")).distinct()
    text = lambda right_, x: forms.where(F.col("_right") == right_).select(F.col("_id").alias(f"_i{x}"), F.col("_t").alias(f"_{x}"))
    return durable(passed.join(text(False, "a"), "_ia").join(text(True, "b"), "_ib").select("_a", "_b", "score"))


def pages_for(titles: DataFrame, links: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``title_id``, ``slug``, ``exact`` of the page each title leads to: the page of its own slug, else the best fuzzy match; titles without either are left out. With ``by``, columns of links, a page for each of their values."""
    exact = by_slug(titles.select("title_id", "name"), links.select("slug", *by).distinct()).select("title_id", "slug", *by).withColumn("exact", F.lit(True))
    fuzzy = fuzzy_matches(titles, links, by).select("title_id", "slug", *by).withColumn("exact", F.lit(False))
    return exact.unionByName(fuzzy.join(exact.select("title_id", *by).distinct(), ["title_id", *by], "left_anti"))


def merge(results: DataFrame) -> DataFrame:
    """One record per title from provider results (``title_id``, ``priority``, ``result_id``, ...): first known value per attribute in priority order.

    Results under the floor (or without score) don't take part; score is the
    greatest, sources are distinct in order, screenshots distinct by URL in order.
    """
    kept = results.where(F.col("score") >= F.lit(sim.FLOOR).cast("float"))
    order = F.struct("priority", "result_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    base = kept.groupBy("title_id").agg(*(first(c) for c in ("genre", "description", "year", "external_url", "cover")), F.max("score").alias("score"))
    sources = kept.groupBy("title_id", "source").agg(F.min(order).alias("o")).groupBy("title_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "source"))), lambda x: x["source"]), ",").alias("sources"))
    shots = kept.select("title_id", "priority", "result_id", F.posexplode("shots").alias("pos", "shot")).groupBy("title_id", F.col("shot.url").alias("url")).agg(F.min(F.struct("priority", "result_id", "pos", "shot")).alias("o"))
    shots = shots.groupBy("title_id").agg(F.transform(F.array_sort(F.collect_list("o")), lambda x: x["shot"]).alias("shots"))
    return base.join(sources, "title_id").join(shots, "title_id", "left").withColumn("shots", F.coalesce("shots", F.slice(F.array("cover"), 1, 0)))


def wanted_images(merged: DataFrame, details: bool = False) -> DataFrame:
    """``title_id``, ``kind``, ``ord``, ``url`` (with ``details`` caption and source too) of a merged record's images: the cover and the first screenshots."""
    fields = ("url", "caption", "source") if details else ("url",)
    cover = merged.where(F.col("cover").isNotNull()).select("title_id", F.lit("cover").alias("kind"), F.lit(0).alias("ord"), *(F.col(f"cover.{c}").alias(c) for c in fields))
    shots = merged.select("title_id", F.posexplode(F.slice("shots", 1, MOST_SHOTS)).alias("ord", "s")).select("title_id", F.lit("screenshot").alias("kind"), "ord", *(F.col(f"s.{c}").alias(c) for c in fields))
    return cover.unionByName(shots)


def replace_images(existing: DataFrame, fresh: DataFrame, merged: DataFrame) -> DataFrame:
    """Images after a run over the titles of ``merged`` (``title_id``, ``has_cover``, ``has_shots``).

    A kind is replaced where images of it came in, or where the merge had none of
    it; where all its downloads failed the old ones stay, and so do those of
    titles that weren't looked up. Any kind but cover counts as screenshot.
    """
    kind = F.when(F.col("kind") == "cover", "cover").otherwise("screenshot")
    asked = merged.select("title_id", F.explode(F.array(F.struct(F.lit("cover").alias("k"), F.col("has_cover").alias("expected")), F.struct(F.lit("screenshot").alias("k"), F.col("has_shots").alias("expected")))).alias("x")).select("title_id", "x.*")
    came = fresh.select("title_id", kind.alias("k")).distinct().withColumn("came", F.lit(True))
    replaced = asked.join(came, ["title_id", "k"], "left").where(F.coalesce("came", F.lit(False)) | ~F.col("expected")).select("title_id", "k")
    kept = existing.withColumn("k", kind).join(replaced, ["title_id", "k"], "left_anti").drop("k")
    return kept.unionByName(fresh.withColumn("k", kind).join(replaced, ["title_id", "k"], "left_semi").drop("k"))


def run(titles: DataFrame, providers: list[Provider], images: DataFrame, meta: DataFrame, screenshots: DataFrame, now: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An enrichment of ``titles`` (``title_id``, ``name``): (metadata, screenshots, report) after it.

    Results of all providers are merged by priority; a title with none above the
    floor is skipped. ``images`` (``url``, ``content``, ``header``) are what could
    be fetched; a null content failed. ``now`` is the time of the run in unix
    seconds, the present if it isn't given. The report has ``total``, ``enriched`` and ``skipped``.
    """
    results = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.results(titles) for p in providers))
    merged = durable(merge(results))
    wanted = wanted_images(merged, details=True)
    blob = images.where(F.col("content").isNotNull()).select("url", F.sha1("content").alias("blob_sha1"), flags.image_type(F.col("content"), F.col("header")).alias("mime")).dropDuplicates(["url"])
    fresh = wanted.join(blob, "url").select("title_id", "blob_sha1", "mime", "caption", "source", F.col("ord").cast("long").alias("ord"), "kind")
    expected = merged.select("title_id", F.col("cover").isNotNull().alias("has_cover"), (F.size("shots") > 0).alias("has_shots"))
    rows = merged.select("title_id", "genre", "description", "year", "sources", "external_url", F.col("score").cast("double").alias("match_score"), (F.unix_timestamp() if now is None else F.lit(now)).cast("long").alias("fetched_at"))
    done = titles.select("title_id").distinct().join(rows.select("title_id", F.lit(True).alias("_hit")), "title_id", "left")
    report = done.agg(F.count("*").alias("total"), F.count_if("_hit").alias("enriched"), F.count_if(F.col("_hit").isNull()).alias("skipped"))
    return save_meta(meta, rows), replace_images(screenshots, fresh, expected), report


def save_meta(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Metadata rows by title, fresh ones instead of old ones."""
    return existing.join(fresh.select("title_id"), "title_id", "left_anti").unionByName(fresh)
