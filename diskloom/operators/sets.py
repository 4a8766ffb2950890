"""Editions, sets of disks, lineages: primaries, coverage, playable sets. Everything is set-at-a-time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flags, naming
from ..session import durable

SET = ("title", "category", "version", "language", "publisher", "qualifier", "disk_count")
EDITION = (*SET, "disk_no")
#: Order of releases: the four leading keys, then the rest as they were grouped.
RELEASES = ("title", "category", "qualifier", "disk_count", "version", "language", "publisher")


def sound() -> Column:
    return ~flags.disqualified(F.col("bad"), F.col("virus"), F.col("over"), F.col("under"))


def rank() -> list[Column]:
    return flags.rank(F.col("verified_good"), F.col("modifications"), F.col("trainer"), F.col("alt_index"))


def edition_primary(artifacts: DataFrame) -> DataFrame:
    """Best sound dump of each edition, null if none is sound."""
    return artifacts.groupBy(*EDITION).agg(F.min_by("uid", F.when(sound(), F.struct(*rank(), F.col("uid")))).alias("primary_uid"))


def _members(artifacts: DataFrame, missing_disk: int) -> DataFrame:
    return artifacts.withColumns({"tag": F.coalesce("lineage", F.lit("")), "disk": F.coalesce("disk_no", F.lit(missing_disk).cast("long"))})


def set_size(artifacts: DataFrame) -> DataFrame:
    """``needed`` disks of each set: the declared count, else the greatest disk held, at least 1."""
    return artifacts.groupBy(*SET).agg(F.max("disk_no").alias("_held")).withColumn("needed", F.greatest(F.coalesce("disk_count", "_held", F.lit(1).cast("long")), F.lit(1).cast("long"))).drop("_held")


def same_set(a: str, b: str, keys: tuple[str, ...] = SET) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def lineage_coverage(artifacts: DataFrame, declared: bool = False) -> DataFrame:
    """Each lineage of a set (empty tag: no group): ``covered`` disks, ``complete``, ``mods``, ``place`` (1: the set's primary lineage), ``kind``.

    Only sound dumps count. Completeness is relational division by counting the
    disks within 1..needed, never by listing 1..needed. ``declared`` uses the
    declared disk count and disk 0 for a missing number (as primaries are
    recomputed) instead of the held disks and disk 1.
    """
    members = _members(artifacts, 0 if declared else 1).where(sound())
    if declared:
        members = members.withColumn("needed", F.coalesce("disk_count", F.lit(0).cast("long")))
    else:
        size = set_size(artifacts)
        members = members.alias("m").join(size.alias("s"), same_set("m", "s")).select("m.*", "s.needed")
    by = members.groupBy(*SET, "tag").agg(
        F.array_sort(F.collect_set("disk")).alias("covered"), F.max("needed").alias("needed"), F.sum("modifications").alias("mods"),
        F.min_by(flags.class3(F.col("dump_type")), F.struct(*rank(), F.col("disk_no"), F.col("uid"))).alias("kind"),
        F.min_by("trainer", F.when(F.col("trainer").isNotNull(), F.struct(F.col("disk_no"), F.col("uid")))).alias("trainer"),
    )
    inside = F.size(F.filter("covered", lambda d: (d >= 1) & (d <= F.col("needed"))))
    by = by.withColumn("complete", (F.col("needed") == 0) | (inside == F.col("needed")))
    order = Window.partitionBy(*SET).orderBy((~F.col("complete")).asc(), F.size("covered").desc(), "mods", "tag")
    return by.withColumn("place", F.row_number().over(order))


def best_per_disk(artifacts: DataFrame, missing_disk: int = 1) -> DataFrame:
    """Best sound dump of each disk within a lineage of a set."""
    return _members(artifacts, missing_disk).where(sound()).groupBy(*SET, "tag", "disk").agg(F.min_by(F.struct("uid", "disk_no"), F.struct(*rank(), F.col("uid"))).alias("_p")).select(*SET, "tag", "disk", "_p.*")


def primary_lineage(artifacts: DataFrame, declared: bool = False) -> DataFrame:
    return lineage_coverage(artifacts, declared).where("place = 1").select(*SET, "tag", "complete", "covered")


def coherent_primaries(artifacts: DataFrame) -> DataFrame:
    """Primary of each edition: in sets declared as several disks the primary lineage's dump where it has one, else the edition's own best."""
    several = artifacts.where(F.col("disk_count") > 1)
    chosen = primary_lineage(several, declared=True)
    picks = best_per_disk(several, 0).alias("b").join(chosen.alias("c"), same_set("b", "c", (*SET, "tag"))).select("b.*")
    own = edition_primary(artifacts)
    return own.alias("o").join(picks.alias("p"), same_set("o", "p", EDITION), "left").select("o.*", "p.uid").select(*EDITION, F.coalesce("uid", "primary_uid").alias("primary_uid"))


def resolved_sets(artifacts: DataFrame, disks: DataFrame | None = None) -> DataFrame:
    """Files of every lineage of a set as ``disk:uid`` in disk order."""
    return (best_per_disk(artifacts) if disks is None else disks).groupBy(*SET, "tag").agg(F.array_sort(F.collect_list(F.struct("disk", "uid"))).alias("_f")).select(*SET, "tag", F.array_join(F.transform("_f", lambda f: F.concat_ws(":", f["disk"].cast("string"), f["uid"])), ",").alias("files"))


def missing_disks(coverage: DataFrame) -> DataFrame:
    """``missing``: runs (``first``, ``last``) of disks in 1..needed that a lineage lacks, and ``missing_count``; no list of 1..needed is ever made, so any declared count will do."""
    inside = F.filter("covered", lambda d: (d >= 1) & (d <= F.col("needed")))
    zero = F.array(F.lit(0).cast("long"))
    runs = F.filter(F.zip_with(F.concat(zero, inside), F.concat(inside, F.array(F.col("needed") + 1)), lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last"))), lambda r: r["first"] <= r["last"])
    return coverage.withColumn("missing", runs).withColumn("missing_count", F.aggregate("missing", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1))


def runs_text(runs: Column) -> Column:
    """Runs of disks as text: ``2``, ``2,3``, ``2-9``."""
    one = lambda r: F.when(r["first"] == r["last"], r["first"].cast("string")).otherwise(F.concat(r["first"].cast("string"), F.when(r["last"] == r["first"] + 1, ",").otherwise("-"), r["last"].cast("string")))
    return F.array_join(F.transform(runs, one), ",")


def trainer_options(artifacts: DataFrame, coverage: DataFrame | None = None, disks: DataFrame | None = None) -> DataFrame:
    """Choices of trainer on the boot disk of complete lineages: best dump per trainer (none is one), where there are two or more.

    ``coverage`` and ``disks`` are what lineage_coverage and best_per_disk give, where they are known.
    """
    complete = (lineage_coverage(artifacts) if coverage is None else coverage).where("complete").select(*SET, "tag")
    disks = best_per_disk(artifacts) if disks is None else disks
    boot = disks.groupBy(*SET, "tag").agg(F.min_by(F.struct(F.col("disk").alias("boot_disk"), F.col("uid").alias("default_uid")), "disk").alias("_b")).select(*SET, "tag", "_b.*")
    boot = boot.alias("b").join(complete.alias("c"), same_set("b", "c", (*SET, "tag"))).select("b.*")
    members = _members(artifacts, 1).where(sound()).alias("m").join(boot.alias("b"), same_set("m", "b", (*SET, "tag")) & (F.col("m.disk") == F.col("b.boot_disk"))).select("m.*", "b.boot_disk", "b.default_uid")
    best = members.groupBy(*SET, "tag", "trainer").agg(F.min_by("uid", F.struct(*rank(), F.col("uid"))).alias("uid"), F.max("default_uid").alias("default_uid"), F.max("boot_disk").alias("boot_disk"))
    several = best.withColumn("_n", F.count("*").over(Window.partitionBy(*SET, "tag"))).where("_n >= 2")
    return several.select(*SET, "tag", "boot_disk", "trainer", "uid", (F.col("uid") == F.col("default_uid")).alias("is_default"))


def playable_sets(artifacts: DataFrame) -> DataFrame:
    """Every lineage of a set as a download: kind, trainer, completeness, missing disks, files of complete ones, trainer choices."""
    # One row per lineage and one per disk of it, each used several times.
    coverage, disks = durable(lineage_coverage(artifacts)), durable(best_per_disk(artifacts))
    rows = missing_disks(coverage)
    files = resolved_sets(artifacts, disks)
    options = trainer_options(artifacts, coverage, disks).groupBy(*SET, "tag").agg(F.array_sort(F.collect_list(F.struct("trainer", "uid", "is_default"))).alias("_o"))
    options = options.select(*SET, "tag", F.array_join(F.transform("_o", lambda o: F.concat(F.coalesce(o["trainer"], F.lit("-")), F.lit("="), o["uid"], F.when(o["is_default"], "*").otherwise(""))), ",").alias("options"))
    joined = rows.alias("r").join(files.alias("f"), same_set("r", "f", (*SET, "tag")), "left").join(options.alias("o"), same_set("r", "o", (*SET, "tag")), "left")
    return joined.select(
        *(F.col(f"r.{k}").alias(k) for k in SET), "r.tag", "r.kind", "r.trainer", "r.complete", runs_text(F.col("r.missing")).alias("missing"), (F.col("r.place") == 1).alias("recommended"),
        F.when(F.col("r.complete"), F.col("f.files")).otherwise("").alias("files"), F.coalesce("o.options", F.lit("")).alias("options"),
    )


def set_export(artifacts: DataFrame, tag: str | None = None, boot: DataFrame | None = None) -> DataFrame:
    """``canonical``, ``sha1``, ``disk`` of every file in complete sets (of lineage ``tag``, or all).

    ``boot`` (``uid``) names dumps to use as boot disk; those that aren't sound
    dumps of the boot disk in the same lineage are ignored.
    """
    complete = lineage_coverage(artifacts).where("complete").select(*SET, "tag")
    if tag is not None:
        complete = complete.where(F.col("tag") == tag)
    files = best_per_disk(artifacts).alias("b").join(complete.alias("c"), same_set("b", "c", (*SET, "tag"))).select("b.*")
    if boot is not None:
        first = files.groupBy(*SET, "tag").agg(F.min("disk").alias("disk"))
        wanted = _members(artifacts, 1).where(sound()).join(boot.select("uid").distinct(), "uid", "left_semi")
        chosen = wanted.alias("w").join(first.alias("f"), same_set("w", "f", (*SET, "tag", "disk"))).groupBy(*(F.col(f"w.{k}").alias(k) for k in (*SET, "tag", "disk"))).agg(F.min("w.uid").alias("other"))
        files = files.alias("b").join(chosen.alias("c"), same_set("b", "c", (*SET, "tag", "disk")), "left").select(*(F.col(f"b.{k}").alias(k) for k in (*SET, "tag", "disk", "disk_no")), F.coalesce("c.other", "b.uid").alias("uid"))
    named = files.join(artifacts.select("uid", "sha1"), "uid")
    return named.select(*SET, "tag", "disk", "uid", canonical().alias("canonical"), "sha1")


def export_requests(artifacts: DataFrame, requests: DataFrame) -> DataFrame:
    """One answer per request (``request``, set key, ``tag``, ``boot``): its files in disk order, or an ``error``.

    A set that isn't there and a lineage that isn't complete (unknown ones too)
    are errors; a boot dump that isn't a sound dump of the boot disk is ignored.
    """
    cover = lineage_coverage(artifacts).where("complete").select(*SET, "tag")
    known = artifacts.select(*SET).distinct()
    asked = requests.alias("q").join(known.alias("k"), same_set("q", "k"), "left_semi").select("request").withColumn("_known", F.lit(True))
    whole = requests.alias("q").join(cover.alias("c"), same_set("q", "c", (*SET, "tag")), "left_semi")
    best = best_per_disk(artifacts)
    files = whole.alias("q").join(best.alias("b"), same_set("q", "b", (*SET, "tag"))).select("q.request", "q.boot", *(F.col(f"b.{k}").alias(k) for k in (*SET, "tag", "disk", "disk_no", "uid")))
    first = files.groupBy("request").agg(F.min("disk").alias("_first"))
    sound_dumps = _members(artifacts, 1).where(sound()).select(*SET, "tag", "disk", "uid")
    files = files.join(first, "request")
    valid = files.where((F.col("disk") == F.col("_first")) & F.col("boot").isNotNull()).alias("f").join(sound_dumps.alias("s"), same_set("f", "s", (*SET, "tag", "disk")) & (F.col("f.boot") == F.col("s.uid"))).select("f.request").distinct().withColumn("_boots", F.lit(True))
    files = files.join(valid, "request", "left").withColumn("uid", F.when(F.col("_boots") & (F.col("disk") == F.col("_first")), F.col("boot")).otherwise(F.col("uid")))
    named = files.join(artifacts.select("uid", "sha1"), "uid").groupBy("request").agg(F.array_sort(F.collect_list(F.struct("disk", canonical().alias("canonical"), "sha1"))).alias("files"))
    error = F.when(F.col("_known").isNull(), "unknown set").when(F.col("files").isNull(), F.concat(F.lit("lineage '"), F.coalesce("tag", F.lit("")), F.lit("' is not a complete set")))
    return requests.select("request", "tag").join(asked, "request", "left").join(named, "request", "left").select("request", "files", error.alias("error"))


def canonical() -> Column:
    return naming.canonical_name(F.col("title"), F.col("version"), F.col("language"), F.col("disk_no"), F.col("disk_count"), F.col("uid"))


def list_sets(artifacts: DataFrame, incomplete_only: bool = False) -> DataFrame:
    """One row per set: representative disk's year, disks present, variants, complete lineages, primary lineage, lineages by class."""
    editions = artifacts.groupBy(*EDITION).agg(F.count("*").alias("variants"), F.min("year").alias("year"))
    shape = editions.groupBy(*SET).agg(
        F.min_by("year", F.coalesce("disk_no", F.lit(0).cast("long"))).alias("year"), F.count("*").alias("editions"), F.array_sort(F.collect_set("disk_no")).alias("_disks"), F.sum("variants").alias("variant_count"),
    )
    lines = lineage_coverage(artifacts).groupBy(*SET).agg(
        F.count_if("complete").alias("complete_lineages"), F.max(F.when(F.col("place") == 1, F.nullif("tag", F.lit("")))).alias("primary_lineage"),
        *(F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("original", "cracked", "hacked")),
    )
    counts = ("complete_lineages", "original_count", "cracked_count", "hacked_count")
    out = shape.alias("s").join(lines.alias("l"), same_set("s", "l"), "left").select(
        *(F.col(f"s.{k}").alias(k) for k in SET), naming.version_key(F.col("s.version")).alias("version_key"), "s.year", (F.coalesce(F.col("s.disk_count") > 1, F.lit(False)) | (F.col("s.editions") > 1)).alias("multi"),
        F.array_join(F.col("s._disks"), ",").alias("disks_present"), "s.variant_count", "l.primary_lineage", *(F.coalesce(f"l.{c}", F.lit(0)).alias(c) for c in counts),
    )
    return out.where("complete_lineages = 0") if incomplete_only else out


def list_works(sets: DataFrame) -> DataFrame:
    """Releases rolled up by trimmed title across categories."""
    return sets.groupBy(naming.trimmed(F.col("title")).alias("name")).agg(
        F.count("*").alias("release_count"), *(F.count_if(F.col("category") == c).alias(f"{c}_count") for c in ("game", "demo", "tool")),
        *(F.sum(c).alias(c) for c in ("original_count", "cracked_count", "hacked_count")),
    )


def works_nested(sets: DataFrame) -> DataFrame:
    """Works with their releases nested in release order (nulls first), as the catalog's views are served."""
    fields = [c for c in sets.columns if c not in RELEASES]
    release = F.struct(*RELEASES, *fields)
    return sets.groupBy(naming.trimmed(F.col("title")).alias("name")).agg(F.array_sort(F.collect_list(release)).alias("releases"))


def work_facets(sets: DataFrame) -> DataFrame:
    """Facets of each work: earliest year, representative's publisher and genre, completeness, category.

    The representative is the first enriched game, else the first game, else the
    first enriched release, else the first, in release order (nulls first).
    ``sets`` may have ``genre`` (of the title's metadata, null if not enriched).
    """
    genre = F.col("genre") if "genre" in sets.columns else F.lit(None).cast("string")
    place = F.when((F.col("category") == "game") & genre.isNotNull(), 0).when(F.col("category") == "game", 1).when(genre.isNotNull(), 2).otherwise(3)
    out = sets.groupBy(naming.trimmed(F.col("title")).alias("name")).agg(
        F.min("year").alias("year"), F.min_by(F.struct("publisher", genre.alias("genre")), F.struct(place.alias("p"), *RELEASES)).alias("_r"), F.max(F.col("complete_lineages") > 0).alias("complete"),
        F.min_by("category", F.when(F.col("category") == "game", 0).when(F.col("category") == "demo", 1).otherwise(2)).alias("category"),
    )
    return out.select("name", "year", F.coalesce("_r.publisher", F.lit("")).alias("publisher"), F.coalesce(F.trim(F.element_at(F.split("_r.genre", ","), 1)), F.lit("")).alias("genre"), "complete", "category")


def grouped_works(facets: DataFrame, by: str) -> DataFrame:
    """Works counted by genre, publisher, category or decade, or all as one group (``none``); missing values are Unknown."""
    keys = {
        "none": F.lit(""), "genre": F.coalesce(F.nullif("genre", F.lit("")), F.lit("Unknown")), "publisher": F.coalesce(F.nullif("publisher", F.lit("")), F.lit("Unknown")), "category": F.col("category"),
        "decade": F.coalesce(F.concat((F.floor(F.col("year") / 10) * 10).cast("string"), F.lit("s")), F.lit("Unknown")),
    }
    return facets.groupBy(keys[by].alias("group_name")).agg(F.count("*").alias("works"))


def sorted_works(facets: DataFrame, by: str) -> DataFrame:
    """Works sorted by title, year (latest first, unknown last), publisher, genre or completeness, then name: a range-partitioned global sort. Texts are ordered as people sort them (root collation), equal ones by code point."""
    text = lambda c: F.expr(f"collate({c}, 'UNICODE')")
    first = {"title": [], "year": [F.coalesce("year", F.lit(-1)).desc()], "publisher": [text("publisher")], "genre": [text("genre")], "completeness": [F.col("complete").desc()]}[by]
    return facets.orderBy(*first, text("name"), "name")


def version_timeline(sets: DataFrame) -> DataFrame:
    """Game releases of each work by version (by year without one): languages and place, newest first."""
    games = sets.where(F.col("category") == "game").withColumns({"name": naming.trimmed(F.col("title")), "versioned": F.coalesce(F.col("version_key") != "", F.lit(False))})
    key = F.when(F.col("versioned"), F.concat(F.lit("v:"), F.col("version_key"))).otherwise(F.concat(F.lit("n:"), F.coalesce(F.col("year").cast("string"), F.lit(""))))
    nodes = games.groupBy("name", key.alias("node"), "versioned").agg(
        F.min("year").alias("year"), F.count("*").alias("releases"), F.array_join(F.array_sort(F.collect_list(F.coalesce("language", F.lit("")))), ",").alias("languages"), F.coalesce(F.max("version_key"), F.lit("")).alias("_k"),
    )
    order = Window.partitionBy("name").orderBy(F.col("year").desc_nulls_last(), F.col("versioned").desc(), F.col("_k").desc())
    return nodes.withColumn("place", F.row_number().over(order)).select("name", "node", "year", "releases", "languages", "place")


def release_rows(sets: DataFrame) -> DataFrame:
    """A release as one line: disks held of disks declared."""
    held = F.size(F.filter(F.split("disks_present", ","), lambda d: d != ""))
    return sets.select(*SET, F.concat(held.cast("string"), F.lit("/"), F.coalesce(F.nullif("disk_count", F.lit(0).cast("long")), held.cast("long")).cast("string")).alias("disks"))
