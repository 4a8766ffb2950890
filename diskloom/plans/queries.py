"""The engine's queries over a folder of tables. Uploads come from the bridge, stored tables from the folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flags, identity, naming, similarity
from ..operators import browse, enrich, identify, ingest, maintain, sets
from ..schema import conform
from ..session import checkpoint_folder, durable, table
from ..sources import bridge, containers, lists, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


_SNAPSHOTS: dict[tuple, str] = {}
#: Parts that are broadcast where line items are read often.
PARTS = 2_000_000


def artifacts(spark: SparkSession, folder: str, verified: bool = False) -> DataFrame:
    """Identified artifacts of the bridge's uploads; with ``verified`` matched by hash against a list of some of them.

    As in a catalog they are identified once, when they come in, and stored: the
    first query of a session over a folder writes the snapshot, in the folder
    that all executors share, and all read it. ``ingest_batches`` and
    ``identify_uploads`` do the whole way each time.
    """
    source = f"{folder}/lineitem.parquet"
    at = lambda p: (p.getFileSystem(spark._jsc.hadoopConfiguration()), p)
    fs, path = at(spark._jvm.org.apache.hadoop.fs.Path(source))
    key = (spark.sparkContext.applicationId, folder, fs.getFileStatus(path).getModificationTime(), verified)
    if key in _SNAPSHOTS:
        fs, path = at(spark._jvm.org.apache.hadoop.fs.Path(f"{_SNAPSHOTS[key]}/_SUCCESS"))
        if not fs.exists(path):
            del _SNAPSHOTS[key]
    if key not in _SNAPSHOTS:
        target = f"{checkpoint_folder(spark)}/artifact-{len(_SNAPSHOTS)}-{uuid4().hex}"
        identified_uploads(spark, folder, verified).write.parquet(target)
        _SNAPSHOTS[key] = target
    return spark.read.parquet(_SNAPSHOTS[key])


def identified_uploads(spark: SparkSession, folder: str, verified: bool = False) -> DataFrame:
    images = ingest.images_of(bridge.uploads(spark, folder), raw=True)[0]
    found = identify.identified(durable(identify.first_of_each(images)), bridge_list(spark, folder) if verified else None)
    return found.select("uid", "sha1", "md5", "crc32", "filename", "byte_len", "tosec_name", "verified", *sets.EDITION, "year", *identify.INFO)


def bridge_list(spark: SparkSession, folder: str, most: int = 0, repeats: bool = False) -> DataFrame:
    """A reference list of every seventh part's uploads, some without a sha1, numbered by arrival; up to ``most`` parts are broadcast."""
    rows = bridge.lines_of_parts(spark, folder, most).where("l_partkey % 7 = 0")
    content = F.expr(bridge.CONTENT).cast("binary")
    blank = F.lit(None).cast("string")
    rows = rows.select(
        (F.expr("l_orderkey * 10 + l_linenumber") * (1 << 28) + F.conv(F.substring(F.md5(content), 1, 7), 16, 10).cast("long")).alias("dat_id"), F.lit("List").alias("source"), F.expr(bridge.NAME).alias("name"), F.when(F.expr("l_linenumber % 3 > 0"), F.sha1(content)).alias("sha1"),
        blank.alias("crc32"), F.md5(content).alias("md5"), *(blank.alias(c) for c in ("title", "version", "language", "publisher", "year", "disk_no", "disk_count")),
    )
    return rows if repeats else rows.distinct()


def stored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(title, edition, artifact) as the folder stores them."""
    title = table(spark, folder, "title_query").select(F.col("title_id").alias("id"), "name", "category")
    return title, table(spark, folder, "edition"), table(spark, folder, "artifact")


def dumps(spark: SparkSession, folder: str) -> DataFrame:
    """The last record of each stored uid under its edition's identity, as the operators on sets take it."""
    title, edition, artifact = stored(spark, folder)
    rest = [c for c in artifact.columns if c != "uid"]
    last = artifact.groupBy("uid").agg(F.max_by(F.struct(*rest), "record_id").alias("_r")).select("uid", "_r.*")
    return ingest.stored_members(title, edition, last)


# Names, flags, versions


@query
def parse_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = naming.expand(bridge.uploads(spark, folder).select("filename").distinct(), naming.parse_name(F.col("filename")))
    return rows.withColumn("flags", F.array_join("flags", "|"))


@query
def parse_listed_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = naming.expand(table(spark, folder, "dat_entry").select("dat_id", "name"), naming.parse_name(F.col("name")))
    return rows.select("dat_id", "title", "version", "language", "publisher", "year", "disk_no", "disk_count")


@query
def parse_flags(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts(spark, folder).select("uid", *identify.INFO)


@query
def listed_dump_types(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dat_entry").select("dat_id", "name")
    return naming.expand(rows, flags.dump_info(naming.parse_name(F.col("name"))["flags"])).select("dat_id", "dump_type", "crack_group")


@query
def category_inference(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dat_entry").withColumn("n", naming.parse_name(F.col("name")))
    return rows.groupBy("source", F.col("n.qualifier").alias("qualifier"), flags.category(F.col("n.qualifier"), F.col("source")).alias("category")).agg(F.count("*").alias("entries"))


@query
def dump_class(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts(spark, folder).groupBy("dump_type", flags.class3(F.col("dump_type")).alias("class")).agg(F.count("*").alias("artifacts"))


@query
def alternate_badges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "artifact").where(F.col("alt_index").isNotNull()).groupBy(flags.alternate_badge(F.col("alt_index")).alias("badge")).agg(F.count("*").alias("records"))


@query
def sanitize_titles(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "title_query").select("name").union(table(spark, folder, "provider_results").select("page_title")).where(F.col("name").isNotNull()).distinct()
    return names.select("name", naming.sanitize_title(F.col("name")).alias("kebab"))


@query
def version_keys(spark: SparkSession, folder: str) -> DataFrame:
    versions = table(spark, folder, "edition_key").select("version").union(table(spark, folder, "edition").select("version")).where(F.col("version").isNotNull()).distinct()
    return versions.select("version", naming.version_key(F.col("version")).alias("version_key"))


@query
def canonical_names(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts(spark, folder).select("uid", sets.canonical().alias("canonical"))


@query
def canonical_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    names = artifacts(spark, folder).select(sets.canonical().alias("canonical"))
    return naming.expand(names, naming.parse_canonical(F.col("canonical"))).drop("canonical")


@query
def safe_names(spark: SparkSession, folder: str) -> DataFrame:
    groups = table(spark, folder, "artifact").select(F.coalesce("lineage", F.lit("")).alias("tag")).distinct()
    return groups.select("tag", naming.safe_name(F.col("tag")).alias("safe"))


@query
def name_hues(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_name").alias("name")).distinct().withColumn("hue", flags.hue(F.col("name")))


# Identity


@query
def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of all contents; the checksum of every short text, for which SQL has one too."""
    return bridge.uploads(spark, folder).select("ingest_seq", *identity.hashes(F.col("content"))[:2]).distinct()


@query
def uid_assign(spark: SparkSession, folder: str) -> DataFrame:
    contents = bridge.uploads(spark, folder).groupBy(F.sha1("content").alias("sha1")).agg(F.min("ingest_seq").alias("ingest_seq"))
    return identity.assign_uids(durable(contents)).select("sha1", "uid")


@query
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The first document of each text, through the operator that keeps the first upload of each content."""
    docs = table(spark, folder, "documents").where(F.col("text").isNotNull())
    images = docs.select(F.sha1(F.col("text").cast("binary")).alias("sha1"), F.col("doc_id").alias("ingest_seq"), F.coalesce("title", F.lit("")).alias("filename"), "source")
    return identify.first_of_each(images.distinct()).select("sha1", F.col("ingest_seq").alias("first_id"), "filename", "source")


@query
def container_detect(spark: SparkSession, folder: str) -> DataFrame:
    content = F.expr("CASE record_id % 4 WHEN 0 THEN 'PK..' WHEN 1 THEN 'DMS!' ELSE 'x' END").cast("binary")
    rows = table(spark, folder, "artifact").where(F.col("orig_filename").isNotNull()).select("record_id", "orig_filename").distinct()
    return rows.select("record_id", containers.detect(F.col("orig_filename"), content).alias("container"))


@query
def decode_zip(spark: SparkSession, folder: str) -> DataFrame:
    """Every upload packed into an archive with a folder, plain and gzipped, some archives cut short; then decoded again."""
    packed = containers.zip_each(bridge.uploads(spark, folder).withColumn("filename", F.concat(F.lit("disks/"), "filename")), broken=7)
    return containers.decode(packed).select("ingest_seq", "name", "container", F.sha1("content").alias("sha1"), F.col("error").isNotNull().alias("failed"))


@query
def list_parse(spark: SparkSession, folder: str) -> DataFrame:
    """The reference list written as XML, one document per source, and read back."""
    game = F.concat(
        F.lit('<game name="'), "name", F.lit('"><rom size="901120"'), *(F.coalesce(F.concat(F.lit(f' {a}="'), F.upper(h), F.lit('"')), F.lit("")) for a, h in (("crc", "crc32"), ("md5", "md5"), ("sha1", "sha1"))), F.lit("/></game>")
    )
    entries = table(spark, folder, "dat_entry").withColumn("xml", game)
    documents = entries.groupBy("source", F.pmod("dat_id", F.lit(64))).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dat_id", "xml"))), lambda x: x["xml"]), "").alias("xml"))
    return lists.parse_list(documents.withColumn("xml", F.concat(F.lit("<datafile><header/>"), "xml", F.lit("</datafile>")))).select("source", "name", "sha1", "crc32", "md5", "disk_no", "disk_count")


@query
def hash_match_priority(spark: SparkSession, folder: str) -> DataFrame:
    return identify.hash_match(artifacts(spark, folder), bridge_list(spark, folder))


@query
def hash_match_strict(spark: SparkSession, folder: str) -> DataFrame:
    return identify.hash_match(artifacts(spark, folder), bridge_list(spark, folder), strict=True)


@query
def hash_match_null_order(spark: SparkSession, folder: str) -> DataFrame:
    """Entries that lack a sha1 lose to entries with another one: items and list with hashes taken apart."""
    entries = table(spark, folder, "dat_entry").select("dat_id", F.when(F.expr("dat_id % 2 = 0"), F.col("sha1")).alias("sha1"), "crc32", "md5")
    items = table(spark, folder, "dat_entry").select(F.col("name").alias("uid"), F.when(F.expr("dat_id % 3 = 0"), F.sha1("name")).otherwise(F.col("sha1")).alias("sha1"), "crc32", "md5")
    twins = entries.unionByName(entries.select((F.col("dat_id") + 100000).alias("dat_id"), F.sha1(F.col("dat_id").cast("string").cast("binary")).alias("sha1"), "crc32", F.lit(None).cast("string").alias("md5")))
    return identify.hash_match(items, twins)


@query
def identify_uploads(spark: SparkSession, folder: str) -> DataFrame:
    return identified_uploads(spark, folder, verified=True).select("uid", *sets.EDITION, "year", "verified")


def two_batches(spark: SparkSession, folder: str, most: int = 0) -> tuple[DataFrame, DataFrame]:
    """The bridge's uploads as two batches.

    Every 50th part's uploads have names that don't parse. The first batch holds
    the even orders and meets no list; then the list is imported; the second holds
    the rest, and contents of the first under other names.
    """
    rows = bridge.uploads(spark, folder, most).withColumns({"order": F.expr("ingest_seq div 10"), "filename": F.when(F.expr("filename LIKE '%(1990)%'"), F.concat(F.lit("disk"), F.col("ingest_seq").cast("string"), F.lit(".adf"))).otherwise(F.col("filename"))})
    first, second = rows.where("order % 2 = 0"), rows.where("order % 2 = 1")
    again = first.where("order % 10 = 0").withColumns({"filename": F.lit("Again (1999)(Other).adf"), "ingest_seq": F.col("ingest_seq") + 1_000_000_000_000})
    return first.drop("order"), second.unionByName(again).drop("order")


def batches(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], list[dict[str, DataFrame]]]:
    """The catalog after two batches of the bridge's uploads, and what each batch changed."""
    entries = maintain.import_entries(ingest.empty(spark, "dat_entry"), conform(bridge_list(spark, folder), "dat_entry").withColumn("position", F.col("dat_id")))
    catalog = {name: ingest.empty(spark, name) for name in ("title", "edition", "artifact", "quarantine")}
    done = []
    for uploads, known in zip(two_batches(spark, folder), (None, durable(entries)), strict=True):
        done.append(ingest.ingest(catalog, uploads, known, raw=True))
        catalog = ingest.add(catalog, done[-1])
    return catalog, done


@query
def ingest_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Editions with their variants, verified ones and primary after two batches."""
    catalog, _ = batches(spark, folder)
    variants = catalog["artifact"].where(F.col("edition_id").isNotNull()).groupBy(F.col("edition_id").alias("id")).agg(F.count("*").alias("variants"), F.count_if("verified").alias("verified"))
    titles = catalog["title"].select(F.col("id").alias("title_id"), F.col("name").alias("title"), "category")
    return catalog["edition"].join(titles, "title_id").join(variants, "id").select(*sets.EDITION, "variants", "verified", F.col("primary_artifact_uid").alias("primary_uid"))


@query
def ingest_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Images of each batch by outcome."""
    _, done = batches(spark, folder)
    parts = [c["outcome"].withColumn("batch", F.lit(n)) for n, c in enumerate(done, 1)]
    return parts[0].unionByName(parts[1]).groupBy("batch", "kind", "verified", "quarantined").agg(F.count("*").alias("images"))


@query
def ingest_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Title and edition ids: dense, in order of arrival over both batches; only what they depend on is worked out."""
    catalog = {name: ingest.empty(spark, name) for name in ("title", "edition", "artifact")}
    # The list's own numbers follow its order, as those that an import gives; entries that are repeated name the same contents alike.
    # Line items are read several times rather than written down.
    for uploads, known in zip(two_batches(spark, folder, PARTS), (None, conform(bridge_list(spark, folder, PARTS, repeats=True), "dat_entry")), strict=True):
        made = ingest.numbered(catalog, uploads, known)
        catalog = {name: catalog[name].select(*made[name].columns).unionByName(made[name]) for name in catalog}
    titles = catalog["title"].select(F.col("id").alias("title_id"), F.col("name").alias("title"), "category")
    return catalog["edition"].join(titles, "title_id").select("id", "title_id", *sets.EDITION)


# Editions, sets, lineages


@query
def edition_groups(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts(spark, folder).groupBy(*sets.EDITION).agg(F.count("*").alias("variants"), F.min("year").alias("year"))


@query
def edition_primary(spark: SparkSession, folder: str) -> DataFrame:
    rows = artifacts(spark, folder)
    best = sets.edition_primary(rows).withColumnRenamed("primary_uid", "uid")
    return best.select(*sets.EDITION, F.col("uid").alias("primary_uid"), F.when(F.col("uid").isNotNull(), sets.canonical()).alias("canonical"))


@query
def set_primary_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return sets.primary_lineage(artifacts(spark, folder)).withColumn("covered", F.array_join("covered", ","))


@query
def coherent_primaries(spark: SparkSession, folder: str) -> DataFrame:
    return sets.coherent_primaries(artifacts(spark, folder))


@query
def lineage_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return sets.lineage_coverage(artifacts(spark, folder)).select(*sets.SET, "tag", F.array_join("covered", ",").alias("covered"), "complete", "mods", "kind", "place")


@query
def set_division(spark: SparkSession, folder: str) -> DataFrame:
    return sets.lineage_coverage(artifacts(spark, folder)).where("complete").select(*sets.SET, "tag")


@query
def missing_disks(spark: SparkSession, folder: str) -> DataFrame:
    return sets.missing_disks(sets.lineage_coverage(artifacts(spark, folder))).select(*sets.SET, "tag", sets.runs_text(F.col("missing")).alias("missing"), "missing_count")


@query
def set_disks(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts(spark, folder).groupBy(*sets.SET).agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("disk_no", F.lit(0).cast("long")))), ",").alias("disks"))


@query
def resolve_set(spark: SparkSession, folder: str) -> DataFrame:
    return sets.resolved_sets(artifacts(spark, folder))


@query
def trainer_options(spark: SparkSession, folder: str) -> DataFrame:
    return sets.trainer_options(artifacts(spark, folder))


@query
def playable_sets(spark: SparkSession, folder: str) -> DataFrame:
    return sets.playable_sets(artifacts(spark, folder))


@query
def export_set_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return sets.set_export(artifacts(spark, folder))


@query
def export_set_boot_override(spark: SparkSession, folder: str) -> DataFrame:
    """Complete sets with the trained dump on the boot disk, where there is one."""
    rows = artifacts(spark, folder)
    return sets.set_export(rows, boot=sets.trainer_options(rows).where(F.col("trainer").isNotNull()).select("uid")).select(*sets.SET, "tag", "disk", "uid", "sha1")


@query
def export_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Three requests per set, one of them of a set that isn't there: files or the error."""
    rows = artifacts(spark, folder)
    asked = rows.select(*sets.SET).distinct().withColumn("request", F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in sets.SET)))
    boots = sets.trainer_options(rows).where(F.col("trainer").isNotNull() & (F.col("tag") == "CSL")).groupBy(*sets.SET).agg(F.max("uid").alias("boot"))
    cracked = asked.alias("a").join(boots.alias("b"), sets.same_set("a", "b"), "left").select("a.*", "b.boot").withColumn("tag", F.lit("CSL"))
    plain = asked.withColumns({"tag": F.lit(""), "boot": F.lit("nonsense")})
    gone = asked.withColumns({"tag": F.lit(""), "boot": F.lit(None).cast("string"), "title": F.concat("title", F.lit("?")), "request": F.concat("request", F.lit("?"))})
    requests = cracked.withColumn("request", F.concat("request", F.lit("|CSL"))).unionByName(plain).unionByName(gone)
    return sets.export_requests(rows, requests).select("request", F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["disk"].cast("string"), f["canonical"], f["sha1"])), " ").alias("files"), "error")


@query
def stored_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Lineages of the stored sets: missing disk numbers, undeclared counts, several trainers, all flags."""
    rows = sets.missing_disks(sets.lineage_coverage(dumps(spark, folder)))
    return rows.select(*sets.SET, "tag", F.array_join("covered", ",").alias("covered"), "needed", "complete", "mods", "kind", "trainer", "place", "missing_count")


@query
def stored_primaries(spark: SparkSession, folder: str) -> DataFrame:
    return sets.coherent_primaries(dumps(spark, folder))


@query
def stored_sets(spark: SparkSession, folder: str) -> DataFrame:
    return sets.list_sets(dumps(spark, folder)).drop("version_key")


@query
def stored_playable(spark: SparkSession, folder: str) -> DataFrame:
    return sets.playable_sets(dumps(spark, folder)).select(*sets.SET, "tag", "kind", "trainer", "complete", "recommended", "files", "options")


@query
def stored_works(spark: SparkSession, folder: str) -> DataFrame:
    """Facets of the stored works, with the genre of their pages."""
    genres = enrich.merge(results_by_title(spark, folder)).join(stored(spark, folder)[0].select(F.col("id").alias("title_id"), F.col("name").alias("title"), "category"), "title_id").groupBy("title", "category").agg(F.max("genre").alias("genre"))
    found = sets.list_sets(dumps(spark, folder)).join(genres, ["title", "category"], "left")
    return sets.work_facets(found)


@query
def works_by_genre(spark: SparkSession, folder: str) -> DataFrame:
    return sets.grouped_works(stored_works(spark, folder), "genre")


@query
def works_in_one(spark: SparkSession, folder: str) -> DataFrame:
    return sets.grouped_works(stored_works(spark, folder), "none")


def ranked_works(by: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ordered = sets.sorted_works(stored_works(spark, folder), by)
        # Only checks list the place: a global sort needs no numbering.
        return ordered.select("name", "category", "year", "publisher", "genre", "complete")

    return run


for _by in ("title", "publisher", "genre", "completeness"):
    QUERIES[f"works_sorted_by_{_by}"] = ranked_works(_by)


@query
def export_edition_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts(spark, folder).select(*sets.EDITION, sets.canonical().alias("canonical"), "sha1", "byte_len")


# Browse


@query
def browse_all(spark: SparkSession, folder: str) -> DataFrame:
    return browse.browse_order(browse.browse(*stored(spark, folder)))


@query
def browse_search(spark: SparkSession, folder: str) -> DataFrame:
    return browse.browse_order(browse.browse(*stored(spark, folder), q="GARD_N"))


@query
def browse_language(spark: SparkSession, folder: str) -> DataFrame:
    return browse.browse_order(browse.browse(*stored(spark, folder), category="game", language="de"))


@query
def browse_verified(spark: SparkSession, folder: str) -> DataFrame:
    return browse.browse_order(browse.browse(*stored(spark, folder), status="verified"))


@query
def browse_unverified(spark: SparkSession, folder: str) -> DataFrame:
    return browse.browse_order(browse.browse(*stored(spark, folder), status="unverified"))


@query
def browse_quarantined_status(spark: SparkSession, folder: str) -> DataFrame:
    return browse.browse(*stored(spark, folder), status="quarantined").groupBy("category").agg(F.count("*").alias("editions"))


@query
def list_sets(spark: SparkSession, folder: str) -> DataFrame:
    return sets.list_sets(artifacts(spark, folder)).orderBy(*sets.RELEASES)


@query
def sets_incomplete(spark: SparkSession, folder: str) -> DataFrame:
    return sets.list_sets(artifacts(spark, folder), incomplete_only=True).select(*sets.SET, "disks_present", "variant_count")


@query
def list_works(spark: SparkSession, folder: str) -> DataFrame:
    return sets.list_works(sets.list_sets(artifacts(spark, folder))).orderBy("name")


@query
def works_nested(spark: SparkSession, folder: str) -> DataFrame:
    works = sets.works_nested(sets.list_sets(artifacts(spark, folder)))
    line = lambda r: F.concat_ws(":", r["category"], F.coalesce(r["version"], F.lit("-")), F.coalesce(r["language"], F.lit("-")), r["publisher"], r["complete_lineages"].cast("string"))
    return works.select("name", F.array_join(F.transform("releases", line), " ").alias("releases"))


@query
def work_type_filter(spark: SparkSession, folder: str) -> DataFrame:
    works = sets.list_works(sets.list_sets(artifacts(spark, folder)))
    return works.where("cracked_count > 0").select("name", "cracked_count")


@query
def works_by_decade(spark: SparkSession, folder: str) -> DataFrame:
    return sets.grouped_works(sets.work_facets(sets.list_sets(artifacts(spark, folder))), "decade")


@query
def works_by_publisher(spark: SparkSession, folder: str) -> DataFrame:
    return sets.grouped_works(sets.work_facets(sets.list_sets(artifacts(spark, folder))), "publisher")


@query
def works_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return sets.grouped_works(sets.work_facets(sets.list_sets(artifacts(spark, folder))), "category")


@query
def works_sorted(spark: SparkSession, folder: str) -> DataFrame:
    return sets.sorted_works(sets.work_facets(sets.list_sets(artifacts(spark, folder))), "year")


@query
def version_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return sets.version_timeline(sets.list_sets(artifacts(spark, folder)))


@query
def release_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sets.release_rows(sets.list_sets(artifacts(spark, folder)))


@query
def variants(spark: SparkSession, folder: str) -> DataFrame:
    _, edition, artifact = stored(spark, folder)
    return browse.variants(artifact, edition).select("record_id", "uid", "edition_id", "canonical", "is_primary").distinct().orderBy("uid", "record_id")


@query
def browse_json(spark: SparkSession, folder: str) -> DataFrame:
    """Editions of a title as the JSON that the catalog serves."""
    rows = browse.browse(*stored(spark, folder)).select("title", "id", "category", "language", "disk_no", "variant_count")
    return browse.json_view(rows, "editions", ("title",), ("language", "disk_no", "id"))


@query
def downloads(spark: SparkSession, folder: str) -> DataFrame:
    """Every primary under its canonical name; its name stands for the bytes."""
    rows = artifacts(spark, folder).withColumns({"canonical": sets.canonical(), "blob_sha1": F.col("sha1")})
    blobs = bridge.uploads(spark, folder).select(F.sha1("content").alias("sha1"), "content").distinct()
    wanted = sets.edition_primary(rows).select(F.col("primary_uid").alias("uid")).where(F.col("uid").isNotNull())
    return browse.download(rows, blobs, wanted).select("uid", "canonical", F.md5("content").alias("md5"))


@query
def escaped_titles(spark: SparkSession, folder: str) -> DataFrame:
    pages_ = table(spark, folder, "provider_results").select("page_title").distinct()
    return pages_.select("page_title", browse.html_escaped(F.concat(F.lit("<b>"), F.coalesce("page_title", F.lit("")), F.lit('</b> & "'))).alias("html"))


@query
def artifact_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Category of every artifact through its edition and title."""
    title, edition, artifact = stored(spark, folder)
    rows = artifact.join(edition.select(F.col("id").alias("edition_id"), "title_id"), "edition_id").join(title.select(F.col("id").alias("title_id"), "category"), "title_id")
    return rows.groupBy("category").agg(F.count_distinct("uid").alias("artifacts"))


@query
def artifact_lookup(spark: SparkSession, folder: str) -> DataFrame:
    _, edition, artifact = stored(spark, folder)
    wanted = edition.where(F.col("primary_artifact_uid").isNotNull()).select(F.col("primary_artifact_uid").alias("uid"))
    return browse.lookup(artifact, wanted).select("uid", "sha1", "crc32", "md5", "edition_id").distinct()


@query
def quarantine_list(spark: SparkSession, folder: str) -> DataFrame:
    return browse.quarantine_list(table(spark, folder, "quarantine"), table(spark, folder, "artifact")).orderBy("uid")


@query
def upload_tally(spark: SparkSession, folder: str) -> DataFrame:
    uploads = table(spark, folder, "artifact").select(F.col("record_id").alias("seq"), F.col("orig_filename").alias("filename"), "uid").distinct()
    return browse.upload_tally(uploads, table(spark, folder, "quarantine"))


# Changes


@query
def resolve_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Quarantined uids with a display title resolved under it: their new identity."""
    q, a = table(spark, folder, "quarantine"), table(spark, folder, "artifact")
    blank = F.lit(None).cast("string")
    named = a.join(q.select(F.col("artifact_uid").alias("uid")), "uid", "left_semi").groupBy("uid").agg(F.max("tosec_name").alias("title")).where(F.col("title").isNotNull())
    done, _ = maintain.resolve(q, named.select("uid", "title", F.lit("").alias("category"), blank.alias("version"), F.lit("en").alias("language"), blank.alias("publisher"), F.lit(1).cast("long").alias("disk_no"), F.lit(1).cast("long").alias("disk_count")))
    return done.select("uid", "title", "category", "language", "qualifier", "disk_no", "disk_count", "display_title")


@query
def quarantine_left(spark: SparkSession, folder: str) -> DataFrame:
    q, a = table(spark, folder, "quarantine"), table(spark, folder, "artifact")
    named = a.where(F.col("tosec_name").isNotNull()).select("uid").distinct()
    blank = F.lit(None).cast("string")
    _, left = maintain.resolve(q, named.select("uid", F.lit("x").alias("title"), *(blank.alias(c) for c in ("category", "version", "language", "publisher")), F.lit(None).cast("long").alias("disk_no"), F.lit(None).cast("long").alias("disk_count")))
    return left.distinct()


def misfiled(spark: SparkSession, folder: str) -> DataFrame:
    """The bridge's artifacts as an early catalog filed them: all games, without qualifier."""
    return artifacts(spark, folder).withColumns({"category": F.lit("game"), "qualifier": F.lit(None).cast("string")})


@query
def reidentify_report(spark: SparkSession, folder: str) -> DataFrame:
    return maintain.reidentify_report(misfiled(spark, folder))


@query
def reidentify_twice(spark: SparkSession, folder: str) -> DataFrame:
    return maintain.reidentify_report(maintain.reidentify(misfiled(spark, folder)).drop("moved"))


def thinned(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored catalog after every seventh edition lost its artifacts, with metadata and a cover for every title."""
    title, edition, artifact = stored(spark, folder)
    ids = title.select(F.col("id").alias("title_id"))
    return {"title": title, "edition": edition, "artifact": artifact.where("edition_id % 7 > 0 AND edition_id % 3 > 0"), "title_meta": ids, "title_screenshot": ids.withColumn("blob_sha1", F.sha1(F.col("title_id").cast("string").cast("binary")))}


@query
def delete_empty_editions(spark: SparkSession, folder: str) -> DataFrame:
    catalog = thinned(spark, folder)
    return browse.missing_editions(catalog["edition"], catalog["artifact"]).select("id", "title_id")


@query
def delete_empty_titles(spark: SparkSession, folder: str) -> DataFrame:
    catalog = thinned(spark, folder)
    return browse.missing_titles(catalog["title"], catalog["edition"].where("title_id % 5 > 0"))


@query
def delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left of each table once empty editions are gone, with titles and all that hangs on them."""
    catalog = thinned(spark, folder)
    left = browse.without_empties(catalog | {"edition": catalog["edition"].where("title_id % 5 > 0")})
    return reduce(DataFrame.unionByName, (left[n].agg(F.lit(n).alias("table"), F.count("*").alias("left")) for n in ("edition", "title", "title_meta", "title_screenshot")))


@query
def upsert_editions(spark: SparkSession, folder: str) -> DataFrame:
    """Editions of the catalog under keys shifted to the next title: the keys that had to be made, with the ids they got."""
    edition = table(spark, folder, "edition")
    wanted = edition.select((F.col("title_id") + 1).alias("title_id"), *maintain.KEY[1:], F.col("id").alias("seq"))
    return maintain.new_editions(edition, wanted, 10_000_000).select("id", *maintain.KEY)


@query
def resolve_and_file(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts of the quarantined uids with a name, after they were resolved under it: shown title and edition."""
    title, edition, artifact = stored(spark, folder)
    q = table(spark, folder, "quarantine").distinct()
    rest = [c for c in artifact.columns if c != "uid"]
    one = artifact.groupBy("uid").agg(F.max_by(F.struct(*rest), "record_id").alias("_r")).select("uid", "_r.*")
    blank = F.lit(None).cast("string")
    names = artifact.join(q.select(F.col("artifact_uid").alias("uid")), "uid", "left_semi").groupBy("uid").agg(F.max("tosec_name").alias("title"), F.min("record_id").alias("seq")).where(F.col("title").isNotNull())
    wanted = names.select("uid", "seq", "title", F.lit("").alias("category"), blank.alias("version"), F.lit("en").alias("language"), blank.alias("publisher"), F.lit(1).cast("long").alias("disk_no"), F.lit(1).cast("long").alias("disk_count"))
    after = ingest.resolve({"title": title, "edition": edition, "artifact": one, "quarantine": q}, wanted)
    home = after["edition"].join(after["title"].select(F.col("id").alias("title_id"), F.col("name").alias("title"), "category"), "title_id").select(F.col("id").alias("edition_id"), "title", "category", "language", "disk_no", "primary_artifact_uid")
    return after["artifact"].join(names.select("uid"), "uid", "left_semi").join(home, "edition_id").select("uid", "display_title", "title", "category", "language", "disk_no", "primary_artifact_uid")


@query
def manual_primary(spark: SparkSession, folder: str) -> DataFrame:
    rows = artifacts(spark, folder)
    chosen = rows.where("alt_index > 0").groupBy(*sets.EDITION).agg(F.max("uid").alias("uid"))
    return maintain.override_primaries(sets.coherent_primaries(rows), chosen)


# Enrichment


def results_by_title(spark: SparkSession, folder: str) -> DataFrame:
    """Provider results under the titles that lead to their page, by slug or else by the best fuzzy match on each source."""
    titles = table(spark, folder, "title_query").select("title_id", "name")
    return enrich.TableProvider("table", table(spark, folder, "provider_results")).results(titles)


@query
def title_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Every page title against every title that could reach the floor: those that share a word or the run-together form."""
    found = enrich.similar_pairs(table(spark, folder, "title_query"), table(spark, folder, "provider_results").select("result_id", "page_title").distinct(), "page_title", same_letter=False)
    return found.select("title_id", "result_id", F.round(F.col("score").cast("double"), 4).alias("similarity")).where(F.col("similarity") >= 0.55)


@query
def fuzzy_best_match(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "provider_results").where(F.col("page_title").isNotNull()).select(F.col("page_title").alias("label"), similarity.slug(F.col("page_title")).alias("slug")).distinct()
    best = enrich.fuzzy_matches(table(spark, folder, "title_query").select("title_id", "name"), links)
    return best.select("title_id", F.round(F.col("score").cast("double"), 4).alias("score"))


@query
def page_titles(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(F.col("text").contains("<title>"))
    return docs.select("doc_id", pages.page_title(F.col("text")).alias("page_title")).distinct()


@query
def page_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Provider results written as game pages and read back."""
    esc = lambda c: browse.html_escaped(F.col(c))
    link = lambda t: F.concat(F.lit('<a href="/browse/x">'), browse.html_escaped(F.trim(t)), F.lit("</a>"))
    shot = lambda t: F.concat(F.lit('<a href="/image/'), F.sha1(t["url"].cast("binary")), F.lit('/x?s=2x"><img src="/small"></a>'))
    html = F.concat(
        F.lit("<html><head><title>"), esc("page_title"), F.lit(" | Site</title></head><body><h1>"), esc("page_title"), F.lit('</h1><div class="game-about"><p>'), esc("description"), F.lit('</p></div><div class="game-info-row">Tags: '),
        F.array_join(F.transform(F.filter(F.split(F.coalesce("genre", F.lit("")), ","), lambda g: F.trim(g) != ""), link), " "), F.lit("</div>"),
        F.coalesce(F.concat(F.lit('<img src="/image/'), F.sha1(F.col("cover.url").cast("binary")), F.lit('?t=lbcover" alt="Front image">')), F.lit("")), F.array_join(F.transform(F.coalesce("shots", F.slice(F.array("cover"), 1, 0)), shot), ""), F.lit("</body></html>"),
    )
    rows = table(spark, folder, "provider_results").where(F.col("page_title").isNotNull()).distinct().select("result_id", html.alias("html"))
    return pages.scan_pages(rows, "result_id", "html").select("result_id", "title", "description", "genre", "cover", F.array_join("shots", " ").alias("shots"))


def run_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An enrichment of all titles in which every third image fails, over covers of an earlier run."""
    titles = table(spark, folder, "title_query").select("title_id", "name")
    rows = table(spark, folder, "provider_results")
    urls = rows.select(F.col("cover.url").alias("url")).unionByName(rows.select(F.explode("shots.url").alias("url"))).where(F.col("url").isNotNull()).distinct()
    images = urls.select("url", F.when(F.ascii(F.sha1(F.col("url").cast("binary"))) % 3 > 0, F.col("url").cast("binary")).alias("content"), F.lit("image/png").alias("header"))
    old = titles.select("title_id", F.sha1(F.lit("old").cast("binary")).alias("blob_sha1"), F.lit("image/gif").alias("mime"), F.lit(None).cast("string").alias("caption"), F.lit("old").alias("source"), F.lit(0).cast("long").alias("ord"), F.lit("cover").alias("kind"))
    return enrich.run(titles, [enrich.TableProvider("table", rows)], images, conform(titles.limit(0), "title_meta"), old, 1_700_000_000)


@query
def enrich_report(spark: SparkSession, folder: str) -> DataFrame:
    return run_of(spark, folder)[2]


@query
def enrich_meta(spark: SparkSession, folder: str) -> DataFrame:
    return run_of(spark, folder)[0].withColumn("match_score", F.round("match_score", 4))


@query
def enrich_images(spark: SparkSession, folder: str) -> DataFrame:
    return run_of(spark, folder)[1].select("title_id", "blob_sha1", "mime", "ord", "kind")


@query
def provider_merge(spark: SparkSession, folder: str) -> DataFrame:
    m = enrich.merge(results_by_title(spark, folder))
    return m.select("title_id", "genre", "description", "year", "external_url", F.col("cover.url").alias("cover"), F.round(F.col("score").cast("double"), 4).alias("score"), "sources", F.array_join(F.transform("shots", lambda s: s["url"]), " ").alias("shots"))


@query
def wanted_images(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.wanted_images(enrich.merge(results_by_title(spark, folder)))


@query
def title_pages(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "provider_results").where(F.col("page_title").isNotNull()).select(F.col("page_title").alias("label"), similarity.slug(F.col("page_title")).alias("slug")).distinct()
    return enrich.pages_for(table(spark, folder, "title_query").select("title_id", "name"), links)


@query
def title_meta(spark: SparkSession, folder: str) -> DataFrame:
    merged = enrich.merge(results_by_title(spark, folder))
    images = enrich.wanted_images(merged).withColumn("blob_sha1", F.sha1(F.col("url").cast("binary")))
    return browse.title_meta(merged.select("title_id", "genre", "sources"), images).withColumn("screenshots", F.array_join("screenshots", " "))


@query
def enrich_targets(spark: SparkSession, folder: str) -> DataFrame:
    fetched = enrich.merge(results_by_title(spark, folder)).select("title_id")
    return enrich.targets(*stored(spark, folder), fetched=fetched).orderBy("name")


@query
def meta_no_wipe(spark: SparkSession, folder: str) -> DataFrame:
    """Images of the first two providers replaced by a run over the others whose covers failed to load."""
    rows = results_by_title(spark, folder)

    def images(part: DataFrame) -> DataFrame:
        cover = part.where(F.col("cover").isNotNull()).select("title_id", F.lit("cover").alias("kind"), F.col("cover.url").alias("url"))
        return cover.unionByName(part.select("title_id", F.lit("screenshot").alias("kind"), F.explode("shots.url").alias("url"))).distinct()

    later = rows.where("priority > 2")
    merged = later.groupBy("title_id").agg(F.max(F.col("cover").isNotNull()).alias("has_cover"), F.max(F.coalesce(F.size("shots"), F.lit(0)) > 0).alias("has_shots"))
    return enrich.replace_images(images(rows.where("priority <= 2")), images(later).where("kind <> 'cover'"), merged)
