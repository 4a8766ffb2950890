import gzip
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from diskloom.functions import identity
from diskloom.operators import browse, components, enrich, identify, maintain, once, sets, skew
from diskloom.operators import ingest as batch
from diskloom.sources import blobs, containers, lists, pages
from diskloom.streaming import ingest


def catalog(spark, names):
    rows = spark.createDataFrame([(k, n, (n + "#").encode()) for k, n in enumerate(names)], "ingest_seq long, filename string, content binary")
    return identify.identified(identify.first_of_each(rows.select("ingest_seq", "filename", *identity.hashes(F.col("content")))))


def test_variants_of_one_disk(spark):
    a = catalog(spark, [f"A-10 v1.0 (1990)(Dyn)(Disk 1 of 2){x}.adf" for x in ("[h PDX]", "[h QTX][a2]", "[h SR]", "[cr QTX]", "[cr QTX][b]", "[!]")])
    best = sets.edition_primary(a).collect()
    assert len(best) == 1 and a.where(F.col("uid") == best[0].primary_uid).first().verified_good


def test_coherent_lineage(spark):
    names = [f"Game (1990)(Pub)(Disk {d} of 3){x}.adf" for d in (1, 2, 3) for x in ("[cr DTC]",)] + ["Game (1990)(Pub)(Disk 1 of 3)[cr Conet].adf", "Game (1990)(Pub)(Disk 1 of 3)[cr DTC][t +3].adf"]
    a = catalog(spark, names).cache()
    chosen = sets.coherent_primaries(a).join(a.select(F.col("uid").alias("primary_uid"), "lineage", "trainer"), "primary_uid").collect()
    assert len(chosen) == 3 and {r.lineage for r in chosen} == {"DTC"} and {r.trainer for r in chosen} == {None}
    cover = {r.tag: r for r in sets.lineage_coverage(a).collect()}
    assert cover["DTC"].complete and cover["DTC"].place == 1 and not cover["Conet"].complete
    options = sets.trainer_options(a).collect()
    assert {(o.trainer, o.is_default) for o in options} == {(None, True), ("+3", False)}
    trained = next(o.uid for o in options if o.trainer)
    export = {r.disk: r.uid for r in sets.set_export(a, "DTC", spark.createDataFrame([(trained,), ("nonsense",)], "uid string")).collect()}
    assert export[1] == trained and len(export) == 3 and sets.set_export(a, "Conet").isEmpty()
    line = {r.tag: r for r in sets.playable_sets(a).collect()}
    assert line["Conet"].missing == "2,3" and line["Conet"].files == "" and line["DTC"].options.count("=") == 2
    listed = sets.list_sets(a).first()
    assert (listed.complete_lineages, listed.primary_lineage, listed.disks_present, listed.variant_count, listed.cracked_count) == (1, "DTC", "1,2,3", 5, 2)


def test_only_unsound_dumps(spark):
    a = catalog(spark, ["X (1990)(P)[b].adf"])
    assert sets.edition_primary(a).first().primary_uid is None and sets.lineage_coverage(a).isEmpty()
    s = sets.list_sets(a, incomplete_only=True).first()
    assert s.complete_lineages == 0 and s.primary_lineage is None and s.variant_count == 1
    assert sets.list_works(sets.list_sets(a)).first().game_count == 1


def test_hostile_disk_count(spark):
    a = catalog(spark, ["X (1990)(P)(Disk 1 of 4294967295).adf"])
    m = sets.missing_disks(sets.lineage_coverage(a)).first()
    assert [tuple(r) for r in m.missing] == [(2, 4294967295)] and m.missing_count == 4294967294 and not m.complete
    assert sets.playable_sets(a).first().missing == "2-4294967295"


def test_hash_match_orders(spark):
    entries = spark.createDataFrame([(1, None, "m", None), (2, "other", None, "c"), (3, "s", None, None)], "dat_id long, sha1 string, md5 string, crc32 string")
    items = spark.createDataFrame([("a", "x", "m", "c"), ("b", "s", "m", "c"), ("c", "n", "n", "n"), ("d", None, "m", "c")], "uid string, sha1 string, md5 string, crc32 string")
    assert {r.uid: r.dat_id for r in identify.hash_match(items, entries).collect()} == {"a": 2, "b": 3, "d": 1}
    assert {r.uid: r.dat_id for r in identify.hash_match(items, entries, strict=True).collect()} == {"a": 1, "b": 3, "d": 1}


def test_uid_extension(spark):
    rows = spark.createDataFrame([("abcdef0123" + "0" * 30, 1), ("abcdef0123" + "999" + "0" * 27, 2), ("f" * 40, 3)], "sha1 string, ingest_seq long")
    assert {r.sha1[:13]: r.uid for r in identity.assign_uids(rows).collect()} == {"abcdef0123000": "abcdef0123", "abcdef0123999": "abcdef01239", "f" * 13: "f" * 10}


def empty_catalog(spark):
    return {n: batch.empty(spark, n) for n in ("title", "edition", "artifact", "quarantine")}


def uploads_of(spark, names, start=0):
    return spark.createDataFrame([(start + k, n, (n if c is None else c).encode()) for k, (n, c) in enumerate(names)], "ingest_seq long, filename string, content binary")


def test_uids_of_later_batches_avoid_stored_ones(spark):
    stored = spark.createDataFrame([("abcdef0123" + "0" * 30, "abcdef0123"), ("abcdef0123" + "1" * 30, "abcdef01231")], "sha1 string, uid string")
    fresh = spark.createDataFrame([("abcdef0123" + "12" * 15, 7), ("abcdef0123" + "9" * 30, 8), ("e" * 40, 9)], "sha1 string, ingest_seq long")
    assert {r.sha1[10:12] or "": r.uid for r in identity.assign_uids(fresh, stored=stored).collect()} == {"12": "abcdef012312", "99": "abcdef01239", "ee": "e" * 10}


def test_ingest_in_batches(spark):
    one = batch.ingest(empty_catalog(spark), uploads_of(spark, [("A v1.0 (1990)(P)(Disk 1 of 2)[cr X].adf", None), ("A v1.0 (1990)(P)(Disk 2 of 2)[cr X].adf", None), ("noname.adf", "zz"), ("again.adf", "zz"), ("A v1.0 (1990)(P)(Disk 1 of 2).adf", "q"), ("x.txt", "?"), ("bad.adz", "no gzip")]))
    catalog = batch.add(empty_catalog(spark), one)
    assert sorted((r.kind, r.quarantined) for r in one["outcome"].collect()) == [("duplicate", None), ("stored", False), ("stored", False), ("stored", False), ("stored", True)]
    assert {r.filename for r in one["error"].collect()} == {"x.txt", "bad.adz"} and catalog["title"].count() == 1 and catalog["edition"].count() == 2
    lineage = {r.uid: r.lineage for r in catalog["artifact"].collect()}
    assert [lineage[r.primary_artifact_uid] for r in catalog["edition"].orderBy("disk_no").collect()] == ["X", "X"]  # one lineage covers the set
    entries = batch.empty(spark, "dat_entry")
    fresh = spark.createDataFrame([("L", "B (1991)(Q)", None, None, None, 2), ("L", "C - tool (1992)(Q)", hashlib.sha1(b"zz").hexdigest(), None, None, 1)], "source string, name string, sha1 string, crc32 string, md5 string, position int")
    for c in entries.columns:
        if c not in fresh.columns:
            fresh = fresh.withColumn(c, F.lit(None).cast(entries.schema[c].dataType))
    entries = entries.unionByName(maintain.import_entries(entries, fresh))
    assert {(r.dat_id, r.name[0]) for r in entries.collect()} == {(1, "C"), (2, "B")}
    two = batch.ingest(catalog, uploads_of(spark, [("other.adf", "zz"), ("A v1.0 (1990)(P)(Disk 2 of 2).adf", "w")], 100), entries)
    catalog = batch.add(catalog, two)
    # What was quarantined before the list came stays so; the set's plain dumps now cover it, unmodified.
    assert [r.kind for r in two["outcome"].orderBy("ingest_seq").collect()] == ["duplicate", "stored"] and catalog["quarantine"].count() == 1
    assert [catalog["artifact"].where(F.col("uid") == r.primary_artifact_uid).first().lineage for r in catalog["edition"].orderBy("disk_no").collect()] == [None, None]
    held = catalog["quarantine"].first().artifact_uid
    wanted = spark.createDataFrame([(held, 1, " New ", "", None, "en", None, 1, 1), ("nobody", 2, "Ghost", "demo", None, None, None, None, None)], "uid string, seq long, title string, category string, version string, language string, publisher string, disk_no long, disk_count long")
    after = batch.resolve(catalog, wanted)
    moved = after["artifact"].where(F.col("uid") == held).first()
    assert moved.display_title == " New " and after["quarantine"].isEmpty() and after["title"].where("name = 'New'").count() == 1 and after["edition"].where("primary_artifact_uid = '" + held + "'").count() == 1
    clean = browse.without_empties(after | {"title_meta": after["title"].select(F.col("id").alias("title_id"))})
    assert after["title"].count() == 3 and clean["title"].count() == 2 and clean["title_meta"].count() == 2


def test_two_writers_of_one_commit(spark, tmp_path):
    rows = spark.range(3).withColumnRenamed("id", "n")
    a, b = blobs.Snapshots(spark, str(tmp_path), "a"), blobs.Snapshots(spark, str(tmp_path), "b")
    assert a.commit({"t": rows}) == 1 and b.commit({}, {"t": rows}) == 2 and a.read("t").count() == 6 and a.read("u") is None
    a._claim(3)
    with pytest.raises(RuntimeError):
        b.commit({"t": rows})
    assert a.commit({"t": rows}) == 3 and b.read("t").count() == 3


def test_enrichment_run(spark):
    titles = spark.createDataFrame([(1, "A-10 Tank Killer"), (2, "The Addams Family"), (3, "Zool")], "title_id long, name string")
    page = '<h1>{}</h1><div class="game-about">{}</div><img src="/image/c{}?t=lbcover" alt="front"><a href="/image/s{}?s=2x"></a>'
    site = spark.createDataFrame([("u1", "a10 tank killer", page.format("A10 Tank Killer", "long text " * 6, 1, 1)), ("u2", "addams family", page.format("Addams Family", "short", 2, 2)), ("u3", "other", None)], "url string, label string, html string")
    images = spark.createDataFrame([("c1", b"\xff\xd8\xff1", None), ("s1", None, None), ("s2", b"GIF8", "text/html")], "url string, content binary, header string")
    old = spark.createDataFrame([(1, "old", "m", None, "x", 0, "screenshot"), (2, "old", "m", None, "x", 0, "cover"), (3, "old", "m", None, "x", 0, "cover")], "title_id long, blob_sha1 string, mime string, caption string, source string, ord long, kind string")
    meta = spark.createDataFrame([(3, "kept", None, None, None, None, None, 5)], "title_id long, genre string, description string, year int, sources string, external_url string, match_score double, fetched_at long")
    assert enrich.run(titles, [enrich.PageProvider("site", 1, site)], images, meta, old)[0].agg(F.max("fetched_at")).first()[0] > 1_700_000_000
    found, shots, report = enrich.run(titles, [enrich.PageProvider("site", 1, site)], images, meta, old, 99)
    assert tuple(report.first()) == (3, 2, 1)
    assert {(r.title_id, r.fetched_at, r.description is not None) for r in found.collect()} == {(1, 99, True), (2, 99, False), (3, 5, False)}
    # The failed shot of title 1 and the failed cover of title 2 leave what was there.
    assert {(r.title_id, r.kind, r.mime) for r in shots.collect()} == {(1, "cover", "image/jpeg"), (1, "screenshot", "m"), (2, "cover", "m"), (2, "screenshot", "image/gif"), (3, "cover", "m")}


def test_export_requests(spark):
    a = catalog(spark, ["G (1990)(P)(Disk 1 of 2)[cr X].adf", "G (1990)(P)(Disk 2 of 2)[cr X].adf", "G (1990)(P)(Disk 1 of 2)[cr X][t +3].adf", "G (1990)(P)(Disk 1 of 2).adf"]).cache()
    key = a.select(*sets.SET).distinct()
    trained = a.where("trainer IS NOT NULL").first().uid
    asked = key.crossJoin(spark.createDataFrame([(1, "X", None), (2, "X", trained), (3, "X", "nonsense"), (4, "", None), (5, "Nobody", None)], "request int, tag string, boot string"))
    asked = asked.unionByName(asked.where("request = 1").withColumns({"title": F.lit("none"), "request": F.lit(6)}))
    got = {r.request: (r.files and len(r.files), r.error) for r in sets.export_requests(a, asked).collect()}
    assert {k: n for k, (n, _) in got.items()} == {1: 2, 2: 2, 3: 2, 4: None, 5: None, 6: None} and got[6][1] == "unknown set" and "not a complete set" in got[4][1]
    boot = {r.request: r.files[0].canonical for r in sets.export_requests(a, asked).where("files IS NOT NULL").collect()}
    assert trained in boot[2] and trained not in boot[1] and boot[1] == boot[3]


def test_grid_sorts(spark):
    facets = spark.createDataFrame([("beta", 1990, "Zed", "b", True, "game"), ("Alpha", None, "abc", "", False, "game"), ("älpha", 1992, "", "a", True, "demo")], "name string, year int, publisher string, genre string, complete boolean, category string")
    names = lambda by: [r.name for r in sets.sorted_works(facets, by).collect()]
    assert names("title") == ["Alpha", "älpha", "beta"] and names("year") == ["älpha", "beta", "Alpha"] and names("publisher") == ["älpha", "Alpha", "beta"] and names("genre") == ["Alpha", "älpha", "beta"] and names("completeness") == ["älpha", "beta", "Alpha"]


def test_views_and_downloads(spark):
    rows = spark.createDataFrame([("t", 2, None), ("t", 1, "x")], "t string, id int, v string")
    assert [r.json for r in browse.json_view(rows, "all", ("t",), ("id",)).collect()] == ['{"all":[{"id":1,"v":"x"},{"id":2,"v":null}]}'] and browse.json_view(rows, "all").count() == 2
    shots = spark.createDataFrame([(1, "s", "image/png", 1), (1, "s", "image/gif", 0)], "title_id long, blob_sha1 string, mime string, ord long")
    data = spark.createDataFrame([("s", b"1")], "sha1 string, content binary")
    assert [(r.mime, bytes(r.content)) for r in browse.media(shots, data).collect()] == [("image/gif", b"1")]
    held = spark.createDataFrame([("u", "n.adf", "s"), ("v", "m.adf", "none")], "uid string, canonical string, blob_sha1 string")
    assert [(r.uid, r.canonical, bytes(r.content)) for r in browse.download(held, data, held.select("uid")).collect()] == [("u", "n.adf", b"1")]


def test_folder_walk(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "X.ADF").write_bytes(b"1")
    (tmp_path / "b.txt").write_bytes(b"2")
    assert [r.path.rsplit("/", 1)[1] for r in containers.walk(spark, str(tmp_path)).collect()] == ["X.ADF"]


def test_one_row_per_key(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k long, v string")
    for most in (10, 0):
        assert sorted(str(r.k) for r in once.once_per_key(rows, "k", most).collect()) == ["1", "2", "None"]
    assert once.once_per_key(rows.limit(0), "k").isEmpty() and once.once_per_key(rows.where("v = 'c'"), "k").count() == 1


def test_containers(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("d/A-10.adf", b"image")
        z.writestr("readme.txt", b"no")
        z.writestr("b.ADZ", gzip.compress(b"packed"))
    files = [("x.adf", b"zeros"), ("x.zip", buffer.getvalue()), ("mystery", gzip.compress(b"z")), ("mystery.txt", b"hello"), ("bad.adz", b"no gzip"), ("empty.zip", b""), ("plain", bytes(containers.IMAGE_SIZE)), ("y.dms", b"DMS!")]
    got = containers.decode(spark.createDataFrame([(k, n, c) for k, (n, c) in enumerate(files)], "ingest_seq long, filename string, content binary")).collect()
    fine = {(r.ingest_seq, r.name): (r.container, bytes(r.content)[:6]) for r in got if r.error is None}
    assert fine[0, "x.adf"] == ("adf", b"zeros") and fine[1, "d/A-10.adf"] == ("zip", b"image") and fine[1, "b.ADZ"] == ("zip", b"packed") and fine[2, "mystery"] == ("adz", b"z") and fine[6, "plain"][0] == "adf"
    assert {r.ingest_seq for r in got if r.error} >= {3, 4, 5}


def test_zip_export(spark):
    files = spark.createDataFrame([("s", "b.adf", b"2"), ("s", "a.adf", b"1")], "s string, canonical string, content binary")
    archive = containers.zip_export(files, ("s",)).first().archive
    with zipfile.ZipFile(io.BytesIO(bytes(archive))) as z:
        assert z.namelist() == ["a.adf", "b.adf"] and z.read("a.adf") == b"1"


def test_list_xml(spark):
    xml = '<datafile><game name="A &amp; B v1.0 (1990)(Dyn)(Disk 1 of 2)[cr QTX]"><rom name="x" crc=" A1B2C3D4" sha1=""/></game><game><rom crc="1"/></game><game name="Plain"></game><game name="Y (ES)(Disk 1 of 11)"><rom md5="AB"/></game></datafile>'
    rows = lists.parse_list(spark.createDataFrame([("S", xml), ("E", ""), ("N", None)], "source string, xml string")).orderBy("position").collect()
    assert [(r.name[:5], r.crc32, r.sha1, r.md5) for r in rows] == [("A &am", "a1b2c3d4", None, None), ("Y (ES", None, None, "ab")]
    assert (rows[0].dump_type, rows[0].crack_group, rows[0].disk_count, rows[1].language, rows[1].disk_count) == ("cracked", "QTX", 2, "es", 11)


def test_pages(spark):
    html = '<html><head><title>T | Site</title></head><body><h1>Big <b>Game</b> &amp; Co Amiga</h1><div class="game-about">A long and quite winding text about a game of old</div><div class="game-info-row">Tags: <a href="/browse/flight">flight</a> <a href="/browse/war"></a><a href="/browse/x">FLIGHT</a></div><img src="/image/abc?t=lbcover" alt="front image"><a href="/image/s1?s=2x"></a><a href="/image/s1?s=2x"></a><a href="/image/c?s=512"></a></body>'
    p = {r.url: r for r in pages.scan_pages(spark.createDataFrame([("a", html), ("b", None), ("c", "<title>Only Amiga</title><p")], "url string, html string")).collect()}
    assert (p["a"].title, p["a"].genre, p["a"].cover, p["a"].shots) == ("Big Game & Co", "flight, war", "abc", ["s1"]) and p["a"].description.startswith("A long")
    assert p["b"].title is None and p["b"].shots == [] and p["c"].title == "Only"


def test_fetched_pages(spark):
    rows = spark.createDataFrame([("a", 200, "x"), ("b", 404, None), ("c", 500, "oops"), ("d", 503, None), ("d", 200, "late")], "url string, status int, html string")
    got = {r.url: (r.html, r.error) for r in pages.fetched(spark.createDataFrame([(u,) for u in "abcde"], "url string"), rows).collect()}
    assert got == {"a": ("x", None), "b": (None, None), "c": (None, "status 500"), "d": ("late", None), "e": (None, None)}


def test_browse_like_is_literal_about_backslashes(spark):
    rows = spark.createDataFrame([("A\\B",), ("ÄRA",), ("Garden",), ("10% off",)], "n string")
    hits = lambda q: [r.n for r in rows.where(browse.like_title(F.col("n"), q)).collect()]
    assert hits("\\b") == ["A\\B"] and hits("GARD_N") == ["Garden"] and hits("ära") == [] and len(hits(None)) == 4


def test_changes(spark):
    title = spark.createDataFrame([(1, "A", "game")], "id long, name string, category string")
    more = maintain.upsert_titles(title, spark.createDataFrame([("B", "game", 5), ("A", "game", 1), ("A", "demo", 2), ("B", "game", 3)], "name string, category string, seq long"), 1)
    assert {(r.id, r.name, r.category) for r in more.collect()} == {(1, "A", "game"), (2, "A", "demo"), (3, "B", "game")}
    a = catalog(spark, ["X (demo) (1990)(P).adf", "Y (1990)(P).adf"]).withColumns({"category": F.lit("tool"), "qualifier": F.lit(None).cast("string")})
    once = maintain.reidentify_report(a).first()
    assert (once.scanned, once.moved, once.editions_removed, once.titles_removed) == (2, 1, 1, 1)
    again = maintain.reidentify(a).drop("moved")
    assert maintain.reidentify_report(again).first().moved == 0 and {r.category for r in again.collect()} == {"demo", "tool"}


def test_merge_and_images(spark):
    schema = "title_id long, result_id long, priority int, source string, external_url string, description string, genre string, year int, cover struct<url:string,caption:string,source:string>, shots array<struct<url:string,caption:string,source:string>>, score float"
    one, two = ("u1", None, "s"), ("u2", None, "s")
    rows = [(1, 1, 1, "alpha", "e1", "d", None, 1990, ("c1", None, "s"), [one], 0.9), (1, 2, 2, "beta", "e2", "x", "g", 1991, None, [one, two], 0.8), (2, 3, 1, "beta", None, None, None, None, None, None, 0.2), (3, 4, 1, "beta", None, None, None, None, None, None, None)]
    m = enrich.merge(spark.createDataFrame(rows, schema)).collect()
    assert len(m) == 1 and (m[0].genre, m[0].description, m[0].year, m[0].sources, [s.url for s in m[0].shots]) == ("g", "d", 1990, "alpha,beta", ["u1", "u2"])
    kinds = "title_id long, kind string, url string"
    kept = enrich.replace_images(
        spark.createDataFrame([(1, "cover", "old"), (1, "screenshot", "old"), (2, "cover", "old"), (3, "odd", "old")], kinds), spark.createDataFrame([(1, "screenshot", "new")], kinds),
        spark.createDataFrame([(1, True, True), (2, False, False)], "title_id long, has_cover boolean, has_shots boolean"),
    )
    assert {(r.title_id, r.kind, r.url) for r in kept.collect()} == {(1, "cover", "old"), (1, "screenshot", "new"), (3, "odd", "old")}


def test_fuzzy_matches_against_all_pairs(spark):
    from diskloom.functions import similarity

    titles = spark.createDataFrame([(1, "A-10 Tank Killer"), (2, "The Addams Family"), (3, "Zool")], "title_id long, name string")
    links = spark.createDataFrame([(s.replace("-", " "), s) for s in ("a10-tank-killer", "addams-family-2", "abc", "zoo", "a-10-tank")], "label string, slug string")
    got = {r.title_id: r.slug for r in enrich.fuzzy_matches(titles, links).collect()}
    every = titles.crossJoin(links).where(similarity.index_letter(F.col("name")) == similarity.index_letter(F.col("label"))).withColumn("s", similarity.similarity(F.col("name"), F.col("label"))).where("s >= float(0.55)")
    best = {r.title_id: r.slug for r in every.groupBy("title_id").agg(F.min_by("slug", F.struct(-F.col("s"), F.col("slug"))).alias("slug")).collect()}
    assert got == best and got[1] == "a10-tank-killer"


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(k % 3 or None, k) for k in range(30)], "k int, v int")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    got = lambda hot: sorted((r.k, r.v, r.m) for r in skew.join_counted(rows, keyed, ["k"], "n", hot).collect())
    assert got(5) == got(1_000_000) and len(got(5)) == 20


def test_classes_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(100, 100), (101, 100)]
    found = components.connected_classes(spark.createDataFrame(edges, "a long, b long"))
    by = {r["node"]: r["class"] for r in found.collect()}
    assert {by[k] for k in range(41)} == {0} and {by[k] for k in range(100, 140)} == {100} and found.count() == 81
    assert components.connected_classes(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_blobs_snapshots_and_stream(spark, tmp_path):
    store = blobs.BlobStore(spark, str(tmp_path / "blobs"))
    data = spark.createDataFrame([(b"a",), (b"b",), (b"a",), (None,)], "content binary")
    assert sorted(r.is_new for r in store.put(data).collect()) == [True, True] and sorted(r.is_new for r in store.put(data).collect()) == [False, False]
    assert store.blobs().count() == 2 and store.get(data.select(F.sha1("content").alias("sha1")).limit(1)).count() == 1
    uploads = spark.createDataFrame([(1, "A (1990)(P).adf", b"1"), (2, "B (1990)(P).adf", b"1"), (3, "noname.adf", b"2")], ingest.UPLOADS)
    uploads.write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "cat"), str(tmp_path / "state")).awaitTermination()
        uploads.write.mode("append").parquet(str(tmp_path / "in"))
    stored = blobs.Snapshots(spark, str(tmp_path / "cat")).read("artifact").collect()
    assert sorted((r.orig_filename, r.display_title or "") for r in stored) == [("A (1990)(P).adf", "A"), ("noname.adf", "")]
    assert sorted((r.batch, r.stored, r.duplicate, r.quarantined, r.failed) for r in blobs.Snapshots(spark, str(tmp_path / "cat")).read("progress").collect()) == [(0, 2, 1, 1, 0), (1, 0, 3, 0, 0)]


def test_similar_pairs_are_those_of_all_pairs(spark, monkeypatch):
    """Every kind of key against brute force; pairs far below the floor, which share a common word only, aren't brought together."""
    monkeypatch.setattr(enrich, "RARE", 3)
    monkeypatch.setattr(enrich, "WIDE", 4)
    rnd = __import__("random").Random(3)
    common, rare = ["silent", "golden", "harbour", "orbit", "of", "and", "the", "ii"], ["mindratpasyash", "koltkixzarn", "fotsibkam", "zopvernpish", "bim", "x"]
    made = [" ".join(rnd.choices(common, k=rnd.randint(0, 4)) + rnd.choices(rare, k=rnd.randint(0, 2))) for _ in range(150)]
    typed = [n.replace(rnd.choice("aeio "), rnd.choice(["", "u"]), 1) for n in made] + ["Silent Harbour Of Mindrat", "silentharbourofmindrat", None, "", " ".join(common), "a" * 3000 + " of", "a" * 2999 + "b of"]
    titles = spark.createDataFrame(list(enumerate([*made, None, "", " ".join(common + rare), "a" * 3000 + " of"])), "title_id long, name string")
    links = spark.createDataFrame(list(enumerate(typed)), "result_id long, page_title string")
    score = enrich.sim.similarity(F.col("name"), F.col("page_title"))
    for letter in (False, True):
        every = titles.crossJoin(links).withColumn("score", score)
        if letter:
            every = every.where(enrich.sim.index_letter(F.col("name")) == enrich.sim.index_letter(F.col("page_title")))
        expected = {(r.title_id, r.result_id): r.score for r in every.where("score >= 0.54995").collect()}
        found = {(r.title_id, r.result_id): r.score for r in enrich.similar_pairs(titles, links, "page_title", letter).collect()}
        assert len(expected) > 100 and expected == {k: s for k, s in found.items() if s >= 0.54995} and min(found.values()) > 0.54


def test_blocks_are_dealt(spark):
    left, right = (spark.createDataFrame([(k % 3, k) for k in range(60)], f"key int, {c} int") for c in "ab")
    assert sorted(map(tuple, skew.join_blocks(left, right, "key", 7).collect())) == sorted(map(tuple, left.join(right, "key").collect()))


def test_ids_need_no_primaries(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("primaries were chosen")

    monkeypatch.setattr(batch, "primaries_of", refused)
    uploads = spark.createDataFrame([(k, f"Game {k % 2} (1990)(Pub).adf", str(k).encode()) for k in range(4)], "ingest_seq long, filename string, content binary")
    done = batch.ingest({n: batch.empty(spark, n) for n in ("title", "edition", "artifact", "quarantine")}, uploads, raw=True, primaries=False)
    assert {(r.id, r.name) for r in done["title"].collect()} == {(1, "Game 0"), (2, "Game 1")} and done["primary"].isEmpty() and done["edition"].count() == 2


def test_numbered_gives_the_ids_of_an_ingest_and_writes_no_contents_down(spark, monkeypatch):
    one = uploads_of(spark, [("A v1.0 (1990)(P)(Disk 1 of 2).adf", None), ("B (1991)(Q).adf", "zz"), ("again (1991)(Q).adf", "zz"), ("noname.adf", "n1"), ("noname2.adf", "n2"), ("A v1.0 (1990)(P)(Disk 2 of 2).adf", None)])
    two = uploads_of(spark, [("C (1992)(R).adf", "zz"), ("other.adf", "listed"), ("D (1993)(S).adf", "d"), ("A v1.0 (1995)(P)(Disk 1 of 2)[b].adf", "q"), ("E (1993)(S).adf", "e"), ("F (1993)(S).adf", "e"), ("G (1993)(S).adf", "n1"), ("wrong (1990)(W).adf", "md5 only")], 100)
    entries = spark.createDataFrame([(1, "L", "Zed v2.0 (1990)(P).adf", "listed"), (2, "L", "Later (1990)(P).adf", "listed"), (3, "Demos", "Demo Thing (1999)(X)", "md5 only")], "dat_id long, source string, name string, c string")
    content = F.col("c").cast("binary")
    entries = entries.select("dat_id", "source", "name", F.when(F.col("dat_id") < 3, F.sha1(content)).alias("sha1"), F.lit(None).cast("string").alias("crc32"), F.md5(content).alias("md5"), *(F.lit(None).cast(t).alias(c) for c, t in (("title", "string"), ("version", "string"), ("language", "string"), ("publisher", "string"), ("year", "int"), ("disk_no", "long"), ("disk_count", "long"))))
    whole = lean = {n: batch.empty(spark, n) for n in ("title", "edition", "artifact", "quarantine")}
    lean = {n: lean[n] for n in ("title", "edition", "artifact")}
    made = []
    for rows, known in ((one, None), (two, entries)):
        whole = batch.add(whole, batch.ingest(whole, rows, known, raw=True, primaries=False))
        with monkeypatch.context() as m:
            write = batch.durable
            m.setattr(batch, "durable", lambda df: made.append(df.columns) or write(df))
            done = batch.numbered(lean, rows, known)
        lean = {n: lean[n].select(*done[n].columns).unionByName(done[n]) for n in lean}
    plain = lambda df: sorted(map(tuple, df.select([c for c in df.columns if c != "primary_artifact_uid"]).collect()), key=repr)
    assert plain(lean["title"]) == plain(whole["title"]) and plain(lean["edition"]) == plain(whole["edition"]) and lean["title"].count() == 6
    assert not any({"sha1", "filename"} & set(c) for c in made)
