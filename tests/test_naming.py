from pyspark.sql import functions as F

from diskloom.functions import flags, naming, similarity


def column(spark, values, use, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in rows.select("k", use(F.col("v")).alias("x")).orderBy("k").collect()]


def test_parse_name(spark):
    names = [
        "A-10 Tank Killer v1.0 (1990)(Dynamix)(Disk 1 of 2)[h QTX][a2 highscore].adf",
        "Monkey Island 2 - LeChuck's Revenge v1.0 (1992)(C.T.O.)(IT)(Disk 1 of 11)[cr IBB].adf",
        "Agony (demo-playable) (1991)(Psygnosis)[h PRD].adf", "Whatever (SomeGroup)(1990).adf", "disk047.adf", "X (19xx)(Pub).adf", "X ().adf", "X (a (b) c).adf", "X (1990", "", None, "(1990).adf",
        "v1.0 (1990).adf", "X (disk 1 of 4294967296)(disk +2 of 3).adf", "X (preview)(demo)(1990-04-01)(DE)(FR).adf", "X [a [b] c][d", "dir/Name (1990).tar.gz1",
    ]
    a, b, c, d, none, e, f, g, h, empty, null, untitled, v, big, two, deep, folder = column(spark, names, naming.parse_name)
    assert (a.title, a.version, a.year, a.publisher, a.disk_no, a.disk_count, a.flags) == ("A-10 Tank Killer", "v1.0", 1990, "Dynamix", 1, 2, ["h QTX", "a2 highscore"])
    assert (b.language, b.disk_count, b.publisher) == ("it", 11, "C.T.O.")
    assert (c.qualifier, c.publisher, c.year) == ("demo-playable", "Psygnosis", 1991)
    assert (d.qualifier, d.publisher) == (None, "SomeGroup")
    assert none is None and empty is None and null is None and untitled is None
    assert (e.publisher, e.year) == ("19xx", None)
    assert f.publisher == "" and g.publisher == "a (b) c" and h.year == 1990
    assert (v.title, v.version) == ("v1.0", None)
    assert (big.publisher, big.disk_no, big.disk_count) == ("disk 1 of 4294967296", 2, 3)
    assert (two.qualifier, two.publisher, two.language, two.year) == ("preview", None, "fr", 1990)
    assert deep.flags == ["a [b] c", "d"] and folder.title == "dir/Name"


def test_sanitize_and_canonical(spark):
    assert column(spark, ["Monkey Island 2 - LeChuck's Revenge", "Turrican II: The Final Fight", "Rick Dangerous & Friends", "Über Wing", "Í_ç!"], naming.sanitize_title) == [
        "Monkey-Island-2-LeChucks-Revenge", "Turrican-II-The-Final-Fight", "Rick-Dangerous-and-Friends", "Ueber-Wing", "",
    ]
    rows = spark.createDataFrame([("A-10 Tank Killer", "v1.0", "EN", 1, 2, "a1b2c3d4e5"), ("State of the Art", None, None, None, 2, "9f8e7d6c5b"), (None, "2", None, 10, 110, "9f8e7d6c5b")], "t string, v string, l string, n long, m long, u string")
    made = rows.select(naming.canonical_name(*map(F.col, "tvlnmu")).alias("c")).collect()
    assert [r.c for r in made] == ["A-10-Tank-Killer_v1.0_en_d01of02_a1b2c3d4e5.adf", "State-of-the-Art_9f8e7d6c5b.adf", "Unknown_v2_d10of110_9f8e7d6c5b.adf"]
    back = column(spark, [made[0].c, made[1].c, "Title_x.adf", "T_v1_mul_d1of2_ABCDEF0123"], naming.parse_canonical)
    assert (back[0].title, back[0].version, back[0].language, back[0].disk_no, back[0].disk_count, back[0].uid) == ("A-10-Tank-Killer", "v1.0", "en", 1, 2, "a1b2c3d4e5")
    assert back[1].version is None and back[2] is None and back[3].language == "mul"


def test_version_order(spark):
    keys = dict(zip(v := ["v1.9", "v1.10", "v1.2", "v1.2a", "v1.3", "v1.99", "v2.0", "v1", "v1.0", "v1.00", "v0", "v0.0", "V1.0", "1.0", "v1.99999999999999999999999", "beta"], column(spark, v, naming.version_key), strict=True))
    assert keys["v1.9"] < keys["v1.10"] and keys["v1.2"] < keys["v1.2a"] < keys["v1.3"] and keys["v1.99"] < keys["v2.0"]
    assert keys["v1"] == keys["v1.0"] == keys["v1.00"] == keys["V1.0"] == keys["1.0"] and keys["v0"] == keys["v0.0"] != ""
    assert keys["v1.99999999999999999999999"] == "000001.99999999999999999999999" and keys["beta"] == "beta"


def test_flags(spark):
    lists = [["cr CSL", "t +9 TLPI"], ["cr CSL", "b corrupt file"], ["h GF", "v Saddam 1"], ["h QTX", "a2 highscore"], [], None, ["t", "aga"], ["t x", "t"], ["m", "!"], ["CR X"], ["cr", "f A", "cr B"], ["a99999999999"]]
    i = column(spark, lists, flags.dump_info, "array<string>")
    assert (i[0].dump_type, i[0].crack_group, i[0].trainer, i[0].lineage, i[0].modifications) == ("cracked", "CSL", "+9 TLPI", "CSL", 2)
    assert i[1].bad and i[2].virus and i[3].alt_index == 2 and i[4].dump_type == i[5].dump_type == "original" and i[5].alt_index == 0
    assert (i[6].dump_type, i[6].trainer, i[6].alt_index) == ("trainer", "", 1) and i[7].trainer == "" and i[7].modifications == 2
    assert (i[8].dump_type, i[8].verified_good, i[8].lineage) == ("modified", True, None) and i[9].dump_type == "original"
    assert (i[10].crack_group, i[10].lineage) == ("B", "A") and i[11].alt_index == 1


def test_category_class_badge_hue_image(spark):
    rows = spark.createDataFrame([("demo-playable", None), ("preview", None), (None, "Amiga - Demos"), (None, "Amiga - Applications"), (None, "TOSEC"), (None, None), ("proto", "Utils")], "q string, s string")
    assert [r[0] for r in rows.select(flags.category(F.col("q"), F.col("s"))).collect()] == ["demo", "demo", "demo", "tool", "game", "game", "tool"]
    assert column(spark, ["original", "cracked", "hacked", "modified", "trainer", "odd", None], flags.class3) == ["original", "cracked", "hacked", "hacked", "hacked", "original", "original"]
    assert column(spark, [0, 1, 3], flags.alternate_badge, "long") == ["base", "[a]", "[a3]"]
    assert column(spark, ["", "a", "ab"], flags.hue) == [0, 97, (97 * 31 + 98) % 360]
    images = [b"\x89PNG\r\n\x1a\n....", b"\xff\xd8\xff..", b"GIF89a", b"RIFF....WEBP", b"??"]
    assert column(spark, images, lambda c: flags.image_type(c, F.lit("image/x")), "binary") == ["image/png", "image/jpeg", "image/gif", "image/webp", "image/x"]
    assert column(spark, ["", "A b!"], naming.safe_name) == ["original", "A_b_"]


def test_similarity(spark):
    assert column(spark, ["The Addams Family", "A-10 Tank Killer", "Bubble Bobble!", "The", ""], similarity.normalize) == ["addams family", "a 10 tank killer", "bubble bobble", "the", ""]
    assert column(spark, ["The 4D Box", "1943", ""], similarity.index_letter) == ["d", "0", "0"]
    rows = spark.createDataFrame([("A-10 Tank Killer", "A10 Tank Killer"), ("Turrican", "Turrican"), ("Turrican", "Turrican II"), ("Turrican", "Lemmings"), ("", "x")], "a string, b string")
    same, equal, second, other, none = (r[0] for r in rows.select(similarity.similarity(F.col("a"), F.col("b"))).collect())
    assert same == equal == 1.0 and second > 0.55 and other < 0.4 and none == 0.0
