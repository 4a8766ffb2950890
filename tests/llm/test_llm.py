import base64
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from diskloom.llm import abuse, bounds, canonical, formatting, leakage, linkage, names, survivor, tokens, variants


# 1: works and pages

WORKS = "id long, name string, year int, category string"
PAGES = "id long, name string, year int, genre string, description string, score float"


def test_p1_ties(spark):
    base = [f"{a} {n} of {b}" for a in ("Silent", "Golden", "Broken", "Neon") for n in ("Harbour", "Dungeon", "Orbit") for b in ("Mindratpasyash", "Koltkixzarn Jal", "Fotsibkam Sax", "Bimdos Yedpish", "Zopvernpish Bim")]
    works = [(k, n, 1990, "game") for k, n in enumerate(base, 1)] + [(100, "Silent Harbour of Mindratpasyash II", 1991, "game"), (101, "Silent Harbour of Mindratpasyash", 1999, "demo"), (102, None, 1990, "game"), (103, "", None, None)]
    pages = [(k, n.upper() + " | site", 1990, "puzzle", "game from X.", 0.8) for k, n in enumerate(base, 1)]
    pages += [(200, "Silent Harbour of Mindratpasysh - 2", 1991, None, None, None), (201, "Silent Harbour of Mindratpasyash", 1999, "demo", None, 0.9), (202, "Silent Harbour of Mindratpasyash 5", 1990, None, None, 0.9), (203, None, None, None, None, None), (204, "x" * 50_000, None, None, None, None)]
    extra = spark.createDataFrame(works, WORKS).withColumn("page", F.lit("clash"))
    twice = spark.createDataFrame(pages + pages[:3], PAGES).withColumns({"work": F.lit(1), "name_a": F.lit("x")})
    found = {r.page: (r.work, r.confidence) for r in linkage.ties(extra, twice).collect()}
    assert all(found[k][0] == k for k in range(2, len(base) + 1)) and found[200][0] == 100 and found[201][0] == 101
    assert not {202, 203, 204} & set(found) and all(0.5 <= c <= 1 for _, c in found.values())


def test_p1_one_shared_sequence_is_enough(spark):
    works = spark.createDataFrame([(287, "Dadduztidzop III", 1988, "game"), (288, "Dekwebpukrat II", 1988, "game"), (289, "Zopvernpish", 1988, "game")], WORKS)
    pages = spark.createDataFrame([(476, "Daddutzidzop 3", 1988, None, None, 0.81), (477, "Dekwevpujrat Two", 1988, None, None, 0.81)], PAGES)
    assert {(r.work, r.page) for r in linkage.scored(works, pages).collect()} == {(287, 476), (288, 477)}


def test_p1_common_sequences_make_candidates(spark):
    works = spark.createDataFrame([(k, "Dadutsidzop", 1988, "game") for k in range(1, 61)], WORKS)
    pages = spark.createDataFrame([(1, "Dadutsipzob", 1988, None, None, 0.81)], PAGES)
    assert {(r.work, r.page) for r in linkage.scored(works, pages).collect()} == {(k, 1) for k in range(1, 61)}


def test_p1_of_equal_works_the_least_id(spark):
    works = spark.createDataFrame([(k, "Dadutsidzop", 1988, "game") for k in range(7, 60)] + [(k, f"Kelvarmonit {k}", 1990, "tool") for k in range(60, 70)], WORKS)
    pages = spark.createDataFrame([(k, "Dadutsidzop", 1988, None, "game from X.", 0.9) for k in range(5)] + [(k, f"Kelvarmonit {k}", 1990, None, None, 0.9) for k in range(60, 70)], PAGES)
    assert {(r.page, r.work) for r in linkage.ties(works, pages).collect()} == {(k, 7) for k in range(5)} | {(k, k) for k in range(60, 70)}


def test_p1_copies_of_a_page_are_paired_once(spark, monkeypatch):
    works = spark.createDataFrame([(k, f"Kelvarmonit {k}", 1990, "tool") for k in range(1, 9)], WORKS)
    pages = [(k, f"Kelvarmonit {k}", 1990, None, None, 0.9) for k in range(1, 9)]
    met = []
    whole = linkage.voted
    monkeypatch.setattr(linkage, "voted", lambda w, p, *every: met.append(p.count()) or whole(w, p, *every))
    monkeypatch.setattr(linkage, "HOT_PAIRS", 3)
    found = linkage.ties(works, spark.createDataFrame(pages + [(k + 100 * c, *rest) for k, *rest in pages for c in (1, 2, 3)], PAGES))
    assert {(r.page, r.work) for r in found.collect()} == {(k + 100 * c, k) for k in range(1, 9) for c in range(4)} and met == [8]


def test_p1_rows_are_dealt_once_to_tiles_and_pairs_stay_there(spark, monkeypatch):
    rnd = random.Random(1)
    syllables = ["dad", "dut", "sid", "zop", "kel", "var", "mon", "nit", "b", "a"]
    name = lambda: " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 4))).title() for _ in range(rnd.randint(1, 3))) + rnd.choice(["", "", " II", " - 3"])
    works = [(k, name(), rnd.choice([None, 1990, 1991, 1993]), rnd.choice([None, "game", "tool"])) for k in range(70)] + [(70, "É", 1990, "game"), (71, "Kelvarmon " + "of the Silent Orbit Garden " * 9, 1990, "game")]
    pages = [(k, name(), rnd.choice([None, 1990, 1992]), None, rnd.choice([None, "A tool by X."]), rnd.choice([None, 0.2, 0.6, 0.9])) for k in range(90)] + [(90 + k, w[1] + "!", w[2], None, None, 0.9) for k, w in enumerate(works)] + [(99, "...", None, None, None, None)]
    pages = list({p[0]: p for p in pages}.values())
    monkeypatch.setattr(linkage, "HOT_PAIRS", 400)
    met = linkage.voted(spark.createDataFrame(works, WORKS), spark.createDataFrame(pages, PAGES))
    rows = met.placed.collect()
    # A row goes once to each part of the other side, however many keys it has.
    assert met.count > 4 and len({(r.page, r.id, r.tile) for r in rows}) == len(rows)
    split = {(r.page, r.id): (r.number, r.core.split(), r.common.split(), r.tokens.split()) for r in rows}

    def keys(number, core, _, tokens):
        telling = "".join(t for t in core if len(t) > 1) or "".join(tokens)
        out = {f"={''.join(sorted(tokens))}"} if tokens else set()
        for mark, x in (":", telling), ("~", names.fold(names.consonants(telling))):
            out |= {mark + x[at:at + 5] for at in range(max(1, len(x) - 4))} if x else set()
        whole = names.fold(names.consonants("".join(tokens)))
        return {(number, k) for k in out | ({"~" + whole} if len(whole) >= 5 else set())}

    indexed = {k: keys(*v) for k, v in split.items()}
    expected = {(w, p) for x, w in indexed if not x for y, p in indexed if y and indexed[False, w] & indexed[True, p]}
    found = met.pairs().collect()
    assert len(found) == len(expected) > 200 and {(r.work, r.page) for r in found} == expected
    for r in found:
        a, b = split[False, r.work], split[True, r.page]
        core, shared = names.core_ratio(a[1], b[1]), names.common_share(a[2], b[2])
        whole = names.CORE * core + (1 - names.CORE) * (1.0 if shared is None else shared)
        limits = lambda v, no, yes: 0 if v is None else 1 if v >= yes else -1 if v < no else 0
        assert r.similarity == whole and (r.core, r.spelling, r.common) == (limits(core, 0.7, 0.8), limits(whole, 0.75, 0.86), limits(shared, 0.5, 0.99))
    # All candidates count, unlike ones over all pages; the closest of the others are the same as among all pairs.
    best, far = met.best().collect(), met.best(far=True).collect()
    assert sum(r.n for r in best) == sum(r.n for r in far) == len(found) and len(best) < len(far)
    patterns = lambda rows, n: {v: sum(n(r) for r in rows if tuple(r[x] for x in linkage.VOTES) == v) for v in {tuple(r[x] for x in linkage.VOTES) for r in rows}}
    assert patterns(best, lambda r: r.n) == patterns(far, lambda r: r.n) == patterns(found, lambda r: 1)
    closest = {}
    for r in found:
        k = (r.page, *(r[v] for v in linkage.VOTES))
        closest[k] = max(closest.get(k, (-1, 0)), (r.similarity, -r.work))
    got = {}
    for r in far:
        k = (r.page, *(r[v] for v in linkage.VOTES))
        got[k] = max(got.get(k, (-1, 0)), (r.similarity, -r.work))
    assert got == closest and {(r.page, *(r[v] for v in linkage.VOTES)) for r in best if r.page is not None} == {k for k in closest if max(k[1:3]) >= 0}


def test_p1_unlike_names_are_tied_where_they_are_accepted(spark):
    works = spark.createDataFrame([(k, n, 1990, "game") for k, n in enumerate(["Dadutsidzop", "Kelvarmonit", "Kelvarsidopnit"], 1)], WORKS)
    pages = spark.createDataFrame([(1, "Kelvartutzabfipgon", 1990, None, None, 0.9), (2, "Kelvarmonit", 1990, None, None, 0.9)], PAGES)
    found = {r.page: r.work for r in linkage.ties(works, pages, accept=0.0).collect()}
    every = linkage.scored(works, pages).collect()
    assert found == {k: max((r.confidence, r.similarity, -r.work, r.work) for r in every if r.page == k)[-1] for k in (1, 2)}
    assert any(r.core == r.spelling == -1 and found[r.page] == r.work for r in every)


def test_p1_site_endings_are_learnt(spark):
    pages = spark.createDataFrame([(k, f"Work{k} - full info", 1990, None, None, None) for k in range(20)] + [(k, f"Work{k} - The Last Signal", 1990, None, None, None) for k in range(20, 40)] + [(k, f"Work{k} - 2", 1990, None, None, None) for k in range(40, 60)], PAGES)
    works = spark.createDataFrame([(1, "Work20: The Last Signal", 1990, "game")], WORKS)
    assert linkage.site_tails(works, pages) == ["full info"] and linkage.page_name("Work1 - Full Info", ["full info"]) == "Work1"


def test_p1_names_without_vowels_are_compared(spark):
    works = spark.createDataFrame([(1, "Dadduztidzop", 1988, "game"), (2, "Kelvarmonit", 1988, "game")], WORKS)
    pages = spark.createDataFrame([(1, "DDDZTDZP", 1988, None, None, 0.81), (2, "Kelvarmonit", 1988, None, None, 0.81)], PAGES)
    assert {(r.work, r.page) for r in linkage.scored(works, pages).collect()} == {(1, 1), (2, 2)}


def test_p1_empty_tables(spark):
    none, one = spark.createDataFrame([], WORKS), spark.createDataFrame([(1, "A Name", None, None, None, None)], PAGES)
    assert linkage.ties(none, one).isEmpty() and linkage.ties(spark.createDataFrame([(1, "A Name", 1990, "game")], WORKS), spark.createDataFrame([], PAGES)).isEmpty()


def test_p1_label_model_learns_accuracies():
    import numpy as np

    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    def vote(right, shown):
        return np.where(rng.random(4000) < shown, np.where(rng.random(4000) < right, 1, -1) * np.where(truth, 1, -1), 0)
    good, weak = vote(0.97, 0.9), vote(0.6, 0.9)
    votes = np.stack([good, weak, weak, vote(0.9, 0.8), vote(0.9, 0.8)], axis=1)  # one function copies another
    model = linkage.fit_label_model(votes, np.ones(len(votes)))
    assert abs(model.prior - 0.3) < 0.06 and ((model.posterior(votes) > 0.5) == truth).mean() > 0.94


# 2: typed names and the list

LIST = [
    (1, "Silent Harbour of Mindratpasyash v1.0 (1990)(Pub One)(Disk 1 of 2)"), (2, "Silent Harbour of Mindratpasyash v1.0 (1990)(Pub One)(Disk 2 of 2)"), (3, "Silent Harbour of Mindratpasyash II (1991)(Pub One)"),
    (4, "Silent Harbour of Mindratpasyash II (1991)(Pub One)[cr Kubbimrend Liz]"), (5, "Golden Orbit - A New Dawn (1992)(Other)(DE)"), (6, "Koltkixzarn Jal v1.1 (1992)(Other)(FR)"), (7, "Koltkixzarn Jal v1.2 (1992)(Other)(IT)"),
]


def test_p2_maps_names(spark):
    typed = [
        ("a", "amiga/old/silent_harbuor_of_mindratpasyash_disk_02_(19xx).adf"), ("b", "SILENT HARBOUR OF MINDRATPASYASH PART II.ZIP"), ("c", "Harbour of Mindratpasyash 2, Silent [cr Kubimrend Liz]"), ("d", "Silent Harbour of Mindratpasyash VI"),
        ("e", "disk047.adf"), ("e", None), ("f", "Koltkixzarn Jal italian"), ("g", "misc.adf"), ("g", "Koltkixzarn_Jal_[fr].dms"), ("h", ""), ("i", None), (None, "Koltkixzarn Jal"), ("j", "z" * 20_000), ("a", "backup of backup.adf"), ("k", "???"),
    ]
    rows = spark.createDataFrame(typed + typed[:2], "uid string, name string").withColumns({"dat_id": F.lit(99), "score": F.lit("x")})
    found = {r.uid: r.dat_id for r in canonical.map_names(rows, spark.createDataFrame(LIST + LIST[:1] + [(8, None), (None, "x")], "dat_id long, name string")).collect()}
    assert found == {"a": 2, "b": 3, "c": 4, "d": 0, "e": 0, "f": 7, "g": 6, "h": 0, "i": 0, "j": 0, "k": 0}


def test_p2_empty(spark):
    typed, entries = spark.createDataFrame([("a", "x")], "uid string, name string"), spark.createDataFrame(LIST, "dat_id long, name string")
    assert [(r.uid, r.dat_id) for r in canonical.map_names(typed, entries.limit(0)).collect()] == [("a", 0)] and canonical.map_names(typed.limit(0), entries).isEmpty()


def test_p2_shuffled_list_gives_the_same(spark):
    typed = spark.createDataFrame([(str(k), n.split(" (")[0]) for k, n in LIST], "uid string, name string")
    entries = spark.createDataFrame(LIST, "dat_id long, name string")
    whole = sorted(map(tuple, canonical.map_names(typed, entries).collect()))
    assert sorted(map(tuple, canonical.map_names(typed, entries, broadcast_rows=0).collect())) == whole


def test_p2_cosines_against_all_pairs(spark):
    import math

    texts = ["zak", "silentharbour", "silenthabrour", "goldenorbit", "x", "orbit"]
    reference = canonical.ReferenceList(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "dat_id long, name string"), "dat_id", "name", 0)
    keys = {r.title: "".join(r.core.split()) for r in reference.titles.collect()}
    queries = {1: "zac", 2: "silentharbor", 3: "orbitgold"}
    found = {(r["query"], keys[r["title"]]): r["cosine"] for r in reference.cosines(spark.createDataFrame([(k, canonical.grams(q)) for k, q in queries.items()], "query long, grams array<long>")).collect()}
    own = {t: set(canonical.grams(t)) for t in keys.values()}
    weight = lambda g: math.log(1 + len(own) / max(1, sum(g in x for x in own.values()))) ** 2
    norm = lambda x: math.sqrt(sum(map(weight, x)))
    expected = {(k, t): sum(map(weight, set(canonical.grams(q)) & x)) / norm(canonical.grams(q)) / norm(x) for k, q in queries.items() for t, x in own.items() if set(canonical.grams(q)) & x}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in found)


def test_p2_short_titles_and_all_languages(spark):
    entries = spark.createDataFrame([(1, "Zak (1990)(P)"), (2, "Koltkixzarn Jal (1992)(Other)(NL)"), (3, "Koltkixzarn Jal (1992)(Other)(PL)"), (4, "X (1990)(P)")], "dat_id long, name string")
    typed = spark.createDataFrame([("a", "Zak.adf"), ("b", "Koltkixzarn Jal (PL).adf"), ("c", "koltkixzarn_jal_dutch.adf"), ("d", "x.adf")], "uid string, name string")
    assert {r.uid: r.dat_id for r in canonical.map_names(typed, entries).collect()} == {"a": 1, "b": 3, "c": 2, "d": 4}


# 3: variants


def test_p3_variants(spark):
    groups = [["Jondyash Taznex Limited", "Joondyash Tazneks Limited", "Jondyash Taznex Ltd.", "Taznex, Jondyash Limited"], ["Margaret Kixyashdospod Games", "M. Kixyashdospod Games", "Peggy Kixyashdospod Games"], ["Fotzarnfip Hoz"], ["Hozwig Paslan Systems"]]
    titles = [["Silent Harbour of Mindratpasyash II", "SILENT HARBOUR OF MINDRATPASYASH 2", "Harbour of Mindratpasyash #2, Silent"], ["Silent Harbour of Mindratpasyash", "SilentHarbour of Mindratpasyash"]]
    odd = ["", "???", "a", "x" * 20_000]
    rows = [("publisher", n, 1) for g in groups for n in g] + [("title", n, 1) for g in titles for n in g] + [("title", o, 1) for o in odd]
    frame = spark.createDataFrame(rows, "field string, name string, n int").withColumns({"key": F.lit(1), "class": F.lit("z")}).select("field", "name", "n", "key", "class")
    found = {(r.field, r.name_a, r.name_b) for r in variants.variant_pairs(frame.select("field", "name", "n"), frozenset(("title",))).collect()}
    expected = {(f, min(a, b), max(a, b)) for f, gs in (("publisher", groups), ("title", titles)) for g in gs for a in g for b in g if a != b}
    assert found == expected


def test_p3_spellings_of_common_ends_meet(spark):
    rng = random.Random(5)
    other = {"".join(rng.choice("bfghlt") + rng.choice("aeiou") for _ in range(4)) for _ in range(140)}
    rows = [f"Mindra{t}" for t in other] + [f"{t}osped" for t in other] + ["Mindravekosped", "Mindrawejosped", "Mindravulu", "Tulukosped"]
    strings = spark.createDataFrame([("title", r) for r in rows], "field string, name string")
    found = {(r.name_a, r.name_b) for r in variants.links(strings, frozenset()).collect()}
    assert ("Mindravekosped", "Mindrawejosped") in found


def test_p3_hot_blocks_are_dealt_alike(spark):
    strings = spark.createDataFrame([("title", f"Mindra{a}{b}osped") for a in "bcdfg" for b in "aeiou"], "field string, name string")
    got = lambda hot: sorted(map(tuple, variants.links(strings, frozenset(), hot=hot).collect()))
    assert got(4) == got(2_000) and got(4)


def test_p3_bounds_leave_out_no_alike_pair():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bdfgjklmnprstvwx") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    spoil = lambda w: rng.choice((w, w[1:], w[:-1] + "x", w[:2] + w[3:], w[:1], names.consonants(w) or w, w[::-1], w[:3] + "q" + w[3:]))
    cores = ["margaret kixas", "pegi kixas", "m kixas", "a b", "\u0142adna", "x" * 70, "x" * 69 + "y", "dadupalokitenumorasi " + "fa", "dadupalokitenumoras " + "fe"]
    for _ in range(60):
        tokens = [word() for _ in range(rng.randrange(1, 4))]
        cores += [" ".join(rng.sample(kin, len(kin))) for _ in range(6) if (kin := [t for t in map(spoil, tokens) if t])]
    held = bounds.Cores(cores)
    starts = np.arange(len(cores)) == 0
    alike = 0
    for a, b in bounds.pairs_of(starts, np.ones(len(cores), bool), 5_000):
        near = held.may_reach(a, b, 0.8)
        for i, j, left_in in zip(a.tolist(), b.tolist(), near.tolist(), strict=True):
            if names.core_ratio(cores[i].split(), cores[j].split()) >= 0.8:
                alike += 1
                assert left_in, (cores[i], cores[j])
    assert alike > 300


def test_p3_few_pairs_of_a_large_block_are_compared(spark):
    rng = random.Random(4)
    cores = sorted({"".join(rng.choice("bdfgjklmnprstvw") + rng.choice("aeiou") + rng.choice("dgklmnrst") for _ in range(3)) + "losped" for _ in range(3_000)})
    held, mine = bounds.Cores(cores), np.ones(len(cores), bool)
    sizes = [(len(a), held.may_reach(a, b, 0.8).sum()) for a, b in bounds.pairs_of(~np.arange(len(cores)).astype(bool), mine)]
    assert sum(n for n, _ in sizes) == len(cores) * (len(cores) - 1) // 2
    assert sum(n for _, n in sizes) < 0.05 * sum(n for n, _ in sizes)


def test_p3_blocks_over_several_frames():
    rows = pd.DataFrame([("f", f"k{k}", 0, f"n{n}") for k, size in enumerate((1, 7, 2, 12, 1)) for n in range(size)], columns=["field", "key", "share", "name"])
    for size in (1, 2, 3, 5, 40):
        got = list(variants.whole_blocks(iter([rows[k:k + size] for k in range(0, len(rows), size)])))
        assert pd.concat(got, ignore_index=True).equals(rows)
        assert sum(f.key.nunique() for f in got) == 5


def test_p3_large_classes_are_dealt_alike(spark):
    members = spark.createDataFrame([("f", f"n{k}", f"n{k % 3}") for k in range(40)] + [("f", "z", "z")], "field string, name string, class string")
    got = lambda hot: sorted(map(tuple, variants.pairs_within(members, hot).collect()))
    assert got(4) == got(2_000) and len(got(4)) == 247


def test_numbers_of_a_series():
    number = lambda s: names.parse(s, True).number
    assert [number(s) for s in ("Orbit II", "Orbit Two", "Orbit: Seven Keys", "Orbit Seven Keys", "Orbit 3: Seven Doors", "Orbit IV - Night of Embers", "Orbit: Night of Embers", "Orbit Thre", "Orbit part five: A New Dawn", "Orbit")] == [2, 2, 1, 1, 3, 4, 1, 3, 5, 1]


def test_p3_nulls_repeats_empty(spark):
    rows = spark.createDataFrame([("Abcdefgh Ij", None), ("Abcdefgh Ij", "q"), (None, "q"), ("Abcdefghh Ij", None)], "p string, q string")
    strings = variants.distinct_strings(rows, {"publisher": "p", "other": "q"})
    assert [tuple(r) for r in variants.variant_pairs(strings).collect()] == [("publisher", "Abcdefgh Ij", "Abcdefghh Ij")]
    assert variants.variant_pairs(strings.limit(0)).isEmpty()


def test_lcs_against_dynamic_programming():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(2))
        assert names.lcs(a, b) == slow(a, b)


# 4: formatting

KEYS = "key_id long, source string, title string, publisher string, version string, language string, qualifier string, disk_no long, disk_count long, record string"


def test_p4_copies(spark):
    rows = [
        (1, "w", "The  Game!", "Pub-Lisher", "v1.10", "de", None, 1, 2, None), (5, "w", "the game", "PUB LISHER", " V 1,10", "DE", "-", 1, 2, None), (3, "export", None, None, None, None, None, None, None, "VERSION=v.1.10 | DISK_NO=1|title='The Game';language=de;disk_count=2|publisher=pub​lisher|qualifier="),
        (4, "w", "the game", "publisher", "v11.0", "de", None, 1, 2, None), (6, "w", "the game", "publisher", "v110", "de", None, 1, 2, None), (7, "w", None, None, None, None, None, None, None, None), (9, "w", "???", "", None, None, None, None, None, None), (8, "export", None, None, None, None, None, None, None, ""),
        (10, "w", "publisher", "the game", "v1.10", "de", None, 1, 2, None), (11, "w", "é" * 30_000, None, None, None, None, None, None, None), (12, "w", "É" * 30_000, None, None, None, None, None, None, None), (None, "w", "The Game", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows + rows[:2], KEYS).withColumns({"n": F.lit(1), "raw": F.lit("x"), "tuple": F.lit("t"), "k": F.lit(0)})
    expected = {(1, 3), (1, 5), (7, 8), (7, 9), (11, 12)}
    assert {(r.first_id, r.key_id) for r in formatting.repeats(df).collect()} == expected
    assert {(r.first_id, r.key_id) for r in formatting.repeats(df, hot_rows=1).collect()} == expected  # every key hot
    assert {r.key_id: r.copies for r in formatting.copies(df).collect()} == {1: 3, 3: 3, 5: 3, 4: 1, 6: 1, 7: 3, 8: 3, 9: 3, 10: 1, 11: 2, 12: 2}
    assert formatting.repeats(df.limit(0)).isEmpty()


# 5: survivors

RECORDS = "record_id long, uid string, edition_id long, verified_good boolean, modifications long, alt_index long, trainer string, bad boolean, virus boolean, over boolean, under boolean, recorded_at timestamp_ntz"


def test_p5_latest_and_primary(spark):
    from datetime import datetime

    t1, t2 = datetime(2020, 1, 1), datetime(2021, 1, 1)
    rows = [
        (1, "a", 1, None, 1, None, None, True, None, None, None, t1), (2, "a", 1, None, None, 2, "", False, None, None, None, t2), (3, "a", 1, None, 5, None, None, True, None, None, None, None), (4, "b", 1, None, 1, 0, None, None, None, None, None, t1),
        (5, "c", 2, None, None, None, None, None, True, None, None, t1), (6, "d", 3, True, 9, 1, None, None, None, None, None, t1), (7, "e", 3, None, 0, 1, None, None, None, None, None, t1), (8, "f", 3, None, 0, 1, None, None, None, None, None, t1), (9, "g", None, None, 0, 0, None, None, None, None, None, t1),
        (11, "h", 4, None, None, None, None, True, None, None, None, t1), (10, "h", 4, None, None, None, None, False, None, None, None, t1), (12, None, 5, None, None, None, None, None, None, None, None, t1),
    ]
    df = spark.createDataFrame(rows + rows[:4], RECORDS).withColumns({"_key": F.lit("clash"), "_trained": F.lit(1), "primary_uid": F.lit("z")})
    found = {r.edition_id: r.primary_uid for r in survivor.edition_primaries(df).collect()}
    assert found == {1: "b", 3: "e"}
    record = {r.uid: r for r in survivor.consolidated(df).collect()}["a"]
    assert (record.modifications, record.alt_index, record.trainer, record.bad, record.virus) == (1, 2, "", False, False)
    assert survivor.edition_primaries(df.limit(0)).isEmpty()


def test_p5_consensus_votes_by_token(spark):
    from diskloom.llm import consensus

    rows = [("a", "Neon Arena of Taz", 1), ("a", "Neon Arnea of Taz v1", 1), ("a", "Neon Arena of Tza", 1), ("a", "The Neon Arena of Taz", 1), ("b", "alone", 1), ("c", None, 1), (None, "x", 1), ("d", "", 1), ("d", "", 1), ("d", "z", 1), ("e", "old old", 1), ("e", "new", 3)]
    df = spark.createDataFrame(rows, "g string, v string, n int").withColumns({"field": F.lit("clash"), "value": F.lit(0), "w": F.lit(1)})
    assert {r.g: r.value for r in consensus.consensus(df, "g", ("v",), F.col("n")).collect()} == {"a": "Neon Arena of Taz", "b": "alone", "d": "", "e": "new"}
    assert consensus.consensus(df.limit(0), "g", ("v",), F.col("n")).isEmpty()


def test_p5_consensus_by_arrival_is_the_latest_value(spark):
    from diskloom.llm import consensus

    rng = random.Random(1)
    rows = sorted((g, k, " ".join(rng.choice(["Foo", "Foe", "Bar", "+3", "DC"]) for _ in range(rng.randint(0, 4)))) for g in range(30) for k in range(rng.randint(1, 20)))
    df, late = spark.createDataFrame(rows, "g long, k long, v string"), {g: v for g, _, v in rows}
    for piece in (500, 3):
        assert {r.g: r.value for r in consensus.consensus(df, "g", ("v",), F.col("k") + 1, latest=True, piece=piece).collect()} == late
    assert len(late) == consensus.consensus(df, "g", ("v",), F.lit(1), piece=2).count()


# 6: tokens


@pytest.fixture(scope="module")
def reference():
    public, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_p6_exact_merges_and_round_trip(reference):
    own = tokens.bpe(tokens.default_vocabulary(), tokens.default_pattern())
    rng = random.Random(3)
    for _ in range(1500):
        s = "".join(rng.choice("aabbehtinr tsE1234é日 \n😀​'") for _ in range(rng.randrange(80)))
        assert own.encode(s) == reference.encode_ordinary(s) and own.decode(own.encode(s)).decode() == s
    for s in ("a" * 50_000, "<|endoftext|>", " \t\n ", "zq" * 10_000):
        assert own.encode(s) == reference.encode_ordinary(s)


def test_p6_table(spark, reference):
    texts = [(1, "It's a test"), (2, ""), (3, None), (4, "ünï " * 10_000), (1, "It's a test"), (None, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"k": F.lit("x"), "ids": F.lit(0), "t": F.lit(1)})
    found = {r.doc_id: r.ids for r in tokens.encode_texts(df).collect()}
    assert found == {1: reference.encode_ordinary("It's a test"), 2: [], 3: [], 4: reference.encode_ordinary("ünï " * 10_000), None: reference.encode_ordinary("x")}
    assert tokens.encode_texts(df.limit(0)).isEmpty()


# 7: leakage


def brute(item, doc):
    """Smallest word edits of any span of at least twelve item words against any part of a text, by dynamic programming."""
    a, b = leakage.words(item), leakage.words(doc)
    for start in range(len(a) - leakage.PASSAGE + 1):
        row = [0] * (len(b) + 1)
        for n, w in enumerate(a[start:], 1):
            new = [n]
            for k, v in enumerate(b):
                new.append(min(row[k] + (w != v), row[k + 1] + 1, new[k] + 1))
            row = new
            if n >= leakage.PASSAGE and min(row) * leakage.EDIT_EVERY <= n:
                return True
    return False


def test_p7_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12, 50)))) for k in range(12)]
    docs = []
    for k in range(160):
        words = items[rng.randrange(12)][1].split()
        at = rng.randrange(max(1, len(words) - 11))
        part = words[at:at + rng.randrange(9, 26)]
        for _ in range(rng.randrange(0, 5)):
            p = rng.randrange(len(part))
            part[p:p + 1] = rng.choice([[], ["new"], [part[p], "more"]])
        docs.append((k, "noise words here " + rng.choice([" ", "\n> ", "-- ", "</p><p>"]).join(part).upper() + " and after"))
    found = {(r.item_id, r.doc_id) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(i, d) for i, x in items for d, t in docs if brute(x, t)} and 20 < len(found) < 160


def test_p7_edges(spark, monkeypatch):
    passage = " ".join(f"word{k}" for k in range(20))
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "short one"), (None, passage), (5, passage), (1, passage)], "item_id long, text string").withColumn("t", F.lit(0))
    docs = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "x " * 30_000 + passage.replace("word3", "w​ord3").replace(" ", "<b> ")), (None, passage), (1, passage)], "doc_id long, text string").withColumn("k", F.lit("c"))
    expected = {(1, 1), (1, 4), (5, 1), (5, 4)}
    assert {tuple(r) for r in leakage.leaks(docs, items).collect()} == expected
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 10)
    assert {tuple(r) for r in leakage.leaks(docs, items).collect()} == expected
    assert leakage.leaks(docs, items.limit(0)).isEmpty() and leakage.leaks(docs.limit(0), items).isEmpty()


# 8: abuse


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["The disk has {} tracks.", "Press fire at level {}.", "A dumb terminal shows line {}.", "Kill the guard on floor {}.", "Version {} fixes the crash."]
    bad = ["You are a complete {} and a fool.", "Nobody asked a {} like you.", "All of them are {} and should be thrown out."]
    slurs = ["wombat", "w0mbat", "w.o.m.b.a.t", "wommmbat", "wo​mbat", "w o m b a t"]
    rows = []
    for k in range(n):
        text = [rng.choice(plain).format(rng.randrange(99)) for _ in range(rng.randrange(2, 9))]
        label = rng.random() < 0.4
        if label:
            text.insert(rng.randrange(len(text)), rng.choice(bad).format(rng.choice(slurs)))
        rows.append((k, " ".join(text), int(label)))
    return rows


def test_p8_held_out_accuracy_and_location():
    train, test = corpus(400, 1), corpus(300, 2)
    model = abuse.fit([t for _, t, _ in train], [float(y if k % 40 else 1 - y) for k, _, y in train])  # a few wrong verdicts
    score, worst = abuse.judge(model, [t for _, t, _ in test], abuse.Words())
    assert sum((s >= 0.5) == bool(y) for s, (_, _, y) in zip(score, test, strict=True)) >= 0.97 * len(test)
    hit = [("wombat" in abuse.plain("".join(w.split()).replace(".", "").replace("0", "o")) or "mbat" in w) for w, (_, _, y) in zip(worst, test, strict=True) if y]
    assert sum(hit) >= 0.9 * len(hit)


def test_p8_tables(spark):
    rows = corpus(300, 3)
    docs = spark.createDataFrame([(k, t, "a" if k % 2 else None) for k, t, _ in rows] + [(1000, None, "b"), (1001, "", "b"), (1002, "fine " * 20_000, "b"), (0, rows[0][1], None)], "doc_id long, text string, source string").withColumns({"k": F.lit(1), "t": F.lit(2), "score": F.lit("x")})
    labels = spark.createDataFrame([(k, f"r{v}", y) for k, _, y in rows for v in (1, 2)] + [(None, "r", 1), (5, "r", None), (99_999, "r", 1)], "doc_id long, reviewer string, abusive int")
    found = {r.doc_id for r in abuse.cases(docs, labels).collect()}
    truth = {k for k, _, y in rows if y}
    assert len(found ^ truth) <= 6 and not {1000, 1001, 1002} & found
    rates = {r.source: r for r in abuse.source_rates(docs, labels).collect()}
    assert rates["b"].documents == 3 and rates["b"].abusive == 0 and sum(r.abusive for r in rates.values()) == len(found)
    assert {r.doc_id for r in abuse.scores(docs, abuse.train(docs, labels)).where("worst_sentence IS NULL").collect()} == {1000, 1001}
    assert abuse.cases(docs, labels.limit(0)).isEmpty() and abuse.cases(docs.limit(0), labels).isEmpty()


def test_p5_primaries_come_through_the_consensus(spark, monkeypatch):
    """All eight fields of the records behind the primaries are voted on, negative numbers and empty trainers too."""
    asked = []
    vote = survivor.consensus.consensus
    monkeypatch.setattr(survivor.consensus, "consensus", lambda rows, group, fields, *a, **k: asked.append(fields) or vote(rows, group, fields, *a, **k))
    kind = "record_id long, uid string, edition_id long, verified_good boolean, modifications long, alt_index long, trainer string, bad boolean, virus boolean, over boolean, under boolean, recorded_at timestamp"
    rows = spark.createDataFrame([(1, "a", 1, True, 3, 1, "DC", True, None, None, None, None), (2, "a", 1, None, -1, None, "", False, None, None, None, None), (3, "b", 1, False, 2, 0, None, None, None, None, None, None), (4, "c", 2, None, None, None, None, True, None, None, None, None)], kind)
    assert [tuple(r) for r in survivor.edition_primaries(rows).collect()] == [(1, "a")]
    assert [set(f) for f in asked] == [{*survivor.FLAGS, *survivor.COUNTS, "trainer"}]
    a = survivor.consolidated(rows).where("uid = 'a'").first()
    assert (a.verified_good, a.bad, a.modifications, a.alt_index, a.trainer) == (True, False, -1, 1, "")
