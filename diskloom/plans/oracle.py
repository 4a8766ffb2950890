"""The queries as SQL on the same tables, from the source columns rather than through the parser."""

from __future__ import annotations

from ..functions.naming import LETTERS
from ..sources.bridge import ALTERNATE, BAD, CONTENT, DISK, DUMP, LANGUAGE, LINEAGE, NAME, QUALIFIER, TRAINED, VERSION, YEAR

_SET = ("title", "category", "version", "language", "publisher", "qualifier", "disk_count")
_EDITION = (*_SET, "disk_no")
SET, EDITION = ", ".join(_SET), ", ".join(_EDITION)


def _same(a: str, b: str, keys: tuple[str, ...]) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


# One row per content, m; rank columns as one list.
M = f"""u AS (SELECT l_orderkey * 10 + l_linenumber AS ingest_seq, {NAME} AS filename, sha1({CONTENT}) AS sha1, strlen({CONTENT}) AS byte_len, p_name AS title, {VERSION} AS version, {LANGUAGE} AS language,
 p_brand AS publisher, {QUALIFIER} AS qualifier, CAST({DISK} AS BIGINT) AS disk_no, CAST(3 AS BIGINT) AS disk_count, CAST({YEAR} AS INTEGER) AS year, CASE WHEN l_partkey % 9 = 0 THEN 'demo' ELSE 'game' END AS category,
 {LINEAGE} AS lineage, CASE WHEN l_returnflag = 'A' THEN 'cracked' WHEN l_returnflag = 'R' THEN 'hacked' WHEN {TRAINED} THEN 'trainer' ELSE 'original' END AS dump_type,
 CASE WHEN l_returnflag = 'A' THEN 'CSL' END AS crack_group, CASE WHEN {TRAINED} THEN '+3 DC' END AS trainer, {BAD} AS bad, CASE WHEN {ALTERNATE} THEN 2 ELSE 0 END AS alt_index,
 CAST((l_returnflag IN ('A', 'R'))::INT + ({TRAINED})::INT AS BIGINT) AS modifications, l_partkey % 7 = 0 AS listed FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT substr(sha1, 1, 10) AS uid, sha1, bool_or(listed) AS verified, {", ".join(f"any_value({c}) AS {c}" for c in ("filename", "byte_len", *_EDITION, "year", "lineage", "dump_type", "crack_group", "trainer", "bad", "alt_index", "modifications"))},
 coalesce(any_value(lineage), '') AS tag FROM u GROUP BY sha1)"""
RANK = "CASE WHEN modifications = 0 THEN 0 ELSE 1 END, modifications, CASE WHEN trainer IS NULL THEN 0 ELSE 1 END, alt_index"
CLASS = "CASE dump_type WHEN 'cracked' THEN 'cracked' WHEN 'hacked' THEN 'hacked' WHEN 'modified' THEN 'hacked' WHEN 'trainer' THEN 'hacked' ELSE 'original' END"
BEST = f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {SET}, tag, disk_no ORDER BY {RANK}, uid) AS rn FROM m WHERE NOT bad) WHERE rn = 1)"
COVER = f"""kinds AS (SELECT {SET}, tag, {CLASS} AS kind FROM (SELECT *, row_number() OVER (PARTITION BY {SET}, tag ORDER BY {RANK}, disk_no NULLS FIRST, uid) AS rn FROM m WHERE NOT bad) WHERE rn = 1),
c0 AS (SELECT {SET}, tag, string_agg(DISTINCT CAST(disk_no AS VARCHAR), ',' ORDER BY CAST(disk_no AS VARCHAR)) AS covered, count(DISTINCT disk_no) AS n, CAST(sum(modifications) AS BIGINT) AS mods,
 count(DISTINCT disk_no) = 3 AS complete FROM m WHERE NOT bad GROUP BY {SET}, tag),
cov AS (SELECT c0.*, kind, row_number() OVER (PARTITION BY {", ".join("c0." + k for k in _SET)} ORDER BY CASE WHEN complete THEN 0 ELSE 1 END, n DESC, mods, c0.tag) AS place
 FROM c0 JOIN kinds ON {_same("c0", "kinds", (*_SET, "tag"))})"""


def _kebab(x: str) -> str:
    out = f"replace({x}, '&', '-and-')"
    for a, b in LETTERS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace(regexp_replace(regexp_replace(translate({out}, ' _', '--'), '[^A-Za-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


CANONICAL = "replace(title, ' ', '-') || coalesce('_' || version, '') || coalesce('_' || language, '') || '_d' || lpad(CAST(disk_no AS VARCHAR), 2, '0') || 'of' || lpad(CAST(disk_count AS VARCHAR), 2, '0') || '_' || uid || '.adf'"
PRIMARY = f"own AS (SELECT {EDITION}, arg_min(uid, rn) FILTER (WHERE NOT bad) AS primary_uid FROM (SELECT *, row_number() OVER (PARTITION BY {EDITION}, bad ORDER BY {RANK}, uid) AS rn FROM m) GROUP BY {EDITION})"
COHERENT = f"""{BEST}, {COVER}, {PRIMARY}, coherent AS (SELECT {", ".join("own." + k for k in _EDITION)}, coalesce(p.uid, own.primary_uid) AS primary_uid FROM own LEFT JOIN
 (SELECT best.* FROM best JOIN cov ON {_same("best", "cov", (*_SET, "tag"))} WHERE place = 1) p ON {_same("own", "p", _EDITION)})"""
VKEY = "CASE WHEN version IS NULL THEN NULL WHEN version = 'v1.0' THEN '000001' ELSE '000001.00000' || substr(version, 4) END"
SETS = f"""{COVER}, ed AS (SELECT {EDITION}, count(*) AS variants, min(year) AS year FROM m GROUP BY {EDITION}),
shape AS (SELECT {SET}, arg_min(year, disk_no) AS year, count(*) AS editions, string_agg(CAST(disk_no AS VARCHAR), ',' ORDER BY disk_no) AS disks_present, CAST(sum(variants) AS BIGINT) AS variant_count FROM ed GROUP BY {SET}),
lines AS (SELECT {SET}, count(*) FILTER (WHERE complete) AS complete_lineages, nullif(max(CASE WHEN place = 1 THEN tag END), '') AS primary_lineage, count(*) FILTER (WHERE kind = 'original') AS original_count,
 count(*) FILTER (WHERE kind = 'cracked') AS cracked_count, count(*) FILTER (WHERE kind = 'hacked') AS hacked_count FROM cov GROUP BY {SET}),
sets AS (SELECT {", ".join("s." + k for k in _SET)}, {VKEY.replace("version", "s.version")} AS version_key, s.year, TRUE AS multi, disks_present, variant_count, primary_lineage, coalesce(complete_lineages, 0) AS complete_lineages,
 coalesce(original_count, 0) AS original_count, coalesce(cracked_count, 0) AS cracked_count, coalesce(hacked_count, 0) AS hacked_count FROM shape s LEFT JOIN lines ON {_same("s", "lines", _SET)})"""
WORKS = "works AS (SELECT title AS name, count(*) AS release_count, count(*) FILTER (WHERE category = 'game') AS game_count, count(*) FILTER (WHERE category = 'demo') AS demo_count, count(*) FILTER (WHERE category = 'tool') AS tool_count, CAST(sum(original_count) AS BIGINT) AS original_count, CAST(sum(cracked_count) AS BIGINT) AS cracked_count, CAST(sum(hacked_count) AS BIGINT) AS hacked_count FROM sets GROUP BY title)"
FACETS = """facets AS (SELECT title AS name, min(year) AS year, bool_or(complete_lineages > 0) AS complete, CASE WHEN bool_or(category = 'game') THEN 'game' WHEN bool_or(category = 'demo') THEN 'demo' ELSE 'tool' END AS category,
 first(publisher ORDER BY CASE WHEN category = 'game' THEN 0 ELSE 1 END, category NULLS FIRST, qualifier NULLS FIRST, disk_count NULLS FIRST, version NULLS FIRST, language NULLS FIRST, publisher NULLS FIRST) AS publisher FROM sets GROUP BY title)"""
OPTIONS = f"""boot AS (SELECT best.*, first(uid) OVER (PARTITION BY {", ".join("best." + k for k in _SET)}, best.tag ORDER BY disk_no) AS default_uid, min(disk_no) OVER (PARTITION BY {", ".join("best." + k for k in _SET)}, best.tag) AS boot_disk FROM best),
b AS (SELECT DISTINCT {", ".join("boot." + k for k in _SET)}, boot.tag, boot_disk, default_uid FROM boot JOIN cov ON {_same("boot", "cov", (*_SET, "tag"))} WHERE cov.complete),
o0 AS (SELECT m.*, b.boot_disk, b.default_uid, row_number() OVER (PARTITION BY {", ".join("m." + k for k in _SET)}, m.tag, m.trainer ORDER BY {RANK}, uid) AS rn FROM m JOIN b ON {_same("m", "b", (*_SET, "tag"))} AND m.disk_no = b.boot_disk WHERE NOT bad),
opt AS (SELECT *, count(*) OVER (PARTITION BY {SET}, tag) AS k FROM o0 WHERE rn = 1)"""
BROWSE = """v AS (SELECT edition_id, count(DISTINCT uid) AS variant_count, min(year) AS year FROM artifact WHERE edition_id IS NOT NULL GROUP BY edition_id),
b AS (SELECT e.id, e.title_id, t.name AS title, t.category, e.version, e.language, e.publisher, e.qualifier, e.disk_no, e.disk_count, v.year, coalesce(v.variant_count, 0) AS variant_count, e.primary_artifact_uid
 FROM edition e JOIN title_query t ON e.title_id = t.title_id LEFT JOIN v ON v.edition_id = e.id)"""
_WORDS = "list_filter(string_split(lower({kebab}), '-'), lambda x: x <> '')"


def _words(x: str) -> str:
    w = _WORDS.format(kebab=_kebab(x))
    return f"CASE WHEN len({w}) > 1 AND {w}[1] = 'the' THEN {w}[2:] ELSE {w} END"


SIMILAR = """CASE WHEN ja = '' OR jb = '' THEN 0.0 WHEN ja = jb THEN 1.0 ELSE 0.5 * len(list_intersect(list_distinct(wa), list_distinct(wb))) / len(list_distinct(list_concat(wa, wb)))
 + 0.5 * greatest(1 - levenshtein(ja, jb) / greatest(length(ja), length(jb)), 0) END"""
RESULTS = f"""t AS (SELECT title_id, name, lower({_kebab("name")}) AS slug, {_words("name")} AS wa FROM title_query), p AS (SELECT DISTINCT *, lower({_kebab("page_title")}) AS slug FROM provider_results),
tl AS (SELECT *, array_to_string(wa, '') AS ja, coalesce(nullif(regexp_extract(array_to_string(wa, ' '), '[a-z]'), ''), '0') AS la FROM t),
pl0 AS (SELECT DISTINCT source, page_title, slug, {_words("page_title")} AS wb FROM p WHERE page_title IS NOT NULL),
pl AS (SELECT *, array_to_string(wb, '') AS jb, coalesce(nullif(regexp_extract(array_to_string(wb, ' '), '[a-z]'), ''), '0') AS lb FROM pl0),
hx AS (SELECT DISTINCT title_id, source, pl.slug FROM tl JOIN pl ON tl.slug = pl.slug),
hs AS (SELECT title_id, source, pl.slug AS slug, CAST({SIMILAR} AS FLOAT) AS sim FROM tl JOIN pl ON la = lb),
hf AS (SELECT title_id, source, slug FROM (SELECT *, row_number() OVER (PARTITION BY title_id, source ORDER BY sim DESC, slug) AS n FROM hs WHERE sim >= CAST(0.55 AS FLOAT)) WHERE n = 1),
hit AS (SELECT * FROM hx UNION ALL SELECT * FROM hf WHERE (title_id, source) NOT IN (SELECT (title_id, source) FROM hx)),
r AS (SELECT hit.title_id, p.* EXCLUDE (slug) FROM hit JOIN p ON hit.source = p.source AND hit.slug = p.slug), k AS (SELECT * FROM r WHERE score >= CAST(0.55 AS FLOAT))"""
MERGED = f"""{RESULTS}, src AS (SELECT title_id, string_agg(source, ',' ORDER BY a, b) AS sources FROM (SELECT title_id, source, min(priority) AS a, arg_min(result_id, CAST(priority AS BIGINT) * 1000000000 + result_id) AS b FROM k GROUP BY title_id, source) GROUP BY title_id),
sh0 AS (SELECT title_id, priority, result_id, unnest(shots) AS s, generate_subscripts(shots, 1) AS pos FROM k),
sh AS (SELECT title_id, s.url AS url, min(CAST(priority AS BIGINT) * 1000000000000 + result_id * 1000 + pos) AS o FROM sh0 GROUP BY title_id, s.url),
sho AS (SELECT title_id, string_agg(url, ' ' ORDER BY o) AS shots FROM sh GROUP BY title_id),
mg AS (SELECT k.title_id, {", ".join(f"first({c} ORDER BY priority, result_id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("genre", "description", "year", "external_url", "cover"))}, max(score) AS score FROM k GROUP BY k.title_id)"""


# The stored catalog: the last record of each uid under its edition, general in disks, counts, flags and trainers.
G = f"""g0 AS (SELECT * FROM (SELECT DISTINCT * FROM artifact) QUALIFY row_number() OVER (PARTITION BY uid ORDER BY record_id DESC) = 1),
g AS (SELECT a.uid, a.year, a.dump_type, a.trainer, a.lineage, {", ".join(f'coalesce(a."{c}", FALSE) AS "{c}"' for c in ("bad", "virus", "over", "under", "verified_good"))}, coalesce(a.modifications, 0) AS modifications, coalesce(a.alt_index, 0) AS alt_index,
 t.name AS title, t.category, e.version, e.language, e.publisher, e.qualifier, e.disk_no, e.disk_count FROM g0 a JOIN edition e ON a.edition_id = e.id JOIN title_query t ON e.title_id = t.title_id),
size AS (SELECT {SET}, greatest(coalesce(disk_count, max(disk_no), 1), 1) AS needed FROM g GROUP BY {SET}),
gs AS (SELECT *, coalesce(lineage, '') AS tag, coalesce(disk_no, 1) AS disk, coalesce(disk_no, 0) AS disk0, CASE WHEN verified_good OR modifications = 0 THEN 0 ELSE 1 END AS unclean, CASE WHEN trainer IS NULL THEN 0 ELSE 1 END AS trained,
 CASE WHEN dump_type = 'cracked' THEN 'cracked' WHEN dump_type IN ('hacked', 'modified', 'trainer') THEN 'hacked' ELSE 'original' END AS class FROM g WHERE NOT (bad OR virus OR "over" OR "under")),
gr AS (SELECT *, row_number() OVER (PARTITION BY {SET}, tag ORDER BY unclean, modifications, trained, alt_index, disk_no NULLS FIRST, uid) AS rk, row_number() OVER (PARTITION BY {SET}, tag, disk ORDER BY unclean, modifications, trained, alt_index, uid) AS best,
 row_number() OVER (PARTITION BY {SET}, tag, disk0 ORDER BY unclean, modifications, trained, alt_index, uid) AS best0, row_number() OVER (PARTITION BY {EDITION} ORDER BY unclean, modifications, trained, alt_index, uid) AS own,
 row_number() OVER (PARTITION BY {SET}, tag, trainer ORDER BY disk_no NULLS FIRST, uid) AS first_of_trainer FROM gs),
gc0 AS (SELECT {", ".join("gr." + k for k in _SET)}, tag, needed, string_agg(DISTINCT disk, ',' ORDER BY disk) AS covered, count(DISTINCT disk) AS n, count(DISTINCT CASE WHEN disk BETWEEN 1 AND needed THEN disk END) AS inside, CAST(sum(modifications) AS BIGINT) AS mods, arg_min(class, rk) AS kind,
 first(trainer ORDER BY disk_no NULLS FIRST, uid) FILTER (WHERE trainer IS NOT NULL) AS trainer FROM gr JOIN size ON {_same("gr", "size", _SET)} GROUP BY ALL),
gcov AS (SELECT *, inside = needed AS complete, needed - inside AS missing_count, CAST(row_number() OVER (PARTITION BY {SET} ORDER BY CASE WHEN inside = needed THEN 0 ELSE 1 END, n DESC, mods, tag) AS INTEGER) AS place FROM gc0),
gd0 AS (SELECT {SET}, tag, count(DISTINCT disk0) AS n, count(DISTINCT CASE WHEN disk0 BETWEEN 1 AND disk_count THEN disk0 END) = max(disk_count) AS complete, sum(modifications) AS mods FROM gr WHERE disk_count > 1 GROUP BY {SET}, tag),
gd AS (SELECT * FROM gd0 QUALIFY row_number() OVER (PARTITION BY {SET} ORDER BY CASE WHEN complete THEN 0 ELSE 1 END, n DESC, mods, tag) = 1),
gown AS (SELECT {EDITION} FROM g GROUP BY {EDITION}),
gprim AS (SELECT {", ".join("gown." + k for k in _EDITION)}, coalesce(p.uid, o.uid) AS primary_uid FROM gown LEFT JOIN (SELECT * FROM gr WHERE own = 1) o ON {_same("gown", "o", _EDITION)}
 LEFT JOIN (SELECT gr.* FROM gr JOIN gd ON {_same("gr", "gd", (*_SET, "tag"))} WHERE best0 = 1) p ON {_same("gown", "p", _EDITION)})"""
GSETS = f"""ged AS (SELECT {EDITION}, count(*) AS variants, min(year) AS year FROM g GROUP BY {EDITION}),
gshape AS (SELECT {SET}, first(year ORDER BY coalesce(disk_no, 0)) AS year, count(*) AS editions, coalesce(string_agg(disk_no, ',' ORDER BY disk_no), '') AS disks_present, CAST(sum(variants) AS BIGINT) AS variant_count FROM ged GROUP BY {SET}),
glines AS (SELECT {SET}, count(*) FILTER (WHERE complete) AS complete_lineages, nullif(max(CASE WHEN place = 1 THEN tag END), '') AS primary_lineage, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}_count" for k in ("original", "cracked", "hacked"))} FROM gcov GROUP BY {SET}),
gsets AS (SELECT {", ".join("s." + k for k in _SET)}, s.year, coalesce(s.disk_count > 1, FALSE) OR s.editions > 1 AS multi, disks_present, variant_count, primary_lineage, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("complete_lineages", "original_count", "cracked_count", "hacked_count"))}
 FROM gshape s LEFT JOIN glines ON {_same("s", "glines", _SET)})"""
GOPTIONS = f"""gboot AS (SELECT {", ".join("gr." + k for k in _SET)}, gr.tag, min(disk) AS boot_disk, arg_min(uid, disk) AS default_uid FROM gr JOIN gcov ON {_same("gr", "gcov", (*_SET, "tag"))} WHERE best = 1 AND complete GROUP BY ALL),
gopt AS (SELECT {", ".join("gr." + k for k in _SET)}, gr.tag, gr.trainer, gr.uid, default_uid, row_number() OVER (PARTITION BY {", ".join("gr." + k for k in _SET)}, gr.tag, gr.trainer ORDER BY unclean, modifications, trained, alt_index, uid) AS rn
 FROM gr JOIN gboot ON {_same("gr", "gboot", (*_SET, "tag"))} AND disk = boot_disk),
gtext AS (SELECT {SET}, tag, string_agg(coalesce(trainer, '-') || '=' || uid || CASE WHEN uid = default_uid THEN '*' ELSE '' END, ',' ORDER BY trainer NULLS FIRST) AS options FROM gopt WHERE rn = 1 GROUP BY {SET}, tag HAVING count(*) >= 2)"""
GFACETS = f"""genres AS (SELECT name AS title, category, max(genre) AS genre FROM mg JOIN title_query USING (title_id) GROUP BY ALL), gw AS (SELECT gsets.*, genre FROM gsets LEFT JOIN genres USING (title, category)),
works AS (SELECT trim(title) AS name, min(year) AS year, coalesce(first(publisher ORDER BY o), '') AS publisher, coalesce(trim(string_split(first(genre ORDER BY o), ',')[1]), '') AS genre, bool_or(complete_lineages > 0) AS complete,
 CASE WHEN bool_or(category = 'game') THEN 'game' WHEN bool_or(category = 'demo') THEN 'demo' ELSE 'tool' END AS category FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN category = 'game' AND genre IS NOT NULL THEN 0 WHEN category = 'game' THEN 1 WHEN genre IS NOT NULL THEN 2 ELSE 3 END,
 title, category NULLS FIRST, qualifier NULLS FIRST, disk_count NULLS FIRST, version NULLS FIRST, language NULLS FIRST, publisher NULLS FIRST) AS o FROM gw) GROUP BY 1)"""
# Two batches: which contents are known when, and which are identified by name or by the list of the second.
TWO = M.replace("l_partkey % 7 = 0 AS listed FROM", f"l_partkey % 7 = 0 AS listed, l_orderkey % 2 = 1 AS late, l_orderkey % 10 = 0 AS again, {NAME} LIKE '%(1990)%' AS nameless FROM").replace(
    "m AS (SELECT substr", "ma AS (SELECT substr").replace("bool_or(listed) AS verified,", "bool_or(listed) AND bool_and(late) AS verified, bool_and(late) AS late, bool_and(nameless) AND NOT (bool_or(listed) AND bool_and(late)) AS held, min(ingest_seq) AS ingest_seq, count(*) AS copies,",
) + ", m AS (SELECT *, CASE WHEN late THEN 10000000000000 ELSE 0 END + ingest_seq AS o FROM ma WHERE NOT held)"


ORACLE: dict[str, str] = {
    "parse_names": f"""SELECT DISTINCT filename, title, version, language, publisher, year, disk_no, disk_count, qualifier, array_to_string(list_filter([{", ".join((
        "CASE WHEN f1 <> '' THEN f1 END", "CASE WHEN t THEN 't +3 DC' END", "CASE WHEN b THEN 'b corrupt' END", "CASE WHEN a THEN 'a2' END"))}], lambda x: x IS NOT NULL), '|') AS flags
        FROM (SELECT {NAME} AS filename, p_name AS title, {VERSION} AS version, {LANGUAGE} AS language, p_brand AS publisher, CAST({YEAR} AS INTEGER) AS year, CAST({DISK} AS BIGINT) AS disk_no, CAST(3 AS BIGINT) AS disk_count,
        {QUALIFIER} AS qualifier, replace(replace({DUMP}, '[', ''), ']', '') AS f1, {TRAINED} AS t, {BAD} AS b, {ALTERNATE} AS a FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "parse_listed_names": """SELECT dat_id, coalesce(title, trim(regexp_replace(regexp_extract(name, '^[^(\\[]*'), ' [vV][0-9][^ ]* *$', ''))) AS title, coalesce(version, nullif(regexp_extract(regexp_extract(name, '^[^(\\[]*'), ' ([vV][0-9][^ ]*) *$', 1), '')) AS version,
        coalesce(language, nullif(lower(regexp_extract(name, '(?i)\\((en|de|fr|es|it)\\)', 1)), '')) AS language, coalesce(publisher, list_filter(regexp_extract_all(name, '\\(([^()]*)\\)', 1), lambda g: NOT regexp_full_match(g, '(?i)[0-9]{4}|disk [0-9]+ of [0-9]+|en|de|fr|es|it|demo|demo-playable'))[1]) AS publisher,
        coalesce(year, CAST(nullif(regexp_extract(name, '\\(([0-9]{4})\\)', 1), '') AS INTEGER)) AS year, coalesce(disk_no, CAST(nullif(regexp_extract(name, '(?i)\\(disk ([0-9]+) of ([0-9]+)\\)', 1), '') AS BIGINT)) AS disk_no,
        coalesce(disk_count, CAST(nullif(regexp_extract(name, '(?i)\\(disk ([0-9]+) of ([0-9]+)\\)', 2), '') AS BIGINT)) AS disk_count FROM dat_entry""",
    "parse_flags": f"WITH {M} SELECT uid, dump_type, crack_group, trainer, bad, FALSE AS virus, FALSE AS \"over\", FALSE AS \"under\", CAST(alt_index AS BIGINT) AS alt_index, modifications, FALSE AS verified_good, lineage FROM m",
    "listed_dump_types": """SELECT dat_id, CASE WHEN regexp_matches(name, '\\[cr[ \\]]') THEN 'cracked' WHEN regexp_matches(name, '\\[h[ \\]]') THEN 'hacked' WHEN regexp_matches(name, '\\[[fm][ \\]]') THEN 'modified' WHEN regexp_matches(name, '\\[t[ \\]]') THEN 'trainer' ELSE 'original' END AS dump_type,
        nullif(regexp_extract(name, '\\[cr ([^\\]]*)\\]', 1), '') AS crack_group FROM dat_entry""",
    "category_inference": """SELECT source, qualifier, CASE WHEN qualifier LIKE '%demo%' OR qualifier = 'preview' OR lower(source) LIKE '%demo%' THEN 'demo' WHEN lower(source) LIKE '%application%' OR lower(source) LIKE '%tool%' OR lower(source) LIKE '%util%'
        THEN 'tool' ELSE 'game' END AS category, count(*) AS entries FROM (SELECT source, nullif(lower(regexp_extract(name, '\\((demo|demo-playable|demo-rolling|demo-slideshow|demo-kus|playable demo|rolling demo|preview|prerelease|proto|prototype)\\)', 1, 'i')), '') AS qualifier
        FROM dat_entry) GROUP BY ALL""",
    "dump_class": f"WITH {M} SELECT dump_type, {CLASS} AS class, count(*) AS artifacts FROM m GROUP BY ALL",
    "alternate_badges": "SELECT CASE WHEN alt_index = 0 THEN 'base' WHEN alt_index = 1 THEN '[a]' ELSE '[a' || alt_index || ']' END AS badge, count(*) AS records FROM artifact WHERE alt_index IS NOT NULL GROUP BY 1",
    "sanitize_titles": f"SELECT DISTINCT name, {_kebab('name')} AS kebab FROM (SELECT name FROM title_query UNION ALL SELECT page_title FROM provider_results) WHERE name IS NOT NULL",
    "version_keys": """SELECT DISTINCT version, regexp_replace(array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(trim(version, chr(9) || chr(10) || ' ' || chr(160) || chr(8195)), '^[vV]', ''), '[^A-Za-z0-9]+'), lambda p: p <> ''),
        lambda p: CASE WHEN p SIMILAR TO '[0-9].*' THEN lpad(CAST(CAST(regexp_extract(p, '^[0-9]+') AS HUGEINT) AS VARCHAR), 6, '0') || lower(regexp_replace(p, '^[0-9]*', '')) ELSE lower(p) END), '.'), '(\\.0+)+$', '') AS version_key
        FROM (SELECT version FROM edition_key UNION ALL SELECT version FROM edition) WHERE version IS NOT NULL""",
    "canonical_names": f"WITH {M} SELECT uid, {CANONICAL} AS canonical FROM m",
    "canonical_roundtrip": f"WITH {M} SELECT replace(title, ' ', '-') AS title, version, language, disk_no, disk_count, uid FROM m",
    "safe_names": "SELECT DISTINCT tag, CASE WHEN tag = '' THEN 'original' ELSE regexp_replace(tag, '[^A-Za-z0-9]', '_', 'g') END AS safe FROM (SELECT coalesce(lineage, '') AS tag FROM artifact)",
    "name_hues": "SELECT name, CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, c: (h * 31 + c) % 4294967296) % 360 AS INTEGER) AS hue FROM (SELECT DISTINCT p_name AS name FROM part)",
    "content_hashes": f"SELECT DISTINCT l_orderkey * 10 + l_linenumber AS ingest_seq, sha1({CONTENT}) AS sha1, md5({CONTENT}) AS md5 FROM lineitem JOIN part ON l_partkey = p_partkey",
    "uid_assign": f"WITH {M} SELECT sha1, uid FROM m",
    "exact_dedup": """SELECT sha1(text) AS sha1, min(doc_id) AS first_id, arg_min(coalesce(title, ''), doc_id) AS filename, first(source ORDER BY doc_id) AS source FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "container_detect": "SELECT DISTINCT record_id, CASE WHEN e IN ('adf', 'adz', 'dms', 'zip') THEN e WHEN record_id % 4 = 0 THEN 'zip' WHEN record_id % 4 = 1 THEN 'dms' END AS container FROM (SELECT record_id, lower(regexp_extract(orig_filename, '\\.([^.]*)$', 1)) AS e FROM artifact WHERE orig_filename IS NOT NULL)",
    "decode_zip": f"""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 'disks/' || {NAME} AS name, {CONTENT} AS content, (l_orderkey * 10 + l_linenumber) % 7 = 0 AS cut FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT seq AS ingest_seq, name, 'zip' AS container, sha1(content) AS sha1, FALSE AS failed FROM x WHERE NOT cut UNION ALL SELECT seq, left(name, length(name) - 4) || '.adz', 'zip', sha1(content || '+'), FALSE FROM x WHERE NOT cut
        UNION ALL SELECT seq, name || '.zip', 'zip', NULL, TRUE FROM x WHERE cut""",
    "list_parse": "SELECT source, name, lower(sha1) AS sha1, lower(crc32) AS crc32, lower(md5) AS md5, try_cast(nullif(regexp_extract(name, '(?i)\\(disk ([0-9]+) of ([0-9]+)\\)', 1), '') AS BIGINT) AS disk_no, try_cast(nullif(regexp_extract(name, '(?i)\\(disk ([0-9]+) of ([0-9]+)\\)', 2), '') AS BIGINT) AS disk_count FROM dat_entry",
    "hash_match_priority": f"""WITH i AS (SELECT DISTINCT substr(sha1({CONTENT}), 1, 10) AS uid, sha1({CONTENT}) AS sha1, md5({CONTENT}) AS md5 FROM lineitem JOIN part ON l_partkey = p_partkey),
        d AS (SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 268435456 + CAST('0x' || substr(md5({CONTENT}), 1, 7) AS BIGINT) AS dat_id, CASE WHEN l_linenumber % 3 > 0 THEN sha1({CONTENT}) END AS sha1, md5({CONTENT}) AS md5 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 7 = 0),
        h AS (SELECT i.uid, d.dat_id, row_number() OVER (PARTITION BY i.uid ORDER BY (d.sha1 = i.sha1) DESC NULLS LAST, (d.md5 = i.md5) DESC NULLS LAST, d.dat_id) AS n FROM i JOIN d ON d.md5 = i.md5) SELECT uid, dat_id FROM h WHERE n = 1""",
    "hash_match_strict": f"""WITH i AS (SELECT DISTINCT substr(sha1({CONTENT}), 1, 10) AS uid, sha1({CONTENT}) AS sha1, md5({CONTENT}) AS md5 FROM lineitem JOIN part ON l_partkey = p_partkey),
        d AS (SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 268435456 + CAST('0x' || substr(md5({CONTENT}), 1, 7) AS BIGINT) AS dat_id, CASE WHEN l_linenumber % 3 > 0 THEN sha1({CONTENT}) END AS sha1, md5({CONTENT}) AS md5 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 7 = 0),
        h AS (SELECT i.uid, d.dat_id, row_number() OVER (PARTITION BY i.uid ORDER BY CASE WHEN d.sha1 = i.sha1 THEN 0 ELSE 1 END, d.dat_id) AS n FROM i JOIN d ON d.md5 = i.md5) SELECT uid, dat_id FROM h WHERE n = 1""",
    "hash_match_null_order": """WITH e AS (SELECT dat_id, CASE WHEN dat_id % 2 = 0 THEN sha1 END AS sha1, crc32, md5 FROM dat_entry UNION ALL SELECT dat_id + 100000, sha1(CAST(dat_id AS VARCHAR)), crc32, NULL FROM dat_entry),
        i AS (SELECT DISTINCT name AS uid, CASE WHEN dat_id % 3 = 0 THEN sha1(name) ELSE sha1 END AS sha1, crc32, md5 FROM dat_entry),
        h AS (SELECT i.uid, d.dat_id, row_number() OVER (PARTITION BY i.uid ORDER BY (d.sha1 = i.sha1) DESC NULLS LAST, (d.md5 = i.md5) DESC NULLS LAST, d.dat_id) AS n
        FROM i JOIN e d ON d.sha1 = i.sha1 OR d.md5 = i.md5 OR d.crc32 = i.crc32) SELECT uid, dat_id FROM h WHERE n = 1""",
    "identify_uploads": f"WITH {M} SELECT uid, {EDITION}, year, verified FROM m",
    "edition_groups": f"WITH {M} SELECT {EDITION}, count(*) AS variants, min(year) AS year FROM m GROUP BY {EDITION}",
    "edition_primary": f"WITH {M}, {PRIMARY} SELECT {EDITION}, primary_uid, CASE WHEN primary_uid IS NOT NULL THEN {CANONICAL.replace('uid', 'primary_uid')} END AS canonical FROM own",
    "set_primary_lineage": f"WITH {M}, {COVER} SELECT {SET}, tag, complete, covered FROM cov WHERE place = 1",
    "coherent_primaries": f"WITH {M}, {COHERENT} SELECT * FROM coherent",
    "lineage_coverage": f"WITH {M}, {COVER} SELECT {SET}, tag, covered, complete, mods, kind, CAST(place AS INTEGER) AS place FROM cov",
    "set_division": f"WITH {M}, {COVER} SELECT {SET}, tag FROM cov WHERE complete",
    "missing_disks": f"WITH {M}, {COVER} SELECT {SET}, tag, array_to_string(list_filter(['1', '2', '3'], lambda d: NOT list_contains(string_split(covered, ','), d)), ',') AS missing, 3 - n AS missing_count FROM cov",
    "set_disks": f"WITH {M} SELECT {SET}, string_agg(DISTINCT CAST(disk_no AS VARCHAR), ',' ORDER BY CAST(disk_no AS VARCHAR)) AS disks FROM m GROUP BY {SET}",
    "resolve_set": f"WITH {M}, {BEST} SELECT {SET}, tag, string_agg(disk_no || ':' || uid, ',' ORDER BY disk_no) AS files FROM best GROUP BY {SET}, tag",
    "trainer_options": f"WITH {M}, {BEST}, {COVER}, {OPTIONS} SELECT {SET}, tag, boot_disk, trainer, uid, uid = default_uid AS is_default FROM opt WHERE k >= 2",
    "playable_sets": f"""WITH {M}, {BEST}, {COVER}, {OPTIONS}, f AS (SELECT {SET}, tag, string_agg(disk_no || ':' || uid, ',' ORDER BY disk_no) AS files FROM best GROUP BY {SET}, tag),
        tr AS (SELECT {SET}, tag, max(trainer) AS trainer FROM m WHERE NOT bad GROUP BY {SET}, tag),
        oo AS (SELECT {SET}, tag, string_agg(coalesce(trainer, '-') || '=' || uid || CASE WHEN uid = default_uid THEN '*' ELSE '' END, ',' ORDER BY trainer NULLS FIRST) AS options FROM opt WHERE k >= 2 GROUP BY {SET}, tag)
        SELECT {", ".join("cov." + k for k in _SET)}, cov.tag, kind, tr.trainer, complete, array_to_string(list_filter(['1', '2', '3'], lambda d: NOT list_contains(string_split(covered, ','), d)), ',') AS missing, place = 1 AS recommended,
        CASE WHEN complete THEN files ELSE '' END AS files, coalesce(options, '') AS options FROM cov JOIN f ON {_same("cov", "f", (*_SET, "tag"))} JOIN tr ON {_same("cov", "tr", (*_SET, "tag"))} LEFT JOIN oo ON {_same("cov", "oo", (*_SET, "tag"))}""",
    "export_set_manifest": f"WITH {M}, {BEST}, {COVER} SELECT {', '.join('best.' + k for k in _SET)}, best.tag, disk_no AS disk, uid, {CANONICAL.replace('title', 'best.title').replace('version', 'best.version').replace('language', 'best.language').replace('disk_count', 'best.disk_count')} AS canonical, sha1 FROM best JOIN cov ON {_same('best', 'cov', (*_SET, 'tag'))} WHERE cov.complete",
    "export_set_boot_override": f"""WITH {M}, {BEST}, {COVER}, {OPTIONS}, w AS (SELECT {SET}, tag, boot_disk, uid, sha1 FROM opt WHERE k >= 2 AND trainer IS NOT NULL)
        SELECT {", ".join("best." + k for k in _SET)}, best.tag, disk_no AS disk, coalesce(w.uid, best.uid) AS uid, coalesce(w.sha1, best.sha1) AS sha1 FROM best JOIN cov ON {_same("best", "cov", (*_SET, "tag"))}
        LEFT JOIN w ON {_same("best", "w", (*_SET, "tag"))} AND w.boot_disk = best.disk_no WHERE cov.complete""",
    "export_edition_manifest": f"WITH {M} SELECT {EDITION}, {CANONICAL} AS canonical, sha1, byte_len FROM m",
    "browse_all": f"WITH {BROWSE} SELECT * FROM b",
    "browse_search": f"WITH {BROWSE} SELECT * FROM b WHERE title ILIKE '%gard_n%'",
    "browse_language": f"WITH {BROWSE} SELECT * FROM b WHERE category = 'game' AND language = 'de'",
    "browse_verified": f"WITH {BROWSE} SELECT * FROM b WHERE EXISTS (SELECT 1 FROM artifact a WHERE a.edition_id = b.id AND a.verified)",
    "browse_unverified": f"WITH {BROWSE} SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM artifact a WHERE a.edition_id = b.id AND a.verified)",
    "browse_quarantined_status": f"WITH {BROWSE} SELECT category, count(*) AS editions FROM b GROUP BY category",
    "list_sets": f"WITH {M}, {SETS} SELECT * FROM sets",
    "sets_incomplete": f"WITH {M}, {SETS} SELECT {SET}, disks_present, variant_count FROM sets WHERE complete_lineages = 0",
    "list_works": f"WITH {M}, {SETS}, {WORKS} SELECT * FROM works",
    "works_nested": f"""WITH {M}, {SETS} SELECT title AS name, string_agg(category || ':' || coalesce(version, '-') || ':' || coalesce(language, '-') || ':' || publisher || ':' || complete_lineages, ' '
        ORDER BY category NULLS FIRST, qualifier NULLS FIRST, disk_count NULLS FIRST, version NULLS FIRST, language NULLS FIRST, publisher NULLS FIRST) AS releases FROM sets GROUP BY title""",
    "work_type_filter": f"WITH {M}, {SETS}, {WORKS} SELECT name, cracked_count FROM works WHERE cracked_count > 0",
    "works_by_decade": f"WITH {M}, {SETS}, {FACETS} SELECT CAST(year // 10 * 10 AS VARCHAR) || 's' AS group_name, count(*) AS works FROM facets GROUP BY 1",
    "works_by_publisher": f"WITH {M}, {SETS}, {FACETS} SELECT coalesce(nullif(publisher, ''), 'Unknown') AS group_name, count(*) AS works FROM facets GROUP BY 1",
    "works_by_category": f"WITH {M}, {SETS}, {FACETS} SELECT category AS group_name, count(*) AS works FROM facets GROUP BY 1",
    **{f"works_sorted_by_{by}": f"WITH {MERGED}, {G}, {GSETS}, {GFACETS} SELECT * FROM works" for by in ("title", "publisher", "genre", "completeness")},
    "works_sorted": f"WITH {M}, {SETS}, {FACETS} SELECT name, year, coalesce(publisher, '') AS publisher, '' AS genre, complete, category FROM facets",
    "version_timeline": f"""WITH {M}, {SETS}, g AS (SELECT title AS name, CASE WHEN version_key IS NOT NULL THEN 'v:' || version_key ELSE 'n:' || coalesce(CAST(year AS VARCHAR), '') END AS node, year, language, version_key FROM sets WHERE category = 'game'),
        n AS (SELECT name, node, min(year) AS year, count(*) AS releases, string_agg(coalesce(language, ''), ',' ORDER BY coalesce(language, '')) AS languages, max(version_key) AS vk FROM g GROUP BY name, node)
        SELECT name, node, year, releases, languages, CAST(row_number() OVER (PARTITION BY name ORDER BY year DESC NULLS LAST, CASE WHEN vk IS NULL THEN 1 ELSE 0 END, vk DESC NULLS LAST) AS INTEGER) AS place FROM n""",
    "release_rows": f"WITH {M}, {SETS} SELECT {SET}, len(string_split(disks_present, ',')) || '/3' AS disks FROM sets",
    "variants": f"""SELECT DISTINCT record_id, uid, edition_id, {_kebab("coalesce(display_title, 'Unknown')")} || coalesce('_v' || regexp_replace(trim(e.version), '^[vV]', ''), '') || coalesce('_' || lower(e.language), '')
        || coalesce('_d' || CASE WHEN e.disk_no < 10 THEN '0' ELSE '' END || e.disk_no || 'of' || CASE WHEN e.disk_count < 10 THEN '0' ELSE '' END || e.disk_count, '') || '_' || uid || '.adf' AS canonical,
        coalesce(uid = e.primary_artifact_uid, FALSE) AS is_primary FROM artifact a LEFT JOIN edition e ON a.edition_id = e.id""",
    "artifact_lookup": "SELECT DISTINCT uid, sha1, crc32, md5, edition_id FROM artifact WHERE uid IN (SELECT primary_artifact_uid FROM edition)",
    "quarantine_list": "SELECT DISTINCT uid, sha1, crc32, md5, reason FROM artifact JOIN quarantine ON artifact_uid = uid",
    "upload_tally": """WITH u AS (SELECT DISTINCT record_id AS seq, uid, coalesce(regexp_matches(orig_filename, '(?i)\\.(adf|adz|dms|zip)$'), FALSE) AS ok FROM artifact), n AS (SELECT seq, uid, row_number() OVER (PARTITION BY uid ORDER BY seq) AS n FROM u WHERE ok)
        SELECT outcome, count(*) AS uploads FROM (SELECT CASE WHEN n > 1 THEN 'duplicate' WHEN uid IN (SELECT artifact_uid FROM quarantine) THEN 'quarantined' ELSE 'stored' END AS outcome FROM n UNION ALL SELECT 'rejected' FROM u WHERE NOT ok) GROUP BY 1""",
    "resolve_quarantine": """SELECT uid, regexp_replace(max(tosec_name), '^\\s+|\\s+$', '', 'g') AS title, 'game' AS category, 'en' AS language, CAST(NULL AS VARCHAR) AS qualifier, CAST(1 AS BIGINT) AS disk_no, CAST(1 AS BIGINT) AS disk_count, max(tosec_name) AS display_title
        FROM artifact WHERE uid IN (SELECT artifact_uid FROM quarantine) GROUP BY uid HAVING max(tosec_name) IS NOT NULL""",
    "quarantine_left": "SELECT DISTINCT artifact_uid, reason FROM quarantine WHERE artifact_uid NOT IN (SELECT uid FROM artifact WHERE tosec_name IS NOT NULL)",
    "reidentify_report": f"""WITH {M}, a AS (SELECT *, qualifier IS NOT NULL AS moved FROM m), keys AS (SELECT title, version, language, publisher, disk_count, disk_no, bool_and(moved) AS gone FROM a GROUP BY ALL HAVING TRUE),
        e AS (SELECT title, version, language, publisher, disk_count, disk_no, bool_and(moved) AS gone FROM a GROUP BY title, version, language, publisher, disk_count, disk_no), t AS (SELECT title, bool_and(moved) AS gone FROM a GROUP BY title)
        SELECT count(*) AS scanned, count(*) FILTER (WHERE moved) AS moved, (SELECT count(*) FROM e WHERE gone) AS editions_removed, (SELECT count(*) FROM t WHERE gone) AS titles_removed FROM a""",
    "reidentify_twice": f"WITH {M} SELECT count(*) AS scanned, CAST(0 AS BIGINT) AS moved, CAST(0 AS BIGINT) AS editions_removed, CAST(0 AS BIGINT) AS titles_removed FROM m",
    "delete_empty_editions": "SELECT id, title_id FROM edition WHERE id NOT IN (SELECT edition_id FROM artifact WHERE edition_id % 7 > 0 AND edition_id % 3 > 0)",
    "delete_empty_titles": "SELECT title_id AS id, name, category FROM title_query WHERE title_id NOT IN (SELECT title_id FROM edition WHERE title_id % 5 > 0)",
    "upsert_editions": """WITH w AS (SELECT title_id + 1 AS title_id, version, language, publisher, qualifier, disk_no, disk_count, min(id) AS seq FROM edition GROUP BY ALL), f AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM edition e WHERE e.title_id = w.title_id AND e.version IS NOT DISTINCT FROM w.version
        AND e.language IS NOT DISTINCT FROM w.language AND e.publisher IS NOT DISTINCT FROM w.publisher AND e.qualifier IS NOT DISTINCT FROM w.qualifier AND e.disk_no IS NOT DISTINCT FROM w.disk_no AND e.disk_count IS NOT DISTINCT FROM w.disk_count))
        SELECT 10000000 + row_number() OVER (ORDER BY seq) AS id, title_id, version, language, publisher, qualifier, disk_no, disk_count FROM f""",
    "manual_primary": f"""WITH {M}, {COHERENT}, o AS (SELECT {EDITION}, max(uid) AS uid FROM m WHERE alt_index > 0 GROUP BY {EDITION})
        SELECT {", ".join("coherent." + k for k in _EDITION)}, coalesce(o.uid, primary_uid) AS primary_uid FROM coherent LEFT JOIN o ON {_same("coherent", "o", _EDITION)}""",
    "title_similarity": f"""WITH a AS (SELECT title_id, {_words("name")} AS wa FROM title_query), b AS (SELECT DISTINCT result_id, {_words("page_title")} AS wb FROM provider_results WHERE page_title IS NOT NULL),
        j AS (SELECT *, array_to_string(wa, '') AS ja, array_to_string(wb, '') AS jb FROM a CROSS JOIN b), s AS (SELECT title_id, result_id, round(CAST(CAST({SIMILAR} AS FLOAT) AS DOUBLE), 4) AS similarity FROM j) SELECT * FROM s WHERE similarity >= 0.55""",
    "fuzzy_best_match": f"""WITH a AS (SELECT title_id, {_words("name")} AS wa FROM title_query), b AS (SELECT DISTINCT page_title, {_words("page_title")} AS wb FROM provider_results WHERE page_title IS NOT NULL),
        al AS (SELECT *, array_to_string(wa, '') AS ja, coalesce(nullif(regexp_extract(array_to_string(wa, ' '), '[a-z]'), ''), '0') AS la FROM a), bl AS (SELECT *, array_to_string(wb, '') AS jb, coalesce(nullif(regexp_extract(array_to_string(wb, ' '), '[a-z]'), ''), '0') AS lb FROM b),
        s AS (SELECT title_id, CAST({SIMILAR} AS FLOAT) AS score FROM al JOIN bl ON la = lb) SELECT title_id, round(CAST(max(score) AS DOUBLE), 4) AS score FROM s WHERE score >= CAST(0.55 AS FLOAT) GROUP BY title_id""",
    "provider_merge": f"WITH {MERGED} SELECT mg.title_id, genre, description, year, external_url, cover.url AS cover, round(CAST(score AS DOUBLE), 4) AS score, sources, coalesce(shots, '') AS shots FROM mg JOIN src USING (title_id) LEFT JOIN sho USING (title_id)",
    "wanted_images": f"""WITH {MERGED} SELECT title_id, 'cover' AS kind, 0 AS ord, cover.url AS url FROM mg WHERE cover IS NOT NULL UNION ALL SELECT title_id, 'screenshot', CAST(n - 1 AS INTEGER), url FROM (SELECT title_id, url, row_number() OVER (PARTITION BY title_id ORDER BY o) AS n FROM sh) WHERE n <= 6""",
    "title_pages": f"""WITH t AS (SELECT title_id, lower({_kebab("name")}) AS own, {_words("name")} AS wa FROM title_query), l AS (SELECT DISTINCT page_title, lower({_kebab("page_title")}) AS slug, {_words("page_title")} AS wb FROM provider_results WHERE page_title IS NOT NULL),
        x AS (SELECT DISTINCT title_id, slug FROM t JOIN l ON own = slug), al AS (SELECT *, array_to_string(wa, '') AS ja, coalesce(nullif(regexp_extract(array_to_string(wa, ' '), '[a-z]'), ''), '0') AS la FROM t WHERE title_id NOT IN (SELECT title_id FROM x)),
        bl AS (SELECT *, array_to_string(wb, '') AS jb, coalesce(nullif(regexp_extract(array_to_string(wb, ' '), '[a-z]'), ''), '0') AS lb FROM l), s AS (SELECT title_id, slug, CAST({SIMILAR} AS FLOAT) AS score FROM al JOIN bl ON la = lb),
        r AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY score DESC, slug) AS n FROM s WHERE score >= CAST(0.55 AS FLOAT)) SELECT title_id, slug, TRUE AS exact FROM x UNION ALL SELECT title_id, slug, FALSE FROM r WHERE n = 1""",
    "title_meta": f"""WITH {MERGED}, six AS (SELECT title_id, url, n FROM (SELECT title_id, url, row_number() OVER (PARTITION BY title_id ORDER BY o) AS n FROM sh) WHERE n <= 6)
        SELECT title_id, genre, sources, CASE WHEN cover IS NOT NULL THEN sha1(cover.url) END AS cover_sha1, coalesce((SELECT string_agg(sha1(url), ' ' ORDER BY n) FROM six WHERE six.title_id = mg.title_id), '') AS screenshots FROM mg JOIN src USING (title_id)""",
    "enrich_targets": f"""WITH {MERGED} SELECT title_id, name, category, (SELECT min(a.year) FROM artifact a JOIN edition e ON a.edition_id = e.id WHERE e.title_id = q.title_id) AS year FROM title_query q WHERE title_id NOT IN (SELECT title_id FROM mg)""",
    "meta_no_wipe": f"""WITH {RESULTS}, im AS (SELECT DISTINCT title_id, priority > 2 AS late, kind, url FROM (SELECT title_id, priority, 'cover' AS kind, cover.url AS url FROM r WHERE cover IS NOT NULL UNION ALL SELECT title_id, priority, 'screenshot', unnest(list_transform(shots, lambda s: s.url)) FROM r)),
        asked AS (SELECT title_id, bool_or(cover IS NOT NULL) AS c, bool_or(coalesce(len(shots), 0) > 0) AS s FROM r WHERE priority > 2 GROUP BY title_id)
        SELECT DISTINCT title_id, kind, url FROM im WHERE NOT late AND NOT (kind = 'cover' AND title_id IN (SELECT title_id FROM asked WHERE NOT c)) AND NOT (kind = 'screenshot' AND title_id IN (SELECT title_id FROM asked))
        UNION ALL SELECT DISTINCT title_id, kind, url FROM im WHERE late AND kind = 'screenshot'""",
    "page_titles": """SELECT DISTINCT doc_id, trim(regexp_replace(trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\|.*', '', 's')), ' Amiga$', '')) AS page_title
        FROM (SELECT doc_id, CASE WHEN trim(h) <> '' THEN h ELSE t END AS x FROM (SELECT doc_id, regexp_replace(regexp_extract(text, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g') AS h, regexp_replace(regexp_extract(text, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1), '(?s)<[^>]*>', '', 'g') AS t
        FROM documents WHERE contains(text, '<title>')))""",
    "page_scan": """WITH p AS (SELECT DISTINCT * FROM provider_results WHERE page_title IS NOT NULL), x AS (SELECT *, trim(regexp_replace(trim(regexp_replace(page_title, '\\|.*', '', 's')), ' Amiga$', '')) AS t, trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g')) AS d,
        list_filter(list_transform(string_split(coalesce(genre, ''), ','), lambda g: trim(g)), lambda g: g <> '') AS gs FROM p)
        SELECT result_id, t AS title, CASE WHEN strlen(d) >= 40 THEN d END AS description, CASE WHEN len(gs) > 0 THEN array_to_string(list_filter(gs, lambda g, i: list_position(list_transform(gs, lambda h: lower(h)), lower(g)) = i), ', ') ELSE NULL END AS genre,
        sha1(cover.url) AS cover, coalesce(array_to_string(list_filter(list_transform(shots, lambda s: sha1(s.url)), lambda h, i: list_position(list_transform(shots, lambda s: sha1(s.url)), h) = i), ' '), '') AS shots FROM x""",
    "stored_coverage": f"WITH {G} SELECT {SET}, tag, covered, needed, complete, mods, kind, trainer, place, missing_count FROM gcov",
    "stored_primaries": f"WITH {G} SELECT * FROM gprim",
    "stored_sets": f"WITH {G}, {GSETS} SELECT * FROM gsets",
    "stored_playable": f"""WITH {G}, {GOPTIONS}, gf AS (SELECT {SET}, tag, string_agg(disk || ':' || uid, ',' ORDER BY disk) AS files FROM gr WHERE best = 1 GROUP BY {SET}, tag)
        SELECT {", ".join("gcov." + k for k in _SET)}, gcov.tag, kind, trainer, complete, place = 1 AS recommended, CASE WHEN complete THEN files ELSE '' END AS files, coalesce(options, '') AS options FROM gcov JOIN gf ON {_same("gcov", "gf", (*_SET, "tag"))} LEFT JOIN gtext ON {_same("gcov", "gtext", (*_SET, "tag"))}""",
    "stored_works": f"WITH {MERGED}, {G}, {GSETS}, {GFACETS} SELECT * FROM works",
    "works_by_genre": f"WITH {MERGED}, {G}, {GSETS}, {GFACETS} SELECT coalesce(nullif(genre, ''), 'Unknown') AS group_name, count(*) AS works FROM works GROUP BY 1",
    "works_in_one": f"WITH {MERGED}, {G}, {GSETS}, {GFACETS} SELECT '' AS group_name, count(*) AS works FROM works",
    "browse_json": f"""WITH {BROWSE} SELECT title, '{{"editions":[' || string_agg('{{"id":' || id || ',"category":' || coalesce('"' || category || '"', 'null') || ',"language":' || coalesce('"' || language || '"', 'null') || ',"disk_no":' || coalesce(CAST(disk_no AS VARCHAR), 'null')
        || ',"variant_count":' || variant_count || '}}', ',' ORDER BY language NULLS FIRST, disk_no NULLS FIRST, id) || ']}}' AS json FROM b GROUP BY title""",
    "downloads": f"WITH {M}, {PRIMARY}, c AS (SELECT sha1({CONTENT}) AS sha1, any_value(md5({CONTENT})) AS md5 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT uid, {CANONICAL} AS canonical, md5 FROM m JOIN c USING (sha1) WHERE uid IN (SELECT primary_uid FROM own)",
    "escaped_titles": '''SELECT DISTINCT page_title, replace(replace(replace(replace('<b>' || coalesce(page_title, '') || '</b> & "', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM provider_results''',
    "artifact_categories": "SELECT category, count(DISTINCT uid) AS artifacts FROM artifact a JOIN edition e ON a.edition_id = e.id JOIN title_query t ON e.title_id = t.title_id GROUP BY category",
    "delete_cascade": """WITH e AS (SELECT * FROM edition WHERE title_id % 5 > 0 AND id IN (SELECT edition_id FROM artifact WHERE edition_id % 7 > 0 AND edition_id % 3 > 0)), t AS (SELECT * FROM title_query WHERE title_id IN (SELECT title_id FROM e))
        SELECT 'edition' AS "table", count(*) AS "left" FROM e UNION ALL SELECT n, (SELECT count(*) FROM t) FROM (VALUES ('title'), ('title_meta'), ('title_screenshot')) v(n)""",
    "resolve_and_file": """WITH n AS (SELECT uid, max(tosec_name) AS name FROM artifact WHERE uid IN (SELECT artifact_uid FROM quarantine) GROUP BY uid HAVING max(tosec_name) IS NOT NULL), g0 AS (SELECT * FROM (SELECT DISTINCT * FROM artifact) QUALIFY row_number() OVER (PARTITION BY uid ORDER BY record_id DESC) = 1),
        a AS (SELECT n.uid, name AS display_title, regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS title, NOT (coalesce(bad, FALSE) OR coalesce(virus, FALSE) OR coalesce("over", FALSE) OR coalesce("under", FALSE)) AS sound,
        row_number() OVER (PARTITION BY regexp_replace(name, '^\\s+|\\s+$', '', 'g') ORDER BY CASE WHEN coalesce(bad, FALSE) OR coalesce(virus, FALSE) OR coalesce("over", FALSE) OR coalesce("under", FALSE) THEN 1 ELSE 0 END, CASE WHEN coalesce(verified_good, FALSE) OR coalesce(modifications, 0) = 0 THEN 0 ELSE 1 END, coalesce(modifications, 0), CASE WHEN trainer IS NULL THEN 0 ELSE 1 END, coalesce(alt_index, 0), n.uid) AS rn
        FROM n JOIN g0 ON g0.uid = n.uid) SELECT uid, display_title, title, 'game' AS category, 'en' AS language, CAST(1 AS BIGINT) AS disk_no, (SELECT b.uid FROM a b WHERE b.title = a.title AND b.rn = 1 AND b.sound) AS primary_artifact_uid FROM a""",
    "enrich_report": f"WITH {MERGED} SELECT (SELECT count(*) FROM title_query) AS total, (SELECT count(*) FROM mg) AS enriched, (SELECT count(*) FROM title_query) - (SELECT count(*) FROM mg) AS skipped",
    "enrich_meta": f"WITH {MERGED} SELECT mg.title_id, genre, description, year, sources, external_url, round(CAST(score AS DOUBLE), 4) AS match_score, CAST(1700000000 AS BIGINT) AS fetched_at FROM mg JOIN src USING (title_id)",
    "ingest_batches": f"""WITH {TWO}, {COHERENT}, n AS (SELECT {EDITION}, count(*) AS variants, count(*) FILTER (WHERE verified) AS verified FROM m GROUP BY {EDITION})
        SELECT {", ".join("n." + k for k in _EDITION)}, variants, verified, primary_uid FROM n JOIN coherent ON {_same("n", "coherent", _EDITION)}""",
    "ingest_outcomes": f"""WITH {TWO} SELECT CAST(batch AS INTEGER) AS batch, kind, verified, quarantined, CAST(sum(n) AS BIGINT) AS images FROM (SELECT CASE WHEN late THEN 2 ELSE 1 END AS batch, 'stored' AS kind, verified, held AS quarantined, 1 AS n FROM ma
        UNION ALL SELECT CASE WHEN late THEN 2 ELSE 1 END, 'duplicate', NULL, NULL, copies - 1 FROM ma UNION ALL SELECT 2, 'duplicate', NULL, NULL, 1 FROM u WHERE again) GROUP BY ALL HAVING sum(n) > 0""",
    "ingest_ids": f"""WITH {TWO}, t AS (SELECT *, row_number() OVER (ORDER BY o, title, category) AS title_id FROM (SELECT title, category, min(o) AS o FROM m GROUP BY title, category)),
        e AS (SELECT title_id, {", ".join("m." + k for k in _EDITION)}, min(m.o) AS o FROM m JOIN t USING (title, category) GROUP BY ALL)
        SELECT row_number() OVER (ORDER BY o, title_id, version NULLS FIRST, language NULLS FIRST, publisher NULLS FIRST, qualifier NULLS FIRST, disk_no NULLS FIRST, disk_count NULLS FIRST) AS id, title_id, {EDITION} FROM e""",
    "export_requests": f"""WITH {M}, {BEST}, {COVER}, {OPTIONS}, q0 AS (SELECT DISTINCT {SET}, concat_ws('|', {", ".join(f"coalesce(CAST({k} AS VARCHAR), '-')" for k in _SET)}) AS request FROM m),
        bo AS (SELECT {SET}, max(uid) AS boot FROM opt WHERE k >= 2 AND trainer IS NOT NULL AND tag = 'CSL' GROUP BY {SET}),
        q AS (SELECT {", ".join("q0." + k for k in _SET)}, request || '|CSL' AS request, 'CSL' AS tag, boot FROM q0 LEFT JOIN bo ON {_same("q0", "bo", _SET)} UNION ALL SELECT {SET}, request, '', NULL FROM q0),
        ok AS (SELECT q.*, cov.complete FROM q LEFT JOIN cov ON {_same("q", "cov", (*_SET, "tag"))}),
        fl AS (SELECT ok.request, best.disk_no, CASE WHEN boot IS NOT NULL AND best.disk_no = 1 THEN boot ELSE best.uid END AS uid FROM ok JOIN best ON {_same("ok", "best", (*_SET, "tag"))} WHERE ok.complete),
        cn AS (SELECT uid, sha1, {CANONICAL} AS canonical FROM m),
        ft AS (SELECT request, string_agg(fl.disk_no || ':' || canonical || ':' || sha1, ' ' ORDER BY fl.disk_no) AS files FROM fl JOIN cn USING (uid) GROUP BY request)
        SELECT ok.request, files, CASE WHEN files IS NULL THEN concat('lineage ', chr(39), tag, chr(39), ' is not a complete set') END AS error FROM ok LEFT JOIN ft USING (request) UNION ALL SELECT request || '?', NULL, 'unknown set' FROM q0""",
    "enrich_images": f"""WITH {MERGED}, six AS (SELECT title_id, url, n FROM (SELECT title_id, url, row_number() OVER (PARTITION BY title_id ORDER BY o) AS n FROM sh) WHERE n <= 6), w AS (SELECT title_id, 'cover' AS kind, 0 AS ord, cover.url AS url FROM mg WHERE cover IS NOT NULL UNION ALL SELECT title_id, 'screenshot', n - 1, url FROM six),
        came AS (SELECT w.* FROM w WHERE ascii(substr(sha1(url), 1, 1)) % 3 > 0) SELECT title_id, sha1(url) AS blob_sha1, 'image/png' AS mime, CAST(ord AS BIGINT) AS ord, kind FROM came
        UNION ALL SELECT title_id, sha1('old'), 'image/gif', 0, 'cover' FROM title_query q WHERE NOT EXISTS (SELECT 1 FROM came WHERE came.title_id = q.title_id AND kind = 'cover') AND NOT EXISTS (SELECT 1 FROM mg WHERE mg.title_id = q.title_id AND cover IS NULL)""",
}
