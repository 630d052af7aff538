"""Queries of structure and chunking over the parsed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import structure as st
from heronry.tables import staged, table

IDS = ["doc_id", "doc_version"]


def _docs(spark, d):
    return table(spark, d, "parsed_documents").select(*IDS, "title", "raw_text").distinct()


def q_headings(spark, d):
    return st.headings(_docs(spark, d), IDS, "raw_text")


def q_sections(spark, d):
    return st.sections(_docs(spark, d), IDS, "raw_text").drop("content")


def q_section_paths(spark, d):
    found = staged(st.sections(_docs(spark, d), IDS, "raw_text").drop("content"), "sections")
    return st.section_paths(found, IDS).select(*IDS, "section", "path")


def q_list_items(spark, d):
    return st.list_items(_docs(spark, d), IDS, "raw_text")


def q_child_chunks(spark, d):
    """Documents cut into sections and these packed into chunks."""
    found = st.sections(_docs(spark, d), IDS, "raw_text")
    out = st.chunks(found, [*IDS, "section"], "title", "content")
    return out.select(*IDS, "section", "chunk_index", F.length("content").alias("chars"), F.md5("content").alias("content_md5"))


def q_parent_windows(spark, d):
    return st.parent_windows(st.places(table(spark, d, "child_chunks")))


def q_document_mode(spark, d):
    return st.document_mode(_docs(spark, d), IDS, "raw_text")


def q_outline(spark, d):
    return st.outline(table(spark, d, "child_chunks"))


_L = """d AS (SELECT DISTINCT doc_id, doc_version, title, raw_text FROM parsed_documents),
l0 AS (SELECT doc_id, doc_version, unnest(string_split(raw_text, chr(10))) AS raw, generate_subscripts(string_split(raw_text, chr(10)), 1) AS line_no FROM d),
l AS (SELECT doc_id, doc_version, CAST(line_no AS INTEGER) AS line_no, regexp_replace(raw, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS line FROM l0),
h AS (SELECT *, CASE WHEN """ + " OR ".join(f"contains(lower(line), '{t}')" for t in st.NOISE_TITLES) + """ THEN NULL
 WHEN regexp_matches(line, '^#{1,6}\\s+.+') THEN CASE WHEN regexp_matches(line, '^#{1,6}\\s+商品\\s*[0-9]+\\s*[:：\\s]*') THEN least(3, length(regexp_extract(line, '^(#{1,6})\\s', 1))) WHEN length(regexp_extract(line, '^(#{1,6})\\s', 1)) <= 3 THEN length(regexp_extract(line, '^(#{1,6})\\s', 1)) END
 WHEN regexp_matches(line, '^第[一二三四五六七八九十百千0-9]+章') THEN 1 WHEN regexp_matches(line, '^第[一二三四五六七八九十百千0-9]+节') THEN 2
 WHEN regexp_matches(line, '^[0-9]+\\.[0-9]+\\.[0-9]+\\s') THEN 3 WHEN regexp_matches(line, '^[0-9]+\\.[0-9]+\\s') THEN 2
 WHEN regexp_matches(line, '^[0-9]+\\s') AND length(line) < 60 THEN 1 WHEN regexp_matches(line, '^[一二三四五六七八九十]+、\\s') THEN 1 END AS level FROM l),
t AS (SELECT *, regexp_extract(regexp_replace(line, '^#{1,6}\\s+', ''), '^([^。！？]*)', 1) AS title,
 CASE WHEN level IS NULL THEN line ELSE regexp_replace(regexp_extract(line, '^[^。！？]*[。！？](.*)$', 1), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') END AS body FROM h)"""
_S = _L + """, s0 AS (SELECT *, sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, doc_version ORDER BY line_no) AS section FROM t),
s1 AS (SELECT *, max(section) OVER (PARTITION BY doc_id, doc_version) AS mx FROM s0),
s AS (SELECT doc_id, doc_version, section, coalesce(min(level), 1) AS level, coalesce(max(CASE WHEN level IS NOT NULL THEN title END), '正文') AS title,
 sum(CASE WHEN body <> '' THEN 1 ELSE 0 END) AS n_lines, sum(length(body)) AS chars FROM s1 WHERE section > 0 OR mx = 0 GROUP BY 1, 2, 3)"""
_TEXTS = _S + """, ct AS (SELECT doc_id, doc_version, section, coalesce(max(CASE WHEN level IS NOT NULL THEN title END), '正文') AS title, string_agg(body, chr(10) ORDER BY line_no) FILTER (body <> '') AS content FROM s1 WHERE section > 0 OR mx = 0 GROUP BY 1, 2, 3)"""
_STRIP = "regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_SENT = "list_filter(list_transform(regexp_extract_all(p, '[^。！？；!?;\n]*[。！？；!?;]|[^。！？；!?;\n]+'), lambda x: " + _STRIP.format(c="x") + "), lambda x: x <> '')"
#: The folds of the operator in SQL: the state has the type of the elements.
_CHUNKS = _TEXTS + f""", pg AS (SELECT doc_id, doc_version, section, title, unnest(string_split(content, chr(10) || chr(10))) AS p, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS k FROM ct WHERE trim(content) <> ''),
sn AS (SELECT *, list_transform({_SENT}, lambda x: struct_pack(done := CAST([] AS VARCHAR[]), o := x)) AS e FROM pg),
fu AS (SELECT *, list_reduce(e, lambda a, x: CASE WHEN length(concat_ws(' ', nullif(a.o, ''), x.o)) >= 20 THEN struct_pack(done := list_append(a.done, concat_ws(' ', nullif(a.o, ''), x.o)), o := '') ELSE struct_pack(done := a.done, o := concat_ws(' ', nullif(a.o, ''), x.o)) END, struct_pack(done := CAST([] AS VARCHAR[]), o := '')) AS f FROM sn),
un AS (SELECT doc_id, doc_version, section, title, k, CASE WHEN f.o = '' THEN f.done WHEN len(f.done) = 0 THEN [f.o] ELSE list_append(f.done[1:len(f.done) - 1], f.done[-1] || ' ' || f.o) END AS u FROM fu),
al AS (SELECT doc_id, doc_version, section, title, flatten(list(list_transform(u, lambda x, i: struct_pack(done := CAST([] AS VARCHAR[]), now := x, fin := i = len(u))) ORDER BY k)) AS e FROM un GROUP BY 1, 2, 3, 4),
fo AS (SELECT *, list_reduce(e, lambda a, x: CASE WHEN a.now = '' OR length(a.now) + length(x.now) <= 800
  THEN CASE WHEN x.fin AND length(concat_ws(' ', nullif(a.now, ''), x.now)) >= 100 THEN struct_pack(done := list_append(a.done, concat_ws(' ', nullif(a.now, ''), x.now)), now := '', fin := false) ELSE struct_pack(done := a.done, now := concat_ws(' ', nullif(a.now, ''), x.now), fin := false) END
  ELSE CASE WHEN x.fin AND length(x.now) >= 100 THEN struct_pack(done := list_append(list_append(a.done, a.now), x.now), now := '', fin := false) ELSE struct_pack(done := list_append(a.done, a.now), now := x.now, fin := false) END END, struct_pack(done := CAST([] AS VARCHAR[]), now := '', fin := false)) AS f FROM al),
cl AS (SELECT doc_id, doc_version, section, title, CASE WHEN f.now = '' THEN f.done ELSE list_append(f.done, f.now) END AS c FROM fo),
ch AS (SELECT doc_id, doc_version, section, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS chunk_index, '[章节: ' || title || ']' || chr(10) || chr(10) || unnest(c) AS content FROM cl)"""
_PLACES = "p AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index NULLS LAST, child_id) - 1 AS j FROM (SELECT DISTINCT doc_id, child_id, chunk_index, content FROM child_chunks WHERE doc_id IS NOT NULL))"

QUERIES = {
    "q_headings": (q_headings, f"WITH {_L} SELECT doc_id, doc_version, line_no, level, title FROM t WHERE level IS NOT NULL"),
    "q_sections": (q_sections, f"WITH {_S} SELECT * FROM s"),
    "q_section_paths": (
        q_section_paths,
        f"WITH {_S}, o AS (SELECT a.doc_id, a.doc_version, a.section, a.level, a.title, (SELECT max(b.section) FROM s b WHERE b.doc_id = a.doc_id AND b.doc_version = a.doc_version AND b.section < a.section AND b.level = 1) AS one, (SELECT max(b.section) FROM s b WHERE b.doc_id = a.doc_id AND b.doc_version = a.doc_version AND b.section < a.section AND b.level = 2) AS two FROM s a) SELECT o.doc_id, o.doc_version, o.section, concat_ws(' · ', CASE WHEN o.level > 1 THEN x.title END, CASE WHEN o.level > 2 AND o.two > coalesce(o.one, 0) THEN y.title END, o.title) AS path FROM o LEFT JOIN s x ON x.doc_id = o.doc_id AND x.doc_version = o.doc_version AND x.section = o.one LEFT JOIN s y ON y.doc_id = o.doc_id AND y.doc_version = o.doc_version AND y.section = o.two",
    ),
    "q_list_items": (
        q_list_items,
        f"WITH {_L}, k AS (SELECT *, CASE WHEN regexp_matches(line, '^[0-9]+[.、:：]\\s*\\S') THEN 'number' WHEN regexp_matches(line, '^[一二三四五六七八九十]+、') THEN 'han' WHEN regexp_matches(line, '^【[^】]*[0-9]+[^】]*】') THEN 'bracket' WHEN regexp_matches(line, '^[①②③④⑤⑥⑦⑧⑨⑩]') THEN 'circle' WHEN regexp_matches(line, '^#{{3,}}\\s*[0-9]+\\.[0-9]+') THEN 'heading' END AS kind FROM l) SELECT doc_id, doc_version, kind, line_no, length(line) AS chars FROM k WHERE kind IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, doc_version, kind) >= 3",
    ),
    "q_child_chunks": (q_child_chunks, f"WITH {_CHUNKS} SELECT doc_id, doc_version, section, chunk_index, length(content) AS chars, md5(content) AS content_md5 FROM ch"),
    "q_parent_windows": (
        q_parent_windows,
        f"WITH {_PLACES}, w AS (SELECT doc_id, j, content, unnest(range(greatest(0, CAST(ceil((j - 5) / 3.0) AS BIGINT)), j // 3 + 1)) AS win FROM p) SELECT doc_id, win, min(j) AS first, max(j) AS last, count(*) AS n, sum(length(content)) AS chars FROM w GROUP BY 1, 2",
    ),
    "q_document_mode": (
        q_document_mode,
        f"WITH {_L}, g AS (SELECT doc_id, doc_version, count(*) AS n_lines, sum(CASE WHEN level IS NOT NULL OR regexp_matches(line, '^(?:[0-9]+[.、]|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|【)') THEN 1 ELSE 0 END) AS signals, sum(CASE WHEN regexp_matches(line, '{'|'.join(st.PRODUCT_WORDS)}') THEN 1 ELSE 0 END) AS products FROM t WHERE line <> '' GROUP BY 1, 2) SELECT *, CASE WHEN NOT (products >= 2 OR products > n_lines * 0.1) AND signals >= 3 THEN 'structure' ELSE 'topic' END AS mode FROM g",
    ),
    "q_outline": (
        q_outline,
        "WITH c AS (SELECT DISTINCT doc_id, string_split(chapter_title, ' · ') AS parts, chapter_title FROM child_chunks WHERE chapter_title IS NOT NULL), a AS (SELECT doc_id, chapter_title, array_to_string(list_slice(parts, 1, len(parts) - 1), ' · ') AS above, parts[-1] AS own FROM c WHERE len(parts) > 1) SELECT doc_id, above, count(*) AS n_children, array_to_string(list_sort(list_distinct(list(own))), '|') AS titles FROM a GROUP BY 1, 2 HAVING count(*) >= 3",
    ),
}
