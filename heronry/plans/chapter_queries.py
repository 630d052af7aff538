"""Queries of chapters over the parsed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import chapters as ch
from heronry.operators import markdown as md
from heronry.operators import structure as st
from heronry.plans.structure_queries import IDS, _docs, _L, _STRIP, _TEXTS
from heronry.tables import staged


def q_demoted_headings(spark, d):
    return ch.demoted(_docs(spark, d), IDS, "raw_text").select(*IDS, "line_no", "demoted")


def q_pasted_twice(spark, d):
    """Each document after its own text, so that every one starts again: the cut is where the copy begins."""
    twice = _docs(spark, d).withColumn("raw_text", F.concat_ws("\n", "raw_text", "raw_text"))
    return ch.pasted_twice(twice, IDS, "raw_text")


def q_topics(spark, d):
    return ch.topics(_docs(spark, d), IDS, "raw_text")


def q_chapter_contents(spark, d):
    found = staged(st.section_paths(st.sections(_docs(spark, d), IDS, "raw_text"), IDS), "paths")
    return ch.contents(found, IDS).select(*IDS, "section", "n_children", F.md5("contents").alias("contents_md5"))


def q_markdown_lines(spark, d):
    return md.markdown_lines(_docs(spark, d), IDS, "raw_text")


def q_list_chunks(spark, d):
    return ch.list_chunks(_docs(spark, d), IDS, "raw_text")


_STEP = "CAST(({t}) AS INTEGER)"
_NUM = f"""CASE WHEN regexp_matches(c, '^[0-9]+$') THEN CAST(c AS INTEGER) ELSE (SELECT CAST(CASE WHEN x.t + x.n > 0 THEN x.t + x.n ELSE 100 END AS INTEGER) FROM (SELECT list_reduce(list_transform(string_split(c, ''), lambda z: struct_pack(t := {_STEP.format(t=0)}, n := {_STEP.format(t=0)}, ch := z)),
 lambda a, z: CASE WHEN contains('十百千', z.ch) THEN struct_pack(t := {_STEP.format(t="a.t + greatest(a.n, 1) * CASE z.ch WHEN '十' THEN 10 WHEN '百' THEN 100 ELSE 1000 END")}, n := {_STEP.format(t=0)}, ch := '') ELSE struct_pack(t := {_STEP.format(t="a.t")}, n := {_STEP.format(t="CASE z.ch WHEN '两' THEN 2 ELSE instr('零一二三四五六七八九', z.ch) - 1 END")}, ch := '') END,
 struct_pack(t := {_STEP.format(t=0)}, n := {_STEP.format(t=0)}, ch := '')) AS x)) END"""
_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(para, '{'|'.join(words)}') THEN '{name}'" for name, words in ch.TOPICS) + f" ELSE '{ch.OTHER_TOPIC}' END"
_TWICE = _L.replace("title, raw_text FROM parsed_documents", "title, concat_ws(chr(10), raw_text, raw_text) AS raw_text FROM parsed_documents")

QUERIES = {
    "q_markdown_lines": (
        q_markdown_lines,
        f"WITH {_L}, b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id, doc_version ORDER BY line_no) AS before FROM l), m AS (SELECT doc_id, doc_version, line_no, {md.sql_markup('line')} AS markdown FROM b WHERE line <> '' OR before IS NULL OR before <> '') SELECT * FROM m WHERE markdown IS NOT NULL",
    ),
    "q_demoted_headings": (
        q_demoted_headings,
        f"""WITH {_L}, k AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\\s+.+', 1)) AS hashes FROM l), n AS (SELECT *, sum(CASE WHEN hashes = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, doc_version ORDER BY line_no) AS nth FROM k WHERE hashes > 0)
SELECT doc_id, doc_version, line_no, CASE WHEN (hashes = 1 AND nth > 1) OR (hashes = 2 AND regexp_matches(line, '^##\\s+[0-9一二三四五六七八九十]+(?:\\.[0-9]+)*[.、\\s]')) THEN '### ' || regexp_replace(line, '^#{{1,6}}\\s+', '') ELSE line END AS demoted FROM n""",
    ),
    "q_pasted_twice": (
        q_pasted_twice,
        f"""WITH {_TWICE}, k AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN {_STRIP.format(c="regexp_replace(line, '^#{1,6}\\s+', '')")} WHEN length(line) < 80 THEN line END AS head FROM l),
c AS (SELECT doc_id, doc_version, line_no, regexp_extract(head, '([一二三四五六七八九十百千0-9]+)', 1) AS c FROM k WHERE regexp_matches(head, '^第[一二三四五六七八九十百千0-9]+章')), m AS (SELECT *, {_NUM} AS number FROM c),
w AS (SELECT *, count(*) OVER p AS n, max(number) OVER p AS top FROM m WINDOW p AS (PARTITION BY doc_id, doc_version)), z AS (SELECT *, min(CASE WHEN number = top THEN line_no END) OVER (PARTITION BY doc_id, doc_version) AS peak FROM w)
SELECT doc_id, doc_version, max(top) AS top, min(line_no) AS cut_line FROM z WHERE n >= 3 AND line_no > peak AND number <= greatest(top // 2, 3) GROUP BY 1, 2""",
    ),
    "q_topics": (
        q_topics,
        f"""WITH d AS (SELECT DISTINCT doc_id, doc_version, title, raw_text FROM parsed_documents), b AS (SELECT doc_id, doc_version, string_split_regex(regexp_replace(raw_text, '\\r\\n?', chr(10), 'g'), '\\n[\\s\\p{{Z}}]*\\n') AS a FROM d),
p AS (SELECT doc_id, doc_version, {_STRIP.format(c="unnest(a)")} AS para, generate_subscripts(a, 1) - 1 AS place FROM b), t AS (SELECT *, {_TOPIC} AS topic FROM p WHERE para <> '')
SELECT doc_id, doc_version, topic, CAST(min(place) AS INTEGER) AS first, count(*) AS n, sum(length(para)) AS chars FROM t GROUP BY 1, 2, 3""",
    ),
    "q_chapter_contents": (
        q_chapter_contents,
        f"""WITH {_TEXTS}, o AS (SELECT a.*, (SELECT max(b.section) FROM s b WHERE b.doc_id = a.doc_id AND b.doc_version = a.doc_version AND b.section < a.section AND b.level = 1) AS one, (SELECT max(b.section) FROM s b WHERE b.doc_id = a.doc_id AND b.doc_version = a.doc_version AND b.section < a.section AND b.level = 2) AS two FROM s a),
g AS (SELECT a.doc_id, a.doc_version, a.section, (SELECT max(b.section) FROM s b WHERE b.doc_id = a.doc_id AND b.doc_version = a.doc_version AND b.section < a.section AND regexp_matches(b.title, '^第[一二三四五六七八九十百0-9]+部分|^Part\\s*[0-9]+')) AS grp FROM s a),
pa AS (SELECT o.doc_id, o.doc_version, o.section, o.level, o.title, CASE WHEN regexp_matches(o.title, '^第[一二三四五六七八九十百0-9]+部分|^Part\\s*[0-9]+') THEN o.title WHEN g.grp IS NOT NULL THEN z.title || ' · ' || o.title ELSE concat_ws(' · ', CASE WHEN o.level > 1 THEN x.title END, CASE WHEN o.level > 2 AND o.two > coalesce(o.one, 0) THEN y.title END, o.title) END AS path
 FROM o JOIN g USING (doc_id, doc_version, section) LEFT JOIN s x ON x.doc_id = o.doc_id AND x.doc_version = o.doc_version AND x.section = o.one LEFT JOIN s y ON y.doc_id = o.doc_id AND y.doc_version = o.doc_version AND y.section = o.two LEFT JOIN s z ON z.doc_id = o.doc_id AND z.doc_version = o.doc_version AND z.section = g.grp),
pc AS (SELECT pa.*, ct.content FROM pa JOIN ct USING (doc_id, doc_version, section)),
pr AS (SELECT c.doc_id, c.doc_version, c.section AS child, p.section, c.title, c.content, row_number() OVER (PARTITION BY c.doc_id, c.doc_version, c.section ORDER BY p.level DESC, p.section) AS r FROM pc c JOIN pc p ON p.doc_id = c.doc_id AND p.doc_version = c.doc_version AND p.level < c.level AND starts_with(c.path, p.path || ' · ')),
e AS (SELECT *, CASE WHEN coalesce(content, '') = '' THEN title ELSE title || ' - ' || CASE WHEN length(string_split(content, chr(10))[1]) > 150 THEN substr(string_split(content, chr(10))[1], 1, 150) || '...' ELSE string_split(content, chr(10))[1] END END AS entry FROM pr WHERE r = 1)
SELECT doc_id, doc_version, section, count(*) AS n_children, md5('【本章包含以下' || count(*) || '个子章节】' || chr(10) || string_agg(entry, chr(10) ORDER BY child)) AS contents_md5 FROM e GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
    ),
    "q_list_chunks": (
        q_list_chunks,
        f"""WITH {_L}, i AS (SELECT *, regexp_matches(line, '^[0-9]+[.、:：]\\s*\\S') AS it FROM h), n AS (SELECT *, sum(CASE WHEN it THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, doc_version ORDER BY line_no) AS item FROM i),
s AS (SELECT *, max(CASE WHEN level IS NOT NULL AND NOT it THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, doc_version, item ORDER BY line_no) AS shut FROM n WHERE item > 0),
g AS (SELECT doc_id, doc_version, item, CAST(sum(length(line)) + count(*) - 1 AS INTEGER) AS chars FROM s WHERE shut = 0 AND line <> '' GROUP BY 1, 2, 3),
w AS (SELECT doc_id, doc_version, list(struct_pack(out := CAST([] AS STRUCT(first BIGINT, last BIGINT, chars INTEGER)[]), first := CAST(item AS BIGINT), last := CAST(item AS BIGINT), n := CAST(1 AS INTEGER), chars := chars) ORDER BY item) AS e FROM g GROUP BY 1, 2 HAVING count(*) >= 3),
f AS (SELECT doc_id, doc_version, list_reduce(e, lambda a, x: CASE WHEN a.n = 0 AND x.chars > 500 THEN struct_pack(out := list_append(a.out, struct_pack(first := x.first, last := x.last, chars := x.chars)), first := CAST(0 AS BIGINT), last := CAST(0 AS BIGINT), n := CAST(0 AS INTEGER), chars := CAST(0 AS INTEGER))
 WHEN a.n = 0 THEN struct_pack(out := a.out, first := x.first, last := x.last, n := CAST(1 AS INTEGER), chars := x.chars)
 WHEN a.n >= 4 OR a.chars + x.chars > 800 THEN struct_pack(out := list_append(a.out, struct_pack(first := a.first, last := a.last, chars := a.chars)), first := x.first, last := x.last, n := CAST(1 AS INTEGER), chars := x.chars)
 ELSE struct_pack(out := a.out, first := a.first, last := x.last, n := CAST(a.n + 1 AS INTEGER), chars := CAST(a.chars + x.chars AS INTEGER)) END, struct_pack(out := CAST([] AS STRUCT(first BIGINT, last BIGINT, chars INTEGER)[]), first := CAST(0 AS BIGINT), last := CAST(0 AS BIGINT), n := CAST(0 AS INTEGER), chars := CAST(0 AS INTEGER))) AS f FROM w),
c AS (SELECT doc_id, doc_version, CASE WHEN f.n > 0 THEN list_append(f.out, struct_pack(first := f.first, last := f.last, chars := f.chars)) ELSE f.out END AS c FROM f),
u AS (SELECT doc_id, doc_version, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS chunk, unnest(c) AS x FROM c)
SELECT doc_id, doc_version, chunk, x.first AS first, x.last AS last, x.chars AS chars FROM u""",
    ),
}
