"""Scalar text functions over documents, pages and small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ranking
from ..registry import query

TOKENS_SQL = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: length(t) > 1 OR strlen(t) > 1)"


@query("x1_tokens", rf"SELECT doc_id, len({TOKENS_SQL})::BIGINT AS n_tokens, md5(array_to_string({TOKENS_SQL}, ' ')) AS tokens_md5 FROM documents")
def x1(t):
    w = X.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("tokens_md5"))


@query("x2_mixed_tokens", r"""
WITH r AS (SELECT doc_id, regexp_extract_all(lower(text || ' 熱制御 温度5 設'), '[a-z0-9]+|[぀-鿿]+') AS r FROM documents)
SELECT doc_id, md5(array_to_string(flatten(list_transform(r, lambda x: CASE WHEN regexp_matches(x, '^[a-z0-9]') OR length(x) = 1 THEN [x]
  ELSE list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) END)), ' ')) AS tokens_md5 FROM r""")
def x2(t):
    return t.documents.select("doc_id", F.md5(F.array_join(X.mixed_tokens(F.concat("text", F.lit(" 熱制御 温度5 設"))), " ")).alias("tokens_md5"))


@query("x3_cjk_runs", "SELECT doc_id, array_to_string(regexp_extract_all(lang || '熱制御系の温度' || source || '設計' || '熱', '[぀-鿿]{2,}'), '|') AS runs FROM documents")
def x3(t):
    return t.documents.select("doc_id", F.array_join(X.cjk_runs(F.concat("lang", F.lit("熱制御系の温度"), "source", F.lit("設計"), F.lit("熱"))), "|").alias("runs"))


@query("x4_document_id", r"SELECT p_partkey, regexp_replace(regexp_replace('SPEC-' || (p_partkey % 7)::VARCHAR || '-' || (p_partkey % 100)::VARCHAR || chr((65 + p_partkey % 8)::INT) || CASE WHEN p_partkey % 3 = 0 THEN '_N1' ELSE '' END || '.pdf', '\.[A-Za-z0-9]+$', ''), '[A-F]?(_N\d+)?$', '') AS document FROM part")
def x4(t):
    k = F.col("p_partkey")
    name = F.concat(F.lit("SPEC-"), (k % 7).cast("string"), F.lit("-"), (k % 100).cast("string"), F.chr(65 + k % 8), F.when(k % 3 == 0, "_N1").otherwise(""), F.lit(".pdf"))
    return t.part.select("p_partkey", X.document_id(name).alias("document"))


NOISY = "concat('ABCD-1-23\n 4 \n', text, '\n----------\n 12\nIntro ......... 3\n\n\n\n  end  ')"
NOISY_DUCK = "('ABCD-1-23' || chr(10) || ' 4 ' || chr(10) || text || chr(10) || '----------' || chr(10) || ' 12' || chr(10) || 'Intro ......... 3' || repeat(chr(10), 4) || '  end  ')"


@query("x5_clean_noise", rf"""
WITH a AS (SELECT doc_id, regexp_replace({NOISY_DUCK}, '[A-Z]{{4}}-\d+-\d+[\w-]*\s*\n\s*(?:[ivxIVX]+|\d{{1,4}})\s*\n', chr(10), 'g') AS x FROM documents),
b AS (SELECT doc_id, regexp_replace(x, '(?m)^[ \t]*(?:[ivxIVX]+|\d{{1,4}})[ \t]*$\n?', '', 'g') AS x FROM a),
c AS (SELECT doc_id, regexp_replace(x, '[^\n]*\.{{5,}}[^\n]*\n?', '', 'g') AS x FROM b),
d AS (SELECT doc_id, regexp_replace(x, '(?m)^[ \t]*[─━\-=_*#~]{{5,}}[ \t]*$\n?', '', 'g') AS x FROM c),
e AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+\n', chr(10), 'g'), '\n {{2,}}', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM d)
SELECT doc_id, md5(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS clean_md5 FROM e""")
def x5(t):
    return t.documents.select("doc_id", F.md5(X.clean_noise(F.expr(NOISY))).alias("clean_md5"))


@query("x6_chunk_type", r"""
WITH a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN repeat('a....... 1' || chr(10), 4) WHEN 1 THEN text || ' DISCLAIMER' WHEN 2 THEN text || '参考文書' ELSE text END AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) > 0 AND ((length(x) - length(replace(x, '.', ''))) / length(x) > 0.3 OR len(regexp_extract_all(x, '[^\n]*\.{5,}[^\n]*\n?')) >= 3) THEN 'toc'
  WHEN regexp_matches(x, '(?i)免責条項|disclaimer') THEN 'disclaimer' WHEN regexp_matches(x, '関連文書|参考文書|参照文書|適用文書|関係文書') THEN 'references' ELSE 'body' END AS chunk_type FROM a""")
def x6(t):
    x = F.expr("case doc_id % 5 when 0 then repeat('a....... 1\n', 4) when 1 then text || ' DISCLAIMER' when 2 then text || '参考文書' else text end")
    return t.documents.select("doc_id", X.chunk_type(x).alias("chunk_type"))


@query("x7_cross_references", r"""
WITH a AS (SELECT doc_id, 'SPEC-1-' || (doc_id % 9)::VARCHAR AS own, text || ' see SPEC-1-' || (doc_id % 7)::VARCHAR || ', SPEC-1-' || (doc_id % 9)::VARCHAR || ' and TEST-2-' || (doc_id % 5)::VARCHAR || '-A' AS x FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(x, '[A-Z]{4}-\d+-\d+(?:-\w+)?'), lambda r: regexp_replace(r, '[A-Z]$', '') <> regexp_replace(own, '[A-Z]$', '')))), ',') AS refs FROM a""")
def x7(t):
    own = F.expr("concat('SPEC-1-', doc_id % 9)")
    x = F.expr("concat(text, ' see SPEC-1-', doc_id % 7, ', SPEC-1-', doc_id % 9, ' and TEST-2-', doc_id % 5, '-A')")
    return t.documents.select("doc_id", F.array_join(X.cross_references(x, own), ",").alias("refs"))


@query("x8_section", r"""
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '１．２ 概要' || chr(10) || text WHEN doc_id % 3 = 1 THEN '3.4.1 Scope of it ' || chr(10) || text ELSE text END AS x FROM documents),
b AS (SELECT doc_id, list_filter(list_transform(list_filter(string_split(translate(x, '０１２３４５６７８９．', '0123456789.'), chr(10)), lambda l: regexp_matches(l, '^\s*\d+(?:\.\d+){1,3}\.?\s+\S')),
  lambda l: {'number': regexp_extract(l, '^\s*(\d+(?:\.\d+){1,3})', 1), 'title': regexp_replace(regexp_extract(l, '^\s*\d+(?:\.\d+){1,3}\.?\s+(.*)$', 1), '^\s+|\s+$', '', 'g')}), lambda h: length(h.title) - length(replace(h.title, '.', '')) < 5) AS h FROM a)
SELECT doc_id, coalesce(h[1].number, '') AS section_number, coalesce(h[1].title, '') AS section_title FROM b""")
def x8(t):
    x = F.expr("case when doc_id % 3 = 0 then concat('１．２ 概要\n', text) when doc_id % 3 = 1 then concat('3.4.1 Scope of it \n', text) else text end")
    s = X.section(x)
    return t.documents.select("doc_id", s["number"].alias("section_number"), s["title"].alias("section_title"))


PAGED = "concat(case when doc_id % 3 = 0 then concat('JERG-2-310A \n ', doc_id % 50, '\n') else '' end, text, '\n', doc_id * 37 % 1500, '\n0012')"
PAGED_DUCK = "(CASE WHEN doc_id % 3 = 0 THEN 'JERG-2-310A ' || chr(10) || ' ' || (doc_id % 50)::VARCHAR || chr(10) ELSE '' END || text || chr(10) || (doc_id * 37 % 1500)::VARCHAR || chr(10) || '0012')"


@query("x9_page_number", rf"""
WITH a AS (SELECT doc_id, {PAGED_DUCK} AS x FROM documents),
b AS (SELECT doc_id, try_cast(regexp_extract(x, 'JERG-\d+-\d+\w*\s*\n\s*(\d+)\s*\n', 1) AS INT) AS below, try_cast(regexp_extract(x, '(?m)^(\d{{1,4}})$', 1) AS INT) AS line FROM a)
SELECT doc_id, coalesce(below, CASE WHEN line BETWEEN 1 AND 999 THEN line END) AS page_number FROM b""")
def x9(t):
    return t.documents.select("doc_id", X.page_number(F.expr(PAGED)).alias("page_number"))


@query("x10_brief_summary", r"""
WITH a AS (SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: length(l) > 5 AND NOT contains(l, '......')), 1, 3), ' ') AS j FROM documents)
SELECT doc_id, CASE WHEN length(j) > 80 THEN substr(j, 1, 80) || '...' ELSE j END AS summary FROM a""")
def x10(t):
    return t.documents.select("doc_id", X.brief_summary(F.col("text")).alias("summary"))


@query("x11_context_header", r"""
WITH a AS (SELECT doc_id, source, lang, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS p, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, 'Document: ' || source || chr(10) || 'Domain: ' || lang || coalesce(chr(10) || 'Before: ' || p::VARCHAR, '') || coalesce(chr(10) || 'After: ' || n::VARCHAR, '') AS header FROM a""")
def x11(t):
    rows = ranking.neighbours(t.documents.select("doc_id", "source", "lang"), ["source"], ["doc_id"], F.col("doc_id").cast("string"), "p", "n")
    return rows.select("doc_id", X.context_header(F.col("source"), F.lit(""), F.col("lang"), F.col("p"), F.col("n")).alias("header"))


@query("x12_context_prefix", r"""
WITH a AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '2.1 Purpose of the design and of everything else that it says' || chr(10) || text WHEN 1 THEN '熱制御の設計。' || text ELSE text END AS x FROM documents),
b AS (SELECT doc_id, regexp_extract(substr(x, 1, 200), '(?m)^(\d+(?:\.\d+)*)\s+([^\n]+?)$', ['number', 'title']) AS h, string_split(substr(x, 1, 100), '。')[1] AS sentence FROM a)
SELECT doc_id, CASE WHEN h.number <> '' THEN 'このチャンクはセクション ' || h.number || ' 「' || substr(h.title, 1, 50) || '」に関する内容です。' ELSE 'このチャンクは「' || sentence || '」に関する内容を含みます。' END AS prefix FROM b""")
def x12(t):
    x = F.expr("case doc_id % 3 when 0 then concat('2.1 Purpose of the design and of everything else that it says\n', text) when 1 then concat('熱制御の設計。', text) else text end")
    return t.documents.select("doc_id", X.context_prefix(x).alias("prefix"))


PLAIN = (("therefore", "so"), ("shall", "must"), (" the ", " "), ("tion", "shun"))


@query("x13_substitute", "SELECT doc_id, md5(replace(replace(replace(replace(text, 'therefore', 'so'), 'shall', 'must'), ' the ', ' '), 'tion', 'shun')) AS plain_md5 FROM documents")
def x13(t):
    return t.documents.select("doc_id", F.md5(X.substitute(F.col("text"), PLAIN)).alias("plain_md5"))


@query("x14_rule_keywords", r"""
WITH a AS (SELECT doc_id, text || ' ISO 9001 and MIL-STD-1553B, JERG-2-310準拠 at ' || (doc_id % 90)::VARCHAR || ' MHz or 3.5V' AS x FROM documents)
SELECT doc_id, array_to_string(list_slice(list_sort(list_distinct(list_concat(regexp_extract_all(x, '(?:JERG|JAXA|JIS|ISO|MIL|IEEE)[- ]?[\p{L}\p{N}_.-]+'), regexp_extract_all(x, '\d+(?:\.\d+)?\s*(?:km|m|kg|W|V|A|MHz|GHz|dB|°C|Pa|N)')))), 1, 10), '|') AS keywords FROM a""")
def x14(t):
    return t.documents.select("doc_id", F.array_join(X.rule_keywords(F.expr("concat(text, ' ISO 9001 and MIL-STD-1553B, JERG-2-310準拠 at ', doc_id % 90, ' MHz or 3.5V')")), "|").alias("keywords"))


@query("x15_short_or_brief", "SELECT doc_id, CASE WHEN length(text) < 100 THEN substr(text, 1, 50) ELSE substr(text, 1, 80) || CASE WHEN length(text) > 80 THEN '...' ELSE '' END END AS summary FROM documents")
def x15(t):
    return t.documents.select("doc_id", X.short_or_brief(F.col("text")).alias("summary"))


NAMED = "concat(case when doc_id % 2 = 0 then '3.2.1 Thermal control of it\n' else '' end, text, ' DTR of TCS, JAXA and ESA: ISO ', doc_id % 11, '00-1, JIS B 8', ', JERG-2-310-HB1, MIL-STD-1553B。「熱制御」とは、温度を保つことをいう。')"
NAMED_DUCK = "(CASE WHEN doc_id % 2 = 0 THEN '3.2.1 Thermal control of it' || chr(10) ELSE '' END || text || ' DTR of TCS, JAXA and ESA: ISO ' || (doc_id % 11)::VARCHAR || '00-1, JIS B 8' || ', JERG-2-310-HB1, MIL-STD-1553B。「熱制御」とは、温度を保つことをいう。')"


@query("x16_entities", rf"""
WITH a AS (SELECT doc_id, {NAMED_DUCK} AS x FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(x, 'JAXA|宇宙航空研究開発機構') || regexp_extract_all(x, 'NASA|ESA|CNES|DLR') || regexp_extract_all(x, 'ISO\s*\d+|JIS\s*[A-Z]\s*\d+'))), '|') AS organizations,
 array_to_string(list_sort(list_distinct(regexp_extract_all(x, 'JERG-\d{{1,2}}-\d{{3}}(?:-[A-Z]+\d+)?') || regexp_extract_all(x, 'MIL-(?:STD|SPEC)-\d+[A-Z]?') || regexp_extract_all(x, 'ECSS-[A-Z]-[A-Z]{{2}}-\d+') || regexp_extract_all(x, 'ISO\s*\d+(?:-\d+)?'))), '|') AS regulations,
 array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(x, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')))), '|') AS abbreviations,
 array_to_string(list_transform(regexp_extract_all(x, '「[^\n]{{2,20}}」[はとも]?(?:、|　|\s)*[^\n]{{5,80}}?(?:という|と定義|をいう|である)'), lambda d: regexp_extract(d, '「([^\n]{{2,20}})」', 1) || '=' || regexp_extract(d, '「[^\n]{{2,20}}」[はとも]?(?:、|　|\s)*([^\n]{{5,80}}?)(?:という|と定義|をいう|である)', 1)), '|') AS defined_terms FROM a""")
def x16(t):
    e = F.col("e")
    rows = t.documents.select("doc_id", X.entities(F.expr(NAMED)).alias("e"))
    joined = [F.array_join(e[k], "|").alias(k) for k in ("organizations", "regulations", "abbreviations")]
    return rows.select("doc_id", *joined, F.array_join(F.transform(e["defined_terms"], lambda d: F.concat(d["term"], F.lit("="), d["definition"])), "|").alias("defined_terms"))


@query("x17_named_entities", rf"""
WITH a AS (SELECT doc_id, {NAMED_DUCK} AS x FROM documents),
e AS (SELECT doc_id, 'CONCEPT' AS type, unnest(list_transform(regexp_extract_all(substr(x, 1, 500), '\d+(?:\.\d+)+\s+[^\n。]{{5,40}}'), lambda h: regexp_extract(h, '^\d+(?:\.\d+)+') || ' ' || regexp_replace(regexp_replace(h, '^\d+(?:\.\d+)+', ''), '^\s+|\s+$', '', 'g'))) AS name FROM a
 UNION ALL SELECT doc_id, 'STANDARD', unnest(regexp_extract_all(x, '(?:JERG|JAXA|JIS|ISO|MIL|IEEE)[- ]?[\p{{L}}\p{{N}}_.-]+')) FROM a)
SELECT substr(md5(lower(name)), 1, 12) AS entity_id, type, min(CASE type WHEN 'CONCEPT' THEN 'セクション: ' ELSE '規格文書: ' END || name) AS description, count(*) AS mentions, count(DISTINCT doc_id) AS n_docs FROM e GROUP BY 1, 2""")
def x17(t):
    rows = t.documents.select("doc_id", F.explode(X.named_entities(F.expr(NAMED))).alias("e")).select("doc_id", "e.*")
    # one row for each document first, so a name that all documents hold is counted in parts
    own = rows.groupBy("doc_id", F.col("id").alias("entity_id"), "type").agg(F.min("description").alias("description"), F.count(F.lit(1)).alias("n"))
    return own.groupBy("entity_id", "type").agg(F.min("description").alias("description"), F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("n_docs"))


@query("x18_language_flag", "SELECT doc_id, CASE WHEN length(x) > 0 AND length(regexp_replace(x, '[^぀-鿿]', '', 'g')) / length(x) > 0.1 THEN 'ja' ELSE 'en' END AS language FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || repeat('熱制御系の温度設計', length(text) // 40 + 1) ELSE text END AS x FROM documents)")
def x18(t):
    return t.documents.select("doc_id", X.language_flag(F.expr("case when doc_id % 4 = 0 then concat(text, repeat('熱制御系の温度設計', cast(length(text) div 40 + 1 as int))) else text end")).alias("language"))


@query("x19_tidy", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text || '   x' || repeat(chr(10), 5) || 'y  ', '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS tidy_md5 FROM documents")
def x19(t):
    return t.documents.select("doc_id", F.md5(X.tidy(F.concat("text", F.lit("   x\n\n\n\n\ny  ")))).alias("tidy_md5"))


@query("x20_squeeze", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' [12] == Heading == end', '\[\d+\]', '', 'g'), '={2,}[^=\n]*={2,}', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS squeezed_md5 FROM documents")
def x20(t):
    return t.documents.select("doc_id", F.md5(X.squeeze(F.concat("text", F.lit(" [12] == Heading == end")))).alias("squeezed_md5"))


@query("x21_fingerprints", r"SELECT doc_id, md5(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')) AS fingerprint, md5(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS dedup_key FROM documents")
def x21(t):
    return t.documents.select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"), X.dedup_key(F.col("text")).alias("dedup_key"))


NAMES = "['planV3.2.pdf', 'plan_rev2_20240115.docx', 'Rev.4-v2.pdf', 'permit_2024-03-01.pdf', '誓約書_最終.pdf', 'draft-final.docx', '計画_確定_v.pdf', 'note(2).xlsx', 'note_2.1.pdf', '通知書_第3版.docx', '規程第12改定.doc', 'note.pdf', 'plan_20240115.pdf']"


@query("x22_version_mark", rf"""
WITH n AS (SELECT p_partkey, regexp_replace(({NAMES})[(p_partkey % 13 + 1)::INT], '\.[^.]+$', '') AS f FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(f, '(?i)rev\.?\d') THEN 'rev' || regexp_extract(f, '(?i)rev\.?(\d+)', 1) WHEN regexp_matches(f, '[vV]\d') THEN 'v' || regexp_extract(f, '[vV](\d+(?:\.\d+)*)', 1)
 WHEN regexp_matches(f, '第\d+[版改]') THEN '第' || regexp_extract(f, '第(\d+)[版改]', 1) || '版' WHEN regexp_matches(f, '[_\-](最終|final|確定|FINAL)') THEN '最終'
 WHEN regexp_matches(f, '\d{{4}}[-_]\d{{2}}[-_]\d{{2}}') THEN regexp_extract(f, '\d{{4}}[-_]\d{{2}}[-_]\d{{2}}') WHEN regexp_matches(f, '[_\-\(]\d{{1,3}}[_\-\).]') THEN regexp_extract(f, '[_\-\(](\d{{1,3}})[_\-\).]', 1) ELSE '1.0' END AS version FROM n""")
def x22(t):
    name = F.expr(f"element_at(array({NAMES[1:-1]}), cast(p_partkey % 13 + 1 as int))")
    return t.part.select("p_partkey", X.version_mark(name).alias("version"))


@query("x23_version_order", r"""
WITH v AS (SELECT p_partkey, list_transform(regexp_extract_all('v' || (p_size % 5)::VARCHAR || '.' || p_size::VARCHAR, '\d+'), lambda x: x::BIGINT) AS v FROM part)
SELECT p_partkey, coalesce(v[1], 0) AS major, coalesce(v[2], 0) AS minor, coalesce(v[3], 0) AS patch, coalesce(v[1], 0) > 2 OR (coalesce(v[1], 0) = 2 AND coalesce(v[2], 0) > 10) AS newer FROM v""")
def x23(t):
    v = X.version_parts(F.expr("concat('v', p_size % 5, '.', p_size)"))
    return t.part.select("p_partkey", v[0].alias("major"), v[1].alias("minor"), v[2].alias("patch"), ((v[0] > 2) | ((v[0] == 2) & (v[1] > 10))).alias("newer"))


@query("x25_expiry", """
SELECT o_orderkey, date_diff('day', DATE '1998-01-01', o_orderdate::DATE)::INT AS days, CASE WHEN date_diff('day', DATE '1998-01-01', o_orderdate::DATE) < 0 THEN 'expired' WHEN date_diff('day', DATE '1998-01-01', o_orderdate::DATE) = 0 THEN 'today'
 WHEN date_diff('day', DATE '1998-01-01', o_orderdate::DATE) <= 7 THEN 'critical' WHEN date_diff('day', DATE '1998-01-01', o_orderdate::DATE) <= 30 THEN 'warning' ELSE 'info' END AS label
FROM orders WHERE o_orderdate IS NOT NULL AND o_orderdate <= TIMESTAMP '1998-03-01'""")
def x25(t):
    days = F.date_diff(F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date"))
    rows = t.orders.filter(F.col("o_orderdate").isNotNull() & (F.col("o_orderdate") <= F.lit("1998-03-01").cast("timestamp_ntz")))
    return rows.select("o_orderkey", days.alias("days"), X.expiry_label(days).alias("label"))


@query("x26_html_text", r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)<br\s*/?>|</(p|div|tr|li|h[1-6])>', chr(10), 'g'), '<[^>]+>', '', 'g') AS x FROM a),
c AS (SELECT page_id, array_to_string(list_transform(string_split(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), chr(10)), lambda l: regexp_replace(l, '^[ \t\r]+|[ \t\r]+$', '', 'g')), chr(10)) AS x FROM b)
SELECT page_id, md5(regexp_replace(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS text_md5 FROM c""")
def x26(t):
    return t.pages.select("page_id", F.md5(X.html_text(F.col("html"))).alias("text_md5"))


MARKDOWN_SQL = r"SELECT page_id, md5(regexp_replace(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS markdown_md5 FROM x"


def _markdown_sql() -> str:
    """The rules one after the other as SQL."""
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    x = "html"
    for pattern, to in X.MARKDOWN_RULES:
        x = f"regexp_replace({x}, {quote(pattern)}, {quote(to.replace('$', chr(92)))}, 'g')"
    for entity, char in X.MARKDOWN_ENTITIES:
        x = f"replace({x}, {quote(entity)}, {quote(char)})"
    return f"WITH x AS (SELECT page_id, {x} AS x FROM pages) {MARKDOWN_SQL}"


@query("x26_html_markdown", _markdown_sql())
def x26m(t):
    return t.pages.select("page_id", F.md5(X.html_markdown(F.col("html"))).alias("markdown_md5"))


QUOTED = "case turn % 8 when 0 then concat(text, '\n> quoted\nmore') when 1 then concat(text, '\nOn Monday A wrote:\nx') when 2 then concat('> first\n', text) when 3 then concat(text, '\n--- ORIGINAL message ----\nx') when 4 then concat(text, '\n-- \nA. Writer') when 5 then concat(text, '\n転送メッセージです\nx') when 6 then concat(text, '\n2024/01/31 Aのメッセージ:\nx\n___') else text end"
QUOTED_DUCK = QUOTED.replace("concat(", "(").replace(", '", " || '").replace("', text)", "' || text)")


@query("x28_split_quote", rf"""
WITH c AS (SELECT conv_id, turn, {QUOTED_DUCK} AS x FROM conversations),
b AS (SELECT *, regexp_split_to_array(x, '(?m)(?:^>[^\n]*$)|(?:^On [^\n]+ wrote:$)|(?:^-{{3,}}[^\n]*(?i:Original Message)[^\n]*-{{3,}}$)|(?:^_{{3,}}$)|(?:^[^\n]*転送メッセージ[^\n]*$)|(?:^\d{{4}}/\d{{2}}/\d{{2}}[^\n]+のメッセージ:$)|(?:^----[^\n]*メッセージ[^\n]*----$)|(?:^-{{2,}}\s*$)')[1] AS before FROM c)
SELECT conv_id, turn, md5(regexp_replace(before, '^\s+|\s+$', '', 'g')) AS body_md5, md5(regexp_replace(substr(x, length(before) + 1), '^\s+|\s+$', '', 'g')) AS quoted_md5 FROM b""")
def x28(t):
    rows = t.conversations.select("conv_id", "turn", X.split_quote(F.expr(QUOTED)).alias("s"))
    return rows.select("conv_id", "turn", F.md5("s.body").alias("body_md5"), F.md5("s.quoted").alias("quoted_md5"))


@query("x30_address", r"SELECT c_custkey, c_name AS name, lower(c_name || '@Mail.example') AS address FROM customer")
def x30(t):
    a = X.address(F.expr("concat('\"', c_name, '\" <', c_name, '@Mail.example>')"))
    return t.customer.select("c_custkey", a["name"].alias("name"), a["address"].alias("address"))


SAID = "'手配しました', '確認しました', '確認中です', '対応できません', '難しい状況です', '一旦待ってください', '追加でお願いします', 'また、よろしく', '保留中', ''"


@query("x31_status_signals", rf"""
WITH x AS (SELECT conv_id, turn, text || ([{SAID}])[((conv_id + 3 * turn) % 10 + 1)::INT] AS x FROM conversations),
s AS (SELECT conv_id, turn, regexp_matches(x, '{"|".join(X.SIGNALS["completed"])}') AS completed, regexp_matches(x, '{"|".join(X.SIGNALS["rejected"])}') AS rejected,
 regexp_matches(x, '{"|".join(X.SIGNALS["on_hold"])}') AS on_hold, regexp_matches(x, '{"|".join(X.SIGNALS["has_new_tasks"])}') AS has_new_tasks FROM x)
SELECT *, CASE WHEN completed THEN 'done' WHEN rejected THEN 'cancelled' WHEN on_hold THEN 'waiting' END AS status FROM s""")
def x31(t):
    said = F.expr(f"concat(text, element_at(array({SAID}), cast((conv_id + 3 * turn) % 10 + 1 as int)))")
    rows = t.conversations.select("conv_id", "turn", X.signals(said).alias("s"))
    return rows.select("conv_id", "turn", "s.*", X.status_of(F.col("s")).alias("status"))


@query("x32_deadline", """
WITH e AS (SELECT event_id, ts, (['by tomorrow', 'this week', 'next week', 'end of month', 'end of next month', 'within 3 days', 'in 2 weeks', 'no date'])[(event_id % 8 + 1)::INT] AS x FROM events),
f AS (SELECT *, ts::DATE AS d FROM e)
SELECT event_id, CASE WHEN x LIKE '%end of next month%' THEN last_day(d + INTERVAL 1 MONTH) + INTERVAL 17 HOUR WHEN x LIKE '%end of month%' THEN last_day(d) + INTERVAL 17 HOUR
 WHEN x LIKE '%next week%' THEN d + (4 - (isodow(d) - 1) + 7)::INT + INTERVAL 17 HOUR WHEN x LIKE '%this week%' THEN d + (4 - (isodow(d) - 1))::INT + INTERVAL 17 HOUR WHEN x LIKE '%tomorrow%' THEN d + 1 + INTERVAL 17 HOUR
 WHEN x LIKE '%3 days%' THEN ts + INTERVAL 3 DAY WHEN x LIKE '%2 weeks%' THEN ts + INTERVAL 14 DAY END::TIMESTAMP AS due FROM f""")
def x32(t):
    x = F.expr("element_at(array('by tomorrow', 'this week', 'next week', 'end of month', 'end of next month', 'within 3 days', 'in 2 weeks', 'no date'), cast(event_id % 8 + 1 as int))")
    return t.events.select("event_id", X.deadline(x, F.col("ts")).alias("due"))


@query("x34_token_estimates", r"""
SELECT doc_id, ((15 * (length(x) - length(regexp_replace(x, '[^\x00-\x7f]', '', 'g'))) + 3 * length(regexp_replace(x, '[^\x00-\x7f]', '', 'g'))) // 10)::BIGINT AS tokens,
 (CASE WHEN length(x) = 0 THEN 0 ELSE (8 * length(regexp_replace(x, '[^　-鿿＀-￯]', '', 'g')) + length(x) - length(regexp_replace(x, '[^　-鿿＀-￯]', '', 'g'))) // 4 + 4 END)::BIGINT AS message_tokens FROM (SELECT doc_id, text || '熱制御。ＴＣＳ' AS x FROM documents)""")
def x34(t):
    x = F.concat("text", F.lit("熱制御。ＴＣＳ"))
    return t.documents.select("doc_id", X.estimate_tokens(x).alias("tokens"), X.estimate_message_tokens(x).alias("message_tokens"))


TAG_RULES = {"action": ["tion", "act"], "history": ["was ", "had"], "place": ["where", "near"]}


@query("x35_auto_tags", "SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'tion') OR contains(lower(text), 'act') THEN 'action' END, CASE WHEN contains(lower(text), 'was ') OR contains(lower(text), 'had') THEN 'history' END, CASE WHEN contains(lower(text), 'where') OR contains(lower(text), 'near') THEN 'place' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents")
def x35(t):
    return t.documents.select("doc_id", F.array_join(X.auto_tags(F.col("text"), TAG_RULES), ",").alias("tags"))


@query("x36_converters", """
SELECT item_id, 'Explain: ' || text AS instruction, CASE WHEN item_id % 2 = 0 THEN 'Shortly.' ELSE '' END AS input, reverse(text) AS output,
 '[system]S[user]Explain: ' || text || CASE WHEN item_id % 2 = 0 THEN chr(10) || chr(10) || 'Shortly.' ELSE '' END || '[assistant]' || reverse(text) AS messages,
 '<start_of_turn>user' || chr(10) || 'Explain: ' || text || CASE WHEN item_id % 2 = 0 THEN chr(10) || chr(10) || 'Shortly.' ELSE '' END || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || reverse(text) || '<end_of_turn>' AS turns FROM benchmark""")
def x36(t):
    i, p, o = F.concat(F.lit("Explain: "), "text"), F.expr("case when item_id % 2 = 0 then 'Shortly.' end"), F.reverse("text")
    m = F.array_join(F.transform(X.chat_messages(i, p, o, "S"), lambda x: F.concat(F.lit("["), x["role"], F.lit("]"), x["content"])), "")
    return t.benchmark.select("item_id", X.alpaca(i, p, o).alias("a"), m.alias("messages"), X.turn_text(i, p, o).alias("turns")).select("item_id", "a.*", "messages", "turns")


@query("x37_subject", "SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS subject FROM conversations")
def x37(t):
    return t.conversations.select("conv_id", "turn", X.subject(F.expr("concat(element_at(array('Re: ', 'FW:', 'Fwd:  ', '転送：'), cast(turn % 4 + 1 as int)), text)")).alias("subject"))


@query("x38_searchable", """
SELECT doc_id, md5(array_to_string(list_filter(['[' || source || ']', CASE WHEN doc_id % 2 = 0 THEN 'Plainly: ' || text ELSE text END, lang || ' ' || source, CASE WHEN doc_id % 3 = 0 THEN 'sum' ELSE '' END], lambda x: x <> ''), chr(10))) AS searchable_md5 FROM documents""")
def x38(t):
    plain = F.expr("case when doc_id % 2 = 0 then concat('Plainly: ', text) else '\n\n' end")
    s = X.searchable(F.col("source"), plain, F.col("text"), F.array("lang", "source"), F.expr("case when doc_id % 3 = 0 then 'sum' else '' end"))
    return t.documents.select("doc_id", F.md5(s).alias("searchable_md5"))
