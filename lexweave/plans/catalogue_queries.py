"""Glossaries, catalogues and small record operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import expand as E
from ..operators import glossary as G
from ..operators import ranking
from ..operators import segment as S
from ..operators.dimension import small
from ..registry import query
from .record_queries import ORDER, TASKS_SQL, tasks

ABBR = [("MIT", "Institute of Technology", "law"), ("THE", "Thermal Head End", "heat"), ("ER", "Entity Relation", "data"), ("AND", "Any Node Down", "data")]
ABBR_SQL = "(VALUES ('MIT', 'Institute of Technology', 'law'), ('THE', 'Thermal Head End', 'heat'), ('ER', 'Entity Relation', 'data'), ('AND', 'Any Node Down', 'data')) a(abbr, full_, category)"
TERMS = [("license", "permit", "law"), ("that", "which", "data"), ("con", "with", "heat")]
TERMS_SQL = "(VALUES ('license', 'permit', 'law'), ('that', 'which', 'data'), ('con', 'with', 'heat')) m(term, english, category)"
ALONE = "contains(text, abbr) AND regexp_matches(text, '(^|[^A-Za-z])' || abbr || '($|[^A-Za-z0-9])')"


def abbreviations(t):
    return t.spark.createDataFrame(ABBR, "abbr string, full string, category string")


def terms(t):
    return t.spark.createDataFrame(TERMS, "term string, english string, category string")


def asked(t):
    return t.documents.select(F.col("doc_id").alias("query_id"), "text")


@query("q5_abbreviations", f"SELECT doc_id AS query_id, abbr, full_ AS \"full\" FROM documents JOIN {ABBR_SQL} ON {ALONE}")
def q5(t):
    return G.abbreviations_in(asked(t), abbreviations(t).drop("category"), "query_id")


SPACE_TERMS = [(1, "熱制御", "Thermal control", "TCS", ["温度管理", "heat control"]), (2, "熱設計", "thermal design", None, ["heat"]), (3, "姿勢", "attitude", "ACS", []), (4, "熱", "thermal", None, None)]
SPACE_SQL = "(VALUES (1, ['熱制御', 'Thermal control', '温度管理', 'heat control'], 'Thermal control', 'TCS'), (2, ['熱設計', 'thermal design', 'heat'], 'thermal design', ''), (3, ['姿勢', 'attitude'], 'attitude', 'ACS'), (4, ['熱', 'thermal'], 'thermal', '')) v(position, names, english, abbr)"
SHORT = "case doc_id % 6 when 0 then 'Thermal' when 1 then 'tcs' when 2 then 'heat' when 3 then '熱' when 4 then concat('MIT and AND of ', source) else text end"
SHORT_SQL = SHORT.replace("concat('MIT and AND of ', source)", "'MIT and AND of ' || source")


@query("q6_enhance", f"""
WITH q AS (SELECT doc_id AS query_id, {SHORT_SQL} AS text FROM documents),
a AS (SELECT query_id, text || coalesce(' ' || (SELECT string_agg(abbr || ': ' || full_, '; ' ORDER BY list_position(['MIT', 'THE', 'ER', 'AND'], abbr)) FROM {ABBR_SQL} WHERE {ALONE}), '') AS x, text FROM q),
m AS (SELECT query_id, english, row_number() OVER (PARTITION BY query_id ORDER BY position) AS k FROM q JOIN {SPACE_SQL} ON len(list_filter(names, lambda n: contains(lower(n), lower(text)))) > 0 OR (abbr <> '' AND lower(abbr) = lower(text))),
b AS (SELECT a.query_id, CASE WHEN e.english IS NULL OR contains(lower(x), lower(e.english)) THEN x ELSE x || ' ' || e.english END AS x FROM a LEFT JOIN m e ON e.query_id = a.query_id AND e.k = 1),
c AS (SELECT b.query_id, CASE WHEN e.english IS NULL OR contains(lower(x), lower(e.english)) THEN x ELSE x || ' ' || e.english END AS x FROM b LEFT JOIN m e ON e.query_id = b.query_id AND e.k = 2)
SELECT query_id, md5(x) AS enhanced_md5 FROM c""")
def q6(t):
    asked = t.documents.select(F.col("doc_id").alias("query_id"), F.expr(SHORT).alias("text"))
    abbr = t.spark.createDataFrame([(i, a, f) for i, (a, f, _) in enumerate(ABBR)], "position int, abbr string, full string")
    known = t.spark.createDataFrame(SPACE_TERMS, "position int, name string, english string, abbr string, synonyms array<string>")
    return G.enhance(asked, abbr, known).select("query_id", F.md5("enhanced").alias("enhanced_md5"))


@query("q7_lookup", f"SELECT n_name AS name, full_ AS \"full\" FROM (SELECT n_name FROM nation UNION ALL SELECT 'mit' UNION ALL SELECT 'Er') LEFT JOIN {ABBR_SQL} ON abbr = upper(n_name)")
def q7(t):
    names = t.nation.select(F.col("n_name").alias("name")).unionByName(t.spark.createDataFrame([("mit",), ("Er",)], "name string"))
    return G.lookup(names, abbreviations(t).select("abbr", "full"))


@query("q8_glossary_header", f"SELECT doc_id AS query_id, 'Terms: ' || string_agg(abbr || ' = ' || full_, '; ' ORDER BY abbr) AS header FROM documents JOIN {ABBR_SQL} ON {ALONE} GROUP BY doc_id")
def q8(t):
    found = G.abbreviations_in(asked(t), abbreviations(t).drop("category"), "query_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.concat("abbr", F.lit(" = "), "full"))).alias("x"))
    return found.select("query_id", F.concat(F.lit("Terms: "), F.array_join("x", "; ")).alias("header"))


@query("q9_add_synonym", "SELECT * FROM (VALUES ('the', 'a,one,that'), ('mit', 'with'), ('new', 'that')) v(term, synonyms) WHERE term <> 'new'")
def q9(t):
    rows = t.spark.createDataFrame([("the", ["a", "one"]), ("mit", ["with"])], "term string, synonyms array<string>")
    return G.add_synonym(G.add_synonym(rows, "the", "that"), "the", "one").select("term", F.array_join("synonyms", ",").alias("synonyms"))


@query("q4_query_list", "SELECT item_id, array_to_string(list_filter([text, CASE WHEN lower(text) <> text THEN lower(text) END], lambda x: x IS NOT NULL), '|') AS queries FROM benchmark")
def q4(t):
    return t.benchmark.select("item_id", F.array_join(F.array_distinct(F.array("text", F.lower("text"))), "|").alias("queries"))


@query("a16_glossary_text", "SELECT n_regionkey, string_agg(n_name || ': ' || n_nationkey::VARCHAR, chr(10) ORDER BY n_name || ': ' || n_nationkey::VARCHAR) AS text, count(*) AS n FROM nation GROUP BY n_regionkey")
def a16(t):
    return G.grouped_text(t.nation.withColumn("k", F.col("n_nationkey").cast("string")), "n_regionkey", "n_name", "k")


@query("a17_keyword_specificity", "SELECT w AS keyword, max(p_size)::INT AS specificity FROM (SELECT unnest(string_split(p_name, ' ')) AS w, p_size FROM part) GROUP BY w")
def a17(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("keyword"), "p_size").groupBy("keyword").agg(F.max("p_size").alias("specificity"))


@query("a19_router_statistics", "SELECT event_type AS role, count(*) AS n, round(sum(value), 4) AS latency FROM events GROUP BY event_type")
def a19(t):
    return t.events.groupBy(F.col("event_type").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("latency"))


@query("r18_category_score", f"""WITH a AS (SELECT doc_id AS query_id, category, 2 * count(*) AS a FROM documents JOIN {ABBR_SQL} ON {ALONE} GROUP BY 1, 2), m AS (SELECT doc_id AS query_id, category, count(*) AS t FROM documents JOIN {TERMS_SQL} ON contains(text, term) GROUP BY 1, 2)
SELECT coalesce(a.query_id, m.query_id) AS query_id, coalesce(a.category, m.category) AS category, coalesce(t, a) AS score FROM a FULL JOIN m ON a.query_id = m.query_id AND a.category = m.category""")
def r18(t):
    return G.category_score(asked(t), abbreviations(t), terms(t))


@query("r20_community_search", "SELECT doc_id // 8 AS community, round(contains(lower(string_agg(text, ' ' ORDER BY doc_id)), 'the')::INT + contains(lower(string_agg(text, ' ' ORDER BY doc_id)), 'que')::INT + 0.5 * count(DISTINCT lang) FILTER (contains(lang, 'e')), 6)::DOUBLE AS score FROM documents GROUP BY 1 ORDER BY score DESC, community LIMIT 5")
def r20(t):
    texts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    c = t.documents.groupBy(F.expr("doc_id div 8").alias("community")).agg(F.array_join(F.transform(texts, lambda s: s["text"]), " ").alias("summary"), F.collect_set("lang").alias("keywords"))
    return G.community_score(c, ["the", "que"], "e").select("community", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "community").limit(5)


@query("w5_latest_by_version", "SELECT p_brand AS doc, max((p_size % 5, p_size, p_partkey))[3]::BIGINT AS p_partkey FROM part GROUP BY p_brand".replace("max((p_size % 5, p_size, p_partkey))[3]::BIGINT", "arg_max(p_partkey, [p_size % 5, p_size, p_partkey])"))
def w5(t):
    files = t.part.select(F.col("p_brand").alias("doc"), "p_partkey", X.version_parts(F.concat(F.lit("v"), (F.col("p_size") % 5).cast("string"), F.lit("."), F.col("p_size").cast("string"))).alias("parts"))
    return G.latest_by_version(files, "doc", "parts", "p_partkey").select("doc", "p_partkey")


@query("w7_version_history", f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)})::INT AS seq, l_shipdate FROM lineitem")
def w7(t):
    return ranking.numbered(t.lineitem.select("l_orderkey", *ORDER), ["l_orderkey"], ORDER, "seq").select("l_orderkey", F.col("seq").cast("int").alias("seq"), "l_shipdate")


@query("f3_threshold", "SELECT doc_id, n_chars / 1000 AS score FROM documents WHERE n_chars / 1000 >= 3")
def f3(t):
    return t.documents.select("doc_id", (F.col("n_chars") / 1000).alias("score")).filter("score >= 3")


@query("f9_nodes_by_type", "SELECT n_nationkey AS node, 'Nation' AS type FROM nation")
def f9(t):
    nodes = t.nation.select(F.col("n_nationkey").alias("node"), F.lit("Nation").alias("type")).unionByName(t.region.select(F.col("r_regionkey").alias("node"), F.lit("Region").alias("type")))
    return nodes.filter("type = 'Nation'")


@query("s6_file_digest", "SELECT page_id, sha256(html) AS sha256, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS extension, strlen(html)::INT AS size FROM pages")
def s6(t):
    return t.pages.select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("sha256"), F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), F.octet_length("html").alias("size"))


@query("z3_task_documents", f"WITH {TASKS_SQL} SELECT assignee, md5(string_agg(title || ' [' || status || ']', chr(10) ORDER BY task_id)) AS listing_md5 FROM u GROUP BY assignee")
def z3(t):
    rows = F.array_sort(F.collect_list(F.struct("task_id", F.concat("title", F.lit(" ["), "status", F.lit("]")).alias("x"))))
    return tasks(t).groupBy("assignee").agg(F.md5(F.array_join(F.transform(rows, lambda s: s["x"]), "\n")).alias("listing_md5"))


@query("z4_summarised_list", "SELECT source, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source ORDER BY source")
def z4(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars")).orderBy("source")


@query("z5_knowledge_summary", "SELECT n_regionkey AS category, array_to_string(list_slice(list_sort(list(n_name)), 1, 5), ', ') AS first_terms FROM nation WHERE n_regionkey NOT IN (0) GROUP BY n_regionkey")
def z5(t):
    names = F.slice(F.array_sort(F.collect_list("n_name")), 1, 5)
    return t.nation.filter("n_regionkey <> 0").groupBy(F.col("n_regionkey").alias("category")).agg(F.array_join(names, ", ").alias("first_terms"))


@query("z6_put_terms", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (3, 99) UNION ALL SELECT 3, 'NEW' UNION ALL SELECT 99, 'ADDED'")
def z6(t):
    new = t.spark.createDataFrame([(3, "NEW"), (99, "ADDED")], "n_nationkey int, n_name string")
    return G.put(t.nation.select("n_nationkey", "n_name"), new, "n_nationkey")


@query("z14_first_available", "SELECT s_nationkey, coalesce(arg_min(s_name, s_suppkey) FILTER (s_acctbal > 5000), 'fallback') AS model FROM supplier GROUP BY s_nationkey")
def z14(t):
    c = t.supplier.select("s_nationkey", F.col("s_name").alias("model"), F.col("s_suppkey").alias("priority"), (F.col("s_acctbal") > 5000).alias("healthy"))
    return G.first_available(c, "s_nationkey", "fallback")


@query("z15_parse_plan", "SELECT item_id, 'Goal ' || item_id::VARCHAR AS goal, 'good' AS success_criteria, 'look>q' || item_id::VARCHAR || '>hits;read it>-> ;note ' || item_id::VARCHAR || '>-> all' AS steps FROM benchmark")
def z15(t):
    k = F.col("item_id").cast("string")
    text = F.concat(F.lit("- not a step\nGOAL: first\nGOAL: Goal "), k, F.lit("\n  SUCCESS_CRITERIA: good\nsteps below\nSTEPS:\n\n1. look | search: q"), k, F.lit(" | Expect: hits\nno step\n2) read it | SEARCH: none\n- note "), k, F.lit(" | SEARCH: NONE | EXPECT: all\n"))
    p = t.benchmark.select("item_id", G.parse_plan(text).alias("p"))
    step = lambda s: F.concat(s["description"], F.lit(">"), F.coalesce(s["search"], F.lit("-")), F.lit(">"), F.when(s["search"].isNull(), F.concat(F.lit(" "), s["expect"])).otherwise(s["expect"]))
    return p.select("item_id", "p.goal", "p.success_criteria", F.array_join(F.transform("p.steps", step), ";").alias("steps"))


@query("z16_step_digest", "SELECT conv_id, md5(string_agg(substr(text, 1, 200), chr(10) ORDER BY turn)) AS digest_md5 FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def z16(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 200).alias("x"))))
    return t.conversations.filter("role = 'assistant'").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(rows, lambda s: s["x"]), "\n")).alias("digest_md5"))


@query("z22_offline_answers", f"WITH {TASKS_SQL} SELECT item_id, CASE WHEN contains(text, 'the') THEN 'overdue: ' || (SELECT count(*) FROM u WHERE status = 'overdue')::VARCHAR WHEN contains(text, 'de') THEN 'done: ' || (SELECT count(*) FROM u WHERE status = 'done')::VARCHAR ELSE 'tasks: ' || (SELECT count(*) FROM u)::VARCHAR END AS answer FROM benchmark")
def z22(t):
    u = tasks(t).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "overdue").alias("late"), F.count_if(F.col("status") == "done").alias("done"))
    say = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))
    answer = F.when(F.contains("text", F.lit("the")), say("overdue", "late")).when(F.contains("text", F.lit("de")), say("done", "done")).otherwise(say("tasks", "n"))
    return t.benchmark.crossJoin(small(u)).select("item_id", answer.alias("answer"))


@query("j8_glossary_domains", f"SELECT item_id AS query_id, term FROM benchmark JOIN {TERMS_SQL} ON contains(text, term)")
def j8g(t):
    return E.contained(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), terms(t)).select("query_id", "term")
