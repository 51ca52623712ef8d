"""Dataset checks over documents and pages, and file-like sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dataset as D
from ..operators.dimension import small
from ..registry import query

FP = r"md5(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'))"


@query("f7_problems", "SELECT doc_id, 'short' AS problem FROM documents WHERE length(text) < 100 UNION ALL SELECT doc_id, 'long' FROM documents WHERE length(text) > 8000 UNION ALL SELECT doc_id, 'no_line' FROM documents WHERE NOT contains(text, chr(10))")
def f7(t):
    x = F.col("text")
    return D.problems(t.documents, "doc_id", {"short": F.length(x) < 100, "long": F.length(x) > 8000, "no_line": ~F.contains(x, F.lit("\n"))})


@query("f8_integrity", "SELECT 'unlabelled' AS issue, count(*) AS n FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT 'empty', count(*) FROM documents WHERE trim(text) = '' UNION ALL SELECT 'no_vector', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def f8(t):
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("issue"), "n")
    d = t.documents.select("doc_id", "text")
    return count("unlabelled", d.join(t.labels, "doc_id", "left_anti")).unionByName(count("empty", d.filter("trim(text) = ''"))).unionByName(count("no_vector", d.join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")))


@query("f1_substring_filter", "SELECT doc_id FROM documents WHERE contains(source, 'c1')")
def f1(t):
    return t.documents.filter(F.contains("source", F.lit("c1"))).select("doc_id")


@query("f2_optional_filters", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE source = 'src3' AND quality <= 1")
def f2(t):
    return t.documents.filter("source = 'src3'").join(t.labels.filter("quality <= 1"), "doc_id").select("doc_id")


@query("f6_dated_predicate", "SELECT o_orderkey FROM orders WHERE o_orderdate IS NOT NULL AND o_orderdate <= TIMESTAMP '1996-01-01'")
def f6(t):
    return t.orders.filter(F.col("o_orderdate").isNotNull() & (F.col("o_orderdate") <= F.lit("1996-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("f10_category_filter", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#11', 'Brand#2') OR contains(p_type, 'BRASS')")
def f10(t):
    return t.part.filter(F.col("p_brand").isin("Brand#1", "Brand#11", "Brand#2") | F.contains("p_type", F.lit("BRASS"))).select("p_partkey")


@query("a1_document_list", "SELECT source, count(*) AS chunk_count, min(doc_id) AS first_chunk FROM documents GROUP BY source")
def a1(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("chunk_count"), F.min("doc_id").alias("first_chunk"))


@query("a4_section_entries", "SELECT doc_id // 5 AS section, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS text_md5, string_agg(DISTINCT lang, ',' ORDER BY lang) AS keywords, arg_min(source, doc_id) AS title, count(*) AS n_chunks FROM documents GROUP BY 1")
def a4(t):
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    out = t.documents.groupBy(F.expr("doc_id div 5").alias("section")).agg(parts.alias("p"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("keywords"), F.min_by("source", "doc_id").alias("title"), F.count(F.lit(1)).alias("n_chunks"))
    return out.select("section", F.md5(F.array_join(F.transform("p", lambda s: s["text"]), "\n\n")).alias("text_md5"), "keywords", "title", "n_chunks")


@query("a5_level_statistics", "SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM documents GROUP BY lang ORDER BY n DESC LIMIT 5")
def a5(t):
    by = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("all"))
    return by.crossJoin(small(total)).select("lang", "n", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("percent")).orderBy(F.desc("n")).limit(5)


RECORDS_SQL = "SELECT doc_id, 'Q' || (doc_id % 150)::VARCHAR AS instruction, CASE WHEN doc_id % 5 > 0 THEN source || ' ' || lang END AS input, text || CASE WHEN doc_id % 9 = 0 THEN ' ```x```' WHEN doc_id % 7 = 0 THEN ' 熱制御' WHEN doc_id % 11 = 0 THEN ' import os' ELSE '' END AS output FROM documents"


def records(t):
    k = F.col("doc_id")
    more = F.when(k % 9 == 0, " ```x```").when(k % 7 == 0, " 熱制御").when(k % 11 == 0, " import os").otherwise("")
    return t.documents.select("doc_id", F.concat(F.lit("Q"), k % 150).alias("instruction"), F.when(k % 5 > 0, F.concat_ws(" ", "source", "lang")).alias("input"), F.concat("text", more).alias("output"))


@query("a6_dataset_statistics", f"""WITH r AS ({RECORDS_SQL}), k AS (SELECT *, contains(output, '```') OR contains(output, 'def ') OR contains(output, 'import ') AS code, regexp_matches(output, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]') AS jp FROM r)
SELECT count(*)::BIGINT AS total_records, min(length(output))::INT AS output_len_min, max(length(output))::INT AS output_len_max, round(avg(length(output)), 6) AS output_len_avg, list_sort(list(length(output)))[(count(*) // 2 + 1)::INT]::INT AS output_len_median, round(avg(length(coalesce(input, ''))), 6) AS input_len_avg,
 count(*) FILTER (WHERE code) AS code_block_count, round(count(*) FILTER (WHERE code) / count(*) * 100, 6) AS code_block_ratio_pct, count(*) FILTER (WHERE jp) AS japanese_output_count, round(count(*) FILTER (WHERE jp) / count(*) * 100, 6) AS japanese_output_ratio_pct, (SELECT count(*) FROM (SELECT instruction FROM r GROUP BY 1 HAVING count(*) > 1)) AS duplicate_instructions_count FROM k""")
def a6(t):
    told = D.dataset_statistics(records(t))
    return told.withColumns({c: F.round(c, 6) for c, kind in told.dtypes if kind == "double"})


@query("a6_repeated_instructions", f"SELECT instruction, count(*) AS n FROM ({RECORDS_SQL}) GROUP BY 1 HAVING count(*) > 1 ORDER BY min(doc_id) LIMIT 5")
def a6_repeated(t):
    return D.repeated_instructions(records(t), "doc_id")


@query("a7_duplicate_groups", f"SELECT {FP} AS fingerprint, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def a7(t):
    return D.duplicate_groups(t.documents, X.fingerprint(F.col("text")), "doc_id")


@query("a7_unique_ratio", f"SELECT round(count(DISTINCT {FP}) / count(*), 6) AS ratio, count(DISTINCT {FP}) / count(*) >= 0.9 AS passed FROM documents")
def a7_ratio(t):
    u = t.documents.agg((F.count_distinct(X.fingerprint(F.col("text"))) / F.count(F.lit(1))).alias("r"))
    return u.select(F.round("r", 6).alias("ratio"), (F.col("r") >= 0.9).alias("passed"))


@query("d2_keep_first", f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {FP} ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def d2(t):
    rows = t.documents.select("doc_id", "source", X.fingerprint(F.col("text")).alias("fp"))
    return D.keep_first(rows, F.col("fp"), ["doc_id"]).select("doc_id", "source")


@query("d1_concat_sources", "SELECT doc_id AS id, text, 'documents' AS origin FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark")
def d1(t):
    a = t.documents.select(F.col("doc_id").alias("id"), "text", F.lit("documents").alias("origin"))
    return a.unionByName(t.benchmark.select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("origin")), allowMissingColumns=True)


@query("d3_difference", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def d3(t):
    return t.embeddings.select("vec_id").join(t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@query("d4_intersection", "SELECT item_id, len(list_intersect(list_distinct(string_split(lower(text), ' ')), ['the', 'and', 'que', 'der', 'les']))::INT AS common FROM benchmark")
def d4(t):
    return t.benchmark.select("item_id", F.size(F.array_intersect(F.split(F.lower("text"), " "), F.array(*map(F.lit, ("the", "and", "que", "der", "les"))))).alias("common"))


@query("d5_union_of_sets", "SELECT conv_id, string_agg(DISTINCT x, ',' ORDER BY x) AS members FROM (SELECT conv_id, unnest([role, 'turn' || (turn % 2)::VARCHAR]) AS x FROM conversations) GROUP BY conv_id")
def d5(t):
    # a set, partly formed before the exchange, holds each member once however many turns name it
    members = t.conversations.select("conv_id", F.explode(F.array("role", F.concat(F.lit("turn"), (F.col("turn") % 2).cast("string")))).alias("x"))
    return members.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("members"))


@query("d6_split", "WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42' || doc_id::VARCHAR)) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= floor(n * 0.85) THEN 'train' WHEN k <= floor(n * 0.85) + floor(n * 0.10) THEN 'val' ELSE 'test' END AS split FROM k")
def d6(t):
    return D.split_parts(t.documents.select("doc_id"), F.col("doc_id").cast("string")).select("doc_id", "split")


@query("s16_grep", "SELECT page_id, n AS line_number, line FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS n FROM pages) WHERE regexp_matches(line, '(?i)href=\"/(the|que|ch)[^\"]*\"') ORDER BY page_id, line_number LIMIT 50")
def s16(t):
    rows = t.pages.select("page_id", F.posexplode(F.split("html", "\n")).alias("n", "line"))
    hit = rows.filter(F.col("line").rlike('(?i)href="/(the|que|ch)[^"]*"')).select("page_id", (F.col("n") + 1).cast("long").alias("line_number"), "line")
    return hit.orderBy("page_id", "line_number").limit(50)


@query("s11_vector_alignment", "SELECT vec_id, label, lang FROM embeddings JOIN documents ON doc_id = vec_id")
def s11(t):
    return t.embeddings.select("vec_id", "label").join(t.documents.select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id")


@query("s15_incremental", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def s15(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("z18_before_after", "SELECT doc_id, length(text)::INT AS before, length(trim(text))::INT AS after FROM documents ORDER BY doc_id LIMIT 10")
def z18(t):
    return t.documents.select("doc_id", F.length("text").alias("before"), F.length(F.trim("text")).alias("after")).orderBy("doc_id").limit(10)
