"""Graphs: suppliers and parts refer to each other through lineitem; events chain users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expand as E
from ..operators import graph as G
from ..operators.dimension import small
from ..registry import query

EDGES_SQL = "e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 + 1 AS b FROM lineitem)"


def edges(t):
    return t.lineitem.select(F.col("l_suppkey").alias("from"), (F.col("l_partkey") % 100 + 1).alias("to")).distinct()


def nodes(t):
    return t.supplier.select(F.col("s_suppkey").alias("node"))


@query("a2_reference_edges", "SELECT l_suppkey AS \"from\", l_partkey % 100 + 1 AS \"to\", count(DISTINCT l_orderkey) AS count FROM lineitem GROUP BY 1, 2")
def a2(t):
    return G.reference_edges(t.lineitem.select(F.col("l_suppkey").alias("from"), F.col("l_orderkey").alias("chunk"), (F.col("l_partkey") % 100 + 1).alias("to")))


@query("a2_degrees", f"WITH {EDGES_SQL} SELECT s_suppkey AS node, (SELECT count(*) FROM e WHERE a = s_suppkey) AS out_degree, (SELECT count(*) FROM e WHERE b = s_suppkey) AS in_degree FROM supplier")
def a2d(t):
    return G.degrees(nodes(t), edges(t))


@query("a14_hubs", "SELECT l_partkey % 100 + 1 AS node, count(*) AS in_degree FROM lineitem GROUP BY 1 ORDER BY in_degree DESC, node LIMIT 10")
def a14(t):
    return G.hubs(t.lineitem.select((F.col("l_partkey") % 100 + 1).alias("to")), 10)


@query("g1_reach", f"""WITH {EDGES_SQL}, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), h1 AS (SELECT a AS seed, b AS node FROM s WHERE a IN (1, 2) AND a <> b), h2 AS (SELECT DISTINCT seed, s.b AS node FROM h1 JOIN s ON s.a = h1.node)
SELECT seed, node, 1 AS distance FROM h1 UNION ALL SELECT seed, node, 2 FROM h2 WHERE node <> seed AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.seed = h2.seed AND h1.node = h2.node)""")
def g1(t):
    return G.reach(edges(t), nodes(t).filter("node in (1, 2)"), 2)


@query("g2_typed_paths", """
WITH e AS (SELECT l_suppkey AS a, l_partkey % 100 + 1 AS b, l_returnflag AS type FROM lineitem WHERE l_returnflag IN ('A', 'R')),
s AS (SELECT a, b, min(type) AS type FROM (SELECT a, b, type FROM e UNION ALL SELECT b, a, '<-' || type FROM e) GROUP BY 1, 2),
h1 AS (SELECT a AS seed, b AS node, min(type) AS path FROM s WHERE a = 3 AND b <> 3 GROUP BY 1, 2), h2 AS (SELECT seed, s.b AS node, min(path || ' ' || type) AS path FROM h1 JOIN s ON s.a = h1.node GROUP BY 1, 2)
SELECT seed, node, 1 AS distance, path FROM h1 UNION ALL SELECT seed, node, 2, path FROM h2 WHERE node <> seed AND node NOT IN (SELECT node FROM h1)""")
def g2(t):
    e = t.lineitem.select(F.col("l_suppkey").alias("from"), (F.col("l_partkey") % 100 + 1).alias("to"), F.col("l_returnflag").alias("type"))
    return G.paths(e, nodes(t).filter("node = 3"), 2, ["A", "R"])


@query("g4_concept_network", f"WITH {EDGES_SQL} SELECT a AS \"from\", b AS \"to\" FROM e WHERE a <= 10 OR b <= 10")
def g4(t):
    concepts = nodes(t).filter("node <= 10")
    e = edges(t)
    left = e.join(small(concepts.withColumnRenamed("node", "from")), "from", "left_semi").select("from", "to")
    return left.unionByName(e.join(small(concepts.withColumnRenamed("node", "to")), "to", "left_semi").select("from", "to")).distinct()


PR_ROUND = "r{i} AS MATERIALIZED (SELECT s_suppkey AS node, 0.15 / (SELECT count(*) FROM supplier) + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{p} WHERE node NOT IN (SELECT a FROM e)) / (SELECT count(*) FROM supplier)) AS rank FROM supplier LEFT JOIN (SELECT b, sum(rank / deg) AS got FROM e JOIN o USING (a) JOIN r{p} ON r{p}.node = a GROUP BY b) g ON g.b = s_suppkey)"


@query("g5_pagerank", f"WITH {EDGES_SQL.replace('e AS (', 'e AS MATERIALIZED (')}, o AS MATERIALIZED (SELECT a, count(*) AS deg FROM e GROUP BY a), r0 AS MATERIALIZED (SELECT s_suppkey AS node, 1.0::DOUBLE / (SELECT count(*) FROM supplier) AS rank FROM supplier), " + ", ".join(PR_ROUND.format(i=i, p=i - 1) for i in range(1, 21)) + " SELECT node, round(rank, 8) AS rank FROM r20")
def g5(t):
    return G.pagerank(edges(t), nodes(t), rounds=20, tolerance=0).select("node", F.round("rank", 8).alias("rank"))


SPARSE_SQL = "e AS (SELECT DISTINCT o_custkey AS a, o_custkey + 7 AS b FROM orders), n AS (SELECT c_custkey AS node FROM customer), s AS (SELECT a, b FROM e JOIN n ON n.node = b UNION SELECT b, a FROM e JOIN n ON n.node = b), r(node, other) AS (SELECT node, node FROM n UNION SELECT r.node, s.b FROM r JOIN s ON r.other = s.a), c AS (SELECT node, min(other) AS component FROM r GROUP BY node)"


def sparse(t):
    n = t.customer.select(F.col("c_custkey").alias("node"))
    e = t.orders.select(F.col("o_custkey").alias("from"), (F.col("o_custkey") + 7).alias("to")).distinct()
    return e.join(n.withColumnRenamed("node", "to").hint("merge"), "to", "left_semi").join(n.withColumnRenamed("node", "from").hint("merge"), "from", "left_semi").select("from", "to"), n


@query("g6_components", f"WITH RECURSIVE {SPARSE_SQL} SELECT node, component FROM c")
def g6(t):
    e, n = sparse(t)
    return G.components(e, n)


@query("g6_communities", f"WITH RECURSIVE {SPARSE_SQL}, d AS (SELECT n.node, (SELECT count(*) FROM s WHERE a = n.node) AS degree FROM n), k AS (SELECT node, component, count(*) OVER (PARTITION BY component) AS size, row_number() OVER (PARTITION BY component ORDER BY degree DESC, node) AS k FROM c JOIN d USING (node)) SELECT node, component::VARCHAR || '/' || CASE WHEN size > 5 AND k > size // 2 THEN '1' ELSE '0' END AS community FROM k")
def g6c(t):
    e, n = sparse(t)
    return G.communities(e, n)


@query("g9_levels", "SELECT n_nationkey AS task, (n_nationkey // 5)::INT AS level FROM nation")
def g9(t):
    tasks = t.nation.select(F.col("n_nationkey").alias("task"))
    return G.levels(tasks, t.nation.select(F.col("n_nationkey").alias("task"), (F.col("n_nationkey") - 5).alias("on")))


@query("j7_prefix_resolution", "WITH r AS (SELECT DISTINCT substr(p_name, 1, 6) AS ref FROM part), d AS (SELECT DISTINCT p_name AS doc FROM part) SELECT ref, arg_min(doc, (-length(doc), doc)) AS doc FROM r JOIN d ON starts_with(doc, ref) OR starts_with(ref, doc) WHERE ref <> '' GROUP BY ref")
def j7(t):
    return G.resolve_prefix(t.part.select(F.substring("p_name", 1, 6).alias("ref")), t.part.select(F.col("p_name").alias("doc")))


@query("r10_cross_reference_seeds", f"WITH {EDGES_SQL}, h AS (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 3), n AS (SELECT b AS node FROM e WHERE a IN (FROM h) UNION SELECT a FROM e WHERE b IN (FROM h)) SELECT node FROM n WHERE node NOT IN (FROM h) ORDER BY node LIMIT 5")
def r10(t):
    found = t.supplier.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(3).select(F.col("s_suppkey").alias("node"))
    return G.reach(edges(t), found, 1).select("node").distinct().join(found, "node", "left_anti").orderBy("node").limit(5)


SYN = [("the", ["a", "one"]), ("mit", ["with", "und"]), ("que", ["which"])]
SYN_SQL = "(VALUES ('the', 'a'), ('the', 'one'), ('mit', 'with'), ('mit', 'und'), ('que', 'which')) s(term, synonym)"


@query("q1_synonyms", f"SELECT item_id AS query_id, text || coalesce(' ' || (SELECT string_agg(DISTINCT synonym, ' ' ORDER BY synonym) FROM {SYN_SQL} WHERE contains(text, term)), '') AS expanded FROM benchmark")
def q1(t):
    return E.expand_synonyms(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), t.spark.createDataFrame(SYN, "term string, synonyms array<string>"))


@query("j8_containment", f"SELECT item_id, term FROM benchmark JOIN (SELECT DISTINCT term FROM {SYN_SQL}) ON contains(text, term)")
def j8(t):
    return E.contained(t.benchmark, t.spark.createDataFrame([(a,) for a, _ in SYN], "term string")).select("item_id", "term")


@query("q2_substitutions", "SELECT item_id, array_to_string(list_distinct_in_order, '|') AS queries FROM (SELECT item_id, list_filter([text, CASE WHEN contains(text, 'the') THEN replace(text, 'the', 'a') END, CASE WHEN contains(text, 'the') THEN replace(text, 'the', 'one') END, CASE WHEN contains(text, 'que') THEN replace(text, 'que', 'which') END], lambda x: x IS NOT NULL) AS list_distinct_in_order FROM benchmark)")
def q2(t):
    return t.benchmark.select("item_id", F.array_join(E.substitutions(F.col("text"), [SYN[0], SYN[2]]), "|").alias("queries"))


@query("q3_boolean_query", "WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM benchmark), f AS (SELECT item_id, w, min(k) AS k FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k) AS p FROM f) SELECT item_id, string_agg(w, ' OR ' ORDER BY p) AS boolean_query FROM r WHERE p <= 6 GROUP BY item_id")
def q3(t):
    return t.benchmark.select("item_id", E.boolean_query(F.split("text", " ")).alias("boolean_query"))


RULES = [(1, "(?i)license|released", "legal"), (2, "(?i)the|that", "english"), (3, ".", "any")]


@query("j9_first_procedure", "SELECT item_id AS query_id, CASE WHEN regexp_matches(text, '(?i)license|released') THEN 'legal' WHEN regexp_matches(text, '(?i)the|that') THEN 'english' ELSE 'any' END AS rule FROM benchmark WHERE text <> ''")
def j9(t):
    return E.first_procedure(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), t.spark.createDataFrame(RULES, "position int, pattern string, rule string"))


@query("r24_router", """
WITH w AS (SELECT item_id, CASE WHEN regexp_matches(lower(text), '(?i)The') THEN 2.0 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '(?i)AND') THEN 1.0 ELSE 0 END AS a, CASE WHEN regexp_matches(lower(text), '(?i)que|les') THEN 2.5 ELSE 0 END AS b FROM benchmark)
SELECT item_id AS query_id, CASE WHEN a = 0 AND b = 0 THEN 'general' WHEN a >= b THEN 'english' ELSE 'romance' END AS role, round(CASE WHEN a = 0 AND b = 0 THEN 0.3 ELSE least(1.0, 0.4 + 0.1 * abs(a - b)) END, 6)::DOUBLE AS confidence FROM w""")
def r24(t):
    rules = t.spark.createDataFrame([("english", "The", 2.0), ("english", "AND", 1.0), ("romance", "que|les", 2.5)], "role string, pattern string, weight double")
    return E.route(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), rules, "general").withColumn("confidence", F.round("confidence", 6))


@query("r25_complexity", "SELECT item_id, length(text) > 300 OR (regexp_matches(text, 'the')::INT + regexp_matches(text, 'ing')::INT) >= 2 AS is_complex FROM benchmark")
def r25(t):
    return t.benchmark.select("item_id", E.is_complex(F.col("text"), ["the", "ing"], 300).alias("is_complex"))


@query("j16_merge_indexes", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN b.s ELSE a.s + 0.5 * coalesce(b.s, 0) END AS score FROM (SELECT doc_id, n_chars::DOUBLE AS s FROM documents) a FULL JOIN (SELECT doc_id, quality::DOUBLE AS s FROM labels) b ON a.doc_id = b.doc_id")
def j16(t):
    a = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return E.merge_indexes(a, t.labels.select("doc_id", F.col("quality").cast("double").alias("score")), "doc_id")


@query("j10_titles_in_mail", "SELECT conv_id, turn, item_id FROM conversations c JOIN (SELECT item_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS term FROM benchmark) b ON term <> '' AND contains(c.text || CASE WHEN conv_id % 3 = 0 THEN ' re: ' || (SELECT array_to_string(string_split(text, ' ')[1:2], ' ') FROM benchmark WHERE item_id = 1) ELSE '' END, term)")
def j10(t):
    title = F.array_join(F.slice(F.split("text", " "), 1, 2), " ")
    one = t.benchmark.filter("item_id = 1").select(title.alias("one"))
    mail = t.conversations.join(F.broadcast(one)).withColumn("text", F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" re: "), "one")).otherwise(F.col("text")))
    return E.contained(mail, t.benchmark.select("item_id", title.alias("term"))).select("conv_id", "turn", "item_id")


@query("r16_domains", """
WITH q AS (SELECT item_id AS query_id, text, length(text) AS n FROM benchmark), k AS (SELECT * FROM (VALUES ('law', 4, 'license', false), ('law', 4, 'the MIT', false), ('talk', 3, 'the', true), ('talk', 3, 'que', false), ('speech', 2, 'que', false)) v(domain, spec, kw, has_longer)),
s AS (SELECT query_id, domain, spec, sum(CASE WHEN NOT contains(text, kw) THEN 0 WHEN kw = 'the' AND contains(text, 'the MIT') THEN 0.1 ELSE
 CASE WHEN length(kw) / n >= 0.5 THEN CASE WHEN kw = 'que' AND spec = 2 THEN 2.0 ELSE 4.0 END WHEN length(kw) / n >= 0.2 THEN CASE WHEN kw = 'que' AND spec = 2 THEN 1.5 ELSE 2.5 END ELSE CASE WHEN kw = 'que' AND spec = 2 THEN 0.8 ELSE 1.5 END END END) AS s FROM q CROSS JOIN k GROUP BY 1, 2, 3)
SELECT query_id, domain, round((s * (1 + 0.3 * (spec - 1)))::DOUBLE, 2) AS score FROM s WHERE s > 0""")
def r16(t):
    domains = t.spark.createDataFrame([("law", 4, ["license", "the MIT"]), ("talk", 3, ["the", "que"]), ("speech", 2, ["que"])], "domain string, specificity int, keywords array<string>")
    return E.detect_domains(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), domains)
