"""Knowledge graphs and the entity index, over all documents as chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knowledge as K
from ..registry import query

#: The text of a chunk: a document with a heading, organizations, standards and a definition; names are new every few documents.
BODY = "concat(case when doc_id % 2 = 0 then concat(doc_id % 7 + 1, '.', doc_id % 3, ' Thermal control of it\n') else '' end, text, ' JAXA and ESA: see ISO ', 1000 + doc_id div 3, ', JERG-2-', 300 + doc_id % 40, ', MIL-STD-1553B。「熱制御', doc_id % 5, '」とは、温度を保つことをいう。')"
BODY_DUCK = "(CASE WHEN doc_id % 2 = 0 THEN (doc_id % 7 + 1)::VARCHAR || '.' || (doc_id % 3)::VARCHAR || ' Thermal control of it' || chr(10) ELSE '' END || text || ' JAXA and ESA: see ISO ' || (1000 + doc_id // 3)::VARCHAR || ', JERG-2-' || (300 + doc_id % 40)::VARCHAR || ', MIL-STD-1553B。「熱制御' || (doc_id % 5)::VARCHAR || '」とは、温度を保つことをいう。')"


def chunks(t):
    """Documents as the chunks of 40 standards, in the order of their ids."""
    heading = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("doc_id") % 7 + 1, F.lit("."), F.col("doc_id") % 3))
    other = lambda n: F.concat(F.lit("JERG-2-"), 300 + (F.col("doc_id") + n) % 40)
    return t.documents.select(other(0).alias("doc_id"), F.col("doc_id").alias("position"), F.col("doc_id").alias("chunk_id"), F.expr(BODY).alias("text"), F.concat(F.lit("Standard "), "source").alias("doc_title"), heading.alias("section_number"), F.lit("Thermal control of it").alias("section_title"), F.col("lang").alias("summary"), F.array(other(1), F.lit("JERG-9-999")).alias("cross_refs"))


GRAPH_SQL = rf"""
c AS (SELECT doc_id AS position, 'JERG-2-' || (300 + doc_id % 40)::VARCHAR AS doc, 'JERG-2-' || (300 + (doc_id + 1) % 40)::VARCHAR AS other, 'Standard ' || source AS title, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 7 + 1)::VARCHAR || '.' || (doc_id % 3)::VARCHAR END AS num, lang, {BODY_DUCK} AS x FROM documents),
reg AS (SELECT position, doc, unnest(list_sort(list_distinct(regexp_extract_all(x, 'JERG-\d{{1,2}}-\d{{3}}(?:-[A-Z]+\d+)?') || regexp_extract_all(x, 'MIL-(?:STD|SPEC)-\d+[A-Z]?') || regexp_extract_all(x, 'ECSS-[A-Z]-[A-Z]{{2}}-\d+') || regexp_extract_all(x, 'ISO\s*\d+(?:-\d+)?')))) AS node FROM c),
org AS (SELECT position, doc, unnest(list_sort(list_distinct(regexp_extract_all(x, 'JAXA|宇宙航空研究開発機構') || regexp_extract_all(x, 'NASA|ESA|CNES|DLR') || regexp_extract_all(x, 'ISO\s*\d+|JIS\s*[A-Z]\s*\d+')))) AS node FROM c),
def AS (SELECT position, doc, regexp_extract(d, '「([^\n]{{2,20}})」', 1) AS node, regexp_extract(d, '「[^\n]{{2,20}}」[はとも]?(?:、|　|\s)*([^\n]{{5,80}}?)(?:という|と定義|をいう|である)', 1) AS about
 FROM (SELECT position, doc, unnest(regexp_extract_all(x, '「[^\n]{{2,20}}」[はとも]?(?:、|　|\s)*[^\n]{{5,80}}?(?:という|と定義|をいう|である)')) AS d FROM c)),
sec AS (SELECT num, arg_min(doc, position) AS doc, min(position) AS position, arg_min(lang, position) AS lang FROM c WHERE num IS NOT NULL GROUP BY num),
w AS (SELECT doc AS node, 'Document' AS type, 'title=' || arg_min(title, position) AS props, 0 AS loop, min(position) AS position, 0 AS step FROM c GROUP BY doc
 UNION ALL SELECT doc || '#' || num, 'Section', 'title=Thermal control of it|doc_id=' || doc || '|section_id=' || num || '|level=2|summary=' || coalesce(lang, ''), 1, position, 0 FROM sec
 UNION ALL SELECT node, 'Concept', 'description=|ctype=regulation', 1, position, 1 FROM reg WHERE node <> doc
 UNION ALL SELECT node, 'Concept', 'description=|ctype=organization', 1, position, 2 FROM org
 UNION ALL SELECT node, 'Concept', 'description=' || about || '|ctype=concept', 1, position, 3 FROM def),
n AS (SELECT node, arg_max(type, (loop, position, step)) AS type, arg_max(props, (loop, position, step)) AS props FROM w GROUP BY node),
g AS (SELECT doc AS a, doc || '#' || num AS b, 'CONTAINS' AS type FROM sec UNION ALL SELECT doc, node, 'REFERENCES' FROM reg WHERE node <> doc UNION ALL SELECT doc, node, 'MENTIONS' FROM org UNION ALL SELECT doc, node, 'DEFINES' FROM def
 UNION ALL SELECT doc, other, 'REFERENCES' FROM c WHERE other <> doc AND other IN (SELECT node FROM n))"""


@query("g3_graph_build", f"WITH {GRAPH_SQL} SELECT node, type, props AS properties FROM n")
def g3(t):
    nodes, _ = K.document_graph(chunks(t))
    told = [F.when(F.col("properties")[c].isNotNull(), F.concat(F.lit(f"{c}="), F.col("properties")[c].cast("string"))) for c in K.PROPERTIES]
    return nodes.select("node", "type", F.concat_ws("|", *told).alias("properties"))


@query("g3_graph_edges", f'WITH {GRAPH_SQL} SELECT a AS "from", b AS "to", type, count(*) AS n FROM g GROUP BY ALL')
def g3_edges(t):
    _, edges = K.document_graph(chunks(t))
    return edges.groupBy("from", "to", "type").agg(F.count(F.lit(1)).alias("n"))


JSON_DUCK = "'\"' || replace(replace({}, '\\', '\\\\'), '\"', '\\\"') || '\"'"


@query("k5_cypher", f"""
SELECT 'MERGE (n:Nation {{name: ' || {JSON_DUCK.format("n_name")} || ', rank: ' || n_nationkey::VARCHAR || ', note: ' || {JSON_DUCK.format("'a' || chr(34) || n_name || '\\'")} || ', node_id: "' || n_nationkey::VARCHAR || '"}})' AS statement FROM nation
UNION ALL SELECT 'MATCH (a {{node_id: "' || n_nationkey::VARCHAR || '"}}), (b {{node_id: "r' || n_regionkey::VARCHAR || '"}}) MERGE (a)-[:IN' || CASE WHEN n_nationkey % 2 = 0 THEN ' {{label: "even"}}' ELSE '' END || ']->(b)' FROM nation""")
def k5(t):
    note = F.concat(F.lit('a"'), "n_name", F.lit("\\"))
    nodes = t.nation.select(F.col("n_nationkey").alias("node"), F.lit("Nation").alias("type"), F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("rank"), note.alias("note"), F.lit(None).cast("string").alias("title")).alias("properties"))
    label = F.struct(F.when(F.col("n_nationkey") % 2 == 0, "even").alias("label"))
    return K.cypher(nodes, t.nation.select(F.col("n_nationkey").alias("from"), F.concat(F.lit("r"), "n_regionkey").alias("to"), F.lit("IN").alias("type"), label.alias("properties")))


def entity_index(t):
    """Every standard refers to the next one, but for each seventh."""
    n = F.expr("doc_id div 3")
    relations = t.documents.filter(n % 7 != 6).select(F.concat(F.lit("ISO "), 1000 + n).alias("source"), F.concat(F.lit("iso "), 1001 + n).alias("target"))
    return K.entity_index(chunks(t), relations)


INDEX_SQL = rf"""
c AS (SELECT doc_id AS position, {BODY_DUCK} AS x FROM documents WHERE text IS NOT NULL),
heads AS (SELECT position, 0 AS part, regexp_extract_all(substr(x, 1, 500), '\d+(?:\.\d+)+\s+[^\n。]{{5,40}}') AS l FROM c), stds AS (SELECT position, 1 AS part, regexp_extract_all(x, '(?:JERG|JAXA|JIS|ISO|MIL|IEEE)[- ]?[\p{{L}}\p{{N}}_.-]+') AS l FROM c),
m0 AS (SELECT position, part, unnest(l) AS raw, generate_subscripts(l, 1) AS nth FROM (FROM heads UNION ALL FROM stds)),
m AS (SELECT position, part, nth, CASE part WHEN 0 THEN regexp_extract(raw, '^\d+(?:\.\d+)+') || ' ' || regexp_replace(regexp_replace(raw, '^\d+(?:\.\d+)+', ''), '^\s+|\s+$', '', 'g') ELSE raw END AS name FROM m0),
i AS (SELECT *, substr(md5(lower(name)), 1, 12) AS id FROM m),
en AS (SELECT id, arg_min(name, (position, part, nth)) AS name, arg_min(part, (position, part, nth)) AS part, min((position, part, nth)) AS first, count(*) AS mentions FROM i GROUP BY id),
rl AS (SELECT DISTINCT substr(md5('iso ' || (1000 + doc_id // 3)::VARCHAR), 1, 12) AS a, substr(md5('iso ' || (1001 + doc_id // 3)::VARCHAR), 1, 12) AS b FROM documents WHERE (doc_id // 3) % 7 <> 6),
kn AS (SELECT a, b FROM rl WHERE a IN (SELECT id FROM en) AND b IN (SELECT id FROM en)), s AS (SELECT a, b FROM kn UNION SELECT b, a FROM kn),
r(a, b) AS (SELECT id, id FROM en UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a), co AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a),
k AS (SELECT en.id, en.name, CASE part WHEN 0 THEN 'CONCEPT' ELSE 'STANDARD' END AS type, CASE part WHEN 0 THEN 'セクション: ' ELSE '規格文書: ' END || name AS description, mentions, first, coalesce(d.n, 0) AS degree, component, count(*) OVER (PARTITION BY component) AS size FROM en JOIN co USING (id) LEFT JOIN (SELECT a, count(*) AS n FROM s GROUP BY a) d ON d.a = en.id),
o AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY CASE WHEN size > 5 THEN -degree ELSE 0 END, first) AS k FROM k),
ix AS (SELECT *, component || '/' || CASE WHEN size > 5 AND k > size // 2 THEN '1' ELSE '0' END AS community, CASE WHEN size > 5 AND k > size // 2 THEN k - size // 2 ELSE k END AS place FROM o)"""


@query("g7_entity_index", f"WITH RECURSIVE {INDEX_SQL} SELECT id, name, type, description, mentions, degree, community, place::INT AS place, (SELECT count(DISTINCT position) FROM i WHERE i.id = ix.id) AS n_chunks FROM ix")
def g7(t):
    index = entity_index(t)
    n = index.links.groupBy("id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return index.entities.join(n, "id").select("id", "name", "type", "description", "mentions", "degree", "community", F.col("place").cast("int").alias("place"), "n_chunks")


@query("a15_community_rollup", f"WITH RECURSIVE {INDEX_SQL} SELECT community, count(*) AS n, string_agg(id, ',' ORDER BY place) FILTER (WHERE place <= 10) AS entity_ids, 'エンティティ群: ' || string_agg(name, ', ' ORDER BY place) FILTER (WHERE place <= 5) AS summary, string_agg(name, '|' ORDER BY place) FILTER (WHERE place <= 10) AS keywords FROM ix GROUP BY community")
def a15(t):
    rows = K.community_rollup(entity_index(t))
    return rows.select("community", "n", F.array_join("entity_ids", ",").alias("entity_ids"), "summary", F.array_join("keywords", "|").alias("keywords"))


SEARCH_SQL = f"""{INDEX_SQL},
q AS (SELECT doc_id AS query_id, 'iso ' || (100 + doc_id // 30)::VARCHAR || CASE WHEN doc_id % 100 = 0 THEN ' Thermal' ELSE '' END AS text FROM documents WHERE doc_id % 50 = 0),
sc AS (SELECT query_id, ix.*, contains(lower(name), lower(text))::INT * 2 + contains(lower(description), lower(text))::INT + 0.5 * len(list_filter(string_split(lower(text), ' '), lambda w: contains(lower(name), w))) AS score FROM q CROSS JOIN ix),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM sc WHERE score > 0) WHERE rank <= 5),
nb AS (SELECT query_id, other, row_number() OVER (PARTITION BY query_id ORDER BY other) AS place FROM (SELECT DISTINCT query_id, s.b AS other FROM b JOIN s ON s.a = b.id))"""


@query("r19_entity_search", f"""WITH RECURSIVE {SEARCH_SQL}
SELECT query_id, 'entity' AS part, rank::INT AS place, name, type || ' ' || community || ' ' || round(score, 6)::DOUBLE::VARCHAR AS about FROM b
UNION ALL SELECT query_id, 'neighbour', place::INT, name, type FROM nb JOIN ix ON ix.id = nb.other WHERE nb.place <= 10
UNION ALL SELECT DISTINCT query_id, 'chunk', 0, position::VARCHAR, '' FROM b JOIN i USING (id)""".replace("nb JOIN ix ON ix.id = nb.other WHERE nb.place", "(SELECT nb.query_id, nb.place, ix.name, ix.type FROM nb JOIN ix ON ix.id = nb.other) z WHERE z.place"))
def r19(t):
    n = F.concat(F.lit("iso "), 100 + F.expr("doc_id div 30"), F.when(F.col("doc_id") % 100 == 0, " Thermal").otherwise(""))
    questions = t.documents.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), n.alias("text"))
    best, near, held = K.local_search(questions, entity_index(t))
    a = best.select("query_id", F.lit("entity").alias("part"), F.col("rank").cast("int").alias("place"), "name", F.concat_ws(" ", "type", "community", F.round("score", 6).cast("string")).alias("about"))
    b = near.select("query_id", F.lit("neighbour").alias("part"), F.col("place").cast("int").alias("place"), "name", F.col("type").alias("about"))
    return a.unionByName(b).unionByName(held.select("query_id", F.lit("chunk").alias("part"), F.lit(0).alias("place"), F.col("chunk_id").cast("string").alias("name"), F.lit("").alias("about")))
