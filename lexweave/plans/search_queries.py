"""Retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import guided as D
from ..operators import postings as P
from ..operators import search as S
from ..operators.dimension import small
from ..registry import query
from .text_queries import TOKENS_SQL

QUESTIONS = [(1, ["worthless", "nation", "des"]), (2, ["the", "mit", "ciónes", "the"]), (3, ["que", "onth", "released", "license"])]
QUESTIONS_SQL = "(VALUES (1, 'worthless'), (1, 'nation'), (1, 'des'), (2, 'the'), (2, 'mit'), (2, 'ciónes'), (2, 'the'), (3, 'que'), (3, 'onth'), (3, 'released'), (3, 'license')) q(query_id, term)"
BASE_SQL = f"""
d AS (SELECT doc_id, source, {TOKENS_SQL} AS tokens FROM documents),
q AS (SELECT * FROM {QUESTIONS_SQL}),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d WHERE len(tokens) > 0),
f AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
plus AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY 1, 2),
v AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM f CROSS JOIN s),
okapi AS (SELECT query_id, doc_id, sum(CASE WHEN raw < 0 THEN (SELECT 0.25 * avg(raw) FROM v) ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(tokens)) FROM d)))) AS score FROM q JOIN tf USING (term) JOIN v USING (term) GROUP BY 1, 2)
"""


def chunks(t):
    return t.documents.select("doc_id", "source", "text", X.tokens(F.col("text")).alias("tokens"))


def questions(t):
    return t.spark.createDataFrame(QUESTIONS, "query_id int, terms array<string>")


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names or ("score",)})


@query("a3_corpus_statistics", f"WITH {BASE_SQL} SELECT term, df, n, round(avgdl, 6) AS avgdl FROM f CROSS JOIN s")
def a3(t):
    terms, sizes = S.vocabulary(chunks(t))
    return terms.crossJoin(F.broadcast(sizes)).select("term", "df", F.col("filled").alias("n"), F.round(F.col("total") / F.col("filled"), 6).alias("avgdl"))


@query("r1_bm25_okapi", f"WITH {BASE_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM okapi WHERE score > 0) WHERE rank <= 10")
def r1(t):
    return _round(S.top_k(S.bm25_okapi(chunks(t), questions(t), key="doc_id"), 10, "doc_id"))


@query("r1_bm25_filter_after", f"WITH {BASE_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM okapi JOIN d USING (doc_id) WHERE score > 0 AND contains(source, 'c1')) WHERE rank <= 10")
def r1_filter(t):
    c = chunks(t)
    hits = S.bm25_okapi(c, questions(t), key="doc_id").join(c.filter(F.contains("source", F.lit("c1"))).select("doc_id"), "doc_id", "left_semi")
    return _round(S.top_k(hits, 10, "doc_id").select("query_id", "doc_id", "score", "rank"))


@query("r2_bm25_topk", f"WITH {BASE_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM plus) WHERE rank <= 10")
def r2(t):
    return _round(S.top_k(S.bm25_plus_one(chunks(t), questions(t), key="doc_id", keep_zero=False), 10, "doc_id"))


@query("w1_indexed_topk", f"""WITH {BASE_SQL}, a AS (SELECT 'okapi' AS form, query_id, doc_id, round(score, 9) AS score FROM okapi WHERE score > 0 UNION ALL SELECT 'plus', query_id, doc_id, round(score, 9) FROM plus),
k AS (SELECT *, row_number() OVER (PARTITION BY form, query_id ORDER BY score DESC, doc_id) AS rank FROM a) SELECT form, query_id, doc_id, round(score, 6) AS score FROM k WHERE rank <= 10""")
def w1_indexed(t):
    """One index, made in one pass over the texts, answers both forms; 20 are taken, so that equal scores are cut after rounding."""
    index = P.TextIndex.build(chunks(t), key="doc_id")
    forms = [P.ranked(index, questions(t), 20, form=f, key="doc_id").drop("rank").withColumns({"form": F.lit(f), "score": F.round("score", 9)}) for f in ("okapi", "plus")]
    w = Window.partitionBy("form", "query_id").orderBy(F.desc("score"), "doc_id")
    best = forms[0].unionByName(forms[1]).withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    return _round(best.select("form", "query_id", "doc_id", "score"))


@query("r2_bm25_all_scores", f"WITH {BASE_SQL} SELECT qq.query_id, d.doc_id, round(coalesce(score, 0), 6) AS score FROM d CROSS JOIN (SELECT DISTINCT query_id FROM q) qq LEFT JOIN plus ON plus.query_id = qq.query_id AND plus.doc_id = d.doc_id WHERE len(tokens) > 0")
def r2_all(t):
    return _round(S.bm25_plus_one(chunks(t), questions(t), key="doc_id"))


@query("r3_bm25_filtered_corpus", "WITH " + BASE_SQL.replace("FROM documents", "FROM documents WHERE source = 'src1' OR source = 'src2'") + " SELECT query_id, doc_id, round(score, 6) AS score FROM plus WHERE score > 0")
def r3(t):
    return _round(S.bm25_plus_one(chunks(t).filter(F.col("source").isin("src1", "src2")), questions(t), key="doc_id", keep_zero=False).filter("score > 0"))


@query("r4_keyword_count", "SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'mit')::INT + contains(lower(text), 'que')::INT) AS score FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'mit') OR contains(lower(text), 'que')")
def r4(t):
    return t.documents.select("doc_id", S.keyword_count(F.col("text"), ["the", "mit", "que", "the"]).alias("score")).filter("score > 0")


COS = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % 50 = 0), c AS (SELECT query_id, vec_id, label, list_inner_product(v, q) AS d, sqrt(list_inner_product(v, v)) AS a, sqrt(list_inner_product(q, q)) AS b FROM e CROSS JOIN q)"


def vector_queries(t):
    return t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


TOP = " SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({}){}) WHERE rank <= 10"


@query("r5_cosine_topk", COS + TOP.format("SELECT query_id, vec_id, d / ((a + 1e-10) * (b + 1e-10)) AS score FROM c", " WHERE score >= 0.3"))
def r5(t):
    return _round(S.vector_search(t.embeddings, vector_queries(t), 10, threshold=0.3))


@query("r6_cosine_product", COS + TOP.format("SELECT query_id, vec_id, d / (a * b + 1e-8) AS score FROM c", ""))
def r6(t):
    return _round(S.vector_search(t.embeddings, vector_queries(t), 10, kind="product"))


@query("r7_cosine_zero", COS + TOP.format("SELECT query_id, vec_id, CASE WHEN a = 0 OR b = 0 THEN 0 ELSE d / (a * b) END AS score FROM c", ""))
def r7(t):
    return _round(S.vector_search(t.embeddings, vector_queries(t), 10, kind="zero"))


#: Every document whose id is divisible by 50 asks with its first words, and with the vector of that id.
ASKED_SQL = f"SELECT doc_id AS query_id, list_slice({TOKENS_SQL}, 1, 6) AS terms FROM documents WHERE doc_id % 50 = 0"
RANKS_SQL = f"""WITH {BASE_SQL.replace(f"SELECT * FROM {QUESTIONS_SQL}", f"SELECT query_id, unnest(terms) AS term FROM ({ASKED_SQL})")}, e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), qv AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % 50 = 0),
c AS (SELECT query_id, vec_id AS doc_id, list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q)) + 1e-8) AS score FROM e CROSS JOIN qv),
hit AS (SELECT query_id, 'bm25' AS list, doc_id, round(score, 9) AS score FROM plus UNION ALL SELECT query_id, 'vector', doc_id, round(score, 9) FROM c), ranks AS (SELECT query_id, list, doc_id, score, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, doc_id) AS rank FROM hit),
rrf AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS rrf FROM ranks WHERE rank <= 50 GROUP BY 1, 2)"""


def asking(t):
    return t.documents.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.slice(X.tokens(F.col("text")), 1, 6).alias("terms"))


def rankings(t, k=50):
    # sums of equal terms in another order are equal, so copies of a text tie
    sparse = P.best_by_shard(chunks(t), asking(t), k, key="doc_id").withColumn("list", F.lit("bm25"))
    dense = S.vector_search(t.embeddings, vector_queries(t), k, kind="product").withColumn("score", F.round("score", 9)).withColumnRenamed("vec_id", "doc_id").withColumn("list", F.lit("vector"))
    return sparse.unionByName(dense)


@query("r8_rrf", RANKS_SQL + " SELECT query_id, doc_id, round(rrf, 6) AS rrf FROM rrf")
def r8(t):
    return _round(S.reciprocal_rank_fusion(rankings(t), key="doc_id"), "rrf")


@query("w3_ranks", RANKS_SQL + " SELECT query_id, list, doc_id, rank::INT AS rank FROM ranks WHERE rank <= 50")
def w3(t):
    return rankings(t).select("query_id", "list", "doc_id", "rank")


@query("r9_weighted_fusion", RANKS_SQL + """, h AS (SELECT *, max(score) OVER (PARTITION BY query_id, list) AS best FROM ranks WHERE rank <= 50),
b AS (SELECT query_id, doc_id, score / best AS s FROM h WHERE list = 'bm25' AND best > 0), w AS (SELECT query_id, doc_id, score * 0.9 AS s FROM h WHERE list = 'vector')
SELECT coalesce(b.query_id, w.query_id) AS query_id, coalesce(b.doc_id, w.doc_id) AS doc_id, round(CASE WHEN b.s IS NULL THEN w.s WHEN w.s IS NULL THEN b.s ELSE b.s + 0.5 * w.s END, 6) AS score, CASE WHEN b.s IS NULL THEN 'vector' WHEN w.s IS NULL THEN 'bm25' ELSE 'bm25,vector' END AS methods FROM b FULL JOIN w ON b.query_id = w.query_id AND b.doc_id = w.doc_id""")
def r9(t):
    hits = rankings(t).select("query_id", F.col("list").alias("method"), F.lit(1).alias("batch"), "doc_id", "score")
    return _round(S.weighted_fusion(hits, key="doc_id").withColumn("methods", F.array_join("methods", ",")))


PAIRS = "list_filter(list_distinct(list_transform(range(1, length({0})), lambda i: substr(lower({0}), i, 2))), lambda g: length(g) = 2 AND trim(g) <> '')"


@query("r11_pair_overlap", f"""
WITH q AS (SELECT item_id, {PAIRS.format("text")} AS q FROM benchmark), p AS (SELECT doc_id, {PAIRS.format("text")} AS p FROM documents)
SELECT item_id, doc_id, round(len(list_intersect(q, p)) / len(q), 6) AS overlap FROM q CROSS JOIN p WHERE len(list_intersect(q, p)) > 0""")
def r11(t):
    q = t.benchmark.select("item_id", S.pairs_of(F.col("text")).alias("q"))
    d = t.documents.select("doc_id", F.col("text").alias("p"))
    return S.shared_pairs(q, d, "item_id", "doc_id").withColumn("overlap", F.round("overlap", 6))


RERANK = RANKS_SQL + f""", base AS (SELECT query_id, doc_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM rrf),
texts AS (SELECT doc_id, {PAIRS.format("substr(text, 1, 500)")} AS p FROM documents), qt AS (SELECT query_id, {PAIRS.format("array_to_string(terms, ' ')")} AS g FROM ({ASKED_SQL})),
sc AS (SELECT query_id, doc_id, rank, CASE WHEN rank <= 20 THEN 0.5 * rrf + 0.5 * CASE WHEN len(g) = 0 THEN 0 ELSE len(list_intersect(g, p)) / len(g) END ELSE rrf END AS final FROM base JOIN texts USING (doc_id) JOIN qt USING (query_id)),
pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 20 THEN 0 ELSE 1 END, CASE WHEN rank <= 20 THEN -final ELSE 0 END, rank, doc_id) AS position FROM sc)"""


def reranked(t):
    fused = S.reciprocal_rank_fusion(rankings(t), key="doc_id").withColumnRenamed("rrf", "score")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    hits = fused.withColumn("rank", F.row_number().over(w)).join(t.documents.select("doc_id", "text"), "doc_id")
    hits = hits.join(asking(t).select("query_id", F.array_join("terms", " ").alias("question")), "query_id")
    return S.blend_rerank(hits, F.col("question"), F.col("text"), key="doc_id")


@query("r12_blend_rerank", RERANK + " SELECT query_id, doc_id, round(final, 6) AS score, position::INT AS position FROM pos")
def r12(t):
    return reranked(t).select("query_id", "doc_id", F.round("final", 6).alias("score"), "position")


@query("r13_full_rerank", RERANK + " SELECT query_id, doc_id, round(final, 6) AS score, position::INT AS position FROM pos WHERE position <= 5")
def r13(t):
    return reranked(t).filter("position <= 5").select("query_id", "doc_id", F.round("final", 6).alias("score"), "position")


@query("r14_contextual_hybrid", RANKS_SQL.replace("rank <= 50", "rank <= 150") + " SELECT query_id, doc_id, round(rrf, 6) AS rrf, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM rrf) WHERE rank <= 10")
def r14(t):
    return _round(S.top_k(S.reciprocal_rank_fusion(rankings(t, 150), key="doc_id"), 10, "doc_id", "rrf"), "rrf")


@query("r15_multi_representation", COS + """, r AS (SELECT query_id, vec_id // 4 AS doc_id, CASE label % 4 WHEN 0 THEN 'original' WHEN 1 THEN 'summary' WHEN 2 THEN 'keywords' ELSE 'paraphrase' END AS rep_type, CASE WHEN a = 0 OR b = 0 THEN 0 ELSE d / (a * b) END AS s, vec_id FROM c),
t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 50),
b AS (SELECT query_id, doc_id, rep_type, max(s * CASE rep_type WHEN 'original' THEN 1.0 WHEN 'summary' THEN 0.8 WHEN 'keywords' THEN 0.7 ELSE 0.9 END) AS s FROM t GROUP BY 1, 2, 3)
SELECT query_id, doc_id, round(max(s) + 0.05 * (count(*) - 1), 6) AS score, arg_max(rep_type, s) AS matched_via FROM b GROUP BY 1, 2""")
def r15(t):
    s = S.vector_search(t.embeddings, vector_queries(t), 50, kind="zero").join(t.embeddings.select("vec_id", "label"), "vec_id")
    rep = F.element_at(F.array(*map(F.lit, ("original", "summary", "keywords", "paraphrase"))), (F.col("label") % 4 + 1).cast("int"))
    rows = s.select("query_id", F.expr("vec_id div 4").alias("doc_id"), rep.alias("rep_type"), F.col("score").alias("cosine"))
    return _round(S.multi_representation(rows, {"original": 1.0, "summary": 0.8, "keywords": 0.7, "paraphrase": 0.9}))


#: A map of domains over sources; "nowhere" leads to a source that isn't there.
DOMAINS = [("english", 2, ["the", "and"], ["src1"], ["src2", "src3"]), ("german", 3, ["die", "und"], ["src4"], ["src5"]), ("romance", 4, ["les", "que"], ["src6", "src7"], ["src1"]), ("nowhere", 5, ["onth"], ["src99"], [])]
SYNONYM = ("the", "und")
GUIDED_SQL = f"""WITH {BASE_SQL.replace(f"SELECT * FROM {QUESTIONS_SQL}", f"SELECT query_id, unnest(terms) AS term FROM ({ASKED_SQL})")},
a AS (SELECT query_id, terms, array_to_string(terms, ' ') AS text FROM ({ASKED_SQL})),
dm AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {s}, {w}, {p}, {r})" for n, s, w, p, r in DOMAINS)}) v(domain, spec, kws, prim, rel)),
kw AS (SELECT domain, spec, unnest(kws) AS kw FROM dm), f1 AS (SELECT query_id, domain, spec, sum(CASE WHEN NOT contains(text, kw) THEN 0 WHEN length(kw) / length(text) >= 0.5 THEN 4.0 WHEN length(kw) / length(text) >= 0.2 THEN 2.5 ELSE 1.5 END) AS s FROM a CROSS JOIN kw GROUP BY ALL),
fd AS (SELECT query_id, domain, round((s * (1 + 0.3 * (spec - 1)))::DOUBLE, 2) AS score FROM f1 WHERE s > 0),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, domain) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM fd) WHERE rank <= 2),
tg AS (SELECT DISTINCT query_id, unnest(list_concat(prim, CASE WHEN score >= best * 0.7 THEN rel ELSE [] END)) AS target FROM tp JOIN dm USING (domain)),
al AS (SELECT DISTINCT query_id, d.doc_id FROM tg JOIN d ON contains(d.source, target)),
sy AS (SELECT query_id, unnest(list_transform(terms, lambda x: CASE WHEN x = '{SYNONYM[0]}' THEN '{SYNONYM[1]}' ELSE x END)) AS term FROM a WHERE list_contains(terms, '{SYNONYM[0]}')),
ok2 AS (SELECT query_id, doc_id, sum(CASE WHEN raw < 0 THEN (SELECT 0.25 * avg(raw) FROM v) ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(tokens)) FROM d)))) AS score FROM sy JOIN tf USING (term) JOIN v USING (term) GROUP BY 1, 2),
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), cs AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_inner_product(e.v, q.v) / ((sqrt(list_inner_product(e.v, e.v)) + 1e-10) * (sqrt(list_inner_product(q.v, q.v)) + 1e-10)) AS score FROM e JOIN e q ON q.vec_id % 50 = 0 AND q.vec_id IN (SELECT query_id FROM a) AND e.vec_id IN (SELECT doc_id FROM d)),
h AS (SELECT query_id, 'bm25' AS method, doc_id, round(score, 9) AS score FROM okapi WHERE score > 0 UNION ALL SELECT query_id, 'synonym', doc_id, round(score, 9) FROM ok2 WHERE score > 0 UNION ALL SELECT query_id, 'vector', doc_id, round(score, 9) FROM cs WHERE score >= 0.3),
g1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id, method) AS best FROM h SEMI JOIN al USING (query_id, doc_id)),
g2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id, method) AS best FROM h WHERE query_id NOT IN (SELECT query_id FROM g1)),
g AS (SELECT *, true AS guided FROM g1 WHERE rank <= 5 UNION ALL SELECT *, false FROM g2 WHERE rank <= 5),
p AS (SELECT query_id, doc_id, guided, max(CASE WHEN method = 'bm25' THEN score / best END) AS b, max(CASE WHEN method = 'synonym' THEN 0.8 * score / best END) AS s, max(CASE WHEN method = 'vector' THEN 0.9 * score END) AS v FROM g GROUP BY ALL),
fu AS (SELECT query_id, doc_id, guided, CASE WHEN b IS NOT NULL THEN b + 0.5 * coalesce(s, 0) + 0.5 * coalesce(v, 0) WHEN s IS NOT NULL THEN s + 0.5 * coalesce(v, 0) ELSE v END AS score, array_to_string(list_filter([CASE WHEN b IS NOT NULL THEN 'bm25' END, CASE WHEN s IS NOT NULL THEN 'synonym' END, CASE WHEN v IS NOT NULL THEN 'vector' END], lambda x: x IS NOT NULL), ',') AS methods FROM p),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fu)
SELECT query_id, doc_id, round(score, 6) AS score, methods, rank::INT AS rank, guided, (SELECT domain FROM tp WHERE tp.query_id = rk.query_id AND tp.rank = 1) AS domain, CASE WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM rk WHERE rank <= 5"""


@query("r17_guided_search", GUIDED_SQL)
def r17(t):
    c = chunks(t)
    domains = t.spark.createDataFrame(DOMAINS, "domain string, specificity int, keywords array<string>, primary_docs array<string>, related_docs array<string>")
    asked = asking(t).withColumn("text", F.array_join("terms", " "))

    shards = []

    def ranked(questions, allowed):
        """BM25, BM25 of the question with a synonym, and vectors of documents; the best five of each."""
        if allowed is None:
            questions, own = questions.withColumn("targets", F.lit(None).cast("array<string>")), c.withColumn("targets", F.lit(None).cast("array<string>"))
        else:
            own = c.join(small(allowed.withColumnRenamed("doc", "source")), "source", "left")
            shards.append(P.joined_shards(own, key="doc_id", tags="targets"))
        other = F.transform("terms", lambda x: F.when(x == SYNONYM[0], SYNONYM[1]).otherwise(x))
        expanded = questions.filter(F.array_contains("terms", SYNONYM[0])).withColumn("terms", other)
        both = [q.select(F.struct("query_id", F.lit(m).alias("method")).alias("query_id"), "terms", "targets") for m, q in (("bm25", questions), ("synonym", expanded))]
        worded = P.best_by_shard(own, both[0].unionByName(both[1]), 5, form="okapi", key="doc_id", tags="targets", made=shards[0]).select("query_id.query_id", "query_id.method", "doc_id", "score")
        v = t.embeddings.join(own.groupBy(F.col("doc_id").alias("vec_id")).agg(F.flatten(F.collect_list("targets")).alias("targets")), "vec_id")
        q = vector_queries(t).join(questions.select("query_id", "targets").distinct(), "query_id")
        near = S.vector_search(v, q, 5, threshold=0.3, tags="targets", digits=9).select("query_id", F.lit("vector").alias("method"), F.col("vec_id").alias("doc_id"), "score")
        return worded.unionByName(near).withColumn("batch", F.lit(1))

    out = D.guided_search(asked, c, domains, ranked, k=5, key="doc_id", doc="source", by_target=True)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.array_join("methods", ",").alias("methods"), "rank", "guided", "domain", S.confidence(F.col("score")).alias("confidence"))


@query("w4_per_document_top3", f"WITH {BASE_SQL}, h AS (SELECT query_id, doc_id, source, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS rank FROM plus JOIN d USING (doc_id)) SELECT query_id, source, doc_id, rank::INT AS rank FROM h WHERE rank <= 3")
def w4(t):
    c = chunks(t)
    hits = S.bm25_plus_one(c, questions(t), key="doc_id", keep_zero=False).join(c.select("doc_id", "source"), "doc_id")
    w = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("query_id", "source", "doc_id", "rank")
