"""What grows with the tables is not sent to the driver, and equal questions are answered once."""

import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lexweave import registry
from lexweave.operators import eventlog as L
from lexweave.operators import graph as G
from lexweave.operators import guided as D
from lexweave.operators import knowledge as K
from lexweave.operators import postings as P
from lexweave.operators import search as S
from lexweave.operators import segment as C
from lexweave.plans import segment_queries as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equal_questions_meet_parts_once(spark, data):
    """The memory of parts is ranked for each text, not for each supplier."""
    assert "windowspecdefinition(text" in plan(registry.queries()["z11_memory_context"](spark, data))


@pytest.mark.parametrize("text", ["Ab abc  x", "", "a", "😀é ß", None, "zz\nz"])
def test_pairs_are_the_distinct_neighbours(spark, text):
    got = spark.createDataFrame([(text,)], "text string").select(S.pairs_of(F.col("text")).alias("p")).first()["p"]
    low = None if text is None else text.lower()
    assert got == (None if text is None else list(dict.fromkeys(low[i : i + 2] for i in range(len(low) - 1) if low[i : i + 2].strip(" "))))


def test_graph_rounds_broadcast_nothing(spark, monkeypatch):
    plans = []
    plain = G.cut
    monkeypatch.setattr(G, "cut", lambda df, label, **k: plans.append(plan(df)) or plain(df, label, **k))
    nodes = spark.range(40).withColumnRenamed("id", "node")
    edges = spark.range(39).select(F.col("id").alias("from"), (F.col("id") + 1).alias("to")).filter("to % 10 > 0")
    rows = {r["node"]: r["community"] for r in G.communities(edges, nodes).collect()}
    assert {rows[n].split("/")[0] for n in range(10, 20)} == {"10"} and len(set(rows.values())) == 8
    assert not [p for p in plans if "Broadcast" in p]


def test_few_titles_are_looked_for_without_cutting_texts_up(spark, data):
    text = plan(registry.queries()["j10_titles_in_mail"](spark, data))
    assert "Generate" not in text and "Exchange hashpartitioning" not in text


def test_guided_search_makes_no_pairs_of_questions_and_documents(spark, data, monkeypatch):
    written = {}
    plain = D.cut
    monkeypatch.setattr(D, "cut", lambda df, label, **k: written.setdefault(label, plain(df, label, **k)))
    registry.queries()["r17_guided_search"](spark, data)
    assert "candidates" not in written and written["named-targets"].count() <= spark.read.parquet(f"{data}/documents.parquet").select("source").distinct().count()


def test_tags_choose_chunks_and_vectors(spark):
    tags = lambda i: None if i % 7 == 0 else [f"t{i % 3}", f"t{i % 5}"]
    asked = {1: None, 2: ["t0"], 3: ["t1", "t4"], 4: ["nowhere"], 5: []}
    chunks = spark.createDataFrame([(i, ["a"] * (i % 4 + 1) + ["b", f"w{i}"], tags(i)) for i in range(60)], "chunk_id int, tokens array<string>, tags array<string>")
    questions = spark.createDataFrame([(q, ["a", "w8"], t) for q, t in asked.items()], "query_id int, terms array<string>, tags array<string>")
    for form in ("plus", "okapi"):
        every = P.best_by_shard(chunks, questions.filter("query_id = 1"), 100, form=form, shard=7).collect()
        got = P.best_by_shard(chunks, questions, 6, form=form, shard=7, block=2, tags="tags").collect()
        for q, own in asked.items():
            best = sorted((-r["score"], r["chunk_id"]) for r in every if own is None or set(own) & set(tags(r["chunk_id"]) or ()))
            assert [(-r["score"], r["chunk_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == best[:6]
    vectors = spark.createDataFrame([(i, [float(i % 11), 1.0, float(i % 4)], tags(i)) for i in range(60)], "vec_id int, embedding array<double>, tags array<string>")
    q = spark.createDataFrame([(i, [3.0, 1.0, 2.0], t) for i, t in asked.items()], "query_id int, q array<double>, tags array<string>")
    every = S.vector_search(vectors, q.filter("query_id = 1"), 100, digits=9).collect()
    got = S.vector_search(vectors, q, 6, block=30, tags="tags", digits=9).collect()
    for i, own in asked.items():
        best = sorted((-r["score"], r["vec_id"]) for r in every if own is None or set(own) & set(tags(r["vec_id"]) or ()))
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == best[:6]


def test_a_word_of_all_questions_does_not_meet_all_entities(spark):
    rng = random.Random(3)
    names = [f"{rng.choice(('ISO', 'Iso part', 'JIS'))} {rng.randrange(100, 999)}" for _ in range(120)]
    entities = spark.createDataFrame([(f"e{i:03}", n, "STANDARD", f"about {n}", i, f"c{i % 3}") for i, n in enumerate(names)], "id string, name string, type string, description string, first int, community string")
    none = spark.createDataFrame([], "id string, other string"), spark.createDataFrame([], "id string, chunk_id int")
    asked = {q: " ".join(rng.sample(("iso", "part", "jis", "about"), rng.choice((0, 0, 0, 1))) + ["iso", str(rng.randrange(10, 99))]) for q in range(80)} | {80: "iso", 81: "iso iso", 82: "about jis", 83: "iso"}
    questions = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    best, _, _ = K.local_search(questions, K.EntityIndex(entities, none[1], none[0]), k=4)
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in best.collect())
    want = []
    for q, text in asked.items():
        scores = [(2.0 * (text in n.lower()) + (text in f"about {n.lower()}") + 0.5 * sum(w in n.lower() for w in text.split()), i) for i, n in enumerate(names)]
        want += [(q, r, f"e{i:03}", s) for r, (s, i) in enumerate(sorted(((s, i) for s, i in scores if s), key=lambda x: (-x[0], x[1]))[:4], 1)]
    assert got == sorted(want)
    same = spark.createDataFrame([(f"iso {n}",) for n in range(1000, 1200)], "asked string")
    assert K.entities_met(same, F.split("asked", " "), entities, 4).groupBy("asked").count().agg(F.max("count")).first()[0] == 4


@pytest.mark.parametrize("name", ["dml_approvals", "dml_versions_after_cascade"])
def test_the_log_is_folded_in_one_exchange_by_key(spark, data, name):
    """Documents go by key for inserts and for cascades, events once; the state joins nothing."""
    text = plan(registry.queries()[name](spark, data))
    assert len(re.findall(r"Exchange hashpartitioning\(key#", text)) == 3
    assert not re.search(r"SortMergeJoin \[key#|BroadcastHashJoin \[key#", text)


def test_inserts_alone_ask_for_their_parent(spark):
    docs = L.effective(spark.createDataFrame([("A", None, 1, 0, "insert"), ("A", None, 5, 0, "delete")], "key string, parent string, at int, seq int, op string"))
    rows = [("v", "A", 2, 0, "insert", "x", None), ("v", "A", 3, 0, "update", None, "n"), ("w", "A", 0, 0, "insert", "x", None), ("v", "B", 6, 0, "update", "y", None), (None, "A", 2, 0, "insert", "x", None), ("u", "A", 2, 0, "insert", "a", "b"), ("u", "A", 3, 0, "insert", None, "c")]
    made = L.effective(spark.createDataFrame(rows, "key string, parent string, at int, seq int, op string, x string, y string"), docs)
    now = lambda at: {(r["key"], r["x"], r["y"], r["at"]) for r in L.state(made, ["x", "y"], F.lit(at)).collect()}
    # an insert that replaces a row doesn't keep its fields
    assert now(4) == {("v", "x", "n", 3), ("u", None, "c", 3)} and now(9) == set()


def test_children_of_documents_are_those_of_their_sections(spark, data):
    docs = Q.outlined(SimpleNamespace(documents=spark.createDataFrame([(1, "Words of it. " * 90), (2, "no heading"), (3, None), (4, "熱。" * 500)], "doc_id long, text string")))
    own = C.outlined(C.cut_rows(docs, C.sections, "number string, title string, depth int, start bigint, text string").withColumnRenamed("chunk_idx", "pos").drop("start"))
    want = C.child_chunks(own).join(own.select(F.col("chunk_id").alias("parent_id"), F.md5("text").alias("m")), "parent_id")
    want = sorted(tuple(r) for r in want.select("chunk_id", "parent_id", "m", "text").collect())
    assert sorted(tuple(r) for r in C.children_of_documents(docs).collect()) == want and len(want) > 10
    text = plan(registry.queries()["t6_parent_child_search"](spark, data))
    # hits are exchanged, texts are not
    assert "SortMergeJoin" not in text and text.count("MapInArrow") == 1
