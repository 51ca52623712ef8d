"""The persisted index: results of scoring everything, from fewer folders, blocks and shards."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lexweave import registry
from lexweave.operators import postings as P
from lexweave.operators import search as S


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, rng.choices(words, weights, k=rng.randint(0, 30))) for i in range(400)]
    rows += [(400, []), (401, []), (402, ["only", "only"]), (None, ["w0", "w299"]), (403, ["w1"] * 5000)]
    queries = [(1, ["w0", "w1", "w0"]), (2, ["w250", "w7"]), (3, ["only"]), (4, ["unknown"]), (5, []), (6, ["w3", None])]
    return spark.createDataFrame(rows, "k int, tokens array<string>").repartition(3).cache(), spark.createDataFrame(queries, "query_id int, terms array<string>")


def rows(df):
    return sorted(((r["query_id"], r["rank"], r["k"], round(r["score"], 8)) for r in df.collect()), key=str)


@pytest.mark.parametrize("form", ["okapi", "plus"])
@pytest.mark.parametrize("shard,first,terms", [(4096, 2, 2000), (17, 1, 2000), (5, 3, 0)])
def test_same_as_scoring_everything(corpus, monkeypatch, form, shard, first, terms):
    chunks, queries = corpus
    monkeypatch.setattr(P, "MOST_TERMS", terms)
    whole = S.bm25_okapi(chunks, queries, key="k") if form == "okapi" else S.bm25_plus_one(chunks, queries, key="k", keep_zero=False)
    index = P.TextIndex.build(chunks, key="k", shard=shard)
    # equal sums in another order may differ in their last digits, so ties are compared after rounding
    want = S.top_k(whole.withColumn("score", F.round("score", 9)), 400, "k")
    got = S.top_k(P.ranked(index, queries, 400, form=form, key="k", first=first).drop("rank").withColumn("score", F.round("score", 9)), 400, "k")
    assert rows(got) == rows(want)


def test_kept_index_is_read_by_folders_and_terms(spark, corpus, tmp_path):
    chunks, queries = corpus
    path = str(tmp_path / "index")
    built = P.TextIndex.build(chunks, path, key="k", shard=50)
    index = P.TextIndex.open(spark, path)
    assert rows(P.ranked(index, queries, 5, key="k")) == rows(P.ranked(built, queries, 5, key="k"))
    one = spark.createDataFrame([(1, ["w250"])], "query_id int, terms array<string>")
    held = index.held(one)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*term", plan)
    # the scan opens one folder of the many
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    assert len({f.split("bucket=")[1].split("/")[0] for f in files(held)}) == 1 < len({f.split("bucket=")[1].split("/")[0] for f in files(index.blocks)})
    # weights need no postings: the columns of lists are not read for bounds
    meta = held.select("term", "df")._jdf.queryExecution().executedPlan().toString()
    assert "keys" not in re.search(r"ReadSchema: (\S+)", meta)[1]


def test_shards_below_the_floor_are_not_scored(spark, monkeypatch):
    """Ten good chunks come first; shards of long chunks with one occurrence can't reach them."""
    good = [(i, ["heat"] * 5) for i in range(10)]
    poor = [(100 + i, ["heat", *["x"] * 400]) for i in range(200)]
    chunks = spark.createDataFrame(good + poor, "k int, tokens array<string>").coalesce(1)
    index = P.TextIndex.build(chunks, key="k", shard=10)
    asked = spark.createDataFrame([(1, ["heat"])], "query_id int, terms array<string>")
    seen = []
    plain = P.reaching
    monkeypatch.setattr(P, "reaching", lambda s, f: seen.append((s.count(), (out := plain(s, f)).count())) or out)
    out = P.ranked(index, asked, 5, form="plus", key="k", first=1)
    assert [r["k"] for r in out.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert seen == [(20, 0)]


def test_nothing(spark, corpus):
    chunks, queries = corpus
    index = P.TextIndex.build(chunks.limit(0), key="k")
    assert P.ranked(index, queries, 5, key="k").count() == 0
    assert P.ranked(P.TextIndex.build(chunks, key="k"), queries.limit(0), 5, key="k").count() == 0


def test_many_questions_meet_shards(spark):
    """As scoring all pairs, ties by key; no shard hands on more than k rows for a question."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, [words[min(39, int(rng.expovariate(0.12)))] for _ in range(rng.randrange(0, 30))]) for i in range(120)]
    rows += [(200 + i, rows[i % 7][1]) for i in range(60)] + [(900, None)]
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "chunk_id long, tokens array<string>").repartition(3)
    questions = spark.createDataFrame([(i, [*rng.sample(words, 4), "w0", "w0", "unknown"]) for i in range(25)] + [(50, []), (51, ["unknown"])], "query_id int, terms array<string>")
    want = S.top_k(S.bm25_plus_one(chunks, questions, keep_zero=False).withColumn("score", F.round("score", 9)), 5)
    got = P.best_by_shard(chunks, questions, 5, shard=16, block=6)
    plain = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())
    assert plain(got) == plain(want) and len(plain(want)) == 125


def test_pairs_of_few_queries_are_counted_without_an_exchange(spark, monkeypatch):
    monkeypatch.setattr(S, "_PAIR_CELLS", 40, raising=False)
    texts = spark.createDataFrame([(1, "Ab abc  x"), (2, ""), (3, None), (4, "zz"), (5, "bcd öü ab")], "doc_id long, text string").select("doc_id", S.pairs_of(F.col("text")).alias("p"))
    queries = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(["abcd", "ÖÜ", "", "q", "cab x"])], "item string, text string").select("item", S.pairs_of(F.col("text")).alias("q"))
    out = S.shared_pairs(queries, texts, "item", "doc_id")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    p, q = ({r[0]: set(r[1] or ()) for r in df.collect()} for df in (texts, queries))
    want = {(i, d): len(a & b) / len(a) for i, a in q.items() for d, b in p.items() if a & b}
    assert {(r["item"], r["doc_id"]): r["overlap"] for r in out.collect()} == want and len(want) == 5


@pytest.mark.parametrize("most", [0, 200_000])
def test_whole_texts_are_searched_for_pairs(spark, monkeypatch, most):
    """Few queries and many, pairs across stretches of bytes, at the borders of texts and far behind the first characters."""
    monkeypatch.setattr(S, "is_small", lambda df: df.limit(most + 1).count() <= most)
    monkeypatch.setattr(S, "_PAIR_CELLS", 60)
    monkeypatch.setattr(S, "_TEXT_BYTES", 16, raising=False)
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("aBcd  é熱😀ß\n") for _ in range(rng.choice((0, 1, 2, 7, 40, 90))))) for i in range(60)] + [(60, None), (61, "."), (62, "." * 700 + "q"), (63, "q" * 20)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(["ab é熱😀", ".Q", "", "qq", "😀😀d\n", "ßa  b", None, "xyz"])], "item string, text string").select("item", S.pairs_of(F.col("text")).alias("q"))
    p = {r["doc_id"]: set(r["p"] or ()) for r in texts.select("doc_id", S.pairs_of(F.col("text")).alias("p")).collect()}
    q = {r["item"]: set(r["q"] or ()) for r in queries.collect()}
    want = sorted((i, d, len(a & b) / len(a)) for i, a in q.items() for d, b in p.items() if a & b)
    got = S.shared_pairs(queries, texts.select("doc_id", F.col("text").alias("p")), "item", "doc_id").collect()
    assert sorted((r["item"], r["doc_id"], r["overlap"]) for r in got) == want and ("q1", 62, 1.0) in want


def test_pair_overlap_takes_whole_texts(spark, tmp_path):
    """A passage behind the first 500 characters counts, in the query and in its SQL."""
    spark.createDataFrame([(1, "abc")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "." * 500 + "ABc"), (2, "." * 499 + "abc"), (3, "." * 3000 + "bc"), (4, "." * 600)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()["r11_pair_overlap"](spark, str(tmp_path)).collect()
    assert sorted((r["item_id"], r["doc_id"], r["overlap"]) for r in rows) == [(1, 1, 1.0), (1, 2, 1.0), (1, 3, 0.5)]
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.execute(registry.oracle_sql()["r11_pair_overlap"]).fetchall()) == [(1, 1, 1.0), (1, 2, 1.0), (1, 3, 0.5)]
