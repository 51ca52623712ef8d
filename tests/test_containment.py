"""Containment with dictionaries of any size: no row meets all terms, and the results are those of a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import expand, glossary

MANY = 200_000


def plan(df):
    return df._jdf.queryExecution().toString()


def no_nested_loop(df):
    return not any(x in plan(df) for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.fixture(scope="module")
def many(spark):
    """Terms of one to fourteen characters, most of them in no text."""
    rng = random.Random(4)
    terms = sorted({"".join(rng.choices("abcde", k=rng.randint(1, 14))) for _ in range(MANY * 3)})[:MANY] + ["熱制御系", ""]
    texts = [(i, "".join(rng.choices("abcde ", k=rng.randint(0, 60)))) for i in range(120)] + [(200, "衛星の熱制御系"), (201, None), (202, ""), (203, "ab cd"), (204, "ab cd")]
    return spark.createDataFrame([(t,) for t in terms], "term string").repartition(4), terms, spark.createDataFrame(texts, "k int, text string"), texts


def test_many_terms_meet_texts_by_an_index(many):
    terms, listed, texts, told = many
    out = expand.contained(texts, terms)
    assert no_nested_loop(out)
    known = {t for t in listed if t}
    want = {(k, x[i:j]) for k, x in told if x for i in range(len(x)) for j in range(i + 1, min(len(x), i + 14) + 1) if x[i:j] in known}
    got = [(r["k"], r["term"]) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_both_ways_agree(spark):
    texts = spark.createDataFrame([(1, "the heat"), (1, "the heat"), (2, "eat"), (3, None)], "k int, text string")
    terms = spark.createDataFrame([("heat", 1), ("eat", 2), ("", 3), ("the heat is", 4)], "term string, n int")
    rows = [sorted((r["k"], r["text"], r["term"], r["n"]) for r in expand.contained(texts, terms, few=few).collect()) for few in (0, 200)]
    assert rows[0] == rows[1] and len(rows[0]) == 5


@pytest.mark.parametrize("few", [0, 200])
def test_domains_by_hand(spark, monkeypatch, few):
    """熱 is explained by 熱制御; 制御 belongs to a more specific domain; a formal term adds a half and its entry points at a domain."""
    monkeypatch.setattr(expand.contained, "__defaults__", ("text", "term", few))
    domains = spark.createDataFrame([("heat", 3, ["熱制御", "熱"]), ("control", 5, ["制御"]), ("system", 1, ["制御", "試験"]), ("none", None, ["x"])], "domain string, specificity int, keywords array<string>")
    words = spark.createDataFrame([("テスト", ["試験"], "none")], "term string, formal array<string>, domain string")
    asked = spark.createDataFrame([(1, "熱制御のテスト"), (2, "何もない")], "query_id int, text string")
    out = {(r["query_id"], r["domain"]): r["score"] for r in expand.detect_domains(asked, domains, words).collect()}
    # heat: (2.5 + 0.1) * 1.6; control: 0.1 * 2.2; system: 0.1 + 0.5; none: 3 * 1.6
    assert out == {(1, "heat"): 4.16, (1, "control"): 0.22, (1, "system"): 0.6, (1, "none"): 4.8}


def test_large_glossaries_have_no_nested_loop(spark, many):
    terms, _, texts, _ = many
    abbr = terms.withColumnRenamed("term", "abbr").withColumns({"full": F.col("abbr"), "category": F.lit("c")})
    asked = texts.withColumnRenamed("k", "query_id")
    assert no_nested_loop(glossary.abbreviations_in(asked, abbr, "query_id"))
    assert no_nested_loop(glossary.category_score(asked, abbr, terms.withColumn("category", F.lit("c"))))
    assert no_nested_loop(expand.expand_synonyms(asked, terms.withColumn("synonyms", F.array("term"))))
