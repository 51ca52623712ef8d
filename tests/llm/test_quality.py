"""Quality rules: statistics against plain Python, and the fit."""

import collections
import re

from odd import empty, odd, odd_rows
from pyspark.sql import functions as F

from lexweave.llm import quality as Q


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    covered = {k + i for v in at.values() if len(v) > 1 for k in v for i in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(["a b c d e a b c d e", "x\nx\n\n x\n", "1 2 3 4 5 6 1 2 3 4 5", "a " * 50, None, "# $ %|<"])], "doc_id long, text string")
    rows = docs.union(extra)
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for r in Q.statistics(rows).collect():
        assert plain(texts[r["doc_id"]]) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])


def test_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    out = Q.op5_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed")
    good = out.filter("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = out.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good >= 0.98 and bad <= 0.2


def test_fit_recovers_a_planted_model():
    """Votes drawn from two known classes, with abstentions at random: rates are found, and a rule of pure noise says nothing."""
    import random

    rng = random.Random(1)
    counts = collections.Counter()
    for _ in range(20000):
        good = rng.random() < 0.8
        vote = lambda bad, clean: 0 if rng.random() < 0.2 else -1 if rng.random() < (clean if good else bad) else 1
        counts[(vote(0.7, 0.01), vote(0.6, 0.05), vote(0.8, 0.02), vote(0.9, 0.2), vote(0.3, 0.3))] += 1
    t = Q.fit(sorted(counts.items()), 5)
    assert abs(t.prior - 0.8) < 0.05
    shrink = lambda x, k: (x + Q.BELIEF_WEIGHT * Q.BELIEF[k]) / (1 + Q.BELIEF_WEIGHT)
    for k, (bad, clean) in enumerate([(0.7, 0.01), (0.6, 0.05), (0.8, 0.02), (0.9, 0.2)]):
        assert abs(t.rules[k][0] - shrink(bad, 0)) < 0.1 and abs(t.rules[k][1] - shrink(clean, 1)) < 0.03
    assert abs(t.log_odds(4, -1)) < 0.3 and t.log_odds(0, 0) == 0
    assert t.log_odds(0, -1) < t.log_odds(3, -1) < 0 < t.log_odds(3, 1)


def test_a_weak_bad_vote_is_outvoted(spark):
    """The verdict isn't that every rule must pass, nor that one good vote is enough."""
    out = [r for r in Q.judge(Q.statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()).collect() if not r["base_failed"]]
    bad = lambda r: sum(v < 0 for v in r["votes"])
    assert all(r["kept"] for r in out if not bad(r))
    once = [r for r in out if bad(r) == 1 and sum(v > 0 for v in r["votes"]) >= 4]
    assert any(r["kept"] for r in once) and any(not r["kept"] for r in out if bad(r) == 1)
    assert any(not r["kept"] and any(v > 0 for v in r["votes"]) for r in out)
    short = [r for r in out if r["votes"][0] == -1 and bad(r) == 1]
    assert short and all(r["kept"] for r in short)


def test_odd(spark):
    out = {r["doc_id"]: r for r in Q.judge(Q.statistics(odd(spark))).collect()}
    assert out[0]["n_words"] == 0 and out[0]["base_failed"] and not out[0]["kept"]
    assert len(odd_rows()) == Q.statistics(odd(spark)).count()
    assert Q.judge(Q.statistics(empty(spark))).count() == 0
