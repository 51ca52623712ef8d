"""Language identification: held-out accuracy, mixtures, and the fit against a plain loop."""

import itertools

import numpy as np
from odd import empty, odd
from pyspark.sql import functions as F

from lexweave.llm import language as L


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = L.op4_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98


def model():
    texts = {"en": "the cat and the dog went to the house with that thing", "de": "der hund und die katze gehen in das haus mit dem ding"}
    counts = {k: np.bincount(L.grams(L.words(t))[0], minlength=L.BUCKETS) for k, t in texts.items()}
    log_p = np.stack([np.log((counts[k] + 0.5) / (counts[k].sum() + 0.5 * L.BUCKETS)) for k in sorted(counts)], 1)
    return L.Model(sorted(counts), log_p)


def test_mixture():
    m = model()
    mixed = "the cat and the dog went to the house " + "und die katze mit dem hund in das haus der katze gehen"
    lang, score, share = m.predict(["the dog and the cat", mixed, None, "", "12 34 !!", "der hund"])
    assert lang[0] == "en" and lang[5] == "de" and lang[2:5] == ["und"] * 3
    assert score[0] > 0.95 and list(score[2:5]) == [0, 0, 0]
    assert lang[1] == "de" and 0.4 < score[1] < 0.8 and (share[1] > 0.2).all()


def three():
    """A model of three made-up languages that share some of their letters."""
    import random

    rng = random.Random(3)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnab"}
    vocabulary = {k: ["".join(rng.choice(v) for _ in range(rng.randint(2, 6))) for _ in range(200)] for k, v in letters.items()}
    counts = [np.bincount(L.grams([rng.choice(vocabulary[k]) for _ in range(2000)])[0], minlength=L.BUCKETS) for k in sorted(letters)]
    log_p = np.stack([np.log((n + 0.5) / (n.sum() + 0.5 * L.BUCKETS)) for n in counts], 1)
    return L.Model(sorted(letters), log_p), vocabulary, rng


def best_set(m, text):
    """The best set of languages by penalised likelihood, each fitted by a plain EM loop from equal shares, over all sets."""
    ws = sorted(set(L.words(text)))
    weight = 1 + np.log([L.words(text).count(w) for w in ws])
    bucket, own = L.grams(ws)
    ll = np.zeros((len(ws), len(m.languages)))
    np.add.at(ll, own, m.log_p[bucket])
    found = []
    for n in range(1, len(m.languages) + 1):
        for chosen in itertools.combinations(range(len(m.languages)), n):
            pi = np.zeros(len(m.languages))
            pi[list(chosen)] = 1 / n
            for _ in range(300):
                joint = np.exp(ll - ll.max(1, keepdims=True)) * pi
                joint /= joint.sum(1, keepdims=True) + 1e-300
                pi = (joint * weight[:, None]).sum(0) / weight.sum()
            top = ll.max(1)
            fit = (weight * (top + np.log((np.exp(ll - top[:, None]) * pi).sum(1) + 1e-300))).sum()
            found.append((fit - L.PENALTY * n * np.log(weight.sum() + 1) / 2, chosen, pi))
    return max(found, key=lambda x: x[0])


def test_language_set_against_all_sets():
    """The set found by taking out languages is the best of all sets, and its proportions are those of a plain loop."""
    m, vocabulary, rng = three()
    texts = []
    for _ in range(120):
        n = rng.choice([1, 1, 2, 3])
        parts = rng.sample(sorted(vocabulary), n)
        texts.append(" ".join(rng.choice(vocabulary[p]) for p in parts for _ in range(rng.randint(3, 40))))
    share = m.predict(texts)[2]
    same = 0
    for text, own in zip(texts, share, strict=True):
        _, chosen, pi = best_set(m, text)
        same += tuple(np.flatnonzero(own > 0)) == chosen
        if tuple(np.flatnonzero(own > 0)) == chosen:
            assert np.abs(own - pi).max() < 0.02
    assert same >= 0.97 * len(texts) and len({(s > 0).sum() for s in share}) == 3


def test_added_columns(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "x", "y", "z")], "doc_id long, text string, score string, LANG_pred string, text_to_read string")
    r = L.predict(docs, model())
    assert r.columns == ["doc_id", "text", "text_to_read", "lang_pred", "score", "shares"] and r.first()["lang_pred"] == "en"
    kept = L.predict(docs, model(), added=("a", "b", "c")).first()
    assert (kept["score"], kept["LANG_pred"], kept["a"]) == ("x", "y", "en")


def test_odd(spark):
    out = {r["doc_id"]: r for r in L.predict(odd(spark), L.train(odd(spark))).collect()}
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == "und"
    assert 0 <= out[5]["score"] <= 1
    assert L.predict(empty(spark), L.train(empty(spark))).count() == 0
    nothing = L.train(odd(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in L.predict(odd(spark), nothing).collect()} == {"und"}
