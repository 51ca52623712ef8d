"""Ranked lexical search: SQL, brute force, many shards, odd rows, and that MaxScore skips postings."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect, same
from odd import empty, odd, odd_rows

from lexweave.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """Rows (item_id, rank, doc_id, score) of (id, text) pairs."""
    words = [(i, Counter(terms(t))) for i, t in docs]
    n_all, total = sum(bool(c) for _, c in words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, c in words:
            m = 50 + 50 * sum(c.values()) * n_all // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query(spark, data):
    same(L.op11_search(spark, data), connect(data), L.SQL)


@pytest.mark.parametrize("shard_docs,block_bytes", [(7, 100), (1 << 15, 1 << 20)])
def test_brute_force(spark, shard_docs, block_bytes):
    rng = random.Random(3)
    words = [f"W{i}" for i in range(60)] + ["é", "ÀB", "日本", "the"]
    texts = [" ,".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 40))) for _ in range(300)]
    docs = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(5, texts[0]), (5, texts[0]), (None, texts[1]), (8, None)]
    items = [(i, rng.choice(texts)) for i in range(12)] + [(3, "the THE w1"), (99, "unknown"), (98, None), (97, ""), (None, "w0 w1"), (None, "w0 w1")]
    out = L.search(L.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_docs=shard_docs), spark.createDataFrame(items, "item_id long, text string"), k=9, block_bytes=block_bytes)
    assert rows(out) == sorted(brute(docs, [x for x in items if x[1]], 9), key=str)


def test_odd(spark):
    items = spark.createDataFrame([(1, "w1 text of"), (2, "the 文 é")], "item_id long, text string")
    out = rows(L.search(L.index(odd(spark)), items))
    assert out == sorted(brute([r[:2] for r in odd_rows()], [(1, "w1 text of"), (2, "the 文 é")], 50), key=str)
    assert L.search(L.index(empty(spark)), items).count() == 0
    assert L.search(L.index(odd(spark)), empty(spark).selectExpr("doc_id as item_id", "text")).count() == 0


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [r["doc_id"] for r in L.search(L.index(docs), items).orderBy("rank").collect()] == ["a", "b", None]


def test_rare_terms_spare_frequent_lists():
    """With a rare term that decides, the lists of frequent ones are probed for few documents."""
    n = 20000
    m = np.full(n, 100, np.int64)

    def one(w, docs, tf=1):
        docs = np.asarray(docs, np.uint16)
        return L._List(w, tf, 100, len(docs), docs.tobytes(), np.full(len(docs), tf, np.uint8).tobytes(), lambda x: x, m)

    lists = [one(1, range(n)), one(2, range(0, n, 2)), one(9000, range(0, n, 50))]
    docs, scores, read = L.best(lists, n, 5)
    assert list(docs) == [0, 50, 100, 150, 200] and len(set(scores)) == 1
    assert read < n / 10
