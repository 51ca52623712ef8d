"""Mixing and sharding: laws, brute force and odd rows."""

import collections
import random
import zlib

import pytest
from compare import connect, same
from odd import empty, odd, odd_rows
from pyspark.sql import functions as F

from lexweave.llm import mixing as M
from lexweave.llm import sharding as H


def reshared(sizes, weights, share=1.5, cap=2):
    """Targets by sharing the excess again and again."""
    goal, held = [0.0] * len(sizes), set()
    while True:
        left = share * sum(sizes) - sum(goal[i] for i in held)
        open_ = [i for i in range(len(sizes)) if i not in held]
        for i in open_:
            goal[i] = left * weights[i] / sum(weights[j] for j in open_)
        over = [i for i in open_ if goal[i] > cap * sizes[i]]
        if not over:
            return goal
        for i in over:
            goal[i] = cap * sizes[i]
            held.add(i)


def test_targets_are_the_limit_of_resharing():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 9)
        sizes = [rng.choice([0, 1, 10, 500, 100000]) + rng.randint(0, 5) for _ in range(n)]
        weights = [(3, 1, 2)[i % 3] for i in range(n)]
        assert M.targets(sizes, weights) == pytest.approx(reshared(sizes, weights))


def test_mix_query(spark, data):
    same(M.op8_mix(spark, data), connect(data), M.SQL)


def test_mix_laws(spark):
    d = "/root/testdata/sf0.01"
    rows = M.copies(spark.read.parquet(f"{d}/documents.parquet")).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r["copies"] <= 2
        by[r["source"]].append(r)
    for own in by.values():
        taken = sum(r["copies"] * r["size"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own) + 1


def test_mix_odd(spark):
    out = M.copies(odd(spark)).collect()
    assert len(out) == len(odd_rows())
    assert {r["doc_id"]: r["size"] for r in out}[0] == 0
    again = M.copies(odd(spark).repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    mixed = M.mix(odd(spark))
    assert mixed.columns == odd(spark).columns and mixed.count() >= 1
    assert M.copies(empty(spark)).count() == 0 and M.mix(empty(spark)).count() == 0


def shards(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return by


def test_shard_law(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = H.op9_shard(spark, d).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    by = shards(rows)
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert set(by) == set(range(40)) and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    home = collections.defaultdict(set)
    for r in rows:
        home[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(v) > 1 for v in home.values()) <= 39


def test_shard_hot_text(spark):
    """A third of all rows share one text: shards stay even, and only that group is divided."""
    rows = [(i, f"text {i} " + "x" * (i % 50)) for i in range(2000)] + [(10000 + i, "hot " * 20) for i in range(1000)]
    out = H.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    by = shards(out)
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert len(out) == 3000 and max(sizes) - min(sizes) <= 400


def test_shard_odd(spark):
    out = H.shard(odd(spark), shards=4).collect()
    assert len(out) == len(odd_rows()) and max(r["shard"] for r in out) < 4
    shards(out)
    assert {r["doc_id"]: r["size"] for r in out}[0] == 16
    assert H.shard(empty(spark)).count() == 0
    same_rows = spark.createDataFrame([(1, "a")] * 50, "doc_id long, text string")
    assert len(H.shard(same_rows, shards=3).collect()) == 50


def test_shard_ids_that_are_text(spark):
    rows = spark.createDataFrame([(f"id-{i}", f"text {i % 30}") for i in range(300)] + [(None, "x"), ("12.5", None)], "doc_id string, text string")
    out = H.shard(rows, shards=3).collect()
    assert len(out) == 302 and {r["doc_id"] for r in out} == {r["doc_id"] for r in rows.collect()}
    shards(out)


def test_mix_tells_texts_of_one_id_apart(spark):
    docs = spark.createDataFrame([(1, f"w{i} " * 5, "a", "c", "c") for i in range(40)] + [(2, "x y", "b", "c", "c")] * 3, "doc_id long, text string, source string, mark_of_text string, plan_copies string")
    plan = M.copies(docs).collect()
    got = collections.Counter(r["text"] for r in M.mix(docs).collect())
    assert M.mix(docs).columns == docs.columns
    assert sum(n for t, n in got.items() if t.startswith("w")) == sum(r["copies"] for r in plan if r["doc_id"] == 1)


def test_splitters_count_exactly(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("k1"), F.col("id").alias("k2"), (F.col("id") % 37 + 1).alias("size")).cache()
    edges, counts, rounds = H.splitters(rows, 8, 0.001)
    local = [((r["k1"] % (1 << 64)) << 64 | r["k2"] % (1 << 64), r["size"]) for r in rows.collect()]
    assert 1 <= rounds <= 16
    for (bits, length), (n, size) in zip(edges, counts, strict=True):
        below = [s for k, s in local if k < bits << (128 - length)]
        assert (len(below), sum(below)) == (n, size)
