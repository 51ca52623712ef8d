"""The n-gram Jaccard join against brute force."""

import random

import numpy as np
import pytest
from odd import empty, odd

from lexweave.llm import near_join as N


def brute(rows):
    """{(id, text): (class, links)} for rows with distinct ids."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = {i: set() for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    label = {i: i for i in ids}
    while True:
        new = {i: min([label[i], *(label[j] for j in links[i])]) for i in ids}
        if new == label:
            return {i: (label[i], len(links[i])) for i in ids}
        label = new


def corpus(seed, groups=12, copies=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 150))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t + (passage if rng.random() < 0.3 else [])))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("options", [{}, {"leaf": 4, "block": 8}])
def test_against_brute_force(spark, options):
    rows = corpus(1)
    want = brute(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert len(got) == len(rows)
    pairs = sum(n for _, n in want.values())
    assert sum(n for _, n in got.values()) >= 0.999 * pairs
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(got[i][0] == want[i][0] for i in want) >= 0.999 * len(want)


@pytest.mark.parametrize("options", [{}, {"leaf": 1}])
def test_recall_at_the_threshold(spark, options):
    """Pairs of similarity 0.8 exactly, by leaves and by nodes at full depth: about one of 1,400 may be missed."""
    rows = []
    for k in range(700):
        shared = [f"s{k}x{i}" for i in range(44)]
        rows += [(2 * k + b, " ".join(shared + [f"t{k}x{b}x{i}" for i in range(5)])) for b in range(2)]
    out = N.join(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    found = sum(r["n_links"] for r in out) / 2
    assert found >= 0.994 * 700 and all(r["class_id"] // 2 == r["doc_id"] // 2 for r in out)


def test_blocks_by_shingles(spark, monkeypatch):
    """Long texts make small blocks."""
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 300)
    rows = corpus(5, groups=4)
    want = brute(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_hot_group_is_not_expanded(spark):
    """A large group of near copies: counts are right, and no stage makes rows for its pairs."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(600):
        t = list(base)
        t[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(base)) for i in range(300)]
    want = brute(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string"), block=256).collect()}
    assert got == want


def test_odd_rows(spark):
    out = N.join(odd(spark)).collect()
    assert len(out) == odd(spark).count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"]))
    assert (by[0], by[1], by[2]) == ([(0, 0)], [(1, 0)], [(2, 0)])
    assert by[8] == [(8, 1)] and by[9] == [(8, 1)]
    assert by[5] == [(5, 1), (5, 1)]
    assert (None, 0) in by[None]
    assert N.join(empty(spark)).count() == 0
    kept = N.representatives(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and 9 not in ids and 8 in ids and 11 not in ids


def test_recall_formula():
    assert N.survival(1) == pytest.approx(0.84)
    assert 1 - (1 - N.survival(N.DEPTH)) ** N.runs_needed() >= N.RECALL


def test_recall_over_shared_coordinates():
    """Runs on one signature: pairs at the threshold that agree by chance in few coordinates are missed by all of them."""
    rng = np.random.default_rng(4)
    agree = rng.binomial(N.COORDINATES, N.THRESHOLD, 20000) / N.COORDINATES
    s = np.ones(len(agree))
    for _ in range(N.DEPTH):
        s = 1 - (1 - agree * s) * (0.75 + 0.25 * (1 - agree * s))
    assert ((1 - s) ** N.runs_needed()).mean() <= 1 - N.RECALL


def test_word_hashes_match_split():
    for text in ["", " a  bb\tc\n\x0bd ", "é ü x y", "a" * 5000 + " b"]:
        data = np.frombuffer(text.encode(), np.uint8)
        start, h = N.word_hashes(data)
        words = text.encode().split()
        assert len(start) == len(words) and len(set(h.tolist())) == len(set(words))


def test_a_row_repeated_very_often_is_compared_once(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words))] * 500 + [(2, " ".join(words[1:]))] * 3 + [(None, " ".join(words))] * 2 + [(4, "other words that stand for themselves alone")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 504), 2: (1, 504), None: (1, 504), 4: (4, 0)}
    kept = N.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4]
