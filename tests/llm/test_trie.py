"""Conversation prefix trie: SQL, a plain trie, long conversations, hot nodes, odd rows."""

import hashlib
import random
import zlib

import pytest
from compare import connect, same

from lexweave.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, family=20, heads=4):
    """The nodes by a plain trie over rebuilt conversations."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % family if c >= 0 else -(abs(c) % family))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes, ends, kids = {}, {}, {}
    for c, turns in built.items():
        path = tuple(turns)
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
            if d:
                kids.setdefault(path[: d - 1], set()).add(path[:d])
        ends.setdefault(path, []).append(c)
    out = []
    below = {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len([w for w in p[-1][1].replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]) if p else 0
        sub = [below[k] for k in kids.get(p, ())]
        saved = (len(nodes[p]) - 1) * words + sum(s for s, _ in sub)
        leaves = sum(n for _, n in sub) or 1
        below[p] = saved, leaves
        mine = ",".join(map(str, sorted(ends.get(p, ()))))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(sub), leaves, saved, hashlib.sha256(mine.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def run(spark, rows):
    return T.trie(*T.rebuilt(T.original(spark.createDataFrame(rows, SCHEMA))))


def test_query(spark, data):
    same(T.op12_trie(spark, data), connect(data), T.SQL)


def test_plain_trie(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 3)
    monkeypatch.setattr(T, "BLOCK", 4)
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 130), -7, -25, 4000]:
        # few texts, so that beginnings are shared far down and chains hang on chains
        rows += [(c, t, "user" if t % 2 else "assistant", rng.choice(["yes no", "maybe  so\tthen", "x"]) if rng.random() < 0.8 else "the same") for t in range(rng.choice([0, 1, 2, 3, 5, 8, 11]))]
    assert got(run(spark, rows)) == plain(rows)


def test_odd(spark):
    long = "word " * 20000
    rows = [(1, None, "user", "null first"), (1, 0, None, None), (1, 0, None, None), (1, 1, "user", long), (2, 0, "", ""), (None, 0, "user", "nobody"), (40, 0, "u", "a"), (60, 0, "u", "a"), (60, 1, "u", "b"), (61, 0, "u", "a"), (63, 5, "ua", ""), (64, 5, "u", "a")]
    assert got(run(spark, rows)) == plain(rows)
    assert run(spark, []).count() == 0
    assert run(spark, [(None, 0, "user", "nobody")]).count() == 0
    named = spark.createDataFrame([(1, 0, "u", "a", 3, "x")], SCHEMA + ", depth int, content string")
    assert got(T.trie(*T.rebuilt(T.original(named)))) == plain([(1, 0, "u", "a")])


def test_equal_conversations(spark):
    """Many conversations end in one node, whose list of ends takes several pieces."""
    rows = [(c * 20, t, "u", f"turn {t}") for c in range(300) for t in range(2)]
    assert got(run(spark, rows)) == plain(rows)


@pytest.mark.parametrize("turns", [40])
def test_chains_behind_one_another(spark, turns):
    """Each conversation branches off the one before, a turn later."""
    rows = [(c * 20, t, "u", f"t{t}" if t <= c else f"own {c}") for c in range(turns) for t in range(c + 2)]
    assert got(run(spark, rows)) == plain(rows)
