"""The embedding range join against brute force."""

import math
import random

import numpy as np
import pytest
from compare import connect, same

from lexweave.llm import vectors as V
from lexweave.llm.components import connected_components


def brute(rows, threshold=0.95):
    sound = [(i, x) for i, x in rows if x is not None and len(x) == 8 and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    m = np.array([x for _, x in sound], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array([i for i, _ in sound])
    while True:
        new = np.array([min([label[k], *label[near[k]]]) for k in range(len(label))])
        if (new == label).all():
            break
        label = new
    out = {i: (0, i) for i, _ in rows}
    return out | {i: (int(near[k].sum()), int(label[k])) for k, (i, _) in enumerate(sound)}


@pytest.mark.parametrize("cell, block", [(4096, 4096), (40, 16)])
def test_against_brute_force(spark, cell, block):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(40):
        base = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 15))):
            rows.append((base + rng.normal(size=8) * rng.choice([0, 0.05, 0.15]) * np.linalg.norm(base) / 2).tolist())
    rows = [(i, x) for i, x in enumerate(rows)] + [(9000, None), (9001, [0.0] * 8), (9002, [float("nan")] * 8), (9003, [1.0]), (9004, [None] * 8), (9005, [float("inf")] * 8)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, x, "c", "c") for i, x in rows], "vec_id long, embedding array<double>, node string, x string")
    out = V.link(df, cell=cell, block=block).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("meet, worth", [(1 << 14, 0), (25, 0), (25, 4)])
def test_two_levels_of_pivots(spark, monkeypatch, meet, worth):
    """Large cells are divided again; what the driver collects has a bound that the table doesn't move."""
    monkeypatch.setattr(V, "SPLIT", 1)
    monkeypatch.setattr(V, "MEET", meet)
    monkeypatch.setattr(V, "WORTH", worth)
    divided = []
    plain = V._divided
    monkeypatch.setattr(V, "_divided", lambda *a: divided.append(len(a[1])) or plain(*a))
    taken = []
    first = V.spread
    monkeypatch.setattr(V, "spread", lambda c, n, r: taken.append(len(c)) or first(c, n, r))
    rng = np.random.default_rng(7)
    rows = []
    for size in (300, 900):
        while len(rows) < size:
            base = rng.normal(size=8)
            rows += [(len(rows) + k, (base + rng.normal(size=8) * rng.choice([0.02, 0.15])).tolist()) for k in range(int(rng.integers(1, 9)))]
        out = V.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=12, block=10, top=5).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == brute(rows)
    assert len(divided) == 2 and min(divided) > 1
    # candidates of the top pivots only: the second level's are drawn in tasks
    assert taken == [V._TRIES * 5] * 2


@pytest.mark.parametrize("cell, block", [(4096, 4096), (20, 16)])
def test_each_length_joins_on_its_own(spark, cell, block):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for n, size in ((8, 90), (5, 60), (3, 7), (1, 2)):
        base = [rng.normal(size=8) for _ in range(9)]
        padded = []
        for k in range(size):
            x = ((base[k % 9] + rng.normal(size=8) * 0.05)[:n]).tolist()
            rows.append((len(rows), x))
            padded.append((rows[-1][0], x + [0.0] * (8 - n)))
        want |= brute(padded)
    random.Random(2).shuffle(rows)
    out = V.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=cell, block=block).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == want


def test_components_of_any_size_and_every_length(spark):
    """Norms that overflow or vanish, and lengths that few vectors have."""
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e198]), (2, [1.0, 0.0]), (3, [1e-200, 1e-203]), (4, [5e-324, 0.0]), (5, [0.0, 1e300]), (6, [1.0, 1.0]), (7, [2.0, 2.01])]
    rows += [(10 + k, [1.0, float(k), 0.0]) for k in range(3)] + [(20, []), (21, [1e308, 1e308, 1e308]), (22, [1.0, 1.0, 1.0])]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(out[k] == (4, 0) for k in range(5)) and out[5] == (0, 5) and out[6] == out[7] == (1, 6)
    assert out[20] == (0, 20) and out[21] == out[22] == (1, 21)


def test_pivots_are_spread():
    rng = np.random.default_rng(3)
    group = rng.normal(size=16) + rng.normal(size=(50, 16)) * 0.01
    other = rng.normal(size=(20, 16))
    x = np.concatenate([group, other])
    x /= np.linalg.norm(x, axis=1)[:, None]
    pivots = V.spread(x, 10, 0.3)
    assert len(pivots) == 10 and (pivots @ pivots.T - np.eye(10) * 2).max() < 1 - 0.3**2 / 2
    assert len(V.spread(x[:50], 10, 0.3)) == 1


def test_a_vector_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_COMPONENTS", 4)
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(k, (base + rng.normal(size=8) * 0.05).tolist()) for k in range(12)]
    out = V.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == brute(rows)


def test_query(spark, data):
    same(V.op10_vectors(spark, data), connect(data), V.SQL)


def test_nothing_to_link(spark):
    schema = "vec_id long, embedding array<float>"
    assert V.link(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in V.link(spark.createDataFrame([(1, None)], schema)).collect()] == [(1, 0, 1, True)]
    rows = V.link(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [2.0, 0.0])], schema)).collect()
    assert len(rows) == 3 and {r["n_links"] for r in rows} == {2}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 80)] + [(300 + rng.randrange(50), 300 + rng.randrange(50)) for _ in range(40)]
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {n: c for n, c in label.items() if n in out} and set(label) - set(out) <= {n for n in label if label[n] == n}


def test_vectors_without_structure_are_not_copied_to_cells(spark, monkeypatch):
    """Where all vectors lie near all borders, a vector is sent once for each block, in the precision it came in."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 64)).astype(np.float32)
    x[1000:] = x[:200] + rng.normal(size=(200, 64)).astype(np.float32) * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    told = []
    plain = V.cut
    monkeypatch.setattr(V, "cut", lambda df, label, **k: told.append((label, plain(df, label, **k))) or told[-1][1])
    out = V.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cell=100, block=300)
    m = x.astype(np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    links = (m @ m.T >= 0.95).sum(1) - 1
    assert {r["vec_id"]: r["n_links"] for r in out.collect()} == dict(enumerate(links.tolist())) and links.sum() > 100
    blocks = [(r["n_in"], r["n_out"]) for label, df in told if label == "vectors-blocks" for r in df.collect()]
    assert blocks == [(4, 0)]
