"""Line dedup: SQL, brute force over batches and fans, runs, odd rows, no Python."""

import hashlib
import random

import pytest
from compare import connect, same
from odd import empty, odd, odd_rows
from pyspark.sql import functions as F

from lexweave.llm import line_dedup as D


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def brute(texts, least_docs, least_points=1):
    """(text or None, lines, dropped) of each text."""
    split = [(t or "").split("\n") for t in texts]
    count = {}
    for lines in split:
        for k in {key(x) for x in lines}:
            count[k] = count.get(k, 0) + 1
    hot = {k for k, n in count.items() if n >= least_docs and len(k) >= least_points}
    kept = [[x for x in lines if key(x) not in hot] for lines in split]
    return [(None if t is None else "\n".join(k), len(s), len(s) - len(k)) for t, s, k in zip(texts, split, kept, strict=True)]


def test_query(spark, data):
    same(D.op13_lines(spark, data), connect(data), D.SQL)


@pytest.mark.parametrize("batches,fan", [(1, 2), (5, 2), (7, 3)])
def test_brute_force(spark, batches, fan):
    rng = random.Random(batches)
    lines = ["All rights reserved", " ALL rights Reserved\t", "", "  ", "É", "é", "İ", "a", *[f"line {i}" for i in range(40)], "x\r", "\x0bx"]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 9))) for _ in range(120)] + [None, "", "\n", "only\n" * 50, "a\n\nb"] + ["copy\nof a text"] * 12
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    hot = D.frequent_lines(docs, least_docs=10, batches=batches, fan=fan)
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in D.drop_lines(docs, hot).collect()}
    assert out == dict(enumerate(brute(texts, 10)))


def test_runs_are_levelled_and_settled_lines_not_stored_again(spark):
    runs = D.LineRuns(spark, least_docs=3, fan=2, buckets=2)
    h = [hashlib.md5(bytes([i])).hexdigest() for i in range(9)]

    def add(*docs):
        runs.add(spark.createDataFrame([(list(d),) for d in docs], "hashes array<string>"))

    add([h[0], h[1]], [h[0]], [h[0]])
    assert [len(x) for x in runs.levels] == [1]
    add([h[0], h[1]], [h[2]])
    assert [len(x) for x in runs.levels] == [0, 1]
    stored = {r["hash"].hex(): r["n"] for r in spark.table(runs.levels[1][0][0]).collect()}
    assert stored == {h[0]: 3, h[1]: 2, h[2]: 1}
    add([h[1], h[3]])
    assert [len(x) for x in runs.levels] == [1, 1]
    add([h[4]])
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert {r["hash"].hex() for r in runs.frequent().collect()} == {h[0], h[1]}
    plan = runs._merged(runs.runs() * 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    runs.close()


def test_odd(spark):
    docs = odd(spark)
    hot = D.frequent_lines(docs, least_docs=2)
    out = D.drop_lines(docs, hot)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    want = brute([r[1] for r in odd_rows()], 2)
    got = [(r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(map(str, (r["mark"] for r in out.collect()))) == sorted(str(r[-1]) for r in odd_rows())
    assert D.drop_lines(empty(spark), D.frequent_lines(empty(spark))).count() == 0


def test_no_python(spark, data):
    out = D.op13_lines(spark, data)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
    assert out.select(F.sum("n_dropped")).first()[0] > 0
