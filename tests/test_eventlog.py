"""Events, cascades and approvals, worked by hand."""

from lexweave.operators import eventlog as L

EVENT = "key string, parent string, at int, seq int, op string, x string"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def now(spark, rows, parents=None, as_of=None):
    from pyspark.sql import functions as F

    effective = L.effective(events(spark, rows), parents)
    return {(r["key"], r["x"], r["at"]) for r in L.state(effective, ["x"], None if as_of is None else F.lit(as_of)).collect()}


def test_fold(spark):
    rows = [("a", None, 1, 0, "insert", "one"), ("a", None, 2, 0, "update", "two"), ("a", None, 3, 0, "update", None), ("b", None, 1, 0, "update", "lost"), ("c", None, 1, 0, "insert", "x"), ("c", None, 4, 0, "delete", None), ("c", None, 5, 0, "update", "late"), ("d", None, 1, 0, "insert", "x"), ("d", None, 2, 0, "delete", None), ("d", None, 6, 0, "insert", None), ("e", None, 7, 1, "insert", "second"), ("e", None, 7, 0, "delete", None)]
    assert now(spark, rows) == {("a", "two", 3), ("d", None, 6), ("e", "second", 7)}
    assert now(spark, rows, as_of=3) == {("a", "two", 3), ("c", "x", 1)}
    assert now(spark, rows, as_of=1) == {("a", "one", 1), ("c", "x", 1), ("d", "x", 1)}
    assert now(spark, []) == set()


def test_deletes_cascade(spark):
    docs = L.effective(events(spark, [("A", None, 1, 0, "insert", "a"), ("A", None, 5, 0, "delete", None), ("A", None, 8, 0, "insert", "again"), ("B", None, 3, 0, "insert", "b")]))
    rows = [("v1", "A", 2, 0, "insert", "x"), ("v1", "A", 6, 0, "update", "too late"), ("v2", "A", 6, 0, "insert", "no document"), ("v3", "A", 9, 0, "insert", "new"), ("v4", "B", 2, 0, "insert", "too early"), ("v5", "B", 4, 0, "insert", "y"), ("v1", "A", 10, 0, "insert", "back"), ("v6", "C", 1, 0, "insert", "nobody's")]
    assert now(spark, rows, docs) == {("v3", "new", 9), ("v5", "y", 4), ("v1", "back", 10)}
    assert now(spark, rows, docs, 4) == {("v1", "x", 2), ("v5", "y", 4)}
    assert now(spark, rows, docs, 7) == {("v5", "y", 4)}


def test_approvals(spark):
    acts = [("k", "A", 1, 0, "submit", None, None), ("k", "A", 2, 0, "approve", "Sato", "fine"), ("m", "A", 1, 0, "link", "required", None), ("m", "A", 2, 0, "approve", None, None), ("m", "A", 3, 0, "reject", None, "late"), ("n", "A", 1, 0, "link", "unheard of", None), ("o", "A", 1, 0, "approve", "x", "not there"), ("p", "A", 1, 0, "submit", None, None), ("p", "A", 2, 0, "unlink", None, None)]
    made = L.approvals(spark.createDataFrame(acts, "key string, parent string, at int, seq int, action string, who string, note string"))
    out = {r["key"]: (r["relationship"], r["notes"]) for r in L.state(L.effective(made), ["relationship", "notes"]).collect()}
    assert out == {"k": ("approved", "承認者: Sato / fine"), "m": ("rejected", "差し戻し理由: late")}


def test_status_history(spark):
    rows = [("t", 1, 0, "pending", "a"), ("t", 2, 0, "pending", "b"), ("t", 3, 0, "done", "c"), ("t", 3, 1, "pending", "d"), ("u", 1, 0, "done", "e")]
    out = L.status_history(spark.createDataFrame(rows, "key string, at int, seq int, status string, reason string"))
    assert sorted((r["key"], r["at"], r["before"] or "", r["after"], r["reason"]) for r in out.collect()) == [("t", 1, "", "pending", "a"), ("t", 3, "done", "pending", "d"), ("t", 3, "pending", "done", "c"), ("u", 1, "", "done", "e")]
