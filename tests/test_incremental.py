"""Collection as a stream that is stopped and started, and tables that change while they are read."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexweave.sources.versioned import Conflict, VersionedTable
from lexweave.streaming import collect as C

SCHEMA = StructType().add("doc_id", "string").add("title", "string")


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


@pytest.fixture
def places(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")


def run(spark, places):
    C.collect(spark, str(places[0]), places[1], places[2], SCHEMA).awaitTermination()
    return sorted((r["doc_id"], r["title"]) for r in C.collected(spark, places[1], SCHEMA).collect())


def test_keys_are_collected_once(spark, places):
    lines(places[0] / "1.json", {"doc_id": "a", "title": "one"}, {"doc_id": "b", "title": "two"}, "{broken", {"title": "no key"}, "", {"doc_id": "a", "title": "later"})
    assert run(spark, places) == [("a", "later"), ("b", "two")]
    # nothing new, then a file that repeats a key
    assert run(spark, places) == [("a", "later"), ("b", "two")]
    lines(places[0] / "2.json", {"doc_id": "b", "title": "again"}, {"doc_id": "c", "title": None})
    assert run(spark, places) == [("a", "later"), ("b", "two"), ("c", None)]


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_batch_that_fails_is_run_again(spark, places, monkeypatch, when):
    """The stream dies before or after its second batch was written; a new one starts from the log."""
    lines(places[0] / "1.json", {"doc_id": "a", "title": "one"})
    run(spark, places)
    lines(places[0] / "2.json", {"doc_id": "a", "title": "again"}, {"doc_id": "b", "title": "two"})
    plain, calls = C.collected, []

    def failing(s, target, schema):
        calls.append(1)
        if when == "after":
            # the folder of the batch is there, as of a run that died before the log knew
            s.createDataFrame([("b", "two")], SCHEMA).write.mode("overwrite").parquet(f"{target}/{C.BATCH}=1")
        raise RuntimeError("lost")

    monkeypatch.setattr(C, "collected", failing)
    with pytest.raises(StreamingQueryException):
        C.collect(spark, str(places[0]), places[1], places[2], SCHEMA).awaitTermination()
    assert calls
    monkeypatch.setattr(C, "collected", plain)
    assert run(spark, places) == [("a", "one"), ("b", "two")]


def test_upsert_while_a_reader_is_open(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    with pytest.raises(ValueError):
        t.read()
    assert t.upsert(frame([(1, "a"), (2, "b"), (2, "c")]), "k") == 1
    reader = t.read()
    assert t.upsert(frame([(2, "d"), (3, "e")]), "k") == 2
    assert t.upsert(t.read().withColumn("v", F.upper("v")), "k") == 3
    get = lambda df: sorted(map(tuple, df.collect()))
    assert get(reader) == get(t.read(1)) == [(1, "a"), (2, "c")]
    assert get(t.read()) == [(1, "A"), (2, "D"), (3, "E")]
    assert t.vacuum() == 1 and t.versions() == [2, 3] and get(t.read(2)) == [(1, "a"), (2, "d"), (3, "e")]


def test_writers_dont_overwrite_each_other(spark, tmp_path, monkeypatch):
    t, other = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    t.upsert(frame([(1, "a")]), "k")
    assert other.replace(frame([(1, "x")]), base=1) == 2
    with pytest.raises(Conflict):
        t.replace(frame([(1, "y")]), base=1)
    assert t.read().first()["v"] == "x" and t.versions() == [1, 2]
    # a writer that was overtaken tries again on what the faster one left
    plain, overtaken = t._commit, []

    def commit(rows, version):
        if not overtaken:
            overtaken.append(other.upsert(frame([(5, "fast")]), "k"))
        return plain(rows, version)

    monkeypatch.setattr(t, "_commit", commit)
    assert t.upsert(frame([(6, "slow")]), "k") == 4
    assert {r["k"]: r["v"] for r in t.read().collect()} == {1: "x", 5: "fast", 6: "slow"}


def test_a_write_that_fails_leaves_the_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.upsert(spark.createDataFrame([(1, "a")], "k int, v string"), "k")
    bad = spark.createDataFrame([(1, "b")], "k int, v string").withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        t.upsert(bad, "k")
    assert t.versions() == [1] and t.read().first()["v"] == "a"
    assert t.upsert(spark.createDataFrame([(1, "c")], "k int, v string"), "k") == 2
