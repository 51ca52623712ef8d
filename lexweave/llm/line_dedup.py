"""Line dedup: levelled sorted runs of line hashes.

A run is a table of (hash of a line's key, number of documents), bucketed and
sorted by the hash.  Documents come in batches.  A batch is counted, its hashes
merge-anti-join the runs (a line that a run already has in enough documents is
settled and not stored again) and what is left is a new run of the first level.
When a level has ``fan`` runs they are merged into one run of the next level; as
runs share their buckets, neither the anti-join nor the merge moves a run over
the network.  So n batches leave about fan * log(n) runs, and each hash is
rewritten once a level.

The lines that are in ``least_docs`` documents or more over all batches lose all
their occurrences.  They meet the documents' lines by hash, which gives for each
text the places to drop; lines and places travel, texts only in the last join.

Everything is an expression of Spark; the main path has no Python.

Counts are sums that are partly added before they move, so a line that a third
of all documents have is no hot group; in the joins it meets one row, and the
side with many rows can be split.  Hashes have 128 bits.

Defined cases: a null text has one empty line and stays null; a line's key is
the line without ASCII white space at both ends, A-Z lower-cased; lines whose
key is shorter than ``least_points`` always stay; a line that repeats within a
document counts once; repeated rows are separate documents; rows equal in text
lose the same lines; very long texts are split whole; an empty table gives an
empty result; other columns are kept, whatever their names, and null ids too.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard_path
from .common import bound, cut, quoted, shared_dir, table, unused

#: Parameters of the production query.
LEAST_DOCS = 10
LEAST_POINTS = 1
BATCHES = 4
FAN = 2

#: Stripped from both ends of a line.
SPACE = " \t\n\x0b\f\r"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    own = F.btrim(line, F.lit(SPACE))
    # in ASCII texts the two agree, and the first is much faster
    return F.when(F.octet_length(own) == F.char_length(own), F.lower(own)).otherwise(F.translate(own, _UPPER, _UPPER.lower()))


def lines_of(text: Column) -> Column:
    """The lines of a text; one empty line for null."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key_hashes(text: Column, least_points: int = LEAST_POINTS) -> Column:
    """The distinct hashes (hex) of the keys of a text's lines."""
    keys = F.filter(F.transform(lines_of(text), line_key), lambda k: F.char_length(k) >= least_points)
    return F.array_distinct(F.transform(keys, lambda k: F.md5(k)))


class LineRuns:
    """Runs of (hash, n) by level."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, fan: int = FAN, buckets: int | None = None):
        if fan < 2:
            raise ValueError("at least two runs are merged")
        self.spark, self.least_docs, self.fan = spark, least_docs, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = [[]]

    def _write(self, counts: DataFrame) -> tuple[str, str]:
        """A run: name and path of its table."""
        name = f"lexweave_lines_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/lexweave/{name}"
        counts.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard_path(self.spark, path)

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """All hashes of the runs with the sums of their numbers."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.withColumnRenamed("n", "m")
            return a.join(b, "hash", "full").select("hash", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        return reduce(two, (self.spark.table(name) for name, _ in runs))

    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def add(self, hashes: DataFrame) -> None:
        """Adds a batch: a row for each document, ``hashes`` the array of its distinct hashes."""
        own = hashes.select(F.explode("hashes").alias("hex")).select(F.unhex("hex").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        for name, _ in self.runs():
            own = own.join(self.spark.table(name).filter(F.col("n") >= self.least_docs), "hash", "left_anti")
        self.levels[0].append(self._write(own))
        level = 0
        while len(self.levels[level]) >= self.fan:
            old = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(old)))
            self.levels[level] = []
            self._drop(old)
            level += 1

    def frequent(self) -> DataFrame:
        """The hashes of lines that enough documents have, written."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "hash binary")
        return cut(self._merged(runs).filter(F.col("n") >= self.least_docs).select("hash"), "lines-frequent", few_files=True)

    def close(self) -> None:
        """Deletes the runs."""
        self._drop(self.runs())
        self.levels = [[]]


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_points: int = LEAST_POINTS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """The hashes of lines that at least ``least_docs`` documents have; the documents are dealt to batches by id."""
    batch = F.pmod(F.xxhash64(quoted(id_col)), F.lit(batches)).cast("int")
    hashed = cut(docs.select(batch.alias("batch"), key_hashes(quoted(text_col), least_points).alias("hashes")), "lines-hashes", by="batch")
    runs = LineRuns(docs.sparkSession, least_docs, fan)
    for b in range(batches):
        runs.add(hashed.filter(F.col("batch") == b))
    found = runs.frequent()
    runs.close()
    return found


def drop_lines(docs: DataFrame, frequent: DataFrame, text_col: str = "text", least_points: int = LEAST_POINTS, added: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs without the lines whose hash is in ``frequent``, and the numbers of lines before and of those dropped."""
    text = quoted(text_col).cast("string")
    mark = unused([*docs.columns, *added], "mark_of_text")
    own = docs.select(F.md5(F.coalesce(text, F.lit(""))).alias("mark"), F.posexplode(lines_of(text)).alias("place", "line")).select("mark", "place", line_key(F.col("line")).alias("key"))
    own = own.filter(F.char_length("key") >= least_points).select("mark", "place", F.unhex(F.md5("key")).alias("hash"))
    # a set for each text and task, so rows equal in text don't pile up
    gone = own.join(frequent, "hash").groupBy("mark").agg(F.collect_set("place").alias("places"))
    gone = cut(gone, "lines-places").select(F.col("mark").alias("gone_mark"), F.col("places").alias("gone_places"))
    d = docs.withColumn(mark, F.md5(F.coalesce(text, F.lit("")))).alias("d")
    met = d.join(gone.alias("g"), F.col(f"d.`{mark}`") == F.col("g.gone_mark"), "left")
    whole = F.col("d.`" + text_col.replace("`", "``") + "`").cast("string")
    places = F.col("g.gone_places")

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    kept = F.when(places.isNull(), whole).otherwise(bound(lines_of(whole), rest))
    out = [kept.alias(c) if c == text_col else F.col("d.`" + c.replace("`", "``") + "`") for c in docs.columns]
    n_lines = F.length(F.coalesce(whole, F.lit(""))) - F.length(F.replace(F.coalesce(whole, F.lit("")), F.lit("\n"), F.lit(""))) + 1
    return met.select(*out, n_lines.cast("long").alias(added[0]), F.coalesce(F.size(places), F.lit(0)).cast("long").alias(added[1]))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_lines(docs, frequent_lines(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key AS hot FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(hot)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.hot GROUP BY r
"""
