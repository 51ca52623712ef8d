"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; each of its documents then has the
same expected number of copies, target / source size.  Within a source the
documents are laid out by (size, doc_id), their expected copies are summed as a
running total that starts at one random offset, and a document is emitted once
for every integer that its own step crosses.  Laying out by size stratifies the
sample: the words taken differ from the target by no more than about one
largest document.

Words are counted in one pass over the texts, whose result is written; the rest
reads that narrow table.  The running total needs a rank within the source.  No source is ever gathered
in one task: rows are dealt by range of (source, size, doc_id) and written,
each range counts its rows per source, and a row's rank is its rank within the
range plus the rows of the ranges before it.

Defined cases: a null source is a source of its own, ordered last; null or
empty text has size 0 and is laid out like any other document (a source without
words has target 0 and takes nothing); very long texts are counted whole; equal
rows are separate documents; documents of one size and id are laid out by a hash
of the text; an empty table gives an empty result; columns other than the id, text and source
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, quoted, table, unused, word_count

#: Parameters of the production query.
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
MOST_COPIES = 2
SEED = "mix-1"


def targets(sizes: Sequence[int], weights: Sequence[int], share: tuple[int, int] = SHARE, cap: int = MOST_COPIES) -> list[float]:
    """Shares of ``share`` times all words by weight, where no target is above ``cap`` times its source.

    Sharing an excess again and again by weight ends where every target is
    min(cap * size, level * weight) for one level; sources reach their caps in
    the order of cap * size / weight, so one pass over that order finds it.
    """
    total = sum(sizes) * share[0]
    order = sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i])
    left, weight = total, sum(weights)
    out = [0.0] * len(sizes)
    for n, i in enumerate(order):
        if cap * sizes[i] * share[1] * weight <= left * weights[i]:
            out[i] = float(cap * sizes[i])
            left -= cap * sizes[i] * share[1]
            weight -= weights[i]
        else:
            for j in order[n:]:
                out[j] = left * weights[j] / (share[1] * weight)
            break
    return out


def offset(source, seed: str = SEED):
    """A number in [0, 1) that the source and the seed decide; a multiple of 2**-32."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("\u0000null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, mark (hash of the text), source, size, source_size, target, copies (long).

    The driver gets one row per source (name, words): weights are stated per
    source, so that table is as small as the statement itself.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"))
    # written: the exchange by range reads its input twice, and the words are counted once
    base = cut(base, "mix-sizes")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(base.repartitionByRange(parts, F.col("source"), F.col("size"), F.col("doc_id"), F.col("mark")).withColumn("range", F.spark_partition_id()), "mix")
    counts = dealt.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    counts = cut(counts, "mix-counts")
    found = sorted(((r["source"], r["words"]) for r in counts.groupBy("source").agg(F.sum("words").alias("words")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([n for _, n in found], [weights[i % len(weights)] for i in range(len(found))], share, cap)
    plan = spark.createDataFrame([(s, n, t) for (s, n), t in zip(found, goal, strict=True)], "source string, source_size long, target double")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("source", "range", before.alias("before"))
    starts = starts.alias("a").join(plan.alias("p"), F.expr("a.source <=> p.source")).select("a.source", "a.range", "before", "source_size", "target")
    own = F.row_number().over(Window.partitionBy("range", "source").orderBy("size", "doc_id", "mark")).cast("long")
    ranked = dealt.select("doc_id", "mark", "source", "range", "size", own.alias("own"))
    out = ranked.alias("r").join(starts.alias("s"), F.expr("r.range = s.range and r.source <=> s.source")).select("r.doc_id", "r.mark", "r.source", "r.size", "s.source_size", "s.target", (F.col("r.own") + F.col("s.before")).alias("rank"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    got = F.floor(rate * F.col("rank") + u) - F.floor(rate * (F.col("rank") - 1) + u)
    return out.select("doc_id", "mark", "source", "size", "source_size", "target", F.least(got, F.lit(cap)).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: every document that is taken, its columns unchanged, once per copy.

    Rows that share id and text can't be told apart: each is given the larger
    of their numbers of copies, which differ by one at most if they share the
    source too.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    plan = copies(docs, **options).filter("copies > 0").groupBy("doc_id", "mark").agg(F.max("copies").alias("copies"))
    mark, copy = unused(docs.columns, "mark_of_text"), unused(docs.columns, "number_of_copy")
    marked = docs.withColumn(mark, F.xxhash64(quoted(text_col).cast("string")))
    plan = plan.select(F.col("doc_id").alias("plan_id"), F.col("mark").alias("plan_mark"), F.col("copies").alias("plan_copies"))
    picked = marked.alias("d").join(plan.alias("p"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("p.plan_id")) & (F.col(f"d.`{mark}`") == F.col("p.plan_mark")))
    kept = [F.col("d.`" + c.replace("`", "``") + "`") for c in docs.columns]
    return picked.select(*kept, F.explode(F.sequence(F.lit(1), F.col("p.plan_copies").cast("int"))).alias(copy)).drop(copy)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = copies(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s
), o AS (
  SELECT *, sum(source_size) OVER () * 3 AS total, row_number() OVER (ORDER BY 2 * source_size / weight, source) AS k FROM w
), c AS (
  SELECT *, total - coalesce(sum(4 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM o
), f AS (
  SELECT *, 4 * source_size * open_weight <= rest * weight AS capped FROM c
), l AS (
  SELECT min(k) AS k FROM f WHERE NOT capped
), t AS (
  SELECT f.source, f.source_size,
         CASE WHEN f.k < coalesce(l.k, 9223372036854775807) THEN (2 * f.source_size)::DOUBLE
              ELSE (g.rest * f.weight)::DOUBLE / (2 * g.open_weight)::DOUBLE END AS target,
         ('0x' || substr(md5('mix-1:' || coalesce(f.source, chr(0) || 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM f CROSS JOIN l LEFT JOIN f g ON g.k = l.k
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST)::DOUBLE AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(floor(rate * k + u) - floor(rate * (k - 1) + u), 2) * size)::BIGINT AS taken
FROM r
"""
