"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..batches import bounded_batches  # noqa: F401
from ..storage import cut, discard, shared_dir  # noqa: F401

#: A word is a maximal run of characters other than ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]++"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], name: str) -> str:
    """A name that none of the columns has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(docs: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: within ``run`` they are c0, c1 and so on, before and after."""
    numbered = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, numbered).toDF(*schema.names)


def word_count(text):
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bound(value: Column, use: Callable) -> Column:
    """``use(value)``, where the value is computed once: inside lambdas a column is else computed anew for every item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Items of a stretch in a running fold.
_FOLD = 64


def running(items: Column, first: Column, state: str, step: Callable, emit: Callable, kind: str) -> Column:
    """``emit(state, item)``, of type ``kind``, for each item of an array; ``step(state, item)`` is the next state, of type ``state``.

    A fold copies its accumulator at every step.  So the first fold keeps only
    the states at which stretches of the array begin, and each stretch is then
    folded on its own: the work grows nearly with the number of items.
    """
    none = F.array()

    def stretches(xs):
        cuts = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _FOLD).cast("int"))).otherwise(none.cast("array<int>"))
        return F.transform(cuts, lambda k: F.slice(xs, k * _FOLD + 1, _FOLD))

    def begun(parts):
        start = F.struct(first.alias("state"), none.cast(f"array<{state}>").alias("seen"))
        return F.aggregate(parts, start, lambda acc, own: F.struct(F.aggregate(own, acc["state"], step).alias("state"), F.concat(acc["seen"], F.array(acc["state"])).alias("seen")), lambda acc: acc["seen"])

    def told(own, begin):
        start = F.struct(begin.alias("state"), none.cast(f"array<{kind}>").alias("out"))
        return F.aggregate(own, start, lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x))).alias("out")), lambda acc: acc["out"])

    return bound(items, lambda xs: bound(stretches(xs), lambda parts: F.flatten(F.zip_with(parts, begun(parts), told))))


def sums_before(numbers: Column) -> Column:
    """For each number of an array of int the sum of those before it."""
    return running(numbers, F.lit(0), "int", lambda total, n: total + n, lambda total, n: total, "int")


#: Code points of the stretches that :func:`cut_out` reads.
STRETCH = 256


def stretches(text: Column) -> Column:
    """The text in stretches of ``STRETCH`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))


def cut_out(parts: Column, start: Column, count: Column) -> Column:
    """``count`` code points from ``start`` of a text given by its stretches; it isn't walked from its beginning."""
    first = F.floor(start / STRETCH).cast("int")
    last = F.floor((start + count) / STRETCH).cast("int")
    return F.substr(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), start - first * STRETCH + 1, count)


def span_sql(patterns: list[tuple[str, str]]) -> str:
    """DuckDB CTEs ``d(r, doc_id, t)`` and ``spans(r, k, kind, g, b, e)`` of the leftmost matches of each (kind, pattern).

    Offsets follow from the lengths of the matches and of the pieces between
    them; b is the first code point of a match, e the one behind it.
    """
    quoted = [(kind, "'" + p.replace("'", "''") + "'") for kind, p in patterns]
    parts = [f"SELECT r, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, {p}) AS m, regexp_split_to_array(t, {p}) AS s FROM d" for k, (kind, p) in enumerate(quoted)]
    return (
        "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), found AS (" + " UNION ALL ".join(parts) + "), "
        "places AS (SELECT r, k, kind, m, s, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0), "
        "begun AS (SELECT r, k, kind, m[i] AS g, coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS b FROM places), "
        "spans AS (SELECT r, k, kind, g, b::BIGINT AS b, (b + length(g))::BIGINT AS e FROM begun)"
    )
