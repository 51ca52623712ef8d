"""Dataset quality checks, de-duplication and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered

# Fixed value: what makes an output Japanese.
JAPANESE = r"[\u3040-\u30ff\u4e00-\u9fff]"


def problems(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, problem), one row for each rule that holds."""
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(found).alias("problem"))


def keep_first(rows: DataFrame, fingerprint: Column, order: list) -> DataFrame:
    """The first row of each fingerprint, by an aggregate that is partly computed before the exchange."""
    names = rows.columns
    picked = rows.withColumn("__f", fingerprint).groupBy("__f").agg(F.min(F.struct(*order, F.struct(*names).alias("__row"))).alias("m"))
    return picked.select("m.__row.*")


def duplicate_groups(rows: DataFrame, fingerprint: Column, key: str) -> DataFrame:
    """(fingerprint, n, first key) of fingerprints that occur more than once."""
    return rows.groupBy(fingerprint.alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).filter("n > 1")


def length_statistics(rows: DataFrame, length: Column) -> DataFrame:
    """n, least, most, mean and upper median (the value at position n div 2, from 0) of a length.

    The median comes from counts by length, which are few, not from a sort of all rows.
    """
    counts = rows.groupBy(length.alias("len")).agg(F.count(F.lit(1)).alias("k"))
    total = counts.agg(F.sum("k").alias("n"), F.min("len").alias("least"), F.max("len").alias("most"), (F.sum(F.col("len") * F.col("k")) / F.sum("k")).alias("mean"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.orderBy("len")))
    median = upto.crossJoin(F.broadcast(total.select("n"))).filter("upto > n div 2").agg(F.min("len").alias("median"))
    return total.crossJoin(median)


def dataset_statistics(rows: DataFrame) -> DataFrame:
    """One row about records (instruction, input, output): lengths, shares with code and with Japanese, and repeated instructions.

    Nulls are empty.  Code is a fence, a definition or an import; ratios are in
    per cent.  A table without rows gives none.
    """
    own = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("instruction", "input", "output")])
    out = F.col("output")
    code = F.contains(out, F.lit("```")) | F.contains(out, F.lit("def ")) | F.contains(out, F.lit("import "))
    counts = own.agg(F.avg(F.length("input")).alias("input_len_avg"), F.count_if(code).alias("code_block_count"), F.count_if(out.rlike(JAPANESE)).alias("japanese_output_count"))
    repeated = own.groupBy("instruction").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("duplicate_instructions_count"))
    lengths = length_statistics(own, F.length("output")).filter("n > 0")
    # a row each
    whole = lengths.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(repeated))
    return whole.select(
        F.col("n").alias("total_records"), F.col("least").alias("output_len_min"), F.col("most").alias("output_len_max"), F.col("mean").alias("output_len_avg"), F.col("median").alias("output_len_median"),
        "input_len_avg", "code_block_count", (F.col("code_block_count") / F.col("n") * 100).alias("code_block_ratio_pct"), "japanese_output_count", (F.col("japanese_output_count") / F.col("n") * 100).alias("japanese_output_ratio_pct"), "duplicate_instructions_count",
    )


def repeated_instructions(rows: DataFrame, position: str, most: int = 5) -> DataFrame:
    """(instruction, n) of the first instructions that occur more than once, in the order of their first rows."""
    counted = rows.groupBy(F.coalesce("instruction", F.lit("")).alias("instruction")).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return counted.filter("n > 1").orderBy("first").limit(most).select("instruction", "n")


def split_parts(rows: DataFrame, key: Column, shares: tuple[float, ...] = (0.85, 0.10), names: tuple[str, ...] = ("train", "val", "test"), seed: str = "42") -> DataFrame:
    """A split column; sizes are the floors of the shares of n and the rest, in the order of a seeded digest.

    Places are exact and no task sees all rows.
    """
    order = F.md5(F.concat(F.lit(seed), key))
    n = rows.count()
    cuts = [int(n * s) for s in shares]
    ranked = numbered(rows, [], [order], "__k")
    part = F.when(F.col("__k") <= cuts[0], names[0]).when(F.col("__k") <= cuts[0] + cuts[1], names[1]).otherwise(names[2])
    return ranked.withColumn("split", part).drop("__k")
