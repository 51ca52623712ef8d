"""What a row's place in its group says, without a task that sees a large group.

Groups of at most ``LARGE`` rows are plain windows: one exchange.  The rows of
larger ones are dealt by range of (group, order) and written, so a group with a
third of all rows lies in many ranges, and what a window needs from outside of a
row's range comes from a table of one row for each group and range.  The results
are the same.  Rows that tie in the order are in any order; nulls come first; a
null is a group like any other; an empty group list makes all rows one group,
which counts as large.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


#: Rows of a group that one task sorts, at most.
LARGE = 100_000
#: Hashes by which groups are counted first.
PARTS = 1 << 16


def _large(rows: DataFrame, group: list[str]) -> DataFrame | None:
    """The groups of more than ``LARGE`` rows, written; None if there are none.

    Rows are counted by a hash of their group first, so groups themselves are
    exchanged only where the rows of a hash are that many.
    """
    part = F.pmod(F.xxhash64(*group), F.lit(PARTS))
    full = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > LARGE).select("__part")
    # at most PARTS rows
    full = [r["__part"] for r in full.collect()]
    if not full:
        return None
    within = rows.filter(part.isin(full)) if len(full) <= 1000 else rows
    counts = within.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > LARGE)
    large = cut(counts.select(*group), "large-groups", few_files=True)
    return None if large.isEmpty() else large


def _by_size(rows: DataFrame, group: list[str], plain: Callable[[DataFrame], DataFrame], ranged: Callable[[DataFrame], DataFrame], counted: DataFrame | None = None) -> DataFrame:
    """``plain`` of the rows of groups up to ``LARGE``, ``ranged`` of the others; the groups are counted in parts first.

    ``counted`` has at least a row for each row of a group, if that is cheaper to count.
    """
    if not group:
        return ranged(rows)
    large = _large(rows if counted is None else counted, group)
    if large is None:
        return plain(rows)
    names = {c: f"__l{i}" for i, c in enumerate(group)}
    large = large.withColumnsRenamed(names)
    on = F.lit(True)
    for c, n in names.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    return plain(rows.join(large, on, "left_anti")).unionByName(ranged(rows.join(large, on, "left_semi")))


def _dealt(rows: DataFrame, group: list[str], order: list) -> tuple[DataFrame, list[str]]:
    """The rows by range, written, with __range and the order as columns, and the names of those."""
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.withColumns({f"__o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)})
    keys = [f"__o{i}" for i in range(len(order))]
    return cut(keyed.repartitionByRange(parts, *group, *keys).withColumn("__range", F.spark_partition_id()), "ranges"), keys


def _own(group: list[str], keys: list[str]):
    return Window.partitionBy("__range", *group).orderBy(*keys)


def _ranges(group: list[str]):
    return Window.partitionBy(*group).orderBy("__range")


def _earlier(group: list[str]):
    return _ranges(group).rowsBetween(Window.unboundedPreceding, -1)


def _told(own: DataFrame, facts: DataFrame, group: list[str]) -> DataFrame:
    """The rows with the facts of their group and range."""
    names = {c: f"__g{i}" for i, c in enumerate(group)}
    on = F.col("__range") == F.col("__r")
    for c, g in names.items():
        on = on & F.col(c).eqNullSafe(F.col(g))
    return own.join(facts.withColumnsRenamed(names | {"__range": "__r"}), on)


def numbered(rows: DataFrame, group: list[str], order: list, name: str = "k", size: str | None = None) -> DataFrame:
    """rows with a number from 1 in each group, by the order's columns, and the group's number of rows if ``size`` names it."""
    whole = Window.partitionBy(*group)
    more = [F.count(F.lit(1)).over(whole).alias(size)] if size else []
    plain = lambda own: own.select(*own.columns, F.row_number().over(whole.orderBy(*order)).cast("long").alias(name), *more)
    return _by_size(rows, group, plain, lambda own: _numbered(own, group, order, name, size))


def _numbered(rows: DataFrame, group: list[str], order: list, name: str, size: str | None) -> DataFrame:
    dealt, keys = _dealt(rows, group, order)
    counts = cut(dealt.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n")), "counts")
    facts = counts.select(*group, "__range", F.coalesce(F.sum("__n").over(_earlier(group)), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*group)).alias("__size"))
    own = dealt.withColumn("__own", F.row_number().over(_own(group, keys)))
    more = [F.col("__size").alias(size)] if size else []
    return _told(own, facts, group).select(*rows.columns, (F.col("__own") + F.col("__before")).cast("long").alias(name), *more)


def running_total(rows: DataFrame, group: list[str], order: list, value: Column, name: str = "total") -> DataFrame:
    """rows with the sum of the value up to the row; null as long as all values are."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain = lambda own: own.withColumn(name, F.sum(value).over(before))
    return _by_size(rows, group, plain, lambda own: _running_total(own, group, order, value, name))


def _running_total(rows: DataFrame, group: list[str], order: list, value: Column, name: str) -> DataFrame:
    dealt, keys = _dealt(rows.withColumn("__v", value), group, order)
    sums = cut(dealt.groupBy(*group, "__range").agg(F.sum("__v").alias("__s")), "sums")
    facts = sums.select(*group, "__range", F.sum("__s").over(_earlier(group)).alias("__before"))
    own = dealt.withColumn("__own", F.sum("__v").over(_own(group, keys).rowsBetween(Window.unboundedPreceding, 0)))
    total = F.coalesce(F.col("__own") + F.col("__before"), "__own", "__before")
    return _told(own, facts, group).select(*rows.columns, total.alias(name))


def earlier_largest(rows: DataFrame, group: list[str], order: list, values: dict[str, Column], counted: DataFrame | None = None) -> DataFrame:
    """rows with the largest of each named value in earlier rows of the group; null if there is none.

    ``counted`` (the group's columns) has at least a row for each of a group's, if that is cheaper to count.
    """
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    plain = lambda own: own.withColumns({v: F.max(c).over(before) for v, c in values.items()})
    return _by_size(rows, group, plain, lambda own: _earlier_largest(own, group, order, values), counted)


def _earlier_largest(rows: DataFrame, group: list[str], order: list, values: dict[str, Column]) -> DataFrame:
    dealt, keys = _dealt(rows.withColumns(values), group, order)
    most = cut(dealt.groupBy(*group, "__range").agg(*[F.max(v).alias(f"__m{i}") for i, v in enumerate(values)]), "largest")
    facts = most.select(*group, "__range", *[F.max(f"__m{i}").over(_earlier(group)).alias(f"__b{i}") for i in range(len(values))])
    before = _own(group, keys).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({f"__w{i}": F.max(v).over(before) for i, v in enumerate(values)})
    return _told(own, facts, group).select(*rows.columns, *[F.greatest(f"__w{i}", f"__b{i}").alias(v) for i, v in enumerate(values)])


def neighbours(rows: DataFrame, group: list[str], order: list, value: Column, previous: str = "previous", following: str = "next") -> DataFrame:
    """rows with the value of the row before and of the row behind in the group; null at its ends."""
    w = Window.partitionBy(*group).orderBy(*order)
    plain = lambda own: own.withColumns({previous: F.lag(value).over(w), following: F.lead(value).over(w)})
    return _by_size(rows, group, plain, lambda own: _neighbours(own, group, order, value, previous, following))


def _neighbours(rows: DataFrame, group: list[str], order: list, value: Column, previous: str, following: str) -> DataFrame:
    # in a struct, so that a neighbour's null isn't taken for a missing neighbour
    dealt, keys = _dealt(rows.withColumn("__v", F.struct(value.alias("v"))), group, order)
    at = F.struct(*keys)
    ends = cut(dealt.groupBy(*group, "__range").agg(F.min_by("__v", at).alias("__first"), F.max_by("__v", at).alias("__last")), "ends")
    facts = ends.select(*group, "__range", F.lag("__last").over(_ranges(group)).alias("__before"), F.lead("__first").over(_ranges(group)).alias("__after"))
    own = dealt.withColumns({"__p": F.lag("__v").over(_own(group, keys)), "__n": F.lead("__v").over(_own(group, keys))})
    out = _told(own, facts, group)
    return out.select(*rows.columns, F.coalesce("__p", "__before")["v"].alias(previous), F.coalesce("__n", "__after")["v"].alias(following))
