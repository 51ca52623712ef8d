"""Tables that may be broadcast because their size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes and rows of a dictionary, a rule table or a set of questions that is broadcast, at most.
MOST_BYTES = 16 << 20
MOST_ROWS = 200_000


def is_small(df: DataFrame, most_rows: int = MOST_ROWS) -> bool:
    """Whether ``df`` has at most so many rows and ``MOST_BYTES`` bytes.

    The size is counted, as estimates of planners don't know how long texts are:
    at most that many rows are looked at, and their bytes as JSON are summed.
    """
    own = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, size = df.select(own.alias("b")).limit(most_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= most_rows and size <= MOST_BYTES


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it is small; else as it is, for a join that exchanges both sides."""
    return F.broadcast(df) if is_small(df) else df
