"""Arrow batches of bounded bytes."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

MOST_BYTES, MOST_ROWS = 4 << 20, 4096


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes and rows of Arrow batches, as rows can be very long texts; lower bounds of the session stay.

    The bounds are settings of the session, read when a query runs, so they
    hold for its other Arrow batches too.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", MOST_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", MOST_ROWS)):
        now = re.match(r"\d+", spark.conf.get(key))
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))
