"""Sharding by histogram sort: shards of near-equal bytes, one exchange.

Rows are ordered by (hash of the text, doc_id), so equal texts lie side by side
and any order in the input is broken up.  Splitters between shards are found as
in histogram sort: every round counts the exact rows and bytes between
candidate boundaries over all partitions (one small aggregate), and only the
intervals that hold an unfinished splitter are probed again, 256 times finer,
until each splitter lies within the tolerance of its target.  A group of equal
texts is cut only where it alone is wider than the tolerance; then its rows are
divided by doc_id.  The driver sees a histogram bounded by 256 counters per
splitter, never rows.

Once the splitters are known the rows are exchanged once, into pieces that
never straddle a shard, and numbered: the rows before a piece are known from
the same exact counts.

Defined cases: null text has 0 bytes (size 16) and the checksum of the empty
text; very long texts are measured whole; ids that aren't whole numbers are
ordered by a hash of their text; null ids order first; an empty table gives an empty result; rows that are
equal in text and id are kept together; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Parameters of the production query.
SHARDS = 40
TOLERANCE = 0.002
OVERHEAD = 16
PIECES = 8
_BITS = 8
_FIRST_BITS = 16


def _bits(key: Column, start: int, count: int) -> Column:
    """``count`` bits of an unsigned 64-bit key from bit ``start``, the highest bit first."""
    return F.shiftrightunsigned(key, 64 - start - count).bitwiseAND(F.lit((1 << count) - 1)).cast("int")


def _prefix(start: int) -> tuple[Column, Column]:
    """The first ``start`` bits of the 128-bit key (k1, k2) as two longs."""
    zero = F.lit(0).cast("long")
    if start == 0:
        return zero, zero
    if start <= 64:
        return F.shiftrightunsigned(F.col("k1"), 64 - start), zero
    return F.col("k1"), F.shiftrightunsigned(F.col("k2"), 128 - start) if start > 64 else zero


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def splitters(keyed: DataFrame, shards: int, tolerance: float, pieces: int = 1) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """Boundaries between ``shards`` * ``pieces`` runs of near-equal bytes.

    Returns the boundaries as 128-bit keys (bits, length), the exact (rows,
    bytes) below each, and the number of rounds.  ``keyed`` has k1, k2 (longs,
    unsigned order) and size.
    """
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    runs = shards * pieces
    goals = [total[0] * i / runs for i in range(1, runs)]
    allowed = [tolerance * total[0] / shards / (1 if i % pieces == 0 else 0.02) for i in range(1, runs)]
    found: dict[int, tuple[int, int, int, int]] = {}
    # An open interval is a prefix of the key; splitters that fall in it wait there.
    waiting: dict[int, list[int]] = {0: list(range(runs - 1))}
    below: dict[int, tuple[int, int]] = {0: (0, 0)}
    start = rounds = 0
    while waiting and start < 128 and total[1]:
        width = min(_FIRST_BITS if start == 0 else _BITS, 64 - start % 64)
        rounds += 1
        word = F.col("k1") if start < 64 else F.col("k2")
        a, b = _prefix(start)
        rows = keyed
        if start:
            if start <= 64:
                rows = rows.filter(a.isin([_signed(p) for p in waiting]))
            else:
                rows = rows.filter(F.col("k1").isin(sorted({_signed(p >> (start - 64)) for p in waiting})))
        counts = rows.groupBy(a.alias("a"), b.alias("b"), _bits(word, start % 64, width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
        by: dict[int, dict[int, tuple[int, int]]] = {}
        for r in counts.collect():
            p = r["a"] % (1 << 64) if start <= 64 else ((r["a"] % (1 << 64)) << (start - 64)) | r["b"] % (1 << 64)
            by.setdefault(p, {})[r["bucket"]] = (r["n"], r["bytes"])
        next_waiting: dict[int, list[int]] = {}
        next_below: dict[int, tuple[int, int]] = {}
        for p, wanted in waiting.items():
            n, size = below[p]
            got = sorted(by.get(p, {}).items())
            wanted = sorted(wanted, key=lambda i: goals[i])
            k = 0
            for bucket, (dn, dsize) in got:
                last = start + width >= 128
                while k < len(wanted) and goals[wanted[k]] <= size + dsize:
                    i = wanted[k]
                    low, high = abs(goals[i] - size), abs(size + dsize - goals[i])
                    edge = (p << width) | bucket
                    if min(low, high) <= allowed[i] or last:
                        found[i] = (edge if low <= high else edge + 1, start + width, *((n, size) if low <= high else (n + dn, size + dsize)))
                    else:
                        next_waiting.setdefault(edge, []).append(i)
                        next_below[edge] = (n, size)
                    k += 1
                n, size = n + dn, size + dsize
            for i in wanted[k:]:
                found[i] = ((p << width) + (1 << width), start + width, n, size)
        waiting, below, start = next_waiting, next_below, start + width
    edges = sorted((found.get(i, (0, 1, 0, 0)) for i in range(runs - 1)), key=lambda e: e[0] << (128 - e[1]))
    return [(e[0], e[1]) for e in edges], [(e[2], e[3]) for e in edges], rounds


def _runs(k1: np.ndarray, k2: np.ndarray, edges: list[tuple[int, int]]) -> np.ndarray:
    """The number of boundaries at or below each key."""
    full = [bits << (128 - length) for bits, length in edges]
    full = [f for f in full if f < 1 << 128]
    hi = np.array([f >> 64 for f in full], np.uint64)
    lo = np.array([f & ((1 << 64) - 1) for f in full], np.uint64)
    out = np.searchsorted(hi, k1, side="left")
    end = np.searchsorted(hi, k1, side="right")
    for i in np.flatnonzero(end > out):
        out[i] += np.searchsorted(lo[out[i] : end[i]], k2[i], side="right")
    return out.astype(np.int32)


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE, overhead: int = OVERHEAD, pieces: int = PIECES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row.

    A shard is numbered in ``pieces`` runs, so that no task sorts a whole shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    flip = F.lit(-(1 << 63)).cast("long")
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    ident = F.coalesce(F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string"))), flip)
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("k1"), ident.bitwiseXOR(flip).alias("k2"))
    keyed = cut(base, "shard")
    edges, counts, _ = splitters(keyed, shards, tolerance, pieces)
    runs = shards * pieces

    def place(batches):
        for batch in batches:
            k1, k2 = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in ("k1", "k2"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_runs(k1, k2, edges))], names=[*batch.schema.names, "run"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema)
    signed = keyed.mapInArrow(place, f"{schema}, run int")
    placed = signed.withColumns({"s1": F.col("k1").bitwiseXOR(flip), "s2": F.col("k2").bitwiseXOR(flip)})
    # rows before a run within its shard, from the exact counts
    starts = [0] + [n for n, _ in counts]
    first = F.array(*[F.lit(starts[r] - starts[r - r % pieces]).cast("long") for r in range(runs)])
    own = F.row_number().over(Window.partitionBy("run").orderBy("s1", "s2", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.expr(f"cast(run div {pieces} as int)").alias("shard"), (F.element_at(first, F.col("run") + 1) + own - 1).cast("long").alias("slot"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
