"""Near duplicates of embeddings by an exact metric range join.

Vectors of length one with cosine c are sqrt(2 - 2c) apart, so cosine >= t asks
for all pairs within r = sqrt(2 - 2t) of each other.  Pivots, taken from the
vectors themselves, divide them into cells (a vector is at home with its nearest
pivot).  By the triangle inequality a vector within r of one at home with pivot
p lies at most r beyond the border between the two cells; a vector is copied
to every such cell and to no other.  Each cell then joins on its own: its
vectors at home meet all vectors in the cell, in blocks.  So every vector finds
all its neighbours in its home cell, links are counted there, and no pair is
found twice or sent on: a block returns one count for each vector and a
spanning forest of the links it saw.

Pivots come in two levels of bounded number.  The top ones, at most ``TOP`` of a
length and ``TOP_COMPONENTS`` components in all, are drawn by the driver and
broadcast.  A top cell that is home to more than ``SPLIT`` times ``CELL`` vectors
is divided again by pivots of its own, at most ``TOP``, which one task draws from
a sample of the cell; its vectors meet them in groups of bounded size.  Where
the sample says that a vector would be copied to more than a quarter of the new
cells, the cell stays whole, as copies would cost more than they save.  The argument above holds within the cell, as every neighbour of a
vector at home there is in it.  So the driver's share doesn't grow with the
table.  Within a level a cell of n vectors has one pivot for every ``CELL`` of
them, or the square root of n where that is less.  Pivots are drawn by digest
and lie more than r apart: a dense region gets its share of them, and a group of
near copies one.

Equal vectors are one vector with a number of copies before anything else, so
a very common vector costs nothing.  A cell of any size is cut into blocks of
bounded size, each pair of blocks a task of its own; two blocks at home meet once
for both.  Vectors are sent as they came (in single precision, if they did),
once for each block that theirs meets.  Distances are computed in single
precision with a margin and decided in double precision.

How much is copied depends on the data: well separated vectors stay at home,
while vectors without any structure in many dimensions lie near most borders.
Where the vectors of a length belong to more than ``SPREAD`` top cells and one
in ``DENSE`` of them on average, cells are given up for that length, as they would multiply
what is sent and save little: all blocks meet all blocks, which is exact and
bounded in memory but quadratic in work.

Vectors of each length have pivots and cells of their own and join with each
other alone.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite
components link with nothing and keep themselves; all others take part whatever
the size of their components, which are divided by the largest before the norm;
vectors of different lengths don't link; equal vectors link; rows with equal ids
count as vectors of their own; null ids order first; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table
from .components import connected_components, forest

THRESHOLD = 0.95
#: Vectors to a cell that are aimed at, as long as the cells are fewer than the square root of the vectors.
CELL = 4096
#: Vectors in a block at most (about), and their components; one vector is a block at least.
BLOCK = 1 << 16
BLOCK_COMPONENTS = 1 << 22
#: Blocks that a cell is cut into, about, before they grow beyond ``LEAST_BLOCK`` vectors, so that there are pairs for all cores.
SPREAD, LEAST_BLOCK = 8, 4096
#: Pivots of a level at most, and components of all top pivots.
TOP, TOP_COMPONENTS = 256, 1 << 21
#: A top cell of more than this many times ``CELL`` vectors is divided again; its vectors meet its pivots so many at a time.
#: New cells for each copy that a division makes, at least.
SPLIT, MEET, WORTH = 4, 1 << 14, 4
#: Vectors that belong to more than one in so many top cells (and to more than ``SPREAD``) have no use of cells.
DENSE = 2
#: Vectors looked at for each pivot that is wanted.
_TRIES = 4
#: Distances in one matrix of the search for homes.
_DISTANCES = 1 << 21
#: Products of a pair of blocks that are held at a time.
_PRODUCTS = 1 << 24
#: Covers the rounding of single-precision products.
_MARGIN = 1e-4


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one: divided by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column) -> np.ndarray:
    """A list column of vectors of equal lengths as a float64 matrix of rows of length one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


def _block_links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b whose cosine, in double precision, is at least the threshold; rows have length one."""
    a4, b4 = a.astype(np.float32), b.astype(np.float32)
    left, right = [], []
    step = max(64, _PRODUCTS // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(a4[i : i + step] @ b4.T >= threshold - _MARGIN)
        for k in range(0, len(x), 1 << 16):
            p, q = x[k : k + (1 << 16)] + i, y[k : k + (1 << 16)]
            ok = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
            left.append(p[ok])
            right.append(q[ok])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def spread(candidates: np.ndarray, count: int, radius: float) -> np.ndarray:
    """Up to ``count`` of the candidates, in their order, that are more than the radius apart; one at least."""
    chosen = np.empty((count, candidates.shape[1]))
    n = 0
    for x in candidates:
        if n == count:
            break
        if not n or (2 - 2 * (chosen[:n] @ x)).min() > radius * radius:
            chosen[n] = x
            n += 1
    return chosen[:n]


def _wanted(count: int, cell: int, most: int) -> int:
    """Pivots for so many vectors."""
    return max(1, min(math.ceil(count / cell), math.isqrt(count), most))


def _places(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home of each row of a matrix, and rows and pivots of the cells that it belongs to."""
    homes, rows, cells = [], [], []
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 1e-12))
    step = max(1, _DISTANCES // len(pivots))
    for k in range(0, len(x), step):
        square = np.maximum(2 - 2 * (x[k : k + step] @ pivots.T), 0)
        home = square.argmin(1)
        own = square[np.arange(len(square)), home]
        # distance to the plane between the two pivots, and the plain triangle bound
        near = ((square - own[:, None]) / (2 * apart[home]) <= radius + 1e-9) & (np.sqrt(square) - np.sqrt(own)[:, None] <= 2 * radius + 1e-9)
        near[np.arange(len(square)), home] = True
        at, cell = np.nonzero(near)
        homes.append(home)
        rows.append(at + k)
        cells.append(cell)
    return np.concatenate(homes), np.concatenate(rows), np.concatenate(cells)


def _divided(copied: DataFrame, large: dict[int, tuple[int, int]], cell: int, radius: float, top: int) -> DataFrame:
    """The rows (node, copies, x, cell, asks) of large cells, by vectors at home and in all, dealt to cells of a second level."""
    spark = copied.sparkSession
    big = cut(copied.filter(F.col("cell").isin(list(large))), "vectors-large")
    # node keys are digests, so the smallest of a cell are a sample; each task keeps no more than that of a cell
    first = F.row_number().over(Window.partitionBy("cell").orderBy("node"))
    wanted = F.create_map(*[F.lit(v) for c, (n, _) in large.items() for v in (c, _wanted(n, cell, top))])
    sample = big.select("cell", "node", "x").withColumn("k", first).filter(F.col("k") <= _TRIES * top).withColumn("wanted", wanted[F.col("cell")])

    def draw(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k").combine_chunks()
        count = rows.column("wanted")[0].as_py()
        x = _matrix(rows.column("x").chunk(0))[: _TRIES * count]
        pivots = spread(x, count, radius)
        if WORTH * len(_places(x, pivots, radius)[1]) > len(pivots) * len(x):
            pivots = pivots[:1]
        return pa.table({"cell": pa.array([rows.column("cell")[0].as_py()], pa.int64()), "pivots": pa.array([pivots.tobytes()], pa.binary())})

    pivots = cut(sample.groupBy("cell").applyInArrow(draw, "cell bigint, pivots binary"), "vectors-pivots", few_files=True)
    groups = F.create_map(*[F.lit(v) for c, (_, n) in large.items() for v in (c, math.ceil(n / MEET))])
    dealt = big.withColumn("group", F.pmod(F.xxhash64("node"), groups[F.col("cell")]).cast("int"))
    sent = pivots.withColumn("group", F.explode(F.sequence(F.lit(0), groups[F.col("cell")] - 1)))

    def place(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        if not rows.num_rows:
            return rows.select(["node", "copies", "x", "cell", "asks"])
        x = _matrix(rows.column("x").chunk(0))
        p = np.frombuffer(own.column("pivots")[0].as_py(), np.float64).reshape(-1, x.shape[1])
        home, at, sub = _places(x, p, radius)
        cells = rows.column("cell").to_numpy()[at] + sub + 1
        asks = rows.column("asks").to_numpy(zero_copy_only=False)[at] & (home[at] == sub)
        taken = rows.take(pa.array(at))
        return pa.table({"node": taken.column("node"), "copies": taken.column("copies"), "x": taken.column("x"), "cell": pa.array(cells), "asks": pa.array(asks)})

    return dealt.groupBy("cell", "group").cogroup(sent.groupBy("cell", "group")).applyInArrow(place, copied.schema)


def link(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, cell: int = CELL, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    The driver gets the candidates for the top pivots, ``_TRIES`` times their
    number, one counter for each length, and one for each top cell: all of them
    bounded, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    radius = math.sqrt(2 - 2 * threshold)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("x"))
    sound = F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v).cast("double") == float("inf")))
    largest = F.array_max(F.transform("x", lambda v: F.abs(v)))
    rows = rows.withColumn("largest", F.when(sound & (largest > 0), largest))
    # equal vectors are one node; its key is a digest of the components
    node = F.unhex(F.md5(F.to_binary(F.array_join(F.transform("x", lambda v: F.hex((v.cast("double") + 0.0).cast("string"))), ","), F.lit("utf-8"))))
    heard = F.col("largest").isNotNull()
    keyed = cut(rows.select("vec_id", F.when(heard, node).alias("node"), F.when(heard, F.col("x")).alias("x")), "vectors")
    nodes = cut(keyed.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("x").alias("x")), "nodes")
    counts = {r["n"]: r["k"] for r in nodes.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy("n").collect()}
    if not counts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # by length: the first of its cells and its pivots; a length of one cell needs no pivot
    cells_of, total = {}, 0
    for n, k in counts.items():
        wanted = _wanted(k, cell, min(top, max(1, TOP_COMPONENTS // (n * len(counts)))))
        pivots = None
        if wanted > 1:
            # node keys are digests, so the smallest are a sample
            pivots = spread(_unit(np.array([r["x"] for r in nodes.filter(F.size("x") == n).orderBy("node").limit(_TRIES * wanted).collect()], np.float64)), wanted, radius)
            wanted = len(pivots)
        cells_of[n] = (total, pivots)
        total += wanted
    shared = spark.sparkContext.broadcast(cells_of)
    # a top cell leaves room for the numbers of the cells it is divided into
    room = top + 1

    def place(batches):
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for n in np.unique(lengths):
                own = batch if (lengths == n).all() else batch.take(pa.array(np.flatnonzero(lengths == n)))
                first, pivots = shared.value[int(n)]
                one = np.zeros(own.num_rows, np.int64)
                home, at, cells = (one, np.arange(own.num_rows), one) if pivots is None else _places(_matrix(own.column(2)), pivots, radius)
                cuts = np.searchsorted(at, np.arange(own.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array((home + first) * room), pa.ListArray.from_arrays(pa.array(cuts), pa.array((cells + first) * room))], names=["node", "copies", "x", "home", "cells"])

    placed = cut(nodes.select("node", "copies", "x").mapInArrow(place, f"node binary, copies bigint, x {nodes.schema['x'].dataType.simpleString()}, home bigint, cells array<bigint>"), "placed")
    copied = placed.select("node", "copies", "x", "home", F.explode("cells").alias("cell")).select("node", "copies", "x", "cell", (F.col("home") == F.col("cell")).alias("asks"))
    # one counter for each top cell
    held = copied.groupBy("cell").agg(F.count_if("asks").alias("home"), F.count(F.lit(1)).alias("n")).collect()
    whole = set()
    for n, (first, pivots) in cells_of.items():
        cells = 1 if pivots is None else len(pivots)
        own = range(first * room, (first + cells) * room)
        if sum(r["n"] for r in held if r["cell"] in own) > max(SPREAD, cells / DENSE) * counts[n]:
            whole.add(n)
            held = [r for r in held if r["cell"] not in own]
    if whole:
        # all vectors of such a length are at home in a cell of their own, the first of their cells
        dense = F.size("x").isin(sorted(whole))
        start = F.create_map(*[F.lit(v) for n in sorted(whole) for v in (n, cells_of[n][0] * room)])
        one = placed.filter(dense).select("node", "copies", "x", start[F.size("x")].cast("long").alias("cell"), F.lit(True).alias("asks"))
        copied = copied.filter(~dense).unionByName(one)
    large = {r["cell"]: (r["home"], r["n"]) for r in held if r["home"] > SPLIT * cell and _wanted(r["home"], cell, top) > 1}
    if large:
        copied = cut(copied.filter(~F.col("cell").isin(list(large))).unionByName(_divided(copied, large, cell, radius, top)), "vectors-cells")
    most = F.least(F.lit(block), F.floor(F.lit(BLOCK_COMPONENTS) / F.first(F.size("x"))), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.count(F.lit(1)) / SPREAD)))
    size = F.greatest(F.lit(1), most)
    # blocks at home come first, then those of the cell's other vectors
    blocks = copied.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count_if("asks") / size)).cast("int").alias("n_in"), F.ceil(F.count_if(~F.col("asks")) / size).cast("int").alias("n_out"))
    h = F.xxhash64("node")
    number = F.when(F.col("asks"), F.pmod(h, F.col("n_in"))).otherwise(F.col("n_in") + F.pmod(h, F.col("n_out"))).cast("int")
    copied = copied.join(cut(blocks, "vectors-blocks", few_files=True), "cell").withColumn("block", number)
    # a block at home meets all blocks, one of the others those at home
    sent = copied.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_in") + F.when(F.col("asks"), F.col("n_out")).otherwise(0) - 1)))
    sent = sent.select("node", "copies", "x", "cell", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") <= F.col("other")).alias("left"), (F.greatest("block", "other") < F.col("n_in")).alias("both"))

    def join(group: pa.Table) -> pa.Table:
        def told(names, links, roots):
            return pa.table({"node": names, "links": pa.array(links, pa.int64()), "root": roots})

        group = group.combine_chunks()
        names = group.column("node")
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        left = group.column("left").to_numpy(zero_copy_only=False)
        alone = group.num_rows and group.column("a")[0] == group.column("b")[0]
        mine, theirs = np.flatnonzero(left), np.flatnonzero(left if alone else ~left)
        if not len(mine) or not len(theirs):
            return told(names.slice(0, 0), [], names.slice(0, 0))
        x = _matrix(group.column("x").combine_chunks())
        keys, code = np.unique(np.array(names.to_pylist(), dtype=object), return_inverse=True)
        p, q = _block_links(x[mine], x[theirs], threshold)
        p, q = mine[p], theirs[q]
        different = code[p] != code[q]
        p, q = p[different], q[different]
        copies = group.column("copies").to_numpy()
        links = np.bincount(p, weights=copies[q], minlength=len(x))
        if not alone and group.column("both")[0].as_py():
            links += np.bincount(q, weights=copies[p], minlength=len(x))
        links = links.astype(np.int64)
        have = np.flatnonzero(links)
        node, root = forest(len(keys), code[p], code[q])
        own = keys[code[have]].tolist()
        return told(pa.array(own + keys[node].tolist(), pa.binary()), np.concatenate([links[have], np.zeros(len(node), np.int64)]), pa.array(own + keys[root].tolist(), pa.binary()))

    found = cut(sent.groupBy("cell", "a", "b").applyInArrow(join, "node binary, links bigint, root binary"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("node <> root"), "node", "root")
    summary = nodes.select("node", "copies", "least").join(links, "node", "left").join(parts.withColumnRenamed("component", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # written, so that a large component can be split in the join
    named = cut(summary.groupBy("root").agg(F.min("least").alias("component_id")), "named", few_files=True)
    summary = summary.join(named, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "node").join(summary, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), g AS (
  SELECT vec_id, x, list_max(list_transform(x, lambda v: abs(v))) AS largest FROM e
  WHERE len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), n AS (
  SELECT vec_id, list_transform(x, lambda v: v / largest) AS x FROM g WHERE largest > 0
), u AS (
  SELECT vec_id, list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda w: w * w)))) AS x FROM n
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.vec_id <> b.vec_id AND CASE WHEN len(a.x) = len(b.x) THEN list_inner_product(a.x, b.x) >= 0.95 ELSE false END
), r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (
  SELECT a, least(a, min(b)) AS c FROM r GROUP BY a
), k AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, coalesce(m.c, e.vec_id) AS component_id, e.vec_id = coalesce(m.c, e.vec_id) AS kept
FROM e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN m ON m.a = e.vec_id
"""
