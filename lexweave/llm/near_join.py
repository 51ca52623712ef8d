"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles; two are linked if their Jaccard
similarity is at least 0.8.  Every set is embedded as a signature of
``COORDINATES`` MinHash values, each of them a uniformly sampled token of the
set.  A run of the chosen-path join splits the sets recursively: a node of the
recursion picks 1 / threshold coordinates on average, by a hash of its path,
and sets that share the token there go on together to the child of that
coordinate.  Pairs below the threshold die out, pairs above it are expected to
stay together at least once on every level.  A node of at most ``LEAF`` sets is
brute-forced on the signatures; one that is still larger at ``DEPTH`` hands on
all its sets as candidates.  Runs are repeated until the recall at full depth
reaches ``RECALL``.  All runs read the same signatures, so their misses are
independent only for a given number of coordinates in which a pair agrees: the
miss is the mean of (1 - survival) ** runs over that number's distribution.

What the leaves found are candidate links.  Their connected components, found
by joins, are small; the exact shingle sets of their members are formed once, as
hashes of 64 bits, and all pairs within a component are compared by integers.  A
component above ``BLOCK`` sets or ``BLOCK_SHINGLES`` shingles is cut into blocks
and every pair of blocks is a task of its own, and small components share a task
up to that number of shingles, so a task's memory is bounded however large a
group of near copies is, and however long its texts.  A task returns one count for each set and a spanning forest of the links that it
confirmed, never the pairs.

Texts with equal shingle sets are one set with a number of copies from the
start, so groups of exact copies of any size cost one aggregate.

Defined cases: null texts and texts without a word link with nothing and keep
themselves; texts of one to four words are one shingle of all their words, and
link with equal ones alone; rows that repeat link like other copies; null ids
take part and are never the name of a class unless all ids in it are null; very
long texts are read whole; an empty table gives an empty result; other columns
are not read, and :func:`representatives` keeps them.
"""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, quoted, table, unused
from .components import connected_components, forest

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
COORDINATES = 64
#: Deepest level of a run, and the largest node that is brute-forced.
DEPTH = 4
LEAF = 64
#: Coordinates that must agree, of all, for a leaf's pair to become a candidate: four standard deviations below the threshold.
LEAST_AGREED = 0.6
#: Sets in a block of the exact comparison.
BLOCK = 1024
#: Shingles in a block, or in the small components that share a task, about.
BLOCK_SHINGLES = 1 << 20
SEED = 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93
_P_INVERSE = np.uint64(pow(_P, -1, 1 << 64))
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(256)], np.uint64)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.empty(count, np.uint64)
    if count:
        out[0] = 1
        step = 1
        while step < count:
            k = min(step, count - step)
            out[step : step + k] = out[:k] * np.uint64(pow(base, step, 1 << 64))
            step += k
    return out


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of a text in UTF-8."""
    inside = np.concatenate([[False], ~_GAP[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_P, len(data)))])
    value = (total[end] - total[start]) * _powers(int(_P_INVERSE), len(data))[start]
    return start, _stir(value + (end - start).astype(np.uint64) * _MIX)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for text in texts.to_pylist():
        if not text:
            out.append(np.zeros(0, np.uint64))
            continue
        out.append(_shingles(np.frombuffer(text.encode(), np.uint8)))
    return out


def _shingles(data: np.ndarray) -> np.ndarray:
    _, h = word_hashes(data)
    n = min(len(h), WORDS)
    if not n:
        return h
    x = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        x = _stir(x * _MIX + h[k : len(h) - n + 1 + k])
    return np.unique(x)


def _multipliers() -> np.ndarray:
    rng = random.Random(SEED)
    return np.array([rng.getrandbits(64) | 1 for _ in range(COORDINATES)], np.uint64)


def signature(s: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that isn't empty."""
    low = None
    for k in range(0, len(s), 4096):
        own = (s[k : k + 4096, None] * multipliers).min(0)
        low = own if low is None else np.minimum(low, own)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def choices(threshold: float) -> tuple[int, float]:
    """Coordinates that a node picks for sure, and the chance of one more: 1 / threshold on average."""
    return int(1 / threshold), 1 / threshold - int(1 / threshold)


def survival(depth: int, threshold: float = THRESHOLD, agree: float | None = None) -> float:
    """The chance that a pair that agrees in this share of the coordinates, else the threshold, shares a node at ``depth`` in one run."""
    agree = threshold if agree is None else agree
    sure, more = choices(threshold)
    s = 1.0
    for _ in range(depth):
        miss = 1 - agree * s
        s = 1 - miss**sure * (1 - more + more * miss)
    return s


def missed(runs: int, depth: int = DEPTH, threshold: float = THRESHOLD) -> float:
    """The chance that a pair at the threshold shares no node at ``depth`` in any run; one without an agreeing coordinate is left to no run."""
    n = COORDINATES
    chance = lambda k: math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
    return sum(chance(k) * (1 - survival(depth, threshold, k / n)) ** runs for k in range(1, n + 1))


def runs_needed(recall: float = RECALL, depth: int = DEPTH, threshold: float = THRESHOLD) -> int:
    runs = 1
    while missed(runs, depth, threshold) > 1 - recall:
        runs += 1
    return runs


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (hash of the text), set (digest of the shingles, null if none), n (shingles) and sig of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        multipliers = _multipliers()
        for batch in batches:
            sets = shingle_sets(batch.column(2))
            digest = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
            sig = [signature(s, multipliers) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sig, pa.list_(pa.int32()))], names=["doc_id", "mark", "set", "n", "sig"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, mark bigint, set binary, n int, sig array<int>")


def _children(node, threshold: float):
    """The child nodes of a set at a node; sig is the set's signature."""
    sure, more = choices(threshold)

    def child(k):
        c = F.pmod(F.xxhash64(node, F.lit(k)), F.lit(COORDINATES)).cast("int")
        return F.xxhash64(node, c, F.get("sig", c))

    extra = F.pmod(F.xxhash64(node, F.lit(-1)), F.lit(1 << 20)) < int(more * (1 << 20))
    return F.filter(F.array(*[child(k) for k in range(sure)], F.when(extra, child(sure))), lambda x: x.isNotNull())


def _candidates(sets: DataFrame, threshold: float, recall: float, depth: int, leaf: int) -> DataFrame:
    """Edges (u, v) between sets that leaves hold to be similar."""
    sure, more = choices(threshold)
    rng = random.Random(SEED + 1)
    roots = []
    for run in range(runs_needed(recall, depth, threshold)):
        for c in rng.sample(range(COORDINATES), sure + (rng.random() < more)):
            roots.append(F.xxhash64(F.lit(run), F.lit(c), F.get("sig", F.lit(c))))
    level = cut(sets.select("set", F.explode(F.array(*roots)).alias("node")), "paths")
    sig = sets.select("set", "sig")
    leaves = []
    stars = None
    for d in range(1, depth + 1):
        # written: small sizes are then broadcast without an exchange of the paths, large ones joined with a hot node split
        size = cut(level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes", few_files=True)
        sized = cut(level.join(size, "node"), "paths")
        leaves.append(sized.filter(F.col("size") <= leaf).select("node", "set"))
        large = sized.filter(F.col("size") > leaf).select("node", "set")
        if d == depth:
            least = cut(large.groupBy("node").agg(F.min("set").alias("v")), "least", few_files=True)
            stars = large.join(least, "node").select(F.col("set").alias("u"), "v").filter("u <> v").distinct()
        elif large.isEmpty():
            break
        else:
            level = cut(large.join(sig, "set").select("set", F.explode(_children(F.col("node"), threshold)).alias("node")).distinct(), "paths")
    rows = leaves[0]
    for more_rows in leaves[1:]:
        rows = rows.unionByName(more_rows)
    rows = rows.join(sig, "set").select("node", "set", "sig").repartition("node").sortWithinPartitions("node")
    agreed = math.ceil(LEAST_AGREED * COORDINATES)

    def compare(batches):
        rest = None
        for batch in batches:
            own = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            node = own.column("node").to_numpy()
            end = int(np.searchsorted(node, node[-1])) if len(node) else 0
            rest = own.slice(end)
            if end:
                yield from found(own.slice(0, end))
        if rest is not None and rest.num_rows:
            yield from found(rest)

    def found(own):
        own = own.combine_chunks()
        node = own.column("node").to_numpy()
        column = own.column("sig").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        s = column.flatten().to_numpy().reshape(len(node), COORDINATES)
        left, right = [], []
        for step in range(1, len(node)):
            at = np.flatnonzero(node[step:] == node[:-step])
            if not len(at):
                break
            for k in range(0, len(at), 16384):
                p = at[k : k + 16384]
                p = p[(s[p] == s[p + step]).sum(1) >= agreed]
                left.append(p)
                right.append(p + step)
        names = own.column("set").to_pylist()
        number: dict[bytes, int] = {}
        code = np.fromiter((number.setdefault(x, len(number)) for x in names), np.int64, len(names))
        keys = list(number)
        if left and sum(map(len, left)):
            a, b = forest(len(keys), code[np.concatenate(left)], code[np.concatenate(right)])
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in a], pa.binary()), pa.array([keys[i] for i in b], pa.binary())], names=["u", "v"])

    edges = rows.mapInArrow(compare, "u binary, v binary")
    return edges if stars is None else edges.unionByName(stars)


def exact_links(sets: list[np.ndarray], block: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of sets with Jaccard similarity at least the threshold; only of different blocks if ``cross``."""
    t = Fraction(str(threshold))
    n = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    token = np.concatenate(sets)
    own = np.repeat(np.arange(m), n)
    _, code, count = np.unique(token, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    column = np.cumsum(count > 1) - 1
    code, own = column[code[shared]], own[shared]
    order = np.argsort(code, kind="stable")
    code, own = code[order], own[order]
    common = np.zeros((m, m), np.float32)
    total = int(code[-1]) + 1 if len(code) else 0
    for k in range(0, total, 2048):
        a, b = np.searchsorted(code, [k, k + 2048])
        x = np.zeros((m, min(2048, total - k)), np.float32)
        x[own[a:b], code[a:b] - k] = 1
        common += x @ x.T
    left, right = np.nonzero(common)
    up = left < right
    left, right = left[up], right[up]
    if cross:
        up = block[left] != block[right]
        left, right = left[up], right[up]
    ok = common[left, right].astype(np.int64) * (t.numerator + t.denominator) >= t.numerator * (n[left] + n[right])
    return left[ok], right[ok]


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """doc_id, mark (hash of the text), class_id, class_mark and n_links of every row.

    class_id is the smallest id reachable by links and class_mark the mark of
    its row, so (class_id, class_mark) names one document of the class;
    n_links counts the other rows linked directly.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = cut(_sets(docs, id_col, text_col), "sets")
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    sets = rows.filter("set is not null").groupBy("set").agg(F.count(F.lit(1)).alias("copies"), pick.alias("one"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = cut(sets.select("set", "copies", F.col("one.doc_id").alias("doc_id"), F.col("one.mark").alias("mark"), "n", "sig"), "distinct")
    parts = connected_components(_candidates(sets, threshold, recall, depth, leaf)).withColumnRenamed("node", "set")
    parts = cut(parts.join(sets.select("set", "copies", "doc_id", "mark", "n"), "set"), "candidates")
    size = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    # a small component shares a task with others; a larger one is dealt as pairs of blocks
    bundles = max(1, math.ceil((parts.agg(F.sum("n")).first()[0] or 0) / BLOCK_SHINGLES))
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    group = F.when(blocks == 1, F.pmod(F.xxhash64("component"), F.lit(bundles))).otherwise(F.xxhash64("component"))
    chosen = parts.join(size, "component").select("doc_id", "mark", "set", "component", "copies", blocks.alias("blocks"), group.alias("group"))
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    dealt = chosen.alias("c").join(texts.alias("t"), F.expr("c.doc_id <=> t.doc_id and c.mark = t.mark")).select("c.group", "c.component", "c.set", "c.blocks", "c.copies", "t.text")

    def shingled(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(5))
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], names=["group", "component", "set", "blocks", "copies", "shingles"])

    hashed = dealt.mapInArrow(shingled, "group bigint, component binary, set binary, blocks int, copies bigint, shingles array<bigint>")
    # rows that repeat are one row, partly before the exchange
    hashed = hashed.dropDuplicates(["set"])
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    hashed = hashed.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    hashed = hashed.select("group", "component", "set", "copies", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "shingles")

    def verify(table: pa.Table) -> pa.Table:
        names = table.column("set").to_pylist()
        part = table.column("component").to_pylist()
        at = sorted(range(len(names)), key=lambda k: (part[k], k))
        copies = table.column("copies").to_numpy()
        own = table.column("own").to_numpy()
        cross = bool(len(names)) and table.column("i")[0].as_py() != table.column("j")[0].as_py()
        flat = [c.flatten().to_numpy().view(np.uint64) for c in table.column("shingles").chunks]
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
        end = np.cumsum(pa.compute.list_value_length(table.column("shingles")).to_numpy()).tolist()
        sets = [flat[a:b] for a, b in zip([0, *end], end, strict=False)]
        out_set, out_links, out_root = [], [], []
        k = 0
        while k < len(at):
            end = k
            while end < len(at) and part[at[end]] == part[at[k]]:
                end += 1
            members = np.array(at[k:end])
            k = end
            if len(members) < 2:
                continue
            left, right = exact_links([sets[m] for m in members], own[members], cross, threshold)
            if not len(left):
                continue
            links = np.bincount(left, copies[members[right]], len(members)) + np.bincount(right, copies[members[left]], len(members))
            for i in np.flatnonzero(links):
                out_set.append(names[members[i]])
                out_links.append(int(links[i]))
                out_root.append(names[members[i]])
            for i, r in zip(*forest(len(members), left, right), strict=True):
                out_set.append(names[members[i]])
                out_links.append(0)
                out_root.append(names[members[r]])
        return pa.table({"set": pa.array(out_set, pa.binary()), "links": pa.array(out_links, pa.int64()), "root": pa.array(out_root, pa.binary())})

    found = cut(hashed.groupBy("group", "i", "j").applyInArrow(verify, "set binary, links bigint, root binary"), "links")
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    classes = connected_components(found.filter("set <> root"), "set", "root").withColumnRenamed("node", "set")
    summary = sets.select("set", "copies", "doc_id", "mark").join(links, "set", "left").join(classes, "set", "left").withColumn("component", F.coalesce("component", "set"))
    # written, so that a large class can be split in the join
    named = cut(summary.groupBy("component").agg(pick.alias("one")).select("component", F.col("one.doc_id").alias("class_id"), F.col("one.mark").alias("class_mark")), "named", few_files=True)
    summary = summary.join(named, "component").select("set", "class_id", "class_mark", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "mark", "set").join(summary, "set", "left")
    alone = F.col("set").isNull()
    return out.select("doc_id", "mark", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("mark")).otherwise(F.col("class_mark")).alias("class_mark"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but one document of each class; rows equal in id and text count as one."""
    found = join(docs, id_col=id_col, text_col=text_col, **options)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark"))).select("doc_id", "mark")
    mark = unused(docs.columns, "mark_of_text")
    marked = docs.withColumn(mark, F.xxhash64(quoted(text_col).cast("string")))
    kept = marked.alias("d").join(stay.alias("s"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("s.doc_id")) & (F.col(f"d.`{mark}`") == F.col("s.mark")), "left_semi")
    return kept.dropDuplicates([id_col, mark]).select(*map(quoted, docs.columns))


def op1_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), t AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 9 * count(*) >= 4 * (min(a.n) + min(b.n))
), r(a, b) AS (
  SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), m AS (
  SELECT a, least(a, min(b)) AS c FROM r GROUP BY a
), k AS (
  SELECT a, count(*) AS n FROM p GROUP BY a
)
SELECT s.doc_id, coalesce(m.c, s.doc_id) AS class_id, coalesce(k.n, 0) AS n_links
FROM s LEFT JOIN m ON m.a = s.doc_id LEFT JOIN k ON k.a = s.doc_id
"""
