"""Conversation prefix trie: which conversations share which beginnings.

**Prefixes.**  A turn is a digest of its role and text.  The key of a
conversation's first d turns is the exclusive or of two 64-bit hashes of each
(digest, place), so keys of a long conversation are running totals over blocks
of its turns, and no task has to hold a conversation.

**First owned depth.**  A node of the trie is a distinct prefix; its owner is the
smallest conversation that begins with it, found as a minimum over the prefixes'
keys.  A conversation that owns a prefix owns all its longer ones, so its first
owned depth is found by binary search: every round probes one depth of each
conversation that is still open by a join with the minima.

**Chains.**  The prefixes that a conversation owns are a chain, from its first
owned depth to its end.  The chain hangs on the node before, which the owner of
that prefix has in its own chain: so the chains form a tree.  They are handed up
level by level, from the bottom; a node's subtree is what hangs on its chain from
its depth on, a running total from the chain's end.  Levels follow from pointers
that double, and their number is that of branches behind one another, at most
the number of turns of the longest conversation.

The list of conversations that end in a node can be as long as the table: it is
dealt by range, joined to pieces of bounded length, and the pieces are read in
order by one digest.

Defined cases: rows without a conversation id are no part of any; turns are
ordered by number, null first, and equal numbers by the digest of role and text;
null roles and texts are empty; very long texts are digested whole; equal
conversations end in one node; an empty table has no root and gives no rows; other
columns are not read, whatever their names.  Remainders of negative ids are
negative, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import bounded_batches, cut, discard, quoted, table, word_count

#: Turns of a block of running totals.
BLOCK = 1024

#: Ids of a piece of the list of ends.
PIECE = 4096

#: Parameters of the production query: conversations share the beginning of the first of so many ids, up to so many turns less one.
FAMILY, HEADS = 20, 4


def original(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth (from 1), content (digest of role and text), words; written."""
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    content = F.unhex(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256))
    turns = convs.filter(quoted(conv_col).isNotNull()).select(quoted(conv_col).cast("long").alias("conv_id"), quoted(turn_col).alias("turn"), content.alias("content"), word_count(text).alias("words"))
    ranked = numbered(turns, ["conv_id"], ["turn", "content"], "depth")
    return cut(ranked.select("conv_id", "depth", "content", "words"), "trie-turns")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of the first of their family.

    Gives (conv_id, turns) of every conversation, also without a turn, and the
    rebuilt turns like those of :func:`original`; h is the CRC-32 of the decimal
    id, modulo ``heads``.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    ids = turns.groupBy("conv_id").agg(F.max("depth").alias("own")).select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    ids = cut(ids, "trie-ids", few_files=True)
    size = ids.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    ids = ids.join(size, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    ids = cut(ids.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")), "trie-families", few_files=True)
    first = turns.filter(F.col("depth") < heads).withColumnRenamed("conv_id", "base")
    shared = ids.filter("taken > 0").select("conv_id", "base", "taken").join(first, "base").filter(F.col("depth") <= F.col("taken")).select("conv_id", "depth", "content", "words")
    own = turns.join(ids.select("conv_id", "h", "taken"), "conv_id").filter(F.col("depth") > F.col("h")).select("conv_id", (F.col("taken") + F.col("depth") - F.col("h")).alias("depth"), "content", "words")
    return ids.select("conv_id", "turns"), cut(shared.unionByName(own), "trie-rebuilt")


def _running(rows: DataFrame, group: str, totals: dict[str, Column], merge, back: bool = False) -> DataFrame:
    """rows (group, depth, ...) with running totals over depth, from the end if ``back``; blocks of a group are added up apart."""
    keyed = rows.withColumns({"__block": F.floor((F.col("depth") - (0 if back else 1)) / BLOCK), **{f"__{k}": v for k, v in totals.items()}})
    order = (lambda c: F.col(c).desc()) if back else F.col
    inner = Window.partitionBy(group, "__block").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = keyed.withColumns({k: merge(f"__{k}").over(inner) for k in totals})
    long = keyed.filter("__block > 0").select(group).distinct()
    sums = keyed.join(long, group, "left_semi").groupBy(group, "__block").agg(*[merge(f"__{k}").alias(f"__{k}") for k in totals])
    outer = Window.partitionBy(group).orderBy(order("__block")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col(group).alias("__group"), F.col("__block").alias("__at"), *[merge(f"__{k}").over(outer).alias(f"__before_{k}") for k in totals])
    met = own.join(before, (F.col(group) == F.col("__group")) & (F.col("__block") == F.col("__at")), "left")
    return met


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, a, b (the key of the first ``depth`` turns), words (of the last of them); written."""
    met = _running(turns, "conv_id", {"a": F.xxhash64(F.lit(1), "content", "depth"), "b": F.xxhash64(F.lit(2), "content", "depth")}, F.bit_xor)
    key = [F.col(k).bitwiseXOR(F.coalesce(f"__before_{k}", F.lit(0))).alias(k) for k in ("a", "b")]
    return cut(met.select("conv_id", "depth", *key, "words"), "trie-prefixes")


def _owned_from(ids: DataFrame, keys: DataFrame, minima: DataFrame, root: int, longest: int) -> DataFrame:
    """conv_id, turns, first: the first depth that the conversation owns; turns + 1 if it owns none.  Written."""
    # depth lo isn't owned; depth hi is, or lies behind the end
    start = F.col("conv_id") == root
    state = cut(ids.select("conv_id", "turns", F.when(start, -1).otherwise(0).cast("long").alias("lo"), F.when(start, 0).otherwise(F.col("turns") + 1).cast("long").alias("hi")), "trie-search", few_files=True)
    for _ in range(max(longest, 1).bit_length()):
        probe = state.filter("hi - lo > 1").withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2))
        met = probe.join(keys.select("conv_id", "depth", "a", "b"), ["conv_id", "depth"]).join(minima.select("depth", "a", "b", "owner"), ["depth", "a", "b"])
        owned = F.col("owner") == F.col("conv_id")
        moved = met.select("conv_id", "turns", F.when(owned, F.col("lo")).otherwise(F.col("depth")).alias("lo"), F.when(owned, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        after = cut(state.filter("hi - lo <= 1").unionByName(moved), "trie-search", few_files=True)
        discard(state)
        state = after
    return state.select("conv_id", "turns", F.col("hi").alias("first"))


def _owner_at(at: DataFrame, keys: DataFrame, minima: DataFrame) -> DataFrame:
    """at (conv_id, depth > 0, ...) with the owner of the conversation's prefix of that depth."""
    return at.join(keys.select("conv_id", "depth", "a", "b"), ["conv_id", "depth"]).join(minima.select("depth", "a", "b", "owner"), ["depth", "a", "b"]).drop("a", "b")


def _levels(chains: DataFrame, root: int) -> tuple[DataFrame, int]:
    """conv_id, level: the number of chains above, by doubling pointers; and the largest level."""
    state = cut(chains.filter(F.col("conv_id") != root).select("conv_id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("level")), "trie-up", few_files=True)
    while state.filter(F.col("up") != root).limit(1).count():
        open_ = state.filter(F.col("up") != root)
        step = state.select(F.col("conv_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        moved = open_.join(step, "up").select("conv_id", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        after = cut(state.filter(F.col("up") == root).unionByName(moved), "trie-up", few_files=True)
        discard(state)
        state = after
    return state.select("conv_id", "level"), state.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]


def _attached(chains: DataFrame, nodes: DataFrame, root: int) -> DataFrame:
    """conv_id, depth, hung, leaves, saved: what hangs on a node of a chain by other chains; bottom-up, written level by level."""
    levels, height = _levels(chains, root)
    own = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saved").alias("saved"))
    ready = cut(chains.filter(F.col("conv_id") != root).join(levels, "conv_id").join(own, "conv_id"), "trie-chains", few_files=True, by="level")
    found = below = None
    for level in range(height, 0, -1):
        now = ready.filter(F.col("level") == level)
        if below is None:
            whole = now.select("parent", "first", "saved", F.lit(1).cast("long").alias("leaves"))
        else:
            hung = below.groupBy("conv_id").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.max("depth").alias("last"))
            met = now.join(hung, "conv_id", "left")
            end = F.when(F.col("last") == F.col("turns"), 0).otherwise(1)
            whole = met.select("parent", "first", (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), (end + F.coalesce("more_leaves", F.lit(0))).alias("leaves"))
        below = whole.groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hung"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        below = cut(below, "trie-hung", few_files=True)
        found = below if found is None else found.unionByName(below)
    discard(ready)
    return found if found is not None else chains.sparkSession.createDataFrame([], "conv_id long, depth long, hung long, leaves long, saved long")


def _ends(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of (owner, depth, member) rows."""
    spark = ends.sparkSession
    bounded_batches(spark)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(ends, "trie-ends", few_files=True)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, members = None, []

        def told():
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (node[0], node[1], members[0], ",".join(map(str, members)))], names=["owner", "depth", "least", "ids"])

        for batch in batches:
            for owner, depth, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (owner, depth) != node or len(members) == PIECE:
                    if members:
                        yield told()
                    node, members = (owner, depth), []
                members.append(member)
        if members:
            yield told()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        for batch in batches:
            done = []
            for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids")), strict=True):
                if (owner, depth) == node:
                    state.update(f",{ids}".encode())
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (owner, depth), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["conv_id", "depth", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest())], names=["conv_id", "depth", "ends_sha256"])

    order = ["owner", "depth", "member"]
    dealt = rows.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pieces, "owner long, depth long, least long, ids string")
    whole = cut(dealt, "trie-pieces", few_files=True).repartition(parts, "owner", "depth").sortWithinPartitions("owner", "depth", "least")
    return whole.mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations ``ids`` (conv_id, turns) with ``turns`` (conv_id, depth, content, words)."""
    spark = ids.sparkSession
    top = ids.agg(F.min("conv_id").alias("root"), F.count(F.lit(1)).alias("n"), F.max("turns").alias("longest")).first()
    out = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not top["n"]:
        return spark.createDataFrame([], out)
    root = top["root"]
    keys = prefixes(turns)
    minima = cut(keys.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")), "trie-minima")
    found = _owned_from(ids, keys, minima, root, top["longest"])
    # the owners of the node before the first owned one and of the node of the end
    asked = found.filter("first <= turns and first > 1").select("conv_id", (F.col("first") - 1).alias("depth"), F.lit("before").alias("kind")).unionByName(found.filter("turns > 0 and first > turns").select("conv_id", F.col("turns").alias("depth"), F.lit("end").alias("kind")))
    owners = cut(_owner_at(asked, keys, minima), "trie-owners", few_files=True)
    before = owners.filter("kind = 'before'").select("conv_id", F.col("owner").alias("parent"))
    parent = F.when(F.col("conv_id") == root, F.lit(None)).otherwise(F.coalesce("parent", F.lit(root)))
    chains = cut(found.filter("first <= turns").join(before, "conv_id", "left").withColumn("parent", parent), "trie-owned", few_files=True)
    nodes = minima.select("owner", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    nodes = nodes.unionByName(spark.createDataFrame([(root, 0, top["n"], 0)], "owner long, depth long, n_convs long, saved long"))
    hung = _attached(chains, nodes, root)
    same = [F.col("owner") == F.col("h.conv_id"), F.col("nodes.depth") == F.col("h.depth")]
    zero = F.lit(0)
    full = nodes.alias("nodes").join(hung.alias("h"), same, "left").select("owner", "nodes.depth", "n_convs", F.coalesce("hung", zero).alias("hung"), (F.col("nodes.saved") + F.coalesce("h.saved", zero)).alias("saved"), F.coalesce("leaves", zero).alias("leaves"))
    span = chains.select(F.col("conv_id").alias("owner"), "first", "turns", "parent")
    full = cut(full.join(span, "owner").withColumn("leaves", F.col("leaves") + F.when((F.col("depth") == F.col("turns")) & (F.col("hung") == 0), 1).otherwise(0)), "trie-nodes")
    met = _running(full, "owner", {"sum_leaves": F.col("leaves"), "sum_saved": F.col("saved")}, F.sum, back=True)
    told = met.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("owner")).alias("parent_conv_id"),
        "n_convs",
        (F.col("hung") + (F.col("depth") < F.col("turns")).cast("long")).alias("n_children"),
        (F.col("sum_leaves") + F.coalesce("__before_sum_leaves", zero)).alias("n_leaves"),
        (F.col("sum_saved") + F.coalesce("__before_sum_saved", zero)).alias("saved_tokens"),
    )
    at_own = found.filter("first <= turns").select(F.col("conv_id").alias("owner"), F.col("turns").alias("depth"), F.col("conv_id").alias("member"))
    at_root = found.filter("turns = 0 and first > turns").select(F.lit(root).alias("owner"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member"))
    elsewhere = owners.filter("kind = 'end'").select("owner", "depth", F.col("conv_id").alias("member"))
    ends = _ends(at_own.unionByName(at_root).unionByName(elsewhere))
    none = hashlib.sha256(b"").hexdigest()
    return told.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(original(table(spark, sf_dir, "conversations"))))


SQL = """
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS c,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS words
  FROM conversations WHERE conv_id IS NOT NULL
), f AS (
  SELECT conv_id, max(k) AS own, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END), 4294967295::BIGINT) % 4 AS h
  FROM o GROUP BY conv_id
), g AS (
  SELECT f.*, least(f.h, coalesce(b.own, 0)) AS taken FROM f LEFT JOIN f b ON b.conv_id = f.base
), t AS (
  SELECT g.conv_id, o.k AS d, o.c, o.words FROM g JOIN o ON o.conv_id = g.base AND o.k <= g.taken
  UNION ALL
  SELECT g.conv_id, g.taken + o.k - g.h, o.c, o.words FROM g JOIN o ON o.conv_id = g.conv_id AND o.k > g.h
), p AS (
  SELECT conv_id, d, md5(string_agg(c, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS key, words FROM t
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM g
), e AS (
  SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id
), m AS (
  SELECT p.key, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) AS ids FROM p JOIN e USING (conv_id, d) GROUP BY p.key
), u AS (
  SELECT DISTINCT a.key, b.key AS child FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d = a.d + 1
), n AS (
  SELECT key, min(d) AS depth, min(conv_id) AS owner, count(*)::BIGINT AS n_convs, (count(*) - 1) * min(words) AS saved FROM p GROUP BY key
), w AS (
  SELECT n.*, (SELECT count(*) FROM u WHERE u.key = n.key) AS n_children, (SELECT min(v.owner) FROM u JOIN n v ON u.key = v.key WHERE u.child = n.key) AS parent FROM n
), s AS (
  SELECT a.key, sum(w.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves
  FROM (SELECT DISTINCT a.key, b.key AS below FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d >= a.d) a JOIN w ON w.key = a.below GROUP BY a.key
)
SELECT owner AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN s USING (key) LEFT JOIN m USING (key)
"""
