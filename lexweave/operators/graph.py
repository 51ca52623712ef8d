"""Cross-reference, knowledge and entity graphs.

Vertices and edges are tables.  Iterative operators are loops of joins whose
every round is a written table; neighbours are never gathered per vertex where
a vertex may have very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, discard
from .ranking import numbered


def reference_edges(mentions: DataFrame) -> DataFrame:
    """(from, to, count) from (from, chunk, to): chunks that mention, each once."""
    return mentions.distinct().groupBy("from", "to").agg(F.count(F.lit(1)).alias("count"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of all nodes, isolated ones too."""
    out = edges.groupBy(F.col("from").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    rows = nodes.join(out.hint("merge"), "node", "left").join(into.hint("merge"), "node", "left")
    return rows.select("node", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("out_degree", "in_degree")])


def hubs(edges: DataFrame, k: int) -> DataFrame:
    """The k nodes with the most incoming edges, each of a multigraph counted."""
    return edges.groupBy(F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("in_degree")).orderBy(F.desc("in_degree"), "node").limit(k)


def resolve_prefix(refs: DataFrame, docs: DataFrame, ref: str = "ref", doc: str = "doc") -> DataFrame:
    """(ref, doc): the longest document id that the reference starts with or that starts with it, ties by id.

    Prefix matches become equi-joins: a document id is looked up at each length
    of a reference and a reference at each length of a document id.
    """
    starts = lambda c, name: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, F.lit(1), i))).alias(name)
    r, d = refs.select(F.col(ref).alias("r")).filter("r <> ''").distinct(), docs.select(F.col(doc).alias("d")).filter("d <> ''").distinct()
    one = r.select("r", starts(F.col("r"), "x")).join(d.withColumn("x", F.col("d")), "x").select("r", "d")
    two = d.select("d", starts(F.col("d"), "x")).join(r.withColumn("x", F.col("r")), "x").select("r", "d")
    best = F.min(F.struct((-F.length("d")).alias("n"), "d"))
    return one.unionByName(two).groupBy("r").agg(best.alias("b")).select(F.col("r").alias(ref), F.col("b.d").alias(doc))


def reach(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """(seed, node, distance) of nodes within so many hops, the seed itself left out."""
    forward = edges.select(F.col("from").alias("a"), F.col("to").alias("b"))
    back = edges.select(F.col("to").alias("a"), F.col("from").alias("b"))
    steps = {"out": forward, "in": back, "both": forward.unionByName(back)}[direction].distinct()
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance"))
    front = seen
    for d in range(1, hops + 1):
        front = front.join(steps, front["node"] == steps["a"]).select("seed", F.col("b").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti").withColumn("distance", F.lit(d))
        front = cut(front, "reach")
        seen = seen.unionByName(front)
    return seen.filter("distance > 0")


def paths(edges: DataFrame, seeds: DataFrame, hops: int, types: list[str] | None = None) -> DataFrame:
    """(seed, node, distance, path) with the edge types on the way, ``<-`` before those taken backwards; of equal lengths the smallest path."""
    e = edges if types is None else edges.filter(F.col("type").isin(types))
    steps = e.select(F.col("from").alias("a"), F.col("to").alias("b"), "type").unionByName(e.select(F.col("to").alias("a"), F.col("from").alias("b"), F.concat(F.lit("<-"), "type").alias("type")))
    steps = steps.groupBy("a", "b").agg(F.min("type").alias("type"))
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance"), F.lit("").alias("path"))
    front = seen
    for d in range(1, hops + 1):
        longer = F.when(F.col("path") == "", F.col("type")).otherwise(F.concat("path", F.lit(" "), F.col("type")))
        front = front.join(steps, front["node"] == steps["a"]).select("seed", F.col("b").alias("node"), longer.alias("path"))
        front = front.groupBy("seed", "node").agg(F.min("path").alias("path")).join(seen, ["seed", "node"], "left_anti").withColumn("distance", F.lit(d))
        front = cut(front.select("seed", "node", "distance", "path"), "paths")
        seen = seen.unionByName(front)
    return seen.filter("distance > 0")


def pagerank(edges: DataFrame, nodes: DataFrame, *, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank); weights of dangling nodes are spread over all.

    Ends when the ranks together change by less than ``tolerance`` for each
    node, or after so many rounds; a tolerance of 0 runs all rounds.
    """
    n = nodes.count()
    e = cut(edges.select("from", "to").distinct(), "pagerank")
    out = e.groupBy("from").agg(F.count(F.lit(1)).alias("deg"))
    links = cut(e.join(out, "from"), "pagerank")
    # nodes know whether they send; so a round reads the ranks, not the edges, for what is lost
    start = nodes.join(out.select(F.col("from").alias("node"), F.lit(True).alias("sends")), "node", "left")
    ranks = cut(start.select("node", F.coalesce("sends", F.lit(False)).alias("sends"), F.lit(1.0 / max(n, 1)).alias("rank")), "pagerank")
    for _ in range(rounds):
        sent = links.join(ranks, links["from"] == ranks["node"]).groupBy(F.col("to").alias("node")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        dangling = ranks.filter("not sends").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        after = ranks.join(sent, "node", "left").crossJoin(F.broadcast(dangling))
        new = F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        after = cut(after.select("node", "sends", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")), "pagerank")
        discard(ranks)
        ranks = after
        if tolerance and (ranks.agg(F.sum("change")).first()[0] or 0.0) < tolerance * n:
            break
    return ranks.select("node", "rank")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component), the smallest node of each connected component: hooking to the smallest neighbour, then pointer jumping.

    Labels are as many as the nodes and may be written in few bytes, so they are
    merged and never broadcast: rounds send nothing to the driver.
    """
    both = cut(edges.select("from", "to").unionByName(edges.select(F.col("to").alias("from"), F.col("from").alias("to"))).distinct(), "components")
    label = cut(nodes.select("node", F.col("node").alias("component")), "components")
    while True:
        near = both.join(label.hint("merge"), both["to"] == label["node"]).groupBy(F.col("from").alias("node")).agg(F.min("component").alias("low"))
        hooked = label.join(near.hint("merge"), "node", "left").select("node", "component", F.least("component", F.coalesce("low", "component")).alias("next"))
        jump = label.select(F.col("node").alias("next"), F.col("component").alias("far"))
        after = cut(hooked.join(jump.hint("merge"), "next").select("node", F.least("next", "far").alias("component"), (F.least("next", "far") != F.col("component")).alias("moved")), "components")
        moved = not after.filter("moved").isEmpty()
        discard(label)
        label = after
        if not moved:
            return after.drop("moved")


def communities(edges: DataFrame, nodes: DataFrame, small: int = 5) -> DataFrame:
    """(node, community): a component of at most ``small`` nodes is one community; a larger one is halved by degree.

    The halves are by rank in descending degree, ties by node.
    """
    deg = degrees(nodes, edges).select("node", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    rows = cut(components(edges, nodes), "communities")
    size = rows.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    rows = numbered(rows.join(deg.hint("merge"), "node"), ["component"], [-F.col("degree"), F.col("node")]).join(size.hint("merge"), "component")
    half = F.when((F.col("size") > small) & (F.col("k") > F.expr("size div 2")), 1).otherwise(0)
    return rows.select("node", F.concat(F.col("component").cast("string"), F.lit("/"), half.cast("string")).alias("community"))


def levels(tasks: DataFrame, depends: DataFrame) -> DataFrame:
    """(task, level): level 0 waits for nothing known; in a cycle the smallest task goes first."""
    known = depends.join(tasks.select(F.col("task").alias("on")), "on").select("task", "on").distinct()
    open_ = cut(tasks.select("task"), "levels")
    done = None
    level = 0
    while not open_.isEmpty():
        waiting = known.join(open_.select(F.col("task").alias("on")), "on", "left_semi").select("task").distinct()
        ready = open_.join(waiting, "task", "left_anti")
        if ready.isEmpty():
            ready = open_.agg(F.min("task").alias("task"))
        ready = cut(ready.select("task", F.lit(level).alias("level")), "levels")
        done = ready if done is None else done.unionByName(ready)
        open_ = cut(open_.join(ready, "task", "left_anti"), "levels")
        level += 1
    return done if done is not None else tasks.select("task", F.lit(0).alias("level"))
