"""Knowledge graphs of documents, and an index of entities with local search.

Chunks are rows with an order (``position``, unique); whatever depends on the
order of processing is an aggregate over it: a node that is written more than
once keeps the last write, an entity its first.  Lists that can be long (chunks
of an entity, members of a community, neighbours) are tables, not arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import cut
from .expand import contained_by_index
from .graph import components

#: Properties of nodes in their order, by the types that have them.
PROPERTIES = ("title", "doc_id", "section_id", "level", "summary", "description", "ctype")

#: Fixed value: what opens the summary of a community.
COMMUNITY_OPENING = "エンティティ群: "


def document_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, type, properties) and edges (from, to, type) of chunks, an edge for every mention.

    ``chunks`` has doc_id, position, text, doc_title, section_number,
    section_title, summary and cross_refs (array).  Documents CONTAIN sections,
    REFERENCE regulations and known nodes, MENTION organizations and DEFINE
    terms.  A section number makes one node, of the first chunk that has it, in
    whatever document.  Documents are written first, then what the chunks hold,
    in order; nodes of one key are merged, the last write wins.  Null texts hold
    nothing, null and empty section numbers are none, a null title is the
    document's id.
    """
    none = F.lit(None).cast("string")
    fields = {"title": none, "doc_id": none, "section_id": none, "level": F.lit(None).cast("int"), "summary": none, "description": none, "ctype": none}

    def props(**own: Column) -> Column:
        return F.struct(*[own.get(c, fields[c]).alias(c) for c in PROPERTIES])

    def write(step: int, at, node: Column, kind: str, edge: str, own: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), at.alias("at"), node.alias("node"), F.lit(kind).alias("type"), F.lit(edge).alias("edge"), own.alias("properties"))

    def concepts(step: int, names: Column, edge: str, ctype: str) -> Column:
        return F.transform(names, lambda n, i: write(step, i, n, "Concept", edge, props(description=F.lit(""), ctype=F.lit(ctype))))

    found = chunks.select("doc_id", "position", X.entities(F.coalesce("text", F.lit(""))).alias("e"))
    e = F.col("e")
    terms = F.transform(e["defined_terms"], lambda d, i: write(3, i, d["term"], "Concept", "DEFINES", props(description=d["definition"], ctype=F.lit("concept"))))
    listed = F.concat(concepts(1, F.filter(e["regulations"], lambda r: r != F.col("doc_id")), "REFERENCES", "regulation"), concepts(2, e["organizations"], "MENTIONS", "organization"), terms)
    # written: nodes and edges both come from it, and the texts are searched once
    held = cut(found.select("doc_id", "position", F.explode(listed).alias("w")).select("doc_id", "position", "w.*"), "mentions")

    title = F.coalesce("doc_title", "doc_id")
    documents = chunks.groupBy("doc_id").agg(F.min_by(title, "position").alias("t"), F.min("position").alias("position"))
    documents = documents.select(F.col("doc_id").alias("node"), F.lit("Document").alias("type"), props(title=F.col("t")).alias("properties"), F.struct(F.lit(0).alias("loop"), "position", F.lit(0).alias("step"), F.lit(0).alias("at")).alias("order"))
    numbered_ = chunks.filter("section_number <> ''")
    first = F.min_by(F.struct("doc_id", "section_title", "summary"), "position").alias("f")
    sections = numbered_.groupBy("section_number").agg(first, F.min("position").alias("position"))
    level = F.size(F.split("section_number", r"\.")).cast("int")
    own = props(doc_id=F.col("f.doc_id"), section_id=F.col("section_number"), title=F.coalesce("f.section_title", F.lit("")), level=level, summary=F.coalesce("f.summary", F.lit("")))
    sections = cut(sections.select(F.col("f.doc_id").alias("doc_id"), "position", F.concat("f.doc_id", F.lit("#"), "section_number").alias("node"), own.alias("properties")), "sections")
    loop = lambda step, at: F.struct(F.lit(1).alias("loop"), F.col("position").alias("position"), F.lit(step).alias("step") if isinstance(step, int) else step, at.alias("at")).alias("order")
    writes = documents.unionByName(sections.select("node", F.lit("Section").alias("type"), "properties", loop(0, F.lit(0))))
    writes = writes.unionByName(held.select("node", "type", "properties", loop(F.col("step").alias("step"), F.col("at"))))
    nodes = writes.groupBy("node").agg(F.max_by(F.struct("type", "properties"), "order").alias("w")).select("node", "w.type", "w.properties")
    nodes = cut(nodes, "graph-nodes")
    edges = sections.select(F.col("doc_id").alias("from"), F.col("node").alias("to"), F.lit("CONTAINS").alias("type"))
    edges = edges.unionByName(held.select(F.col("doc_id").alias("from"), F.col("node").alias("to"), F.col("edge").alias("type")))
    crossed = chunks.select("doc_id", F.explode("cross_refs").alias("node")).filter("node <> doc_id").join(nodes.select("node"), "node", "left_semi")
    return nodes, edges.unionByName(crossed.select(F.col("doc_id").alias("from"), F.col("node").alias("to"), F.lit("REFERENCES").alias("type")))


@dataclass
class EntityIndex:
    """Tables of an index.

    entities (id, name, type, description, mentions, first, degree, community, place),
    links (id, chunk_id, mentions), neighbours (id, other), both directions.
    """

    entities: DataFrame
    links: DataFrame
    neighbours: DataFrame


def entity_index(chunks: DataFrame, relations: DataFrame | None = None, small: int = 5) -> EntityIndex:
    """Entities of chunks (chunk_id, position, text), merged by id, with the relations (source, target: names) between them.

    A relation counts if both its ends are entities.  A connected part of at
    most ``small`` entities is a community, in the order of first mention; a
    larger one is halved by the number of neighbours.  ``place`` is the order
    within the community.
    """
    found = chunks.filter(X.strip(F.col("text")) != "").select("chunk_id", "position", F.posexplode(X.named_entities(F.col("text"))).alias("at", "e")).select("chunk_id", "position", "at", "e.*")
    found = cut(found, "entities")
    order = F.struct("position", "at")
    merged = found.groupBy("id").agg(F.min_by(F.struct("name", "type", "description"), order).alias("e"), F.count(F.lit(1)).alias("mentions"), F.min(order).alias("first"))
    merged = cut(merged.select("id", "e.*", "mentions", "first"), "entities")
    links = found.groupBy("id", "chunk_id").agg(F.count(F.lit(1)).alias("mentions"))
    if relations is None:
        both = merged.select("id", F.col("id").alias("other")).limit(0)
    else:
        ends = relations.select(X.entity_id(F.col("source")).alias("id"), X.entity_id(F.col("target")).alias("other")).distinct()
        known = ends.join(merged.select("id"), "id", "left_semi").join(merged.select(F.col("id").alias("other")), "other", "left_semi")
        both = known.select("id", "other").unionByName(known.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    both = cut(both, "neighbours")
    degree = both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    parts = components(both.select(F.col("id").alias("from"), F.col("other").alias("to")), merged.select(F.col("id").alias("node"))).withColumnRenamed("node", "id")
    rows = merged.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).join(parts, "id")
    rows = rows.join(cut(parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "parts"), "component")
    # written, so that a large part is ranked by range and not in one task
    from .ranking import numbered

    large = F.when(F.col("size") > small, -F.col("degree")).otherwise(F.lit(0))
    ranked = numbered(rows.select("id", "component", large.alias("by"), "first"), ["component"], ["by", "first"])
    rows = rows.join(ranked.select("id", "k"), "id")
    half = F.when((F.col("size") > small) & (F.col("k") > F.expr("size div 2")), 1).otherwise(0)
    place = F.when(half == 1, F.col("k") - F.expr("size div 2")).otherwise(F.col("k"))
    rows = rows.select("id", "name", "type", "description", "mentions", "first", "degree", F.concat("component", F.lit("/"), half.cast("string")).alias("community"), place.alias("place"))
    return EntityIndex(cut(rows, "entity-index"), links, both)


def community_rollup(index: EntityIndex, names: int = 5, keywords: int = 10) -> DataFrame:
    """(community, n, entity_ids, summary, keywords): the first entities of each community; its members are in the index."""
    sizes = index.entities.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    first = index.entities.filter(F.col("place") <= max(names, keywords)).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("place", "id", "name"))).alias("e"))
    head = lambda n: F.transform(F.slice("e", 1, n), lambda x: x["name"])
    told = first.select("community", F.transform("e", lambda x: x["id"]).alias("entity_ids"), F.concat(F.lit(COMMUNITY_OPENING), F.array_join(head(names), ", ")).alias("summary"), head(keywords).alias("keywords"))
    return sizes.join(told, "community")


def entities_met(texts: DataFrame, listed: Column, entities: DataFrame, k: int) -> DataFrame:
    """(asked, id): all entities that can be among the ``k`` best of the distinct texts (asked), whose words are ``listed``."""
    words = cut(texts.select("asked", F.explode(F.array_distinct(listed)).alias("word")), "asked-words", few_files=True)
    names = entities.select("id", F.lower("name").alias("low"))
    told = entities.select("id", F.lower("description").alias("low"))
    term = lambda df, c: df.select(F.col(c).alias("term")).distinct()
    by_word = contained_by_index(names, term(words, "word"), ["id"], "low").select(F.col("term").alias("word"), "id")
    by_word = cut(by_word.join(entities.select("id", "first"), "id"), "words-in-names")
    known = words.join(by_word.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("n"), "word"))
    known = cut(known.withColumn("most", place == 1).select("asked", "word", "most"), "asked-words", few_files=True)
    common = by_word.join(known.filter("most").select("word").distinct(), "word", "left_semi")
    common = common.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("first"))).filter(F.col("rank") <= k)
    by_word = known.filter("not most").join(by_word, "word").select("asked", "id").unionByName(known.filter("most").join(common, "word").select("asked", "id"))
    whole = lambda df: contained_by_index(df, term(texts, "asked"), ["id"], "low").select(F.col("term").alias("asked"), "id")
    return by_word.unionByName(whole(names)).unionByName(whole(told)).distinct()


def local_search(questions: DataFrame, index: EntityIndex, k: int = 5, most_neighbours: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The best entities of each question (query_id, text), their neighbours, and their chunks.

    An entity scores 2 if its name contains the question, 1 if its description
    does, and 0.5 for each word of the question that its name contains, whatever
    the case; those without a score are left out, ties go to the earlier mention.
    Whatever contains the question or a word of it is found by an index of
    stretches.  Of a question's words the one in the most names gives its ``k``
    earliest entities alone: another that has no other word scores no more than
    those and comes later.  So no word that all questions share meets all
    entities with each of them, and equal questions are answered once.  Two such
    words in each of many different questions still do.  A blank question finds nothing.

    Gives (query_id, rank, score, id, name, type, description, community),
    (query_id, place, id, name, type) of at most so many neighbours by id, and
    (query_id, chunk_id).
    """
    asked = questions.filter(X.strip(F.col("text")) != "").select("query_id", F.lower("text").alias("asked"))
    listed = F.filter(F.split("asked", r"[\s\p{Z}]+"), lambda w: w != "")
    met = entities_met(asked.select("asked").distinct(), listed, index.entities, k)
    low = lambda c: F.lower(F.col(c))
    holds = lambda c: F.coalesce(F.contains(low(c), F.col("asked")).cast("double"), F.lit(0.0))
    score = holds("name") * 2 + holds("description") + 0.5 * F.size(F.filter(listed, lambda w: F.contains(low("name"), w)))
    w = Window.partitionBy("asked").orderBy(F.desc("score"), "first")
    best = met.join(index.entities, "id").withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    best = best.join(asked, "asked")
    best = cut(best.select("query_id", "rank", "score", "id", "name", "type", "description", "community"), "local-search")
    near = best.select("query_id", "id").join(index.neighbours, "id").select("query_id", F.col("other").alias("id")).distinct()
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).filter(F.col("place") <= most_neighbours)
    near = near.join(index.entities.select("id", "name", "type"), "id").select("query_id", "place", "id", "name", "type")
    return best, near, best.select("query_id", "id").join(index.links, "id").select("query_id", "chunk_id").distinct()


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(statement): MERGE statements of nodes (node, type, properties) and edges (from, to, type, properties).

    Properties are a struct; its fields that aren't null become ``name: value``
    in their order, the value as JSON, a node's id last as ``node_id``.
    """
    def value(c: Column) -> Column:
        # the value of a JSON object of one field
        whole = F.to_json(F.struct(c.alias("v")))
        return F.substr(whole, F.lit(6), F.length(whole) - 6)

    def listed(df: DataFrame, more: list[Column]) -> Column:
        kind = df.schema["properties"].dataType if "properties" in df.columns else None
        own = [F.when(F.col("properties")[f.name].isNotNull(), F.concat(F.lit(f"{f.name}: "), value(F.col("properties")[f.name]))) for f in (kind.fields if kind else ())]
        return F.array_join(F.array_compact(F.array(*own, *more)) if own or more else F.array().cast("array<string>"), ", ")

    ident = lambda c: F.concat(F.lit("node_id: "), value(F.col(c).cast("string")))
    a = nodes.select(F.concat(F.lit("MERGE (n:"), "type", F.lit(" {"), listed(nodes, [ident("node")]), F.lit("})")).alias("statement"))
    held = listed(edges, [])
    props = F.when(held != "", F.concat(F.lit(" {"), held, F.lit("}"))).otherwise("")
    b = edges.select(F.concat(F.lit("MATCH (a {"), ident("from"), F.lit("}), (b {"), ident("to"), F.lit("}) MERGE (a)-[:"), "type", props, F.lit("]->(b)")).alias("statement"))
    return a.unionByName(b)
