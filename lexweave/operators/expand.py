"""Query expansion, domain detection and routing over small dictionaries.

Queries meet dictionaries (synonyms, domains, glossary) by containment: a few
terms are broadcast and looked for one by one, more are found by an index of
their first characters, so no dictionary is met row by row whatever its size.
Rules are patterns, which no index of characters serves; they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .dimension import is_small, small


#: Terms of a dictionary that are looked for one by one, at most.
FEW_TERMS = 200


def contained(queries: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", few: int = FEW_TERMS) -> DataFrame:
    """Queries with every dictionary term that they contain; empty terms are contained in nothing.

    Beyond ``few`` terms, texts meet them by :func:`contained_by_index`, each
    distinct text once.
    """
    known = terms.filter(F.length(term) > 0)
    if is_small(known, few):
        return queries.crossJoin(F.broadcast(known)).filter(F.contains(F.col(text), F.col(term)))
    marked = queries.filter(F.col(text).isNotNull()).withColumn("__mark", F.md5(F.col(text)))
    texts = marked.select("__mark", F.col(text).alias("__text")).dropDuplicates(["__mark"])
    found = contained_by_index(texts, known, ["__mark"], "__text", term).drop("__text")
    return marked.join(found, "__mark").drop("__mark")


def contained_by_index(texts: DataFrame, terms: DataFrame, key: list[str], text: str = "text", term: str = "term", gram: int = 8) -> DataFrame:
    """As :func:`contained`, for dictionaries of any size: an equi-join on the first characters of the terms.

    A term is looked up by its first ``gram`` characters, or all if it has
    fewer, among the stretches of that length in the texts; what is found is
    then compared whole.  Empty terms are contained in nothing.
    """
    heads = terms.filter(F.length(term) > 0).withColumn("__head", F.substring(term, 1, gram))
    lengths = [r["n"] for r in heads.select(F.length("__head").alias("n")).distinct().collect()]
    stretches = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(F.col(text), i, F.lit(n)))
    own = [F.when(F.length(text) >= n, F.array_distinct(stretches(n))).otherwise(F.array().cast("array<string>")) for n in sorted(lengths)]
    found = texts.select(*key, F.explode(F.flatten(F.array(*own)) if own else F.array().cast("array<string>")).alias("__head"))
    hits = found.join(heads.select("__head").distinct(), "__head", "left_semi").join(heads, "__head")
    return hits.drop("__head").join(texts, key).filter(F.contains(F.col(text), F.col(term)))


def expand_synonyms(queries: DataFrame, synonyms: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, expanded): the query and the sorted distinct synonyms (term, synonyms) of its terms."""
    found = contained(queries, synonyms).select(key, F.explode("synonyms").alias("s")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("s")), " ").alias("s"))
    return queries.join(found, key, "left").select(key, F.concat_ws(" ", "text", "s").alias("expanded"))


def boolean_query(terms: Column, most: int = 6) -> Column:
    """The first distinct terms, in quotes if they hold a space, joined by OR."""
    quoted = F.transform(F.slice(F.array_distinct(terms), 1, most), lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))
    return F.array_join(quoted, " OR ")


def substitutions(text: Column, pairs: list[tuple[str, list[str]]], most: int = 2) -> Column:
    """The text, then with each contained term replaced by each of its first alternatives, distinct in order."""
    made = [F.when(F.contains(text, F.lit(term)), F.replace(text, F.lit(term), F.lit(other))) for term, others in pairs for other in others[:most]]
    return F.array_distinct(F.filter(F.array(text, *made), lambda x: x.isNotNull()))


def first_procedure(queries: DataFrame, rules: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, rule): the first rule (position, pattern, rule) whose pattern is found."""
    hits = queries.crossJoin(small(rules)).filter(F.regexp_like("text", F.col("pattern")))
    return hits.groupBy(key).agg(F.min_by("rule", "position").alias("rule"))


def detect_domains(queries: DataFrame, domains: DataFrame, glossary: DataFrame | None = None, key: str = "query_id", default: int = 3) -> DataFrame:
    """(key, domain, score) above 0; domains (domain, specificity, keywords), glossary (term, formal, domain).

    A keyword in the query scores by the share of the query that it covers,
    less where a more specific domain owns it too, and little where a longer
    keyword in the query contains it; one only in the formal terms of the
    query's glossary entries adds 0.5.  A glossary term that points at the
    domain adds 3.  The sum is raised by 30 % for each step of specificity.
    """
    words = domains.select("domain", F.coalesce("specificity", F.lit(default)).alias("spec"), F.explode("keywords").alias("kw"))
    owner = words.groupBy("kw").agg(F.max("spec").alias("top"))
    words = words.join(owner, "kw")
    own = words.select("kw").distinct()
    longer = contained(own.select(F.col("kw").alias("holder")), own, "holder", "kw").filter("holder <> kw")
    q = queries.select(key, "text")
    if glossary is not None:
        hits = contained(q, glossary.select("term", "formal", F.col("domain").alias("points")))
        formal = hits.groupBy(key).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("formal")))), " ").alias("formal"), F.collect_set("points").alias("points"))
        q = q.join(formal, key, "left")
    else:
        q = q.withColumns({"formal": F.lit(None).cast("string"), "points": F.array().cast("array<string>")})
    # a keyword in the query is also in the query with its formal terms
    text, kw = F.col("text"), F.col("kw")
    literal = F.contains(text, kw)
    rows = cut(contained(q.withColumn("wide", F.concat_ws(" ", "text", "formal")), words, "wide", "kw"), "keywords")
    said = rows.filter(literal).select(key, "kw").distinct()
    covered = said.join(longer, "kw").join(said.select(key, F.col("kw").alias("holder")), [key, "holder"], "left_semi").select(key, "kw").distinct()
    rows = rows.join(covered.withColumn("subsumed", F.lit(True)), [key, "kw"], "left")
    cover = F.length(kw) / F.length(text)
    lost = F.col("top") > F.col("spec")
    by_cover = F.when(cover >= 0.5, F.when(lost, 2.0).otherwise(4.0)).when(cover >= 0.2, F.when(lost, 1.5).otherwise(2.5)).otherwise(F.when(lost, 0.8).otherwise(1.5))
    score = F.when(literal, F.when(F.col("subsumed"), 0.1).otherwise(by_cover)).otherwise(0.5)
    none = F.array().cast("array<string>")
    # a domain that a glossary term points at counts without a keyword too
    pointed = q.select(key, F.explode(F.coalesce("points", none)).alias("domain")).join(small(domains.select("domain", F.coalesce("specificity", F.lit(default)).alias("spec"))), "domain")
    out = rows.select(key, "domain", "spec", score.alias("s")).unionByName(pointed.select(key, "domain", "spec", F.lit(3.0).alias("s")))
    out = out.groupBy(key, "domain", "spec").agg(F.sum("s").alias("s")).filter("s > 0")
    return out.select(key, "domain", F.round(F.col("s") * (1 + 0.3 * (F.col("spec") - 1)), 2).alias("score"))


def route(queries: DataFrame, rules: DataFrame, default: str, key: str = "query_id") -> DataFrame:
    """(key, role, confidence): the role with the largest weight of patterns (role, pattern, weight) that match whatever the case, ties by role."""
    hits = queries.crossJoin(small(rules)).filter(F.regexp_like(F.lower("text"), F.concat(F.lit("(?i)"), F.col("pattern")))).groupBy(key, "role").agg(F.sum("weight").alias("w"))
    w = Window.partitionBy(key).orderBy(F.desc("w"), "role")
    best = hits.withColumn("k", F.row_number().over(w)).groupBy(key).agg(F.max(F.when(F.col("k") == 1, F.col("role"))).alias("role"), F.max(F.when(F.col("k") == 1, F.col("w"))).alias("a"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("w"))), F.lit(0.0)).alias("b"))
    rows = queries.join(best, key, "left")
    return rows.select(key, F.coalesce("role", F.lit(default)).alias("role"), F.when(F.col("role").isNull(), 0.3).otherwise(F.least(F.lit(1.0), 0.4 + 0.1 * (F.col("a") - F.col("b")))).alias("confidence"))


def is_complex(text: Column, patterns: list[str], length: int = 100, least: int = 2) -> Column:
    hits = sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))
    return (F.length(text) > length) | (hits >= least)


def merge_indexes(a: DataFrame, b: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, score): a hit of both is the first score and half of the second."""
    rows = a.select(key, F.col("score").alias("a")).join(b.select(key, F.col("score").alias("b")), key, "full_outer")
    return rows.select(key, F.when(F.col("a").isNull(), F.col("b")).otherwise(F.col("a") + 0.5 * F.coalesce("b", F.lit(0.0))).alias("score"))


def entity_score(text: Column, name: Column, description: Column) -> Column:
    """2 for the query in the name, 1 for it in the description, 0.5 for each of its words in the name."""
    low = lambda c: F.lower(c)
    words = F.filter(F.split(low(text), r"\s+"), lambda w: w != "")
    return F.contains(low(name), low(text)).cast("double") * 2 + F.contains(low(description), low(text)).cast("double") + 0.5 * F.size(F.filter(words, lambda w: F.contains(low(name), w)))
