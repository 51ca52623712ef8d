"""Glossaries: abbreviations, terms, categories, and what they add to a query or a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .dimension import small
from .expand import contained, contained_by_index


def abbreviations_in(texts: DataFrame, abbreviations: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, abbr, full) of dictionary abbreviations that stand alone in the text: no letter before, no letter or digit after."""
    pattern = F.concat(F.lit(r"(?:^|[^A-Za-z])\Q"), F.col("abbr"), F.lit(r"\E(?:$|[^A-Za-z0-9])"))
    return contained(texts.select(key, text), abbreviations, text, "abbr").filter(F.regexp_like(F.col(text), pattern)).select(key, "abbr", "full")


def matching_terms(queries: DataFrame, terms: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, position, english): terms of which a name contains the query, or whose abbreviation it is, whatever the case.

    ``terms`` has position, name, english, abbr and synonyms (array); of one
    English name the first term counts.  Blank queries match nothing.
    """
    low = queries.select(key, F.lower("text").alias("low"))
    asked = low.select(F.col("low").alias("term")).distinct()
    names = terms.select("position", F.explode(F.array_compact(F.array_union(F.array("name", "english"), F.coalesce("synonyms", F.array().cast("array<string>"))))).alias("name"))
    names = names.select("position", F.lower("name").alias("low")).distinct()
    inside = contained_by_index(names, asked, ["position", "low"], "low").select("position", "term")
    exact = terms.select("position", F.lower("abbr").alias("term")).filter("term <> ''").join(asked, "term").select("position", "term")
    hits = inside.unionByName(exact).distinct().join(low.withColumnRenamed("low", "term"), "term").join(small(terms.select("position", "english")), "position")
    return hits.groupBy(key, "english").agg(F.min("position").alias("position"))


def enhance(queries: DataFrame, abbreviations: DataFrame, terms: DataFrame, key: str = "query_id", most: int = 2) -> DataFrame:
    """(key, enhanced): the query, ``ABBR: full`` of its abbreviations in the order of the dictionary, and the English names of its first terms.

    The first ``most`` matching terms are taken, then those left out whose name
    the text holds by then, whatever the case.
    """
    order = small(abbreviations.select("abbr", F.col("position").alias("at")))
    found = abbreviations_in(queries, abbreviations, key).join(order, "abbr").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.concat("abbr", F.lit(": "), "full").alias("x")))).alias("a"))
    w = Window.partitionBy(key).orderBy("position")
    first = matching_terms(queries, terms, key).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
    first = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "english"))).alias("t"))
    rows = queries.join(found, key, "left").join(first, key, "left")
    start = F.when(F.col("a").isNull(), F.col("text")).otherwise(F.concat("text", F.lit(" "), F.array_join(F.transform("a", lambda x: x["x"]), "; ")))
    step = lambda acc, x: F.when(F.contains(F.lower(acc), F.lower(x["english"])), acc).otherwise(F.concat(acc, F.lit(" "), x["english"]))
    return rows.select(key, F.when(F.col("t").isNull(), start).otherwise(F.aggregate("t", start, step)).alias("enhanced"))


def lookup(names: DataFrame, abbreviations: DataFrame, key: str = "name") -> DataFrame:
    """(key, full): the entry of the name in capitals, else of the name as it is."""
    upper = abbreviations.select(F.col("abbr").alias("u"), F.col("full").alias("first"))
    plain = abbreviations.select(F.col("abbr").alias("p"), F.col("full").alias("second"))
    rows = names.join(small(upper), F.upper(F.col(key)) == F.col("u"), "left").join(small(plain), F.col(key) == F.col("p"), "left")
    return rows.select(key, F.coalesce("first", "second").alias("full"))


def grouped_text(entries: DataFrame, group: str, name: str, meaning: str) -> DataFrame:
    """(group, text, n): one text of ``name: meaning`` lines for each group."""
    lines = F.array_sort(F.collect_list(F.concat(name, F.lit(": "), meaning)))
    return entries.groupBy(group).agg(F.array_join(lines, "\n").alias("text"), F.count(F.lit(1)).alias("n"))


def category_score(queries: DataFrame, abbreviations: DataFrame, terms: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, category, score): 2 for each abbreviation of a category in the query, or 1 for each term; terms win where both exist."""
    a = abbreviations_in(queries, abbreviations.select("abbr", F.col("category").alias("full")), key).groupBy(key, F.col("full").alias("category")).agg((2 * F.count(F.lit(1))).alias("a"))
    t = contained(queries, terms).groupBy(key, "category").agg(F.count(F.lit(1)).alias("t"))
    return a.join(t, [key, "category"], "full_outer").select(key, "category", F.coalesce("t", "a").alias("score"))


def community_score(communities: DataFrame, words: list[str], query: str) -> DataFrame:
    """communities (community, summary, keywords) with a score: 1 for each word in the summary, 0.5 for each keyword that holds the query; zeros stay."""
    low = F.lower("summary")
    hits = sum((F.contains(low, F.lit(w.lower())).cast("double") for w in words), F.lit(0.0))
    return communities.withColumn("score", hits + 0.5 * F.size(F.filter("keywords", lambda k: F.contains(F.lower(k), F.lit(query.lower())))))


def add_synonym(synonyms: DataFrame, term: str, word: str) -> DataFrame:
    """synonyms (term, synonyms) with one more word, at the end unless it is there; a new term if need be."""
    one = F.array(F.lit(word))
    rows = synonyms.withColumn("synonyms", F.when(F.col("term") == term, F.array_union("synonyms", one)).otherwise(F.col("synonyms")))
    new = synonyms.sparkSession.createDataFrame([(term, [word])], "term string, synonyms array<string>")
    return rows.unionByName(new.join(synonyms, "term", "left_anti"))


def put(entries: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The entries with the new ones put in; of one key the new one stays."""
    return entries.join(new.select(key), key, "left_anti").unionByName(new)


def first_available(candidates: DataFrame, group: str, fallback: str) -> DataFrame:
    """(group, model): the healthy candidate (model, priority, healthy) of the smallest priority, else the fallback."""
    best = F.min_by(F.when(F.col("healthy"), F.col("model")), F.when(F.col("healthy"), F.col("priority")))
    return candidates.groupBy(group).agg(F.coalesce(best, F.lit(fallback)).alias("model"))


def parse_plan(text: Column) -> Column:
    """Struct of goal, success_criteria and steps (description, search, expect) of a plan in lines.

    Of several GOAL or SUCCESS_CRITERIA lines the last counts.  Behind the first
    STEPS line, lines that begin with a digit or a dash are steps, without
    number or bullet; their parts follow bars, by names in either case.  A search
    for NONE is none (null), an expectation that is missing is empty.
    """
    lines = F.filter(F.transform(F.split(X.strip(text), "\n"), X.strip), lambda x: x != "")
    starts = lambda x, name: F.startswith(x, F.lit(name))
    behind = lambda x, name: X.strip(F.substr(x, F.lit(len(name) + 1)))
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    head = lambda name: F.coalesce(last(F.transform(F.filter(lines, lambda x: starts(x, name)), lambda x: behind(x, name))), F.lit(""))
    opened = F.array_position(F.transform(lines, lambda x: starts(x, "STEPS:")), True)
    listed = F.when(opened > 0, F.filter(F.slice(lines, opened.cast("int") + 1, F.size(lines)), lambda x: F.regexp_like(x, F.lit(r"^[\p{Nd}-]")))).otherwise(F.array().cast("array<string>"))

    def step(line: Column) -> Column:
        parts = F.transform(F.split(F.regexp_replace(line, r"^[0-9.\-) ]+", ""), r"\|"), X.strip)
        named = lambda name: F.transform(F.filter(F.slice(parts, 2, F.size(parts)), lambda p: starts(F.upper(p), name)), lambda p: behind(p, name))
        search = last(F.filter(named("SEARCH:"), lambda v: F.upper(v) != "NONE"))
        return F.struct(F.get(parts, F.lit(0)).alias("description"), search.alias("search"), F.coalesce(last(named("EXPECT:")), F.lit("")).alias("expect"))

    return F.struct(head("GOAL:").alias("goal"), head("SUCCESS_CRITERIA:").alias("success_criteria"), F.transform(listed, step).alias("steps"))


def latest_by_version(files: DataFrame, doc: str, parts: str, modified: str) -> DataFrame:
    """The row of each document with the largest version parts, then the latest change."""
    last = F.max_by(F.struct(*files.columns), F.struct(parts, modified))
    return files.groupBy(F.col(doc).alias("__doc")).agg(last.alias("__row")).select("__row.*")
