"""Guided search in two stages: the domains of a question choose documents, a hybrid search ranks their chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .expand import contained_by_index, detect_domains
from .search import top_k, weighted_fusion


def target_documents(found: DataFrame, domains: DataFrame, most: int = 2, close: float = 0.7) -> DataFrame:
    """(query_id, target): document ids of the best ``most`` domains of each question, ties by domain.

    ``found`` has (query_id, domain, score), ``domains`` (domain, primary_docs,
    related_docs).  Primary documents always count, related ones of a domain that
    scores at least ``close`` times the best.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "domain")
    top = found.withColumns({"rank": F.row_number().over(w), "best": F.first("score").over(w)}).filter(F.col("rank") <= most)
    met = top.join(domains.select("domain", "primary_docs", "related_docs"), "domain")
    none = F.array().cast("array<string>")
    docs = F.concat(F.coalesce("primary_docs", none), F.when(F.col("score") >= F.col("best") * close, F.coalesce("related_docs", none)).otherwise(none))
    return met.select("query_id", F.explode(docs).alias("target")).distinct()


def candidates(targets: DataFrame, chunks: DataFrame, key: str = "chunk_id", doc: str = "doc_id") -> DataFrame:
    """(query_id, key): the chunks of documents whose id contains a target of the question."""
    docs = chunks.select(F.col(doc).alias("doc")).distinct()
    named = contained_by_index(docs.withColumn("text", F.col("doc")), targets.select(F.col("target").alias("term")).distinct(), ["doc"])
    pairs = named.select("doc", F.col("term").alias("target")).join(targets, "target").select("query_id", "doc").distinct()
    return chunks.select(F.col(key), F.col(doc).alias("doc")).join(pairs, "doc").select("query_id", key)


def named_targets(targets: DataFrame, chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, targets): for each document id that contains a target of any question, those that it contains."""
    docs = chunks.select(F.col(doc).alias("doc")).distinct()
    named = contained_by_index(docs.withColumn("text", F.col("doc")), targets.select(F.col("target").alias("term")).distinct(), ["doc"])
    return named.groupBy("doc").agg(F.array_sort(F.collect_set("term")).alias("targets"))


def guided_search(questions: DataFrame, chunks: DataFrame, domains: DataFrame, ranked: Callable[[DataFrame, DataFrame | None], DataFrame], *, k: int = 5, glossary: DataFrame | None = None, key: str = "chunk_id", doc: str = "doc_id", by_target: bool = False) -> DataFrame:
    """(query_id, key, score, methods, rank, domain, guided): the best chunks of each question (query_id, text, ...).

    ``ranked(questions, allowed)`` gives the hits of each method (query_id,
    method, batch, key, score) for some questions, scored only among the allowed
    (query_id, key) unless that is None.  The domains' documents are the allowed
    ones; a question whose domains lead to nothing is searched everywhere.
    Those pairs grow with questions times chunks.  With ``by_target`` none are
    made: the questions have their ``targets``, the allowed are the documents
    (doc, targets), and a chunk is allowed where both name a common target.
    ``domain`` is the best domain, ``guided`` whether the documents were chosen by it.
    """
    found = cut(detect_domains(questions.select("query_id", "text"), domains, glossary), "domains")
    targets = cut(target_documents(found, domains), "targets")
    if by_target:
        asked = questions.join(targets.groupBy("query_id").agg(F.array_sort(F.collect_set("target")).alias("targets")), "query_id")
        allowed = cut(named_targets(targets, chunks, doc), "named-targets", few_files=True)
    else:
        asked = questions.join(targets.select("query_id").distinct(), "query_id", "left_semi")
        allowed = cut(candidates(targets, chunks, key, doc), "candidates")
    first = cut(top_k(weighted_fusion(ranked(asked, allowed), key=key), k, key), "guided")
    rest = questions.join(first.select("query_id").distinct(), "query_id", "left_anti")
    second = top_k(weighted_fusion(ranked(rest, None), key=key), k, key)
    both = first.withColumn("guided", F.lit(True)).unionByName(second.withColumn("guided", F.lit(False)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "domain")
    best = found.withColumn("n", F.row_number().over(w)).filter("n = 1").select("query_id", "domain")
    return both.join(best, "query_id", "left")
