"""The corpus pipeline: from documents to token ids.

Language identification drops documents without a determined language, the
n-gram Jaccard join keeps one document of each class of near duplicates, the
secret scan blots secrets out, the mixture repeats or drops documents so that
sources meet their target weights, and the SentencePiece codec turns what is
left into ids.  Every stage but the last returns the columns of documents.

SQL can't express the first stage's mixture inference, so there is no SQL for
the result; tests hold the stages against brute force on small tables.

Defined cases, of every stage: documents with null or empty texts have no
determined language and go in the first stage; null ids, languages, sources and
counts stay as they are; very long texts are processed whole; rows equal in id
and text are one document after the second stage, and documents that tie for a
class are told apart by id; an empty table gives an empty result of the same
columns; columns that documents doesn't have are kept, whatever their names, by
all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import language, mixing, near_join, pieces, secret_scan
from lexweave.llm.common import cut, quoted, table, unused

#: A document stays if this share of its words, at least, is in its language.
LEAST_LANGUAGE_SHARE = 0.35


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those in which no language holds the share."""
    lang, score, shares = (unused(docs.columns, name) for name in language.ADDED)
    found = language.predict(docs, language.train(docs), added=(lang, score, shares))
    return found.filter((F.col(lang) != language.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SHARE)).select(*map(quoted, docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every class of near duplicates."""
    return near_join.representatives(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mixture takes it."""
    return mixing.mix(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digest of the text that the ids decode to."""
    coded = pieces.encode_decode(docs, pieces.model_file())
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
