"""Language identification by multilingual mixture inference.

Training counts the character n-grams (1 to 4, hashed, inside words with their
borders marked) of labelled texts and keeps smoothed log probabilities for each
language.  A text is a mixture: every word is drawn from one language with the
text's proportions, and its likelihood under a language is the product of its
n-grams'.  A word that a text repeats n times weighs 1 + ln(n), so that a
repeated line doesn't outvote the rest.  Expectation-maximisation estimates the proportions.  The set of
languages is chosen by penalised likelihood: starting from all languages that
hold a noticeable share, the least likely is taken out again and again and the
proportions are fitted anew; the set with the best
log likelihood - penalty * languages * log(words) / 2 wins.  The prediction is
the language with the largest share, its score that share.

The classifier is fitted on a bounded sample of labelled rows: the hash of a
row's id picks rows of each language at the rate at which ``TRAIN_ROWS`` are
expected of it (all rows, if it has fewer).  The prediction sees the text only.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
equal languages in share are told apart by name; without any labelled row every
text is ``und``; rows that repeat are predicted, and counted in training, each;
an empty table gives an empty result; very long texts and words are read whole;
other columns are not read, and :func:`predict` keeps them.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import bounded_batches, map_arrow, quoted, table, unused
from .pieces import slices

UNDETERMINED = "und"
#: Labelled texts that are expected in the sample of a language with more.
TRAIN_ROWS = 400
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
#: Of the log likelihood for each further language, times log(words) / 2.
PENALTY = 3.0
#: Languages below this share after the first fit are out.
LEAST_SHARE = 0.02
ITERATIONS = 8
BATCH_CHARS = 1 << 20
CACHE_WORDS = 150_000
#: A run of letters of any length.
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in lower case; none if it has no letter."""
    found = _WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def grams(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, flat, and the word number of each."""
    text = " " + " ".join(items) + " "
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, items), np.int64, len(items)) + 1
    # a word owns the border before it and its letters; the border after it is the next one's
    word = np.append(np.repeat(np.arange(len(items)), lens), len(items) - 1)
    border = cp == 32
    out, own = [], []
    h = np.zeros(len(cp), np.uint64)
    inner = np.zeros(len(cp), bool)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(cp) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + cp[n - 1 :] + np.uint64(n)
        # a border may stand first or last in an n-gram, not inside
        inner = np.zeros(len(cp), bool) if n <= 2 else inner[: len(cp) - n + 1] | border[n - 2 : len(cp) - 1]
        ok = ~inner[: len(h)] & (~border if n == 1 else True)
        if n in ORDERS:
            at = np.flatnonzero(ok)
            if n == 2:
                at = at[~(border[at] & border[at + 1])]
            x = h[at]
            out.append(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 16)).astype(np.int64) % BUCKETS)
            own.append(word[at])
    return np.concatenate(out), np.concatenate(own)


@dataclass
class Model:
    """Languages in order of name and log probabilities of the n-gram buckets, one column a language."""

    languages: list[str]
    log_p: np.ndarray

    def predict(self, texts: list[str | None], cache: dict | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, proportions) of each text."""
        docs = [words(t) for t in texts]
        n, k = len(docs), len(self.languages)
        share = np.zeros((n, k))
        names = [UNDETERMINED] * n
        score = np.zeros(n)
        count = np.fromiter(map(len, docs), np.int64, n)
        have = np.flatnonzero(count)
        if not len(have) or not k:
            return names, score, share
        cache = {} if cache is None else cache
        slot, rows = cache.setdefault("slot", {}), cache.get("rows", np.zeros((0, k)))
        if len(slot) > CACHE_WORDS:
            slot.clear()
            rows = np.zeros((0, k))
        new = [w for w in set().union(*docs) if w not in slot]
        if new:
            bucket, own = grams(new)
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(len(new)))
            ll = np.add.reduceat(self.log_p[bucket[order]], cuts, axis=0)
            slot.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
            rows = np.concatenate([rows, ll])
        cache["rows"] = rows
        get = slot.__getitem__
        token = np.fromiter((s for d in docs for s in map(get, d)), np.int64, int(count.sum()))
        pairs, times = np.unique(np.repeat(np.arange(n), count) * len(rows) + token, return_counts=True)
        number, token = np.divmod(pairs, len(rows))
        weight = 1 + np.log(times)
        ll = rows[token]
        top = ll.max(1, keepdims=True)
        like = np.exp(ll - top)
        first = np.searchsorted(number, have)
        share[have] = self._fit(like, weight, np.add.reduceat(weight * top[:, 0], first), first, np.bincount(number, minlength=n)[have])
        best = share.argmax(1)
        for i in have:
            names[i] = self.languages[best[i]]
        score[have] = np.clip(share[have].max(1), 0, 1)
        return names, score, share

    def _fit(self, like, weight, base, first, count):
        """Proportions of each document; like, weight: of its distinct words, ``count`` in number."""
        k = like.shape[1]
        number = np.repeat(np.arange(len(count)), count)
        size = np.add.reduceat(weight, first)
        weight = weight[:, None]

        def em(pi, rounds):
            for _ in range(rounds):
                joint = like * pi[number]
                joint *= weight / (joint.sum(1, keepdims=True) + 1e-300)
                pi = np.add.reduceat(joint, first, axis=0) / size[:, None]
            total = np.log((like * pi[number]).sum(1) + 1e-300) * weight[:, 0]
            return pi, base + np.add.reduceat(total, first)

        pi, _ = em(np.full((len(count), k), 1 / k), ITERATIONS)
        keep = pi >= np.minimum(LEAST_SHARE, pi.max(1, keepdims=True))
        pi = np.where(keep, pi, 0)
        pi /= pi.sum(1, keepdims=True)
        cost = PENALTY * np.log(size + 1.0) / 2
        pi, fit = em(pi, ITERATIONS // 2)
        best, value = pi.copy(), fit - cost * keep.sum(1)
        for _ in range(k - 1):
            open_ = keep.sum(1) > 1
            if not open_.any():
                break
            weakest = np.where(keep, pi, np.inf).argmin(1)
            keep[np.flatnonzero(open_), weakest[open_]] = False
            pi = np.where(keep, np.maximum(pi, 1e-9), 0)
            pi /= pi.sum(1, keepdims=True)
            pi, fit = em(pi, ITERATIONS // 2)
            now = fit - cost * keep.sum(1)
            better = open_ & (now > value)
            best[better], value[better] = pi[better], now[better]
        return best


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fits the model on about ``rows`` labelled texts a language.

    The sample is drawn by a filter, so no text is exchanged for it.  The driver
    gets one count for each language and one sum for each language and n-gram bucket, a table whose
    size the languages and ``BUCKETS`` bound.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    lang = F.col(lang_col).cast("string")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    step = 1 << 30
    limits = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(step, math.ceil(step * rows / n))))]) if sizes else F.create_map().cast("map<string,int>")
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("train")), F.lit(step))
    sample = labelled.filter(drawn < F.element_at(limits, lang)).select(lang.alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if found := words(text):
                    total.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(grams(found)[0], minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    counts = sample.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).collect()
    found.sort(key=lambda r: r["lang"])
    log_p = np.zeros((BUCKETS, len(found)))
    for j, r in enumerate(found):
        n = np.zeros(BUCKETS)
        n[r["bucket"]] = r["n"]
        log_p[:, j] = np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS))
    return Model([r["lang"] for r in found], log_p)


#: Columns that :func:`predict` adds.
ADDED = ("lang_pred", "score", "shares")


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", added: tuple[str, str, str] = ADDED) -> DataFrame:
    """The rows with the language, its score and all shares (array of double, languages in the model's order) added.

    Columns of ``docs`` that have the names of the added ones are replaced by them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.log_p))
    text = unused(docs.columns, "text_to_read")
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in {a.lower() for a in added}], quoted(text_col).cast("string").alias(text))
    width = len(docs.columns) - 1

    def run(batches):
        cache: dict = {}
        own = Model(*shared.value)
        for batch in batches:
            texts = batch.column(width).to_pylist()
            for a, b in slices(texts, BATCH_CHARS):
                lang, score, share = own.predict(texts[a:b], cache)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(lang, pa.string()), pa.array(score), pa.array(list(share), pa.list_(pa.float64()))], names=[f"c{i}" for i in range(width + 3)])

    schema = StructType([*docs.schema.fields[:-1], StructField(added[0], StringType()), StructField(added[1], DoubleType()), StructField(added[2], ArrayType(DoubleType()))])
    return map_arrow(docs, run, schema)


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
