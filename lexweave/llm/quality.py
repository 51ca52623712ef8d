"""Quality rules combined by weak supervision.

DataFrame functions only.  Every rule looks at one statistic of a text and
votes good, bad or abstains.  How far a rule can be trusted is estimated without
labels: texts that pass the base rule are counted by their votes (at most 3 to
the number of rules patterns, whatever the corpus), and expectation-maximisation
over those counts fits how often each rule, where it votes, calls a bad text bad
and a good text bad, and the share of good texts.  An abstention says nothing.  A text is
kept if the posterior probability of good given its votes is at least
``LEAST_POSTERIOR`` and the base rule holds.  Good votes weigh against bad ones:
a bad vote of a rule that the others seldom bear out is outvoted, one of a rule
that mostly agrees with others isn't.

Statistics are computed in one pass and written; the pattern counts and the
verdicts read that narrow table.  Repeated five-word windows are found inside
the row: windows are hashed to 64 bits, and only rows whose hashes repeat sort
them.

Defined cases: null and empty texts have no word, and fail the base rule; very
long texts are read whole; equal rows get equal verdicts; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, cut, table

LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
LEAST_POSTERIOR = 0.5
EM_ROUNDS = 100
#: The share of good texts that expectation-maximisation starts from.
PRIOR = 0.9
#: Where a rule votes it is believed to call this share of bad and of good texts bad; the belief weighs like this share of the texts.
BELIEF = (0.3, 0.03)
BELIEF_WEIGHT = 0.1


@dataclass(frozen=True)
class Rule:
    """Votes -1 where ``bad`` holds, else 1 where ``good`` holds, else 0; both are SQL over the statistics."""

    name: str
    good: str
    bad: str


#: Shares of few words say little: those rules don't call a text of less than 20 words bad.
RULES = (
    Rule("length", "n_words >= 50", "n_words < 20"),
    Rule("word_length", "word_chars between 4 * n_words and 7 * n_words", "n_words >= 20 and (word_chars < 3 * n_words or word_chars > 9 * n_words)"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("letters", "100 * n_letters >= 90 * word_chars", "n_words >= 20 and 100 * n_letters < 75 * word_chars"),
    Rule("lines", "n_lines >= 3 and n_dup_lines = 0", "100 * n_dup_lines > 30 * n_lines"),
    Rule("repeats", "100 * n_repeat_words <= n_words", "100 * n_repeat_words > 10 * n_words"),
    Rule("capitals", "1000 * n_capitals between 2 * n_letters and 100 * n_letters", "n_words >= 20 and 100 * n_capitals > 30 * n_letters"),
    Rule("shouts", "n_shouts = 0", "10 * n_shouts > n_words"),
    Rule("variety", "10 * n_distinct >= 5 * least(n_words, 1000)", "n_words >= 20 and 10 * n_distinct < 2 * least(n_words, 1000)"),
)


def _without(text: Column, pattern: str) -> Column:
    """Characters that are left when matches are taken out."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics that the rules read, all long."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), t.alias("t"))
    rows = rows.select("doc_id", "t", F.array_remove(F.split("t", WORD_GAP), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.select(
        "doc_id", "t", "w",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    window = F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    rows = rows.withColumn("g", F.when(F.size("h") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    numbered = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), numbered))
    again = F.filter("s", lambda e, k: (F.get("s", k - 1)["h"] == e["h"]) | (F.get("s", k + 1)["h"] == e["h"]))
    starts = F.sort_array(F.transform(again, lambda e: e["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return rows.select(
        "doc_id", "n_words", F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - _without(F.col("t"), r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        _without(F.col("t"), r"\P{L}+").alias("n_letters"), _without(F.col("t"), r"\P{Lu}+").alias("n_capitals"),
        (F.length("t") - _without(F.col("t"), r"!!+")).cast("long").alias("n_shouts"),
        F.size(F.array_distinct(F.filter("h", lambda x: x.isNotNull()))).cast("long").alias("n_distinct"),
    )


def _vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), -1).when(F.expr(rule.good), 1).otherwise(0)


@dataclass
class Trust:
    """Fitted by EM: the share of good texts and, for each rule, P(bad vote | bad text) and P(bad vote | good text) where it votes."""

    prior: float
    rules: list[tuple[float, float]]

    def log_odds(self, k: int, vote: int) -> float:
        bad, good = self.rules[k]
        return math.log(good / bad) if vote < 0 else math.log((1 - good) / (1 - bad)) if vote else 0.0


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = EM_ROUNDS, prior: float = PRIOR) -> Trust:
    """Expectation-maximisation over counted vote patterns.

    The belief keeps a rule that hardly ever calls a text bad near ``BELIEF``
    and no share is 0 or 1; a rule whose votes turn out to say nothing, or the
    opposite, ends with log odds of 0.
    """
    trust = Trust(prior, [BELIEF] * rules)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = 0.0
        # bad votes on bad texts, votes on bad texts, and the same for good ones
        sums = [[0.0] * 4 for _ in range(rules)]
        for votes, n in patterns:
            odds = math.log(trust.prior / (1 - trust.prior)) + sum(trust.log_odds(k, v) for k, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
            good += n * p
            for k, v in enumerate(votes):
                if v:
                    sums[k][0] += n * (1 - p) * (v < 0)
                    sums[k][1] += n * (1 - p)
                    sums[k][2] += n * p * (v < 0)
                    sums[k][3] += n * p
        fitted = []
        for bad_on_bad, on_bad, bad_on_good, on_good in sums:
            w_bad, w_good = BELIEF_WEIGHT * on_bad + 1, BELIEF_WEIGHT * on_good + 1
            high = (bad_on_bad + w_bad * BELIEF[0]) / (on_bad + w_bad)
            low = (bad_on_good + w_good * BELIEF[1]) / (on_good + w_good)
            if high < low:
                high = low = (bad_on_bad + bad_on_good + w_bad * BELIEF[0] + w_good * BELIEF[1]) / (on_bad + on_good + w_bad + w_good)
            fitted.append((high, low))
        trust = Trust(min(0.99, max(0.5, good / total)), fitted)
    return trust


def judge(stats: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = LEAST_POSTERIOR) -> DataFrame:
    """The statistics with votes (array of int), posterior, base_failed and kept added.

    The driver gets the pattern counts, at most 2 * 3 ** len(rules) rows.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    voted = stats.withColumn("base_failed", failed).withColumn("votes", F.array(*map(_vote, rules)))
    # counted with the base rule's verdict: a filter on it would be pushed below the statistics and compute them twice
    counts = voted.groupBy("base_failed", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = [(tuple(r["votes"]), r["n"]) for r in counts if not r["base_failed"]]
    trust = fit(sorted(patterns), len(rules))
    odds = F.lit(math.log(trust.prior / (1 - trust.prior)))
    for k in range(len(rules)):
        v = F.element_at("votes", k + 1)
        odds = odds + F.when(v == -1, trust.log_odds(k, -1)).when(v == 1, trust.log_odds(k, 1)).otherwise(0.0)
    out = voted.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(statistics(table(spark, sf_dir, "documents")), "quality")
    return judge(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
