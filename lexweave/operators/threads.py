"""Mail threads, sessions and memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, discard
from .ranking import neighbours, running_total


def resolve_threads(messages: DataFrame, *, key: str = "message_id", reply: str = "in_reply_to", references: str = "references", rounds: int = 32) -> DataFrame:
    """(key, root): the parent is in_reply_to if known, else the last known reference; roots by pointer doubling.

    Every round is one join on a narrow
    table and halves the remaining depth; it stops when nothing moves.
    """
    known = messages.select(F.col(key).alias("k"))
    asked = messages.select(F.col(key).alias("m"), F.posexplode(F.concat(F.coalesce(references, F.array().cast("array<string>")), F.array(F.col(reply)))).alias("pos", "k"))
    parent = asked.join(known, "k").filter("m <> k").groupBy("m").agg(F.max_by("k", "pos").alias("p"))
    links = messages.select(F.col(key).alias("m")).join(parent, "m", "left").select("m", F.coalesce("p", "m").alias("p"), F.least("m", F.coalesce("p", "m")).alias("low"))
    links = cut(links, "threads")
    for _ in range(rounds):
        up = links.select(F.col("m").alias("p"), F.col("p").alias("pp"), F.col("low").alias("plow"))
        after = links.join(up, "p").select("m", F.col("pp").alias("p"), F.least("low", "plow").alias("low"), (F.col("pp") != F.col("p")).alias("moved"))
        after = cut(after, "threads")
        discard(links)
        links = after
        if after.filter("moved").isEmpty():
            break
    return links.select(F.col("m").alias(key), F.when(F.col("p") == F.col("m"), F.col("m")).otherwise(F.col("p")).alias("root"))


def thread_statistics(messages: DataFrame, as_of: Column, *, thread: str = "thread", sender: str = "sender", to: str = "recipients", at: str = "at", stale_days: int = 7) -> DataFrame:
    """Count, participants, senders with their counts, begin, end, holder of the ball, and whether it is stale."""
    # each person of a thread once before they are gathered
    named = messages.select(thread, F.explode(F.array_union(F.array(F.col(sender)), F.col(to))).alias("__who")).distinct()
    people = named.groupBy(thread).agg(F.array_sort(F.collect_list("__who")).alias("participants"))
    base = messages.groupBy(thread).agg(F.count(F.lit(1)).alias("n_messages"), F.min(at).alias("started"), F.max(at).alias("last"), F.max_by(sender, at).alias("holder"))
    base = base.join(people, thread)
    return base.withColumn("stale", F.date_diff(as_of, F.to_date("last")) > stale_days)


def mean_reply_hours(messages: DataFrame, *, thread: str = "thread", at: str = "at", order: list[str] | None = None) -> DataFrame:
    """The mean of the positive gaps between consecutive messages; null if there is none."""
    order = order or [at]
    rows = neighbours(messages.select(*dict.fromkeys([thread, at, *order])), [thread], order, F.col(at), "__before", "__after")
    gap = (F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(F.col("__before").cast("timestamp"))) / 3600.0
    return rows.withColumn("__gap", gap).groupBy(thread).agg(F.avg(F.when(F.col("__gap") > 0, F.col("__gap"))).alias("mean_hours"))


def unanswered(messages: DataFrame, *, key: str = "message_id", references: str = "references") -> DataFrame:
    """Messages that no other refers to."""
    return messages.join(messages.select(F.explode(references).alias(key)).distinct(), key, "left_anti")


def within_budget(rows: DataFrame, partition: list[str], order: list, length: Column, budget: int) -> DataFrame:
    """The longest prefix of each partition, in order, whose lengths add up to at most the budget."""
    return running_total(rows, partition, order, length, "__sum").filter(F.col("__sum") <= budget).drop("__sum")


def packed_context(texts: Column, budget: int) -> Column:
    """Texts cut to budget / number of them each, joined, while the shrinking budget lasts."""
    each = F.floor(F.lit(budget) / F.size(texts)).cast("int")

    def step(acc, x):
        part = F.substring(x, F.lit(1), F.least(each, acc["left"]))
        return F.struct((acc["left"] - F.length(part)).alias("left"), F.when(acc["left"] > 0, F.concat(acc["out"], F.array(part))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(texts, F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("out")), step, lambda a: F.array_join(a["out"], "\n"))


def recall_score(text: Column, words: list[str], weight: Column, factor: float) -> Column:
    """The number of words in the text plus a weighted importance."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0)) + factor * weight


def dense_sample(n: str, total: str, most: int = 8, head: int = 2, tail: int = 3) -> Column:
    """Whether the n-th of ``total`` messages is shown: all up to ``most``, else the first and the last few."""
    return (F.col(total) <= most) | (F.col(n) <= head) | (F.col(n) > F.col(total) - tail)


# Fixed value: statuses of tasks that no reply changes.
CLOSED = ("done", "cancelled")


def related_tasks(replies: DataFrame, tasks: DataFrame) -> DataFrame:
    """(reply, task_id): open tasks of a reply's thread; where there is none, open tasks whose title shares a word with the subject.

    ``replies`` has reply, thread and subject, ``tasks`` task_id, thread, title
    and status.  Reply and forward marks anywhere in the subject don't count;
    words are compared as they are.
    """
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, r"[\s\p{Z}]+"), lambda w: w != ""))).alias("word")
    live = tasks.filter(~F.col("status").isin(*CLOSED))
    same = replies.select("reply", "thread").join(live.select("thread", "task_id"), "thread").select("reply", "task_id")
    # written: what has no task in its thread is known before words are met
    same = cut(same, "thread-tasks")
    rest = replies.join(same.select("reply").distinct(), "reply", "left_anti")
    subject = rest.select("reply", words(F.regexp_replace(F.coalesce("subject", F.lit("")), "(?i)Re:|FW:|Fwd:", "")))
    titles = live.select("task_id", words(F.coalesce("title", F.lit(""))))
    return same.unionByName(subject.join(titles, "word").select("reply", "task_id").distinct())


#: The parts of a memory context in their order, and their heads.
MEMORY_HEADS = {"working": "[作業記憶]", "semantic": "[ドメイン知識]", "procedural": "[手順パターン]", "episodic": "[関連エピソード]"}


def memory_context(questions: DataFrame, lines: dict[str, DataFrame], total: int = 4000) -> DataFrame:
    """(query_id, context): what the four memories hold for each question, each within a quarter of ``total`` characters.

    ``lines`` has for each memory rows (query_id, rank, line), already cut to its
    number of results; the working memory is the same for all questions and has
    no query_id.  A memory without a line is left out; its lines count up to the
    first that exceeds the budget, its head and line feeds don't.  Parts come in
    a fixed order with a blank line between them.
    """
    out = questions.select("query_id")
    budget = total // len(MEMORY_HEADS)
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))

    def step(acc, x):
        fits = acc["open"] & (acc["n"] + F.length(x["line"]) <= budget)
        return F.struct((acc["n"] + F.when(fits, F.length(x["line"])).otherwise(0)).alias("n"), fits.alias("open"), F.when(fits, F.concat(acc["kept"], F.array(x["line"]))).otherwise(acc["kept"]).alias("kept"))

    for kind, head in MEMORY_HEADS.items():
        rows = lines[kind]
        keys = ["query_id"] if kind != "working" else []
        listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias(f"__{kind}"))
        out = out.join(listed, keys, "left") if keys else out.crossJoin(F.broadcast(listed))
        body = F.aggregate(f"__{kind}", start, step, lambda acc: acc["kept"])
        part = F.when(F.size(f"__{kind}") > 0, F.array_join(F.concat(F.array(F.lit(head)), body), "\n"))
        out = out.withColumn(f"__{kind}", part)
    return out.select("query_id", F.concat_ws("\n\n", *[f"__{k}" for k in MEMORY_HEADS]).alias("context"))


def sessions(index: DataFrame, *, tags: list[str] | None = None, query: str | None = None, include_archived: bool = False, limit: int = 20) -> DataFrame:
    """Sessions (session_id, title, tags, archived, updated_at) with one of the tags and the query in their title, newest first, ties by id."""
    rows = index if include_archived else index.filter("not archived")
    if tags:
        rows = rows.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if query:
        rows = rows.filter(F.contains(F.lower("title"), F.lit(query.lower())))
    return rows.orderBy(F.desc("updated_at"), "session_id").limit(limit)
