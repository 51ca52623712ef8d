"""The versioned document registry and the task tracker.

Tables are immutable: changes are rows of an event log, and the state is the
latest row of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dimension import small
from .ranking import numbered


def latest(log: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in the given order: an upsert of an event log; partly aggregated before the exchange."""
    rows = log.withColumn("__row", F.struct(*log.columns))
    last = rows.groupBy(*keys).agg(F.max_by("__row", F.struct(*order)).alias("__row"))
    return last.select("__row.*")


def like_any(columns: list[str], text: str) -> Column:
    """LIKE %text% on any of the columns, whatever the case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(c), F.lit(text.lower()))
    return out


def number_versions(versions: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """version_seq from 1 in each document and is_latest."""
    rows = numbered(versions, [doc], order, "version_seq", size="__size")
    return rows.withColumns({"version_seq": F.col("version_seq").cast("int"), "is_latest": F.col("version_seq") == F.col("__size")}).drop("__size")


def attach_tags(docs: DataFrame, bridge: DataFrame, tags: DataFrame, doc: str, tag: str, name: str) -> DataFrame:
    """docs with a sorted array of tag names; empty if none."""
    named = bridge.join(small(tags), tag).groupBy(doc).agg(F.array_sort(F.collect_set(name)).alias("tags"))
    return docs.join(named, doc, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def missing_required(required: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return required.join(have, keys, "left_anti")


def effective_status(status: Column, due: Column, as_of: Column) -> Column:
    """overdue once the due date is past, unless done or on hold; overdue stays."""
    return F.when(status.isin("done", "hold"), status).when(due < as_of, "overdue").otherwise(status)


def blocked(tasks: DataFrame, task: str = "task_id", depends: str = "depends_on", status: str = "status") -> DataFrame:
    """(task) of tasks with a known dependency that isn't done; unknown ones don't block."""
    open_ = tasks.filter(F.col(status) != "done").select(F.col(task).alias("__d"))
    return tasks.select(task, F.explode(depends).alias("__d")).join(open_, "__d", "left_semi").select(task).distinct()


def ordinal(c: Column, values: list[str]) -> Column:
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(c == v, i).otherwise(out)
    return out


def completion(status: Column) -> Column:
    """The share of done tasks; 0 for none."""
    return F.coalesce(F.avg(F.when(status == "done", 1.0).otherwise(0.0)), F.lit(0.0))


def alerts(tasks: DataFrame, as_of: Column, task: str = "task_id", soon: int = 3, idle: int = 7) -> DataFrame:
    """(task, kind, level, days) of four rules; needs refreshed status, due, updated and depends_on.

    critical: overdue; else warning: due within ``soon`` days, or past on hold;
    warning: doing, but not updated for more than ``idle`` days; info: blocked
    and not on hold.  Done tasks have none.  days are those that the kind is
    about: until the due date, or since the update.
    """
    days, since = F.date_diff("due", as_of), F.date_diff(as_of, F.col("updated"))
    late = F.col("status") == "overdue"
    rules = (
        (late, "overdue", "critical", F.abs(days)),
        (~late & (days <= soon), "due_soon", "warning", days),
        ((F.col("status") == "doing") & (since > idle), "stale", "warning", since),
        (F.col("__blocked") & (F.col("status") != "hold"), "blocked", "info", F.lit(None).cast("int")),
    )
    rows = tasks.filter("status <> 'done'").join(blocked(tasks, task).withColumn("__blocked", F.lit(True)), task, "left").withColumn("__blocked", F.coalesce("__blocked", F.lit(False)))
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(v).alias("level"), d.alias("days"))) for c, k, v, d in rules]), lambda x: x.isNotNull())
    return rows.select(task, F.explode(found).alias("a")).select(task, "a.*")


def gantt(tasks: DataFrame, start: Column, weeks: int, task: str = "task_id") -> DataFrame:
    """(task, week, symbol): # while running, x done, ! overdue, . outside; needs begin, due and status."""
    grid = tasks.withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    first = F.date_add(start, F.col("week") * 7)
    inside = (F.col("begin") <= F.date_add(first, 6)) & (F.col("due") >= first)
    symbol = F.when(~inside, ".").when(F.col("status") == "done", "x").when(F.col("status") == "overdue", "!").otherwise("#")
    return grid.select(task, "week", symbol.alias("symbol"))


def document_domains(domains: DataFrame) -> DataFrame:
    """(doc_id, domain, name, expert_note, keywords, is_primary): the first domain of a map that names the document.

    ``domains`` has position, domain, name, expert_note, keywords, primary_docs
    and related_docs (arrays; what follows a # is a remark).  Domains come in
    their order, each with its primary documents before its related ones.
    """
    named = lambda c, kind: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda d, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.trim(F.regexp_replace(d, r"#.*", "")).alias("doc_id")))
    rows = domains.select("position", "domain", F.coalesce("name", "domain").alias("name"), F.trim(F.coalesce("expert_note", F.lit(""))).alias("expert_note"), "keywords", F.explode(F.concat(named("primary_docs", 0), named("related_docs", 1))).alias("d"))
    first = F.min_by(F.struct("domain", "name", "expert_note", "keywords", (F.col("d.kind") == 0).alias("is_primary")), F.struct("position", "d.kind", "d.at"))
    return rows.groupBy("d.doc_id").agg(first.alias("f")).select("doc_id", "f.*")


def with_domain(chunks: DataFrame, documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """chunks with domain, domain_name and is_primary_doc of the document, else of its id without an edition at the end (a capital and digits)."""
    own = lambda n: small(documents.select(F.col("doc_id").alias(f"__d{n}"), F.struct("domain", "name", "is_primary").alias(f"__f{n}")))
    base = F.regexp_replace(F.col(doc), r"[A-Z]\p{Nd}*$", "")
    met = chunks.join(own(1), F.col(doc) == F.col("__d1"), "left").join(own(2), base == F.col("__d2"), "left")
    f = F.coalesce("__f1", "__f2")
    told = {"domain": F.coalesce(f["domain"], F.lit("")), "domain_name": F.coalesce(f["name"], F.lit("")), "is_primary_doc": F.coalesce(f["is_primary"], F.lit(False))}
    return met.withColumns(told).drop("__d1", "__f1", "__d2", "__f2")
