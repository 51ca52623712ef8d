"""The registry as a log of events: inserts, updates and deletes that cascade, approvals, and histories of status.

Nothing is changed in place.  An event has a key, the key of its parent (or
none), a time and a number that orders events of one time, an operation and the
fields that it sets.  The state as of any time is a fold over the events up to
then; every fold is an aggregate or looks at earlier rows of a group by range, so
no task sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import earlier_largest, neighbours
from .records import latest

# Relationships of a link, and the notes of approvals and rejections.
RELATIONSHIPS = ("reference", "required", "submitted", "approved", "rejected", "pending")
SUBMITTED_NOTE, APPROVED_NOTE, REJECTED_NOTE = "承認申請", "承認者: ", "差し戻し理由: "


def _order() -> Column:
    return F.struct("at", "seq")


def effective(events: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """The events (key, parent, at, seq, op, ...) that change something, deletes by cascade among them.

    ``op`` is insert, update or delete.  Every delete among ``parents`` (key, at,
    seq, op: effective events of theirs) deletes the children that are there.
    An insert counts if its parent is there (or there are no parents) and
    replaces a row of its key; an update or a delete counts if the row is there.
    """
    rows, counted = events, None
    if parents is not None:
        known = parents.select(F.col("key").alias("parent"), "at", "seq", F.col("op").alias("p_op"))
        # only inserts ask for their parent; the others go past this exchange
        other = F.coalesce(F.col("op") != "insert", F.lit(False))
        marks = known.withColumn("own", F.lit(False)).unionByName(events.filter(~other).withColumn("own", F.lit(True)), allowMissingColumns=True)
        seen = earlier_largest(marks, ["parent"], ["at", "seq"], {"above": F.when(~F.col("own"), F.struct("at", "seq", "p_op"))}).filter("own")
        there = F.coalesce(F.col("above.p_op") != "delete", F.lit(False))
        rows = seen.filter(there).select(*events.columns).unionByName(events.filter(other))
        gone = known.filter("p_op = 'delete'").select("parent", "at", "seq")
        cascaded = events.filter("op = 'insert'").select("key", "parent").join(gone, "parent").distinct().withColumn("op", F.lit("delete"))
        rows = rows.unionByName(cascaded, allowMissingColumns=True)
        counted = events.select("key").unionByName(cascaded.select("key"))
    begun = F.when(F.col("op").isin("insert", "delete"), F.struct("at", "seq", "op"))
    seen = earlier_largest(rows, ["key"], ["at", "seq"], {"before": begun}, counted)
    alive = F.coalesce(F.col("before.op") == "insert", F.lit(False))
    return seen.filter((F.col("op") == "insert") | alive).drop("before")


def state(events: DataFrame, fields: list[str], as_of: Column | None = None) -> DataFrame:
    """(key, parent, at, *fields) of the rows that are there as of a time, from effective events.

    A field has its last value since the row was inserted; a null in an update
    leaves it as it is.  ``at`` is the time of the last change.  All of it is one
    aggregate: a field whose last value is older than the insert has none since.
    """
    rows = events if as_of is None else events.filter(F.col("at") <= as_of)
    begins = F.when(F.col("op") != "update", _order())
    told = [F.when(F.col(f).isNotNull(), _order()) for f in fields]
    last = [c for i, (f, o) in enumerate(zip(fields, told, strict=True)) for c in (F.max(o).alias(f"__o{i}"), F.max_by(f, o).alias(f"__v{i}"))]
    folded = rows.groupBy("key").agg(F.max(begins).alias("__start"), F.max_by("op", begins).alias("__begun"), F.max_by("parent", _order()).alias("parent"), F.max("at").alias("at"), *last)
    since = [F.when(F.col(f"__o{i}") >= F.col("__start"), F.col(f"__v{i}")).alias(f) for i, f in enumerate(fields)]
    return folded.filter("key is not null and __begun = 'insert'").select("key", "parent", "at", *since)


def approvals(actions: DataFrame) -> DataFrame:
    """Events of links (key, parent, at, seq, op, relationship, notes) from actions (key, parent, at, seq, action, who, note).

    link has the relationship in ``who`` and its notes in ``note``, submit asks for approval, approve and
    reject answer, unlink deletes.  Relationships that aren't known are left out.
    """
    act = F.col("action")
    op = F.when(act.isin("link", "submit"), "insert").when(act.isin("approve", "reject", "update"), "update").when(act == "unlink", "delete")
    kind = F.when(act == "submit", "pending").when(act == "approve", "approved").when(act == "reject", "rejected").when(act.isin("link", "update"), F.col("who"))
    said = F.coalesce("note", F.lit(""))
    approved = F.concat(F.lit(APPROVED_NOTE), F.coalesce("who", F.lit("")), F.when(said != "", F.concat(F.lit(" / "), said)).otherwise(""))
    notes = F.when(act == "submit", SUBMITTED_NOTE).when(act == "approve", approved).when(act == "reject", F.concat(F.lit(REJECTED_NOTE), said)).when(act.isin("link", "update"), said)
    made = actions.select("key", "parent", "at", "seq", op.alias("op"), kind.alias("relationship"), notes.alias("notes"))
    return made.filter("op is not null and (op = 'delete' or relationship in ({}))".format(", ".join(f"'{r}'" for r in RELATIONSHIPS)))


def status_history(changes: DataFrame) -> DataFrame:
    """(key, at, seq, before, after, reason): the changes (key, at, seq, status, reason) that change a status; the first has none before."""
    rows = neighbours(changes, ["key"], ["at", "seq"], F.col("status"), "before", "behind")
    return rows.filter(~F.col("before").eqNullSafe(F.col("status"))).select("key", "at", "seq", "before", F.col("status").alias("after"), "reason")


def upserted(log: DataFrame) -> DataFrame:
    """The last row of each key of a log without deletes."""
    return latest(log, ["key"], ["at", "seq"])
