"""The registry as a log: orders are documents, line items their versions and links, events changes of status."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eventlog as L
from ..registry import query

AS_OF = "2000-06-30"


def _later(at, days):
    return F.col(at) + F.make_dt_interval(F.lit(days))


def documents(t):
    """Orders are inserted, some are updated, deleted and inserted again."""
    o = t.orders.select(F.col("o_orderkey").alias("key"), F.lit(None).cast("long").alias("parent"), F.col("o_orderdate").alias("at"), F.lit(0).cast("long").alias("seq"), F.col("o_orderstatus").alias("title"))
    step = lambda rows, days, op, title: rows.withColumns({"at": _later("at", days), "op": F.lit(op), "title": title})
    out = step(o, 0, "insert", F.col("title")).unionByName(step(o.filter("key % 3 = 0"), 20, "update", F.lit("U")))
    out = out.unionByName(step(o.filter("key % 7 = 0"), 60, "delete", F.lit(None).cast("string"))).unionByName(step(o.filter("key % 14 = 0"), 90, "insert", F.lit("again")))
    return L.effective(out)


DOCUMENTS_SQL = """
de AS (SELECT o_orderkey AS key, o_orderdate AS "at", 0 AS seq, 'insert' AS op, o_orderstatus AS title FROM orders UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL 20 DAY, 0, 'update', 'U' FROM orders WHERE o_orderkey % 3 = 0
 UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL 60 DAY, 0, 'delete', NULL FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL 90 DAY, 0, 'insert', 'again' FROM orders WHERE o_orderkey % 14 = 0),
ds AS (SELECT *, last_value(CASE WHEN op <> 'update' THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM de),
d AS (SELECT key, "at", seq, op, title FROM ds WHERE op = 'insert' OR b = 'insert')"""
CHILDREN_SQL = """
u AS (SELECT parent, key, "at", seq, op, a, b, true AS own FROM ce UNION ALL SELECT key, NULL, "at", seq, op, NULL, NULL, false FROM d),
us AS (SELECT *, last_value(CASE WHEN NOT own THEN op END IGNORE NULLS) OVER (PARTITION BY parent ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM u),
cr AS (SELECT parent, key, "at", seq, op, a, b FROM us WHERE own AND (op <> 'insert' OR above <> 'delete') UNION ALL SELECT c.parent, c.key, d."at", d.seq, 'delete', NULL, NULL FROM (SELECT DISTINCT parent, key FROM ce WHERE op = 'insert') c JOIN d ON d.key = c.parent AND d.op = 'delete'),
cs AS (SELECT *, last_value(CASE WHEN op <> 'update' THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cr),
c AS (SELECT parent, key, "at", seq, op, a, b FROM cs WHERE op = 'insert' OR before = 'insert')"""
STATE_SQL = """
st AS (SELECT key, max(("at", seq)) AS start FROM {0} WHERE op <> 'update' AND "at" <= TIMESTAMP '{1}' GROUP BY key HAVING arg_max(op, ("at", seq)) = 'insert'),
si AS (SELECT x.* FROM {0} x JOIN st USING (key) WHERE (x."at", x.seq) >= st.start AND x."at" <= TIMESTAMP '{1}')"""


@query("dml_documents_as_of", f"""WITH {DOCUMENTS_SQL}, {STATE_SQL.format('d', AS_OF)} SELECT key, max("at") AS "at", arg_max(title, ("at", seq)) FILTER (title IS NOT NULL) AS title FROM si GROUP BY key""")
def documents_as_of(t):
    return L.state(documents(t), ["title"], F.lit(AS_OF).cast("timestamp_ntz")).drop("parent")


KEY, SEQ = "l_orderkey * 10 + l_linenumber", "l_partkey * 1000 + l_suppkey"


@query("dml_versions_after_cascade", f"""WITH {DOCUMENTS_SQL},
l AS (SELECT l_orderkey AS parent, l_orderkey * 10 + l_linenumber AS key, l_shipdate AS "at", l_partkey * 1000 + l_suppkey AS seq, l_returnflag AS flag, l_quantity AS q FROM lineitem),
ce AS (SELECT parent, key, "at", seq, 'insert' AS op, flag AS a, NULL AS b FROM l UNION ALL SELECT parent, key, "at" + INTERVAL 10 DAY, seq, 'update', 'X', NULL FROM l WHERE q > 40 UNION ALL SELECT parent, key, "at" + INTERVAL 15 DAY, seq, 'delete', NULL, NULL FROM l WHERE q < 5),
{CHILDREN_SQL}, {STATE_SQL.format('c', AS_OF)} SELECT key, any_value(parent) AS parent, max("at") AS "at", arg_max(a, ("at", seq)) FILTER (a IS NOT NULL) AS flag FROM si GROUP BY key""")
def versions(t):
    """Versions that are there as of a day: those of deleted documents are gone, also where the document came back."""
    v = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.expr(KEY).alias("key"), F.col("l_shipdate").alias("at"), F.expr(SEQ).alias("seq"), F.col("l_returnflag").alias("flag"), "l_quantity")
    step = lambda rows, days, op, flag: rows.withColumns({"at": _later("at", days), "op": F.lit(op), "flag": flag}).drop("l_quantity")
    out = step(v, 0, "insert", F.col("flag")).unionByName(step(v.filter("l_quantity > 40"), 10, "update", F.lit("X"))).unionByName(step(v.filter("l_quantity < 5"), 15, "delete", F.lit(None).cast("string")))
    return L.state(L.effective(out, documents(t)), ["flag"], F.lit(AS_OF).cast("timestamp_ntz"))


@query("dml_approvals", f"""WITH {DOCUMENTS_SQL},
l AS (SELECT l_orderkey AS parent, l_orderkey * 10 + l_linenumber AS key, l_shipdate AS "at", l_partkey * 1000 + l_suppkey AS seq, l_suppkey AS s, l_quantity AS q, l_linestatus AS f, l_tax AS x, l_discount AS k FROM lineitem),
ce AS (SELECT parent, key, "at", seq, 'insert' AS op, CASE WHEN q > 10 THEN 'pending' ELSE 'required' END AS a, CASE WHEN q > 10 THEN '承認申請' ELSE '' END AS b FROM l UNION ALL SELECT parent, key, "at" + INTERVAL 5 DAY, seq, 'update', 'approved', '承認者: S' || s::VARCHAR || CASE WHEN q > 25 THEN ' / ok' ELSE '' END FROM l WHERE f = 'F'
 UNION ALL SELECT parent, key, "at" + INTERVAL 8 DAY, seq, 'update', 'rejected', '差し戻し理由: tax' FROM l WHERE x > 0.05 UNION ALL SELECT parent, key, "at" + INTERVAL 30 DAY, seq, 'delete', NULL, NULL FROM l WHERE k > 0.08),
{CHILDREN_SQL}, {STATE_SQL.format('c', AS_OF)} SELECT key, any_value(parent) AS parent, max("at") AS "at", arg_max(a, ("at", seq)) FILTER (a IS NOT NULL) AS relationship, arg_max(b, ("at", seq)) FILTER (b IS NOT NULL) AS notes FROM si GROUP BY key""")
def approvals(t):
    """Links that ask for approval, are approved or rejected, and undone."""
    v = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.expr(KEY).alias("key"), F.col("l_shipdate").alias("at"), F.expr(SEQ).alias("seq"), "l_suppkey", "l_quantity", "l_linestatus", "l_tax", "l_discount")
    none = F.lit(None).cast("string")
    step = lambda rows, days, act, who, note: rows.select("key", "parent", _later("at", days).alias("at"), "seq", act.alias("action"), who.alias("who"), note.alias("note"))
    many = F.col("l_quantity") > 10
    acts = step(v, 0, F.when(many, "submit").otherwise("link"), F.when(~many, "required"), none)
    acts = acts.unionByName(step(v.filter("l_linestatus = 'F'"), 5, F.lit("approve"), F.concat(F.lit("S"), "l_suppkey"), F.when(F.col("l_quantity") > 25, "ok")))
    acts = acts.unionByName(step(v.filter("l_tax > 0.05"), 8, F.lit("reject"), none, F.lit("tax"))).unionByName(step(v.filter("l_discount > 0.08"), 30, F.lit("unlink"), none, none))
    acts = acts.unionByName(step(v, 1, F.lit("update"), F.lit("no such relationship"), none))
    return L.state(L.effective(L.approvals(acts), documents(t)), ["relationship", "notes"], F.lit(AS_OF).cast("timestamp_ntz"))


@query("dml_status_history", """WITH h AS (SELECT user_id AS key, ts AS "at", event_id AS seq, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after, 'auto: ' || event_type AS reason FROM events) SELECT * FROM h WHERE before IS DISTINCT FROM after""")
def history(t):
    changes = t.events.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.concat(F.lit("auto: "), "event_type").alias("reason"))
    return L.status_history(changes)
