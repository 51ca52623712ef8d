"""Registry and tasks: orders stand for documents and tasks, lineitem for versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking
from ..operators import records as R
from ..operators.dimension import small
from ..registry import query

AS_OF = "1998-01-01"
TASKS_SQL = """t AS (SELECT o_orderkey AS task_id, 'task ' || o_orderkey::VARCHAR AS title, o_custkey AS assignee, o_custkey % 7 AS project, o_orderkey % 3 AS phase,
 CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'doing' ELSE 'todo' END AS base, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate::DATE END AS due, o_orderdate::DATE - 30 AS begin_, (o_orderdate::DATE - 9) AS updated,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority, [o_orderkey - 1, o_orderkey + 100000000] AS depends_on FROM orders),
u AS (SELECT *, CASE WHEN base IN ('done', 'hold') THEN base WHEN due < DATE '1998-01-01' THEN 'overdue' ELSE base END AS status FROM t),
bl AS (SELECT DISTINCT a.task_id FROM (SELECT task_id, unnest(depends_on) AS d FROM u) a JOIN u b ON b.task_id = a.d AND b.status <> 'done')"""


def tasks(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("task_id"), F.concat(F.lit("task "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_custkey").alias("assignee"),
        (F.col("o_custkey") % 7).alias("project"), (F.col("o_orderkey") % 3).alias("phase"),
        F.expr("case o_orderstatus when 'F' then 'done' when 'O' then 'doing' else 'todo' end").alias("base"),
        F.expr("case when o_orderkey % 11 = 0 then null else cast(o_orderdate as date) end").alias("due"),
        F.date_sub(F.to_date("o_orderdate"), 30).alias("begin"), F.date_sub(F.to_date("o_orderdate"), 9).alias("updated"),
        F.expr("case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'high' when '3-MEDIUM' then 'medium' else 'low' end").alias("priority"),
        F.array(F.col("o_orderkey") - 1, F.col("o_orderkey") + 100000000).alias("depends_on"),
    )
    return rows.withColumn("status", R.effective_status(F.col("base"), F.col("due"), F.lit(AS_OF).cast("date")))


@query("j1_document_versions", "SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' AND contains(lower(o_orderpriority), 'high')")
def j1(t):
    docs = t.orders.filter((F.col("o_orderstatus") == "P") & R.like_any(["o_orderpriority"], "HIGH")).select("o_orderkey")
    return docs.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("w6_version_sequence", f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)})::INT AS version_seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) = count(*) OVER (PARTITION BY l_orderkey) AS is_latest FROM lineitem")
def w6(t):
    return R.number_versions(t.lineitem, "l_orderkey", ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "version_seq", "is_latest")


@query("j2_latest_version", f"WITH v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in ORDER)}) AS k FROM lineitem) SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey, l_quantity FROM orders JOIN v ON o_orderkey = l_orderkey AND k = 1")
def j2(t):
    return t.orders.join(R.latest(t.lineitem, ["l_orderkey"], ORDER), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderstatus", "l_linenumber", "l_partkey", "l_quantity")


@query("j3_links_coalesce", """
WITH v AS (SELECT l_orderkey, l_linenumber, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1, 2), cur AS (SELECT l_orderkey, max(l_linenumber) AS current FROM v GROUP BY 1),
links AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS version, o_custkey AS target FROM orders)
SELECT target, doc, coalesce(version, current) AS version, shipped FROM links LEFT JOIN cur ON doc = cur.l_orderkey LEFT JOIN v ON v.l_orderkey = doc AND v.l_linenumber = coalesce(version, current)""")
def j3(t):
    v = t.lineitem.groupBy(F.col("l_orderkey").alias("doc"), "l_linenumber").agg(F.max("l_shipdate").alias("shipped"))
    cur = v.groupBy("doc").agg(F.max("l_linenumber").alias("current"))
    links = t.orders.select(F.col("o_orderkey").alias("doc"), F.expr("case when o_orderkey % 2 = 0 then 1 end").alias("version"), F.col("o_custkey").alias("target"))
    rows = links.join(cur, "doc", "left").withColumn("version", F.coalesce("version", "current"))
    return rows.join(v.withColumnRenamed("l_linenumber", "version"), ["doc", "version"], "left").select("target", "doc", "version", "shipped")


@query("j4_tags", "WITH b AS (SELECT DISTINCT l_orderkey, l_suppkey % 5 AS tag FROM lineitem), n AS (SELECT r_regionkey AS tag, r_name FROM region) SELECT o_orderkey, coalesce((SELECT string_agg(DISTINCT r_name, ',' ORDER BY r_name) FROM b JOIN n USING (tag) WHERE b.l_orderkey = o_orderkey), '') AS tags FROM orders")
def j4(t):
    docs = t.orders.select("o_orderkey")
    bridge = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 5).alias("tag")).distinct()
    return R.attach_tags(docs, bridge, t.region.select(F.col("r_regionkey").alias("tag"), "r_name"), "o_orderkey", "tag", "r_name").select("o_orderkey", F.array_join("tags", ",").alias("tags"))


MAP_SQL = """
m AS (SELECT n_nationkey AS position, n_name AS domain, ['DOC-' || (3 * n_nationkey)::VARCHAR, 'DOC-' || (3 * n_nationkey + 1)::VARCHAR] AS prim, ['DOC-' || (3 * n_nationkey + 3)::VARCHAR, 'DOC-' || (n_nationkey + 70)::VARCHAR] AS rel FROM nation),
r AS (SELECT position, domain, 0 AS kind, unnest(prim) AS doc_id, generate_subscripts(prim, 1) AS nth FROM m UNION ALL SELECT position, domain, 1, unnest(rel), generate_subscripts(rel, 1) FROM m),
f AS (SELECT doc_id, arg_min(domain, (position, kind, nth)) AS domain, arg_min(kind, (position, kind, nth)) = 0 AS is_primary FROM r GROUP BY doc_id)"""


def domain_map(t):
    """A domain for each nation, with two primary and two related documents; some are named twice."""
    n = F.col("n_nationkey")
    doc = lambda k, note="": F.concat(F.lit("DOC-"), k.cast("string"), F.lit(note))
    domains = t.nation.select(n.alias("position"), F.col("n_name").alias("domain"), F.lower("n_name").alias("name"), F.lit(" note ").alias("expert_note"), F.array("n_name").alias("keywords"), F.array(doc(3 * n), doc(3 * n + 1, "  # remark")).alias("primary_docs"), F.array(doc(3 * n + 3), doc(n + 70)).alias("related_docs"))
    return R.document_domains(domains)


@query("j5_two_step_lookup", f"""WITH {MAP_SQL}, c AS (SELECT doc_id AS chunk, 'DOC-' || (doc_id % 120)::VARCHAR || CASE doc_id % 4 WHEN 1 THEN 'A' WHEN 2 THEN 'B12' ELSE '' END AS doc FROM documents)
SELECT chunk, doc, coalesce(a.domain, b.domain, '') AS domain, coalesce(lower(a.domain), lower(b.domain), '') AS domain_name, coalesce(a.is_primary, b.is_primary, false) AS is_primary_doc FROM c LEFT JOIN f a ON a.doc_id = doc LEFT JOIN f b ON b.doc_id = regexp_replace(doc, '[A-Z][0-9]*$', '')""")
def j5(t):
    edition = F.when(F.col("doc_id") % 4 == 1, "A").when(F.col("doc_id") % 4 == 2, "B12").otherwise("")
    chunks = t.documents.select(F.col("doc_id").alias("chunk"), F.concat(F.lit("DOC-"), F.col("doc_id") % 120, edition).alias("doc"))
    return R.with_domain(chunks, domain_map(t), "doc")


@query("j6_first_domain_wins", f"WITH {MAP_SQL} SELECT doc_id, domain, lower(domain) AS name, is_primary, 'note' AS expert_note FROM f")
def j6(t):
    return domain_map(t).select("doc_id", "domain", "name", "is_primary", "expert_note")


@query("j11_missing_required", "SELECT o_orderkey, r AS required FROM orders CROSS JOIN (VALUES ('A'), ('N'), ('R')) q(r) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = r)")
def j11(t):
    required = t.orders.select("o_orderkey", F.explode(F.array(*map(F.lit, "ANR"))).alias("required"))
    have = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("required")).distinct()
    return R.missing_required(required, have, ["o_orderkey", "required"])


@query("f4_like_filters", "SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_type), 'tin')) AND p_size > 20")
def f4(t):
    return t.part.filter(R.like_any(["p_name"], "A") | R.like_any(["p_type"], "TIN")).filter("p_size > 20").select("p_partkey", "p_name")


@query("w18_search_limit", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def w18(t):
    return t.part.filter(R.like_any(["p_name"], "a")).orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_name")


@query("j13_blocked", f"WITH {TASKS_SQL} SELECT task_id FROM bl")
def j13(t):
    return R.blocked(tasks(t))


@query("x33_overdue_refresh", f"WITH {TASKS_SQL} SELECT task_id, status, date_diff('day', DATE '1998-01-01', due)::INT AS days_left, status = 'doing' AND date_diff('day', updated, DATE '1998-01-01') > 7 AS stale FROM u")
def x33(t):
    as_of = F.lit(AS_OF).cast("date")
    return tasks(t).select("task_id", "status", F.date_diff("due", as_of).alias("days_left"), ((F.col("status") == "doing") & (F.date_diff(as_of, "updated") > 7)).alias("stale"))


@query("a8_status_counts", f"WITH {TASKS_SQL} SELECT project, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'doing') AS doing, count(*) FILTER (status = 'todo') AS todo, count(*) FILTER (status = 'overdue') AS overdue FROM u GROUP BY project")
def a8(t):
    return tasks(t).groupBy("project").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("done", "doing", "todo", "overdue")])


@query("a9_completion", f"WITH {TASKS_SQL} SELECT project, phase, round(avg(CASE WHEN status = 'done' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM u GROUP BY ALL")
def a9(t):
    return tasks(t).groupBy("project", "phase").agg(F.round(R.completion(F.col("status")), 6).alias("rate"))


@query("a10_by_assignee", f"""WITH {TASKS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY assignee ORDER BY priority, due NULLS FIRST, task_id) AS k FROM u)
SELECT assignee, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'overdue') AS overdue, string_agg(title, ', ' ORDER BY k) FILTER (k <= 3) || CASE WHEN count(*) > 3 THEN ' (+' || (count(*) - 3)::VARCHAR || ')' ELSE '' END AS preview FROM k GROUP BY assignee""")
def a10(t):
    w = Window.partitionBy("assignee").orderBy("priority", "due", "task_id")
    rows = tasks(t)
    # the first three of each are found before the exchange
    first = rows.withColumn("k", F.row_number().over(w)).filter("k <= 3")
    few = first.groupBy(F.col("assignee").alias("who")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "title"))), lambda x: x["title"]), ", ").alias("few"))
    out = rows.groupBy("assignee").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "overdue").alias("overdue"))
    out = out.join(few, F.col("assignee").eqNullSafe(F.col("who"))).drop("who")
    return out.select("assignee", "total", "done", "overdue", F.concat("few", F.when(F.col("total") > 3, F.concat(F.lit(" (+"), (F.col("total") - 3).cast("string"), F.lit(")"))).otherwise("")).alias("preview"))


@query("a13_bottlenecks", f"WITH {TASKS_SQL}, d AS (SELECT unnest(depends_on) AS task_id FROM u WHERE status IN ('todo', 'overdue')) SELECT u.task_id, count(*) AS dependants FROM d JOIN u USING (task_id) WHERE u.status <> 'done' GROUP BY 1")
def a13(t):
    u = tasks(t)
    d = u.filter(F.col("status").isin("todo", "overdue")).select(F.explode("depends_on").alias("task_id")).groupBy("task_id").agg(F.count(F.lit(1)).alias("dependants"))
    return d.join(u.filter("status <> 'done'").select("task_id"), "task_id")


@query("w8_next_actions", f"""WITH {TASKS_SQL} SELECT task_id, row_number() OVER (ORDER BY CASE status WHEN 'overdue' THEN 0 ELSE 1 END, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, coalesce(date_diff('day', DATE '1998-01-01', due), 9999), task_id)::INT AS position
FROM u ANTI JOIN bl USING (task_id) WHERE status IN ('todo', 'overdue') QUALIFY position <= 25""")
def w8(t):
    u = tasks(t)
    rows = u.filter(F.col("status").isin("todo", "overdue")).join(R.blocked(u), "task_id", "left_anti")
    keys = [R.ordinal(F.col("status"), ["overdue", "todo"]), R.ordinal(F.col("priority"), ["high", "medium", "low"]), F.coalesce(F.date_diff("due", F.lit(AS_OF).cast("date")), F.lit(9999)), F.col("task_id")]
    top = rows.orderBy(*keys).limit(25)
    return top.select("task_id", F.row_number().over(Window.orderBy(*keys)).alias("position"))


@query("w9_alerts", f"""WITH {TASKS_SQL}, z AS (SELECT *, date_diff('day', DATE '1998-01-01', due)::INT AS days, date_diff('day', updated, DATE '1998-01-01')::INT AS since FROM u WHERE status <> 'done')
SELECT task_id, 'overdue' AS kind, 'critical' AS level, abs(days) AS days FROM z WHERE status = 'overdue' UNION ALL SELECT task_id, 'due_soon', 'warning', days FROM z WHERE status <> 'overdue' AND days <= 3
UNION ALL SELECT task_id, 'stale', 'warning', since FROM z WHERE status = 'doing' AND since > 7 UNION ALL SELECT task_id, 'blocked', 'info', NULL FROM z JOIN bl USING (task_id) WHERE status <> 'hold'""")
def w9(t):
    return R.alerts(tasks(t), F.lit(AS_OF).cast("date"))


@query("w17_gantt", f"""WITH {TASKS_SQL} SELECT task_id, w::INT AS week, CASE WHEN NOT coalesce(begin_ <= DATE '1998-01-01' + (w * 7 + 6)::INT AND due >= DATE '1998-01-01' + (w * 7)::INT, false) THEN '.' WHEN status = 'done' THEN 'x' WHEN status = 'overdue' THEN '!' ELSE '#' END AS symbol
FROM u CROSS JOIN range(0, 8) r(w) WHERE due IS NOT NULL""")
def w17(t):
    return R.gantt(tasks(t).filter("due is not null"), F.lit(AS_OF).cast("date"), 8)


@query("z19_task_table", f"WITH {TASKS_SQL} SELECT u.task_id, status, bl.task_id IS NOT NULL AS blocked, CASE WHEN due IS NULL THEN '-' WHEN due < DATE '1998-01-01' THEN 'overdue' WHEN due <= DATE '1998-01-04' THEN 'soon' ELSE due::VARCHAR END AS due_text FROM u LEFT JOIN bl USING (task_id) WHERE status IN ('doing', 'todo')")
def z19(t):
    u = tasks(t)
    rows = u.filter("status in ('doing', 'todo')").join(R.blocked(u).withColumn("b", F.lit(True)), "task_id", "left")
    text = F.when(F.col("due").isNull(), "-").when(F.col("due") < AS_OF, "overdue").when(F.col("due") <= "1998-01-04", "soon").otherwise(F.col("due").cast("string"))
    return rows.select("task_id", "status", F.coalesce("b", F.lit(False)).alias("blocked"), text.alias("due_text"))


@query("z20_kanban", f"WITH {TASKS_SQL} SELECT project, status, task_id, count(*) OVER (PARTITION BY project, status) AS n FROM u")
def z20(t):
    """A card for each task, with the number of cards in its column; columns are never gathered."""
    own = tasks(t).select("project", "status", "task_id")
    return own.join(own.groupBy("project", "status").agg(F.count(F.lit(1)).alias("n")), ["project", "status"])


@query("z21_task_log", "SELECT user_id, event_type AS status, ts AS updated FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def z21(t):
    return R.latest(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("status"), F.col("ts").alias("updated"))


@query("z25_template", "SELECT n_nationkey, n_regionkey, DATE '2024-01-01' + (n_nationkey * 3)::INT AS due, coalesce(r_name, 'nobody') AS assignee, lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS depends_on FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey")
def z25(t):
    rows = t.nation.join(small(t.region.filter("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")), "n_regionkey", "left")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return rows.select("n_nationkey", "n_regionkey", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_nationkey") * 3).cast("int")).alias("due"), F.coalesce("r_name", F.lit("nobody")).alias("assignee"), F.lag("n_nationkey").over(w).alias("depends_on"))


@query("g10_dependency_chain", f"WITH {TASKS_SQL} SELECT task_id, lag(task_id) OVER (PARTITION BY project, phase ORDER BY task_id) AS depends_on FROM u")
def g10(t):
    rows = tasks(t).select("task_id", "project", "phase")
    return ranking.neighbours(rows, ["project", "phase"], ["task_id"], F.col("task_id"), "depends_on").select("task_id", "depends_on")


@query("j14_resolve_titles", f"WITH {TASKS_SQL}, n AS (SELECT title, max(task_id) AS id FROM u GROUP BY title), d AS (SELECT task_id, unnest(['task ' || (task_id - 1)::VARCHAR, 'unknown ' || task_id::VARCHAR]) AS want FROM u) SELECT d.task_id, coalesce(n.id::VARCHAR, want) AS resolved FROM d LEFT JOIN n ON n.title = want")
def j14(t):
    u = tasks(t)
    names = u.groupBy("title").agg(F.max("task_id").alias("id"))
    want = u.select("task_id", F.explode(F.array(F.concat(F.lit("task "), (F.col("task_id") - 1).cast("string")), F.concat(F.lit("unknown "), F.col("task_id").cast("string")))).alias("title"))
    return want.join(names, "title", "left").select("task_id", F.coalesce(F.col("id").cast("string"), "title").alias("resolved"))


@query("z1_document_detail", f"WITH v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in ORDER)}) AS k FROM lineitem) SELECT o_orderkey, o_totalprice, l_linenumber, l_partkey FROM orders LEFT JOIN v ON o_orderkey = l_orderkey AND k = 1")
def z1(t):
    docs = t.orders
    last = R.latest(t.lineitem, ["l_orderkey"], ORDER)
    return docs.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_totalprice", "l_linenumber", "l_partkey")


@query("z2_links_newest_first", "SELECT l_orderkey, l_suppkey, max(l_shipdate) AS linked FROM lineitem GROUP BY ALL ORDER BY linked DESC, l_orderkey, l_suppkey")
def z2(t):
    return t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_shipdate").alias("linked")).orderBy(F.desc("linked"), "l_orderkey", "l_suppkey")


@query("z26_newest_plans", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def z26(t):
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey", "o_orderdate")


@query("z27_best_of_n", "SELECT l_orderkey, arg_min(l_linenumber, (-x, l_linenumber)) AS best FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def z27(t):
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("x"))
    return rows.groupBy("l_orderkey").agg(F.min(F.struct(-F.col("x"), "l_linenumber"))["l_linenumber"].alias("best"))
