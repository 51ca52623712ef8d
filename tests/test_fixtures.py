"""Small inputs with results worked out by hand or restated independently."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import diff, expand, graph, ranking, records, search, segment, threads


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


def test_reciprocal_rank_fusion(spark):
    rows = [(1, "a", i + 1, c) for i, c in enumerate("ABC")] + [(1, "b", i + 1, c) for i, c in enumerate("BAD")]
    out = search.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id int, list string, rank int, chunk_id string"))
    assert {r["chunk_id"]: round(r["rrf"], 6) for r in out.collect()} == {"A": 0.032522, "B": 0.032522, "C": 0.015873, "D": 0.015873}


def test_weighted_fusion(spark):
    hits = [("bm25", 1, "c1", 10.0), ("bm25", 1, "c2", 5.0), ("synonym", 1, "c2", 8.0), ("synonym", 1, "c3", 4.0), ("vector", 1, "c1", 0.6), ("vector", 1, "c4", 0.5), ("cross_ref", 1, "c3", 3.0), ("cross_ref", 2, "c5", 2.0), ("cross_ref", 2, "c3", 1.0)]
    out = search.weighted_fusion(spark.createDataFrame([(1, *h) for h in hits], "query_id int, method string, batch int, chunk_id string, score double"))
    got = {r["chunk_id"]: (round(r["score"], 6), r["methods"]) for r in out.collect()}
    assert got == {"c1": (1.27, ["bm25", "vector"]), "c2": (0.9, ["bm25", "synonym"]), "c3": (0.65, ["synonym", "cross_ref"]), "c5": (0.5, ["cross_ref"]), "c4": (0.45, ["vector"])}


CORPUS = [("d1", ["熱", "制御", "熱"]), ("d2", ["構造"]), ("d3", ["熱", "試験"]), ("d4", ["電源", "試験"])]


def test_bm25_plus_one(spark):
    chunks = spark.createDataFrame(CORPUS, "chunk_id string, tokens array<string>")
    q = spark.createDataFrame([(1, ["熱", "試験"])], "query_id int, terms array<string>")
    got = {r["chunk_id"]: round(r["score"], 6) for r in search.bm25_plus_one(chunks, q).collect()}
    assert got == {"d3": 1.386294, "d1": 0.853104, "d4": 0.693147, "d2": 0.0}


def test_bm25_okapi(spark):
    chunks = spark.createDataFrame(CORPUS, "chunk_id string, tokens array<string>")
    q = spark.createDataFrame([(1, ["構造"]), (2, ["熱"])], "query_id int, terms array<string>")
    assert [(r["query_id"], r["chunk_id"], round(r["score"], 6)) for r in search.bm25_okapi(chunks, q).collect()] == [(1, "d2", 1.093288)]


@pytest.mark.parametrize("q, d, want", [("熱制御 温度 DTR", "熱制御システムの温度要件", 0.333333), ("熱制御 温度 DTR", "DTRの定義と適用", 0.222222), ("abc", "xabx", 0.5), ("a", "abc", 0.0)])
def test_pair_overlap(spark, q, d, want):
    assert round(one(spark, search.pair_overlap(F.col("q"), F.col("d")), q=q, d=d), 6) == want


def test_detect_domains(spark):
    domains = spark.createDataFrame([("thermal", 4, ["熱制御", "温度"]), ("aocs", 3, ["制御"])], "domain string, specificity int, keywords array<string>")
    out = expand.detect_domains(spark.createDataFrame([(1, "熱制御")], "query_id int, text string"), domains)
    assert {r["domain"]: r["score"] for r in out.collect()} == {"thermal": 7.6, "aocs": 0.16}


def test_tokens(spark):
    assert one(spark, X.mixed_tokens(F.col("x")), x="熱制御 DTR 5度 A1") == ["熱制", "制御", "dtr", "5", "度", "a1"]


@pytest.mark.parametrize("x, a, b", [("熱制御 TCS", 5, 11), ("hello world", 3, 6), ("", 0, 0), ("éa", 1, 4)])
def test_token_estimates(spark, x, a, b):
    assert one(spark, X.estimate_tokens(F.col("x")), x=x) == a
    assert one(spark, X.estimate_message_tokens(F.col("x")), x=x) == b


def test_greedy_chunks():
    assert list(segment.greedy_chunks("ああああ。いいいい。うううう。\nええ", 10, 3)) == ["ああああ。いいいい。", "いい。うううう。ええ"]


def test_overlapping_pieces_end():
    out = list(segment.overlapping_pieces("aaaaa。\n" + "b" * 1000))
    assert out[-1].endswith("b") and len(out) < 20


def test_sections():
    text = "1. 総則\nこの文書は熱制御の設計について定めるものである。\n1.1 目的\nここに目的を書く。これは長い本文である。\n1.1.1.1 細目\n短い。\n(2) 備考\nこれは備考であり、十分に長い文である。はい。\n第3章　運用\n" + "運" * 30
    assert [(n, t, d) for n, t, d, _, _ in segment.sections(text)] == [("1", "総則", 1), ("1.1", "目的", 2), ("2", "備考", 3), ("3", "運用", 1)]
    assert all(own.startswith(text[start : start + 3]) for _, _, _, start, own in segment.sections(text))
    assert list(segment.sections("1. " + "x" * 101 + "\nno heading")) == []
    # a title may stand on the next line, and hides a heading of its own kind there, but not of another
    assert [(n, t) for n, t, *_ in segment.sections("1.\n2. " + "y" * 30 + "\n3. " + "z" * 30)] == [("1", "2. " + "y" * 30), ("3", "z" * 30)]
    assert [n for n, *_ in segment.sections("1.\n2.1 " + "y" * 30 + "\n")] == ["2.1"]


def test_structure():
    text = "3 概要\n本文\n3.2 安全管理\n本文\n3.2.4 緊急時対応手順\n本文\n目次 ..... 3\n3.3 続き …… 4\n第 4 章 運用\n（2） 備考\nend"
    out = list(segment.structure(text))
    assert [(i, t, n, p) for i, t, n, p, _, _ in out] == [("3", "概要", 1, ""), ("3.2", "安全管理", 2, "3"), ("3.2.4", "緊急時対応手順", 3, "3.2"), ("3.3", "続き …… 4", 2, "3"), ("第 4 章", "運用", 1, ""), ("2", "備考", 1, "")]
    assert out[2][4] == "3 概要 > 3.2 安全管理 > 3.2.4 緊急時対応手順" and out[0][5] == "3 概要\n本文" and out[-1][5] == "（2） 備考\nend"
    assert list(segment.structure(" plain text ")) == [("1", "本文", 1, "", "1 本文", "plain text")]
    assert [i for i, *_ in segment.structure("1.1 Scope ........ 3\n1.2 Real one\n")] == ["1.2"]


def test_section_chunks(spark):
    long = "。".join("文" * 60 for _ in range(40)) + "。"
    text = "1.1 Scope\n\n" + "a" * 700 + "\n\n第2章 運用\n\n" + long + "\n\n- 12 -\n\n" + "b" * 60
    out = segment.section_chunks(spark.createDataFrame([(7, text), (8, "short"), (9, None)], "doc_id long, text string")).orderBy("chunk_idx").collect()
    assert {r["doc_id"] for r in out} == {7} and [r["chunk_idx"] for r in out] == list(range(len(out)))
    assert out[0]["section"] == "第2章 運用" and out[0]["text"].startswith("1.1 Scope\naaa") and out[0]["language"] == "en" and out[1]["language"] == "ja"
    assert all(r["chunk_id"] == f"7_{r['chunk_idx']}_{hashlib.md5(r['text'][:100].encode()).hexdigest()[:6]}" for r in out)
    assert "- 12 -" not in "".join(r["text"] for r in out) and out[-1]["text"].endswith("b" * 60)
    assert all(len(r["text"]) <= 800 + 130 for r in out)


def test_line_differences(spark):
    old = "マニフェストNo: A-001\n廃棄物種類: 廃プラスチック\n数量: 100kg\n"
    new = "マニフェストNo: A-001\n廃棄物種類: 廃プラスチック\n数量: 150kg\n処理方法: 焼却\n"
    d = one(spark, diff.line_diff(F.col("a"), F.col("b")), a=old, b=new)
    assert (d["added"], d["removed"]) == (["数量: 150kg", "処理方法: 焼却"], ["数量: 100kg"]) and round(d["ratio"], 6) == round(4 / 7, 6)
    assert d["changed"] == ["[変更] 旧: 数量: 100kg → 新: 数量: 150kg / 処理方法: 焼却"]
    assert d["summary"] == "追加 2 行 / 削除 1 行 / 類似度 57.1%\n主な変更点:\n[変更] 旧: 数量: 100kg → 新: 数量: 150kg / 処理方法: 焼却"
    assert one(spark, diff.line_diff(F.lit("x\ny"), F.lit("x\ny")))["summary"] == "変更なし / 類似度 100.0%"
    assert one(spark, diff.line_diff(F.lit(None).cast("string"), F.lit("x")))["added"] == ["x"]
    assert one(spark, diff.unified_diff(F.lit("a\nb\n"), F.lit("a\nc\n"))) == "--- 旧バージョン\n+++ 新バージョン\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n"
    many = diff.differences("\n".join(f"k{i}\nx{i}" for i in range(8)), "\n".join(f"k{i}\ny{i}" for i in range(8)))
    assert many["summary"].endswith("... 他 3 件") and len(many["changed"]) == 8


def test_alerts(spark):
    day = lambda n: dt.date(2024, 1, 10) + dt.timedelta(days=n)
    rows = [(1, "overdue", day(-2), day(0), []), (2, "todo", day(3), day(0), [1]), (3, "doing", None, day(-8), []), (4, "hold", day(-1), day(-30), [1]), (5, "done", day(-5), day(-30), [1]), (6, "todo", day(4), day(0), [5, 99])]
    out = records.alerts(spark.createDataFrame(rows, "task_id int, status string, due date, updated date, depends_on array<int>"), F.lit(day(0)))
    assert sorted(tuple(r)[:3] for r in out.collect()) == [(1, "overdue", "critical"), (2, "blocked", "info"), (2, "due_soon", "warning"), (3, "stale", "warning"), (4, "due_soon", "warning")]


def test_latest(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, None), (2, 5, "c")], "k int, at int, v string")
    assert sorted(map(tuple, records.latest(log, ["k"], ["at"]).collect())) == [(1, 3, "b"), (2, 5, "c")]


def test_overlapping_pieces_against_plain_search():
    def plain(text, size, overlap):
        start = 0
        while start < len(text):
            end = min(start + size, len(text))
            if end < len(text):
                for b in segment.BOUNDARIES:
                    at = max((k for k in range(start, end) if text.startswith(b, k) and k + len(b) <= end), default=-1)
                    if at >= 0 and at + len(b) - overlap > start:
                        end = at + len(b)
                        break
            if text[start:end].strip():
                yield text[start:end].strip()
            if end >= len(text):
                return
            start = max(end - overlap, start + 1)

    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab。。\n、") for _ in range(rng.randint(0, 300)))
        assert list(segment.overlapping_pieces(text, 40, 7)) == list(plain(text, 40, 7))


def test_ids(spark):
    assert one(spark, segment.section_id(F.lit("doc"))) == "sec_5118e2d6"
    assert one(spark, X.entity_id(F.lit("ISO 9001"))) == "c9beaf3aa07f"
    assert one(spark, X.fingerprint(F.lit(" A  b\n"))) == "0cc9cd4dd26c5137b675a0d819cb9ab0"
    assert one(spark, X.dedup_key(F.lit(" A  b\n"))) == "b5cf57e329bd2a219a57cd31692c2d69"


VERSIONS = [
    ("マニフェストv3.pdf", "v3"), ("申請書_rev2_20240115.docx", "rev2"), ("許可証_2024-03-01.pdf", "2024-03-01"), ("誓約書_最終.pdf", "最終"), ("内部稟議書(2).xlsx", "2"), ("受領通知書_第3版.docx", "第3版"), ("稟議書.pdf", "1.0"),
    ("plan-final.docx", "最終"), ("計画_確定.pdf", "最終"), ("Rev.4_v2.pdf", "rev4"), ("規程第12改定.doc", "第12版"), ("plan_20240115.pdf", "1.0"), ("note_2.1.pdf", "2"), ("final.pdf", "1.0"), ("dir.v2/plan.pdf", "1.0"), ("2024_03_01", "2024_03_01"),
]


@pytest.mark.parametrize("name, want", VERSIONS)
def test_version_mark(spark, name, want):
    assert one(spark, X.version_mark(F.col("x")), x=name) == want


@pytest.mark.parametrize("x, body, quoted", [
    ("> a\nb", "", "> a\nb"), ("よろしく\n\n> a", "よろしく", "> a"), ("a\n--\nA. Writer", "a", "--\nA. Writer"), ("a\n-----Original message-----\nb", "a", "-----Original message-----\nb"),
    ("a\n__\nb", "a\n__\nb", ""), ("a\n___\nb", "a", "___\nb"), ("a On Monday wrote:", "a On Monday wrote:", ""), ("a\nOn Monday B wrote:\n", "a", "On Monday B wrote:"), ("a\nFw: 転送メッセージ x", "a", "Fw: 転送メッセージ x"),
    ("a\n2024/01/02 10:00 Bのメッセージ:\nb", "a", "2024/01/02 10:00 Bのメッセージ:\nb"), ("no quote", "no quote", ""),
])
def test_split_quote(spark, x, body, quoted):
    assert tuple(one(spark, X.split_quote(F.col("x")), x=x)) == (body, quoted)


@pytest.mark.parametrize("x, want, status", [
    ("手配いたしました。また、来週確認します。", (True, False, False, True), "done"), ("確認しました", (True, False, False, False), "done"), ("確認中です", (False, False, True, False), "waiting"),
    ("対応できません。検討中", (False, True, True, False), "cancelled"), ("確認をお願いします?", (False, False, False, False), None),
])
def test_status_signals(spark, x, want, status):
    found = X.signals(F.col("x"))
    assert tuple(one(spark, found, x=x)) == want and one(spark, X.status_of(found), x=x) == status


def test_entities(spark):
    e = one(spark, X.entities(F.col("x")), x="JAXAのNASA, ESA: TCS A1 AB_C ISO 9001-2 JIS B 8265。「熱制御」とは、温度を保つことをいう。 MIL-STD-1553B ECSS-E-ST-31 JERG-2-310-HB3")
    assert e["organizations"] == ["ESA", "ISO 9001", "JAXA", "JIS B 8265", "NASA"] and e["abbreviations"] == ["ECSS", "ESA", "ISO", "JERG", "JIS", "MIL", "ST", "STD", "TCS"]
    assert e["regulations"] == ["ECSS-E-ST-31", "ISO 9001-2", "JERG-2-310-HB3", "MIL-STD-1553B"] and [tuple(d) for d in e["defined_terms"]] == [("熱制御", "は、温度を保つこと")]
    named = one(spark, X.named_entities(F.col("x")), x="3.2.1　熱制御の設計 \nと JERG-2-310準拠 ISO9001。" + "x" * 500 + " 4.1 見出しではない")
    assert [(n["type"], n["name"], n["description"]) for n in named] == [("CONCEPT", "3.2.1 熱制御の設計", "セクション: 3.2.1 熱制御の設計"), ("STANDARD", "JERG-2-310準拠", "規格文書: JERG-2-310準拠"), ("STANDARD", "ISO9001", "規格文書: ISO9001")]


@pytest.mark.parametrize("x, want", [("JERG-2-310A\n 24 \nx\n7\n", 24), ("a\n12\nb", 12), ("a\n1200\n7\n", None), (" 12\n", None), ("a", None), ("x\n0", None), ("JERG-2-310\n２４\n", 24)])
def test_page_number(spark, x, want):
    assert one(spark, X.page_number(F.col("x")), x=x) == want


def test_context_and_summaries(spark):
    f = lambda c, x: one(spark, c(F.col("x")), x=x)
    assert f(X.context_prefix, "序\n3.1 熱制御\n本文") == "このチャンクはセクション 3.1 「熱制御」に関する内容です。"
    assert f(X.context_prefix, "温度を保つ。次の文") == "このチャンクは「温度を保つ」に関する内容を含みます。"
    assert f(X.brief_summary, "x" * 90) == "x" * 80 + "..." and f(X.brief_summary, "abcdef\nab\nghijkl ......\nmnopqr") == "abcdef mnopqr"
    assert f(X.short_or_brief, "y" * 99) == "y" * 50 and f(X.short_or_brief, "y" * 100) == "y" * 80 + "..."
    assert f(X.rule_keywords, "ISO9001準拠の 5 kg と 3.5V、90 MHz、12 cm、MIL STD") == ["3.5V", "5 kg", "90 MHz", "ISO9001準拠の", "MIL STD"]
    assert f(X.session_title, " 熱\n制御 ") == "熱 制御" and f(X.session_title, "z" * 51) == "z" * 50 + "..."
    assert one(spark, X.session_title(F.lit(None).cast("string"))) == "無題セッション"
    assert f(X.estimate_message_tokens, "。ＴＣＳ") == 12 and f(X.estimate_message_tokens, "é") == 4


def test_html_markdown(spark):
    html = "<html><style>a{}</style><h1 class='x'>T</h1><p>a <b>b</b> <em>c</em> <a href=\"u\">l</a></p><ul><li>i</li></ul><pre><code>x</code></pre><br/>&lt;&quot;&#39;&nbsp;&amp;"
    assert one(spark, X.html_markdown(F.col("x")), x=html) == "# T\na **b** *c* [l](u)\n- i```\n`x`\n```\n<\"' &"


@pytest.mark.parametrize("x, want", [("3月15日まで", "2024-03-15 00:00"), ("3月1日", "2025-03-01 00:00"), ("明日", "2024-03-14 17:00"), ("今週中", "2024-03-15 17:00"), ("来週金曜", "2024-03-22 17:00"), ("月末", "2024-03-31 17:00"), ("来月末", "2024-04-30 17:00"), ("3日以内", "2024-03-16 10:00"), ("2024年5月6日", "2024-05-06 00:00")])
def test_deadline(spark, x, want):
    now = F.lit("2024-03-13 10:00:00").cast("timestamp_ntz")
    assert one(spark, X.deadline(F.col("x"), now), x=x) == dt.datetime.fromisoformat(want)


@pytest.mark.parametrize("days, want", [(-1, "expired"), (0, "today"), (7, "critical"), (30, "warning"), (31, "info")])
def test_expiry(spark, days, want):
    assert one(spark, X.expiry_label(F.col("d")), d=days) == want


def test_blocked(spark):
    rows = [("t1", [], "done"), ("t2", ["t1"], "todo"), ("t3", ["t2"], "todo"), ("t4", ["missing"], "todo")]
    assert [r[0] for r in records.blocked(spark.createDataFrame(rows, "task_id string, depends_on array<string>, status string")).collect()] == ["t3"]


def test_threads(spark):
    rows = [("m1", None, []), ("m2", "m1", []), ("m3", None, ["x", "m2"]), ("m4", "unknown", [])]
    out = threads.resolve_threads(spark.createDataFrame(rows, "message_id string, in_reply_to string, references array<string>"))
    assert {r["message_id"]: r["root"] for r in out.collect()} == {"m1": "m1", "m2": "m1", "m3": "m1", "m4": "m4"}


def test_reply_gaps(spark):
    rows = [("a", dt.datetime(2024, 1, 1, h)) for h in (0, 2, 2, 5)] + [("b", dt.datetime(2024, 1, 1))]
    out = threads.mean_reply_hours(spark.createDataFrame(rows, "thread string, at timestamp_ntz"))
    assert {r[0]: r[1] for r in out.collect()} == {"a": 2.5, "b": None}


def test_levels_with_cycle(spark):
    tasks = spark.createDataFrame([(c,) for c in "abcd"], "task string")
    depends = spark.createDataFrame([("b", "a"), ("c", "d"), ("d", "c"), ("b", "zz")], "task string, on string")
    assert {r[0]: r[1] for r in graph.levels(tasks, depends).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_plans_do_not_multiply(spark, data):
    """A search reads texts once, for postings; what is left reads those and multiplies nothing."""
    from lexweave import registry

    plan = registry.queries()["r1_bm25_okapi"](spark, data)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "text:string" not in plan


def test_postings(spark):
    chunks = spark.createDataFrame([("a", ["x", "y", "x", "z", "x"]), ("b", []), ("c", ["y"])], "k string, tokens array<string>")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    few = [("a", 5, None, None), ("a", 5, "x", 3), ("b", 0, None, None), ("c", 1, None, None)]
    asked = spark.createDataFrame([(1, ["x", "q"]), (2, ["x"])], "query_id int, terms array<string>")
    posted = search.postings(chunks, asked, "k", few=search._few_terms(asked))
    assert rows(posted) == sorted(few, key=repr)
    many = asked.unionByName(spark.range(2100).selectExpr("3 as query_id", "array(concat('t', id)) as terms"))
    assert search._few_terms(many) is None and rows(search.postings(chunks, many, "k")) == sorted(few, key=repr)
    terms, sizes = search.vocabulary(chunks)
    assert rows(terms) == [("x", 1), ("y", 2), ("z", 1)] and tuple(sizes.first()) == (3, 2, 6)
    assert search.corpus_statistics(posted).first()["avgdl"] == 3.0
    assert rows(search.vocabulary(chunks.limit(0))[0]) == []


@pytest.mark.parametrize("kind", ["each", "product", "zero"])
@pytest.mark.parametrize("block", [None, 60])
def test_vector_search_in_blocks(spark, kind, block):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(120)] + [(500, None), (501, [1.0])]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(i, x) for i, x in rows[:30]], "query_id int, q array<double>")
    plain = v.filter("size(embedding) = 4").crossJoin(q).select("query_id", "vec_id", search.cosine(F.col("embedding"), F.col("q"), kind).alias("score")).filter("score >= 0.2")
    want = sorted((r["query_id"], r["vec_id"], r["rank"], round(r["score"], 9)) for r in search.top_k(plain.withColumn("score", F.round("score", 12)), 7, "vec_id").collect())
    got = search.vector_search(v, q, 7, kind=kind, threshold=0.2, block=block).collect()
    assert [x[3] for x in sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got)] == [x[3] for x in sorted((a, c, b, d) for a, b, c, d in want)]
    assert {(r["query_id"], r["rank"]) for r in got} == {(a, c) for a, _, c, _ in want}


def test_dimension(spark):
    from lexweave.operators import dimension

    assert "broadcast" in dimension.small(spark.createDataFrame([(1, "x")], "k int, v string"))._jdf.queryExecution().analyzed().toString().lower()
    wide = spark.range(100).selectExpr("id", "repeat('x', 400000) as v")
    assert "broadcast" not in dimension.small(wide)._jdf.queryExecution().analyzed().toString().lower()


def test_contained_by_index(spark):
    texts = spark.createDataFrame([(1, "see the long title here"), (2, "ab"), (3, ""), (4, None), (5, "the long ti")], "k int, text string")
    terms = spark.createDataFrame([("the long title",), ("ab",), ("b",), ("",), (None,), ("zz",)], "term string")
    assert sorted((r["k"], r["term"]) for r in expand.contained_by_index(texts, terms, ["k"]).collect()) == [(1, "the long title"), (2, "ab"), (2, "b")]
    assert expand.contained_by_index(texts, terms.limit(0), ["k"]).count() == 0


def test_pagerank_converges(spark):
    """Against a plain power iteration to the same tolerance."""
    rng = random.Random(5)
    edges = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(60)})
    nodes = range(32)
    rank = dict.fromkeys(nodes, 1 / 32)
    while True:
        lost = sum(rank[v] for v in nodes if not any(a == v for a, _ in edges))
        new = {v: 0.15 / 32 + 0.85 * (lost / 32 + sum(rank[a] / sum(x == a for x, _ in edges) for a, b in edges if b == v)) for v in nodes}
        change = sum(abs(new[v] - rank[v]) for v in nodes)
        rank = new
        if change < 32e-6:
            break
    got = graph.pagerank(spark.createDataFrame(edges, "`from` int, `to` int"), spark.createDataFrame([(v,) for v in nodes], "node int"))
    assert all(abs(r["rank"] - rank[r["node"]]) < 1e-9 for r in got.collect()) and abs(sum(rank.values()) - 1) < 1e-9
    early = graph.pagerank(spark.createDataFrame(edges, "`from` int, `to` int"), spark.createDataFrame([(v,) for v in nodes], "node int"), rounds=1)
    assert max(abs(r["rank"] - rank[r["node"]]) for r in early.collect()) > 1e-4


def in_groups(seed, n=300):
    """(g, o, v): one group holds most rows, one is null, and values may be null."""
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 6 + ["a", "b", None]), o, rng.choice([None, *range(9)])) for o in rng.sample(range(10 * n), n)]


def by_group(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("n,large", [(0, 0), (1, 0), (300, 0), (300, 50), (300, 100_000)])
def test_places_in_groups(spark, monkeypatch, n, large):
    """By windows alone, by ranges alone, and by ranges for the large group only."""
    monkeypatch.setattr(ranking, "LARGE", large)
    rows = in_groups(3, n)
    df = spark.createDataFrame(rows, "g string, o int, v int")
    v = F.col("v")
    want_number, want_total, want_near, want_large = set(), set(), set(), set()
    for own in by_group(rows).values():
        for i, (g, o, x) in enumerate(own):
            upto, before = [r[2] for r in own[: i + 1] if r[2] is not None], [r[2] for r in own[:i] if r[2] is not None]
            want_number.add((g, o, x, i + 1, len(own)))
            want_total.add((g, o, x, sum(upto) if upto else None))
            want_near.add((g, o, x, own[i - 1][2] if i else None, own[i + 1][2] if i + 1 < len(own) else None))
            want_large.add((g, o, x, max(before) if before else None))
    assert {tuple(r) for r in ranking.numbered(df, ["g"], ["o"], size="size").collect()} == want_number
    assert {tuple(r) for r in ranking.running_total(df, ["g"], ["o"], v).collect()} == want_total
    assert {tuple(r) for r in ranking.neighbours(df, ["g"], ["o"], v).collect()} == want_near
    assert {tuple(r) for r in ranking.earlier_largest(df, ["g"], ["o"], {"m": v}).collect()} == want_large
    assert sorted(r["k"] for r in ranking.numbered(df, [], ["o"]).collect()) == list(range(1, n + 1))
