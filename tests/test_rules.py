"""Cases worked by hand from the specified rules, not from the engine's SQL."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import dataset, diff, glossary, guided, records, segment, threads


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_greedy_chunks_repeat_only_the_tail_of_longer_ones():
    long = "長" * 798 + "。"
    # the first chunk is no longer than the overlap, so nothing of it is repeated
    assert list(segment.greedy_chunks("短い。" + long)) == ["短い。", long]
    # a chunk of more than the overlap gives its last characters
    out = list(segment.greedy_chunks("あ" * 149 + "。" + "い" * 699 + "。"))
    assert out == ["あ" * 149 + "。", "あ" * 99 + "。" + "い" * 699 + "。"]
    assert list(segment.greedy_chunks(" \n \n")) == []
    assert list(segment.greedy_chunks("x" * 2000)) == ["x" * 2000]


def test_paragraph_chunks():
    a, b, c = "a" * 500, "b" * 290, "c" * 60
    # the line feed between paragraphs is not counted for the paragraph that is added
    assert [t for _, t in segment.paragraph_chunks(f"{a}\n\n{b}\n\n{c}")] == [f"{a}\n{b}", f"{b[-128:]}\n{c}"]
    # a heading that closes a chunk names it
    assert [s for s, _ in segment.paragraph_chunks(f"{'x' * 790}\n\n2.1 Next part\n\n{'y' * 100}")] == ["2.1 Next part", "2.1 Next part"]
    sentences = ("s" * 399 + "。") * 5
    assert [len(t) for _, t in segment.paragraph_chunks(sentences)] == [800, 128 + 1 + 800, 128 + 1 + 400]


def test_child_chunks(spark):
    rows = [("d_0", "1", 1, ["d", "1 A"], "短い。" * 10), ("d_1", "1.1", 2, ["d", "1 A", "1.1 B"], "文。" * 250), ("d_2", "2", 1, ["d", "2 C"], "y" * 400), ("d_3", "3", 1, ["d"], None)]
    out = segment.child_chunks(spark.createDataFrame(rows, "chunk_id string, number string, depth int, hierarchy array<string>, text string")).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["parent_id"], r["section_number"], r["depth"], r["hierarchy"][-1], len(r["text"])) for r in out] == [("d_1_child_0", "d_1", "1.1.1", 3, "段落 1", 400), ("d_1_child_1", "d_1", "1.1.2", 3, "段落 2", 150)]
    assert out[0]["hierarchy"][:3] == ["d", "1 A", "1.1 B"]


def test_outline(spark):
    rows = [("d", 0, "1", "A", 1, ""), ("d", 1, "1.1", "B", 2, ""), ("d", 2, "1.1.1", "C", 3, ""), ("d", 3, "2", "D", 1, ""), ("d", 4, "(1)", "E", 3, ""), ("e", 0, "1.1", "F", 2, "")]
    out = {r["chunk_id"]: (r["parent_id"], r["hierarchy"]) for r in segment.outlined(spark.createDataFrame(rows, "doc_id string, pos int, number string, title string, depth int, text string")).collect()}
    assert out == {
        "d_0": ("d", ["d", "1 A"]),
        "d_1": ("d_0", ["d", "1 A", "1.1 B"]),
        "d_2": ("d_1", ["d", "1 A", "1.1 B", "1.1.1 C"]),
        "d_3": ("d", ["d", "2 D"]),
        "d_4": ("d_3", ["d", "2 D", "(1) E"]),
        "e_0": ("e", ["e", "1.1 F"]),
    }


@pytest.mark.parametrize(
    "mail,out",
    [
        ("お世話になっております。 ＡＢＣ１２３", "ABC123"),
        ("いつもお世話になっております。\n本文", "いつも本文"),
        ("表の件\n\n\n\nご確認のほど、よろしくお願いいたします。\n", "表の件\n\n【確認依頼】"),
        ("ご対応よろしくお願い申し上げます", "【対応依頼】"),
        ("本文\n以上、よろしくお願いいたします。\n署名", "本文\n\n署名"),
        ("本文\n何卒よろしくお願いいたします。 \n", "本文"),
        (None, None),
    ],
)
def test_mail_is_normalised(spark, mail, out):
    assert one(spark, diff.normalise_mail(F.lit(mail).cast("string"))) == out


def test_plan(spark):
    text = "GOAL: one\nSUCCESS_CRITERIA: all done\nSTEPS:\n1. look | SEARCH: heat | EXPECT: a list\n2) read it | search: None\n- tell | Expect: text | SEARCH: a | SEARCH: none\nGOAL: two\nremark"
    p = one(spark, glossary.parse_plan(F.lit(text)))
    assert (p["goal"], p["success_criteria"]) == ("two", "all done")
    assert [tuple(s) for s in p["steps"]] == [("look", "heat", "a list"), ("read it", None, ""), ("tell", "a", "text")]
    assert one(spark, glossary.parse_plan(F.lit("1. no section")))["steps"] == []


def test_enhanced_query(spark):
    abbr = spark.createDataFrame([(2, "TCS", "Thermal Control"), (1, "MLI", "Multi Layer")], "position int, abbr string, full string")
    terms = spark.createDataFrame([(1, "熱制御", "thermal control", "TCS", ["heat"]), (2, "熱", "Thermal", None, []), (3, "熱設計", "thermal design", None, [])], "position int, name string, english string, abbr string, synonyms array<string>")
    asked = spark.createDataFrame([(1, "MLI と TCS"), (2, "熱"), (3, "tcs"), (4, "HEAT"), (5, "")], "query_id int, text string")
    out = {r["query_id"]: r["enhanced"] for r in glossary.enhance(asked, abbr, terms).collect()}
    # of the first two terms the second is in the text already when it is its turn; the third is never looked at
    assert out == {1: "MLI と TCS MLI: Multi Layer; TCS: Thermal Control", 2: "熱 thermal control", 3: "tcs thermal control", 4: "HEAT thermal control", 5: ""}


def test_domain_map(spark):
    d = [(1, "b", None, " note ", ["k"], ["X-1  # remark"], ["X-2", "X-3"]), (2, "a", "A", None, ["k"], ["X-2", "X-4"], None)]
    docs = records.document_domains(spark.createDataFrame(d, "position int, domain string, name string, expert_note string, keywords array<string>, primary_docs array<string>, related_docs array<string>"))
    assert {(r["doc_id"], r["domain"], r["name"], r["is_primary"]) for r in docs.collect()} == {("X-1", "b", "b", True), ("X-2", "b", "b", False), ("X-3", "b", "b", False), ("X-4", "a", "A", True)}
    chunks = spark.createDataFrame([("X-1",), ("X-1F",), ("X-4B12",), ("X-9",), (None,)], "doc_id string")
    assert {(r["doc_id"], r["domain"], r["domain_name"], r["is_primary_doc"]) for r in records.with_domain(chunks, docs).collect()} == {("X-1", "b", "b", True), ("X-1F", "b", "b", True), ("X-4B12", "a", "A", True), ("X-9", "", "", False), (None, "", "", False)}


def test_related_tasks(spark):
    tasks = spark.createDataFrame([(1, "t1", "Heat report", "pending"), (2, "t1", "Other", "done"), (3, "t2", "heat plan", "cancelled"), (4, None, "Heat plan", "waiting")], "task_id int, thread string, title string, status string")
    replies = spark.createDataFrame([(1, "t1", "Re: plan"), (2, "t2", "RE: FW: Heat"), (3, None, "Fwd:plan of heat"), (4, "t9", None)], "reply int, thread string, subject string")
    out = threads.related_tasks(replies, tasks)
    assert {(r["reply"], r["task_id"]) for r in out.collect()} == {(1, 1), (2, 1), (2, 4), (3, 4)}


def test_memory_context(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    line = lambda rows: spark.createDataFrame(rows, "query_id int, rank int, line string")
    working = spark.createDataFrame([(2, "- [b] two"), (1, "- [a] one")], "rank int, line string")
    lines = {"working": working, "semantic": line([(1, 1, "x" * 8), (1, 2, "y" * 30), (1, 3, "z")]), "procedural": line([]), "episodic": line([(2, 1, "e" * 99)])}
    out = {r["query_id"]: r["context"] for r in threads.memory_context(asked, lines, 80).collect()}
    head = "[作業記憶]\n- [a] one\n- [b] two"
    # what follows a line that doesn't fit is left out too; a memory whose first line doesn't fit leaves its head
    assert out == {1: f"{head}\n\n[ドメイン知識]\n{'x' * 8}", 2: f"{head}\n\n[関連エピソード]"}


def test_sessions(spark):
    rows = [("a", "Heat", ["x"], False, 3), ("b", "heat two", ["y"], False, 5), ("c", "Heat", ["x"], True, 9), ("d", "cold", ["x", "z"], False, 7)]
    index = spark.createDataFrame(rows, "session_id string, title string, tags array<string>, archived boolean, updated_at int")
    ids = lambda **o: [r["session_id"] for r in threads.sessions(index, **o).collect()]
    assert ids() == ["d", "b", "a"] and ids(include_archived=True, limit=2) == ["c", "d"]
    assert ids(tags=["x", "q"]) == ["d", "a"] and ids(query="HEAT") == ["b", "a"] and ids(tags=["x"], query="heat") == ["a"]


def test_dataset_statistics(spark):
    rows = [("a", "xx", "import os"), ("a", None, "熱"), ("b", "x", None), ("c", "x", "```"), ("c", "", "abcd")]
    r = dataset.dataset_statistics(spark.createDataFrame(rows, "instruction string, input string, output string")).first()
    assert (r["total_records"], r["output_len_min"], r["output_len_max"], r["output_len_median"]) == (5, 0, 9, 3)
    assert r["output_len_avg"] == pytest.approx(3.4) and r["input_len_avg"] == pytest.approx(0.8)
    assert (r["code_block_count"], r["japanese_output_count"], r["duplicate_instructions_count"]) == (2, 1, 2) and r["code_block_ratio_pct"] == pytest.approx(40)


def test_message_tokens(spark):
    assert one(spark, X.message_tokens(F.lit("熱制御 abcd"))) == 4 + 7 + 4
    assert one(spark, X.message_tokens(F.lit(None).cast("string"), F.lit("[1, 2, 3]"))) == 4 + 2 + 4


def test_target_documents(spark):
    found = spark.createDataFrame([(1, "a", 10.0), (1, "b", 7.0), (1, "c", 7.0), (2, "a", 5.0), (2, "b", 3.4)], "query_id int, domain string, score double")
    domains = spark.createDataFrame([("a", ["A1"], ["A2"]), ("b", ["B1"], ["B2"]), ("c", ["C1"], ["C2"])], "domain string, primary_docs array<string>, related_docs array<string>")
    out = {(r["query_id"], r["target"]) for r in guided.target_documents(found, domains).collect()}
    # the second domain's related documents count from 0.7 of the best score on; a third domain never does
    assert out == {(1, "A1"), (1, "A2"), (1, "B1"), (1, "B2"), (2, "A1"), (2, "A2"), (2, "B1")}


def test_guided_search_falls_back_for_a_question_alone(spark):
    chunks = spark.createDataFrame([("c1", "DOC-1A"), ("c2", "DOC-2"), ("c3", "DOC-3")], "chunk_id string, doc_id string")
    domains = spark.createDataFrame([("heat", 1, ["heat"], ["DOC-1"], []), ("lost", 1, ["lost"], ["DOC-9"], [])], "domain string, specificity int, keywords array<string>, primary_docs array<string>, related_docs array<string>")
    asked = spark.createDataFrame([(1, "heat"), (2, "lost"), (3, "no domain")], "query_id int, text string")
    seen = []

    def ranked(questions, allowed):
        seen.append((sorted(r[0] for r in questions.select("query_id").collect()), allowed is None))
        hits = questions.select("query_id").crossJoin(chunks.select("chunk_id")).withColumns({"method": F.lit("bm25"), "batch": F.lit(1), "score": F.when(F.col("chunk_id") == "c2", 2.0).otherwise(1.0)})
        return hits if allowed is None else hits.join(allowed, ["query_id", "chunk_id"], "left_semi")

    out = guided.guided_search(asked, chunks, domains, ranked, k=2).collect()
    assert seen == [([1, 2], False), ([2, 3], True)]
    assert sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"], r["guided"], r["domain"]) for r in out if r["query_id"] == 1) == [(1, 1, "c1", 1.0, True, "heat")]
    assert [(r["rank"], r["chunk_id"], r["guided"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 2] == [(1, "c2", False), (2, "c1", False)]
    assert {r["domain"] for r in out if r["query_id"] == 3} == {None}
