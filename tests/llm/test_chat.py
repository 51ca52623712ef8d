"""Chat formatting: exact round trips."""

import hashlib
import time

from compare import connect, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.llm import chat as C

NASTY = st.text(alphabet=st.sampled_from("<|>\\ab\n:endturn"), max_size=30)


def test_round_trip(spark):
    found = []

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>\n", "a|>b"]), NASTY), min_size=1, max_size=4))
    def draw(turns):
        found.append(turns)

    draw()
    rows = [(c, t, role, text) for c, turns in enumerate(found) for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = C.format_chats(C.as_parts(df)).select("conv_id", "text", "loss", C.parse(F.col("text")).alias("turns")).collect()
    assert len(out) == len(found)
    for r in out:
        turns = found[r["conv_id"]]
        assert [(x["role"], x["text"]) for x in r["turns"]] == turns
        assert r["text"].count("<|end|>") == len(turns)
        learned = [r["text"][s["start"] : s["end"]] for s in r["loss"]]
        assert len(learned) == sum(role == "assistant" and text != "" for role, text in turns)


def test_a_long_conversation(spark, tmp_path):
    """100,000 turns, and one turn of many parts: linear work, exact places."""
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} \\<|é" + "😀" * (k % 7)) for k in range(100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    began = time.time()
    out = {r["conv_id"]: r for r in C.op7_chat(spark, str(tmp_path)).collect()}
    assert time.time() - began < 60
    told = "".join(t for _, _, role, t in rows if role == "assistant")
    assert out[1]["n_turns"] == 100_000 and out[1]["loss_chars"] == len(told)
    assert out[1]["loss_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert out[1]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in rows).encode()).hexdigest()
    pair = "array(named_struct('type','image','text','','ref','r','width',28,'height',28,'seconds',0D,'pages',0),named_struct('type','text','text','ab','ref','','width',0,'height',0,'seconds',0D,'pages',0))"
    chat = C.format_chats(spark.sql(f"select 1L conv_id, 0L turn, 'assistant' role, flatten(array_repeat({pair}, 20000)) parts")).first()
    assert chat["text"].startswith("<|turn:assistant|><|image:0|>ab<|image:1|>ab") and "<|image:19999|>ab" in chat["text"]
    assert len(chat["loss"]) == 20000 and {chat["text"][s["start"] : s["end"]] for s in chat["loss"]} == {"ab"} and chat["attachment_tokens"] == 20000


def test_query(spark, data):
    same(C.op7_chat(spark, data), connect(data), C.SQL)


def test_parts(spark):
    part = "named_struct('type','{}','text',{},'ref',{},'width',{},'height',{},'seconds',{},'pages',{})"
    p = lambda kind, text="null", ref="null", w="null", h="null", s="cast(null as double)", n="null": f"cast({part.format(kind, text, ref, w, h, s, n)} as {C.PART})"
    df = spark.sql(
        f"select 1L conv_id, 0L turn, 'user' role, array({p('text', repr('see <|end|>'))}, {p('image', ref=repr('a.png'), w='56', h='29')}, {p('document', ref=repr('d'), n='2')}) parts "
        f"union all select 1L, 1L, 'assistant', array({p('audio', ref=repr('b'), s='2.0D')}, {p('text', repr('ok'))}) union all select 1L, 2L, null, null"
    )
    r = C.format_chats(df).first()
    assert r["text"] == "<|turn:user|>see <\\|end|\\><|image:0|><|document:1|><|end|>\n<|turn:assistant|><|audio:2|>ok<|end|>\n<|turn:|><|end|>\n"
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "a.png", 4), (1, "document", "d", 1024), (2, "audio", "b", 25)]
    assert r["attachment_tokens"] == 1053
    assert [r["text"][s["start"] : s["end"]] for s in r["loss"]] == ["ok"]


def test_odd(spark):
    df = spark.createDataFrame([(None, None, None, None, "c"), (1, 0, "user", "b", "c"), (1, 0, "user", "a", "c"), (1, 0, "user", "a", "c"), (1, None, "user", "", "c")], "conv_id long, turn long, role string, text string, turns string")
    out = {r["conv_id"]: r["t"] for r in C.format_chats(C.as_parts(df)).select("conv_id", C.parse(F.col("text")).alias("t")).collect()}
    assert [x["text"] for x in out[1]] == ["", "a", "a", "b"] and [tuple(x) for x in out[None]] == [("", "")]
    assert C.format_chats(C.as_parts(df.limit(0))).count() == 0
