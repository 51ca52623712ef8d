"""Chat formatting with typed content parts.

DataFrame functions only.  A turn's content is an array of typed parts (text,
image, audio, document).  A visitor walks the parts in order: text is escaped
and written, any other part becomes a numbered placeholder, and its reference
and the tokens that it will expand to are recorded as an attachment.  A
conversation is its turns in order, each ``<|turn:role|>content<|end|>`` and a
line feed; ``loss`` lists the spans of the assistant's texts in the output.

All control strings start with ``<|`` and end with ``|>``.  Inside texts and
roles a backslash is doubled, ``<|`` becomes ``<\\|`` and ``|>`` becomes
``|\\>``, so no text can form a control string and :func:`parse` restores every
text exactly.

Defined cases: null text, role and part are empty; a null part type is text and
an unknown one a document; turns with equal numbers are ordered by role and
content, null numbers come first; a null conversation id is a conversation of
its own; equal rows are turns of their own; an empty table gives an empty
result; other columns are not read; very long texts are kept whole, and the work
grows in proportion to the characters and turns of a conversation.  A conversation is one output string and
therefore lies in one row; its turns are gathered by a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_out, stretches, sums_before, table

HEAD, MID, END = "<|turn:", "|>", "<|end|>\n"
#: Parts: their type, text, reference, and what their token count depends on.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Edge of an image patch in pixels, audio tokens a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 12.5, 512


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("|>"), F.lit("|\\>"))


def unescape(text: Column) -> Column:
    plain = F.transform(F.split(text, r"\\\\"), lambda s: F.replace(F.replace(s, F.lit("\\|"), F.lit("|")), F.lit("\\>"), F.lit(">")))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(plain, "\\")).otherwise(text)


def _type(part: Column) -> Column:
    t = F.coalesce(part["type"], F.lit("text"))
    return F.when(t.isin("text", "image", "audio"), t).otherwise(F.lit("document"))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; 0 for text and for unknown sizes."""
    image = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    audio = F.ceil(part["seconds"] * AUDIO_RATE)
    pages = part["pages"] * PAGE_TOKENS
    t = _type(part)
    return F.coalesce(F.when(t == "image", image).when(t == "audio", audio).when(t == "document", pages).cast("long"), F.lit(0).cast("long"))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """conv_id, text, loss (start, end), attachments (turn, number, type, ref, tokens) and attachment_tokens.

    ``parts_col`` is an array of ``PART``.
    """
    parts = F.coalesce(F.filter(F.col(parts_col).cast(f"array<{PART}>"), lambda p: p.isNotNull()), F.array().cast(f"array<{PART}>"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), parts.alias("parts")).alias("x"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    media = lambda ps: F.filter(ps, lambda p: _type(p) != "text")
    # the number of a placeholder counts through the conversation
    chats = chats.withColumn("first", sums_before(F.transform("turns", lambda x: F.size(media(x["parts"])))))

    def visit(x: Column, first: Column) -> Column:
        before = sums_before(F.transform(x["parts"], lambda p: (_type(p) != "text").cast("int")))
        placeholder = lambda p, n: F.concat(F.lit("<|"), _type(p), F.lit(":"), (first + n).cast("string"), F.lit("|>"))
        return F.zip_with(x["parts"], before, lambda p, n: F.when(_type(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p, n)))

    written = F.zip_with("turns", "first", lambda x, first: F.struct(F.concat(F.lit(HEAD), escape(x["role"]), F.lit(MID)).alias("head"), visit(x, first).alias("body"), x["role"].alias("role"), F.transform(x["parts"], _type).alias("types")))
    chats = chats.withColumn("written", written)
    text = F.array_join(F.transform("written", lambda w: F.concat(w["head"], F.array_join(w["body"], ""), F.lit(END))), "")
    # where turns begin, and the parts of the assistant's turns
    chars = lambda w: F.length(w["head"]) + F.aggregate(w["body"], F.lit(0), lambda n, b: n + F.length(b)) + len(END)
    chats = chats.withColumn("begun", sums_before(F.transform("written", chars)))

    def learned(w: Column, begun: Column) -> Column:
        lengths = F.transform(w["body"], lambda b: F.length(b))
        starts = F.transform(sums_before(lengths), lambda n: begun + F.length(w["head"]) + n)
        spans = F.zip_with(starts, lengths, lambda start, n: F.struct(start.alias("start"), (start + n).alias("end")))
        own = F.zip_with(spans, w["types"], lambda s, t: F.when((t == "text") & (s["end"] > s["start"]), s))
        return F.when(w["role"] == "assistant", F.filter(own, lambda s: s.isNotNull())).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    loss = F.flatten(F.zip_with("written", "begun", learned))
    found = F.flatten(F.transform("turns", lambda x: F.transform(media(x["parts"]), lambda p: F.struct(x["turn"].alias("turn"), _type(p).alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))))
    numbered = F.transform(found, lambda a, i: F.struct(a["turn"].alias("turn"), i.alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    out = chats.select("conv_id", text.alias("text"), loss.alias("loss"), numbered.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def parse(text: Column) -> Column:
    """Turns (role, text) of a formatted chat; placeholders stay in the text as they are."""
    pieces = F.split(text, r"<\|end\|>\n", -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece):
        head = F.substring_index(piece, MID, 1)
        return F.struct(unescape(F.substr(head, F.lit(len(HEAD) + 1))).alias("role"), unescape(F.substr(piece, F.length(head) + len(MID) + 1)).alias("text"))

    return F.transform(whole, turn)


def as_parts(rows: DataFrame) -> DataFrame:
    """Rows with a text column as turns of one text part."""
    none = lambda kind: F.lit(None).cast(kind)
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col("text"), F.lit("")).alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages"))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


HARD = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    chats = format_chats(as_parts(rows.unionByName(extra)))
    chats = chats.select("conv_id", "text", "loss", stretches(F.col("text")).alias("parts"))
    read = chats.select("conv_id", "text", parse(F.col("text")).alias("turns"), F.array_join(F.transform("loss", lambda s: unescape(cut_out(F.col("parts"), s["start"], s["end"] - s["start"]))), "").alias("learned"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>')) + length(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>')) + 17 AS own FROM r
), g AS (
  SELECT conv_id, count(*) AS n_turns, sum(own)::BIGINT AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learned
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g
"""
