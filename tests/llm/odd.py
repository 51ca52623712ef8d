"""Inputs that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `set` string, size string, spans string, node string, ids string, mark string"


def odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(30000))
    texts = [None, "", " \t\n", "word", "a b c d", "Hello there, this is a plain text of ten words or so.", "é" * 3000, "x" * 40000, long, long, "Same text here for ties to be broken by ids", "Same text here for ties to be broken by ids", "日本語 の 文", "tok▁en \U0001f600 \x00 end"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "c", "c", "c", "c", "c", "c") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "null id text one two three four five", None, None, 3, "c", None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
