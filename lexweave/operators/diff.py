"""Line differences between versions of a text."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# Words of a summary, and the names of the two versions.
ADDED, REMOVED, CHANGED, SAME, ALIKE = "追加 {} 行", "削除 {} 行", "[変更] 旧: {} → 新: {}", "変更なし", "類似度 {:.1%}"
MAIN_CHANGES, FURTHER = "主な変更点:", "... 他 {} 件"
OLD, NEW = "旧バージョン", "新バージョン"


def differences(old: str, new: str, shown: int = 5, lines: int = 2) -> dict:
    """added, removed and replaced lines, the share of matching lines and a summary, by the longest matching blocks.

    Blocks are those of the standard library's matcher with its rule for very
    frequent lines; its time may grow with the square of the lines.
    """
    x, y = old.splitlines(), new.splitlines()
    matcher = difflib.SequenceMatcher(None, x, y)
    spans = [(op, x[a:b], y[c:d]) for op, a, b, c, d in matcher.get_opcodes() if op != "equal"]
    out = {"added": [v for _, _, n in spans for v in n], "removed": [v for _, o, _ in spans for v in o], "changed": [CHANGED.format(" / ".join(o[:lines]), " / ".join(n[:lines])) for op, o, n in spans if op == "replace"], "ratio": matcher.ratio()}
    told = [text.format(len(out[k])) for k, text in (("added", ADDED), ("removed", REMOVED)) if out[k]] or [SAME]
    summary = [" / ".join([*told, ALIKE.format(out["ratio"])])]
    if out["changed"]:
        summary += [MAIN_CHANGES, *out["changed"][:shown]]
    if len(out["changed"]) > shown:
        summary.append(FURTHER.format(len(out["changed"]) - shown))
    return out | {"summary": "\n".join(summary)}


def line_diff(old: Column, new: Column) -> Column:
    """Struct of lines added, removed and changed, the share of matching lines and a summary; null is the empty text."""

    @F.pandas_udf("struct<added:array<string>,removed:array<string>,changed:array<string>,ratio:double,summary:string>")
    def run(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([differences(a, b) for a, b in zip(old.fillna(""), new.fillna(""), strict=True)], columns=["added", "removed", "changed", "ratio", "summary"])

    return run(old, new)


def unified_diff(old: Column, new: Column, context: int = 3) -> Column:
    """The differences as a patch with so many lines around each; line ends are kept."""

    @F.pandas_udf("string")
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        texts = ((a.splitlines(keepends=True), b.splitlines(keepends=True)) for a, b in zip(old.fillna(""), new.fillna(""), strict=True))
        return pd.Series(["".join(difflib.unified_diff(a, b, OLD, NEW, n=context)) for a, b in texts])

    return run(old, new)


def line_sets(old: Column, new: Column) -> Column:
    """Struct of lines only in the new and only in the old text, each once: set-based, without Python."""
    a, b = F.split(F.coalesce(old, F.lit("")), "\n"), F.split(F.coalesce(new, F.lit("")), "\n")
    return F.struct(F.array_except(b, a).alias("added"), F.array_except(a, b).alias("removed"))


# Phrases of business mail and what stands for them, in order; $ is the end of a line.
MAIL_PHRASES = (
    (r"お世話になっております[。、]?\s*", ""),
    (r"いつもお世話になっております[。、]?\s*", ""),
    (r"ご確認のほど、?よろしく(お願いいたします|お願い申し上げます)[。]?\s*", "【確認依頼】"),
    (r"ご対応(のほど)?、?よろしく(お願いいたします|お願い申し上げます)[。]?\s*", "【対応依頼】"),
    (r"以上、?よろしく(お願いいたします|お願い申し上げます)[。]?\s*$", ""),
    (r"何卒よろしくお願い(いたします|申し上げます)[。]?\s*$", ""),
)


def normalise_mail(text: Column) -> Column:
    """A mail in compatibility composition without its greetings, requests as marks, at most one blank line in a row."""
    out = nfkc(text)
    for pattern, mark in MAIL_PHRASES:
        # white space of any script, as the text may hold some; only line feeds end a line
        out = F.regexp_replace(out, "(?md)" + pattern.replace(r"\s", r"[\s\p{Z}]"), mark)
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.str.normalize("NFKC")

    return run(text)
