"""Text segmentation: chunkers, sections and their hierarchy.

Chunking is sequential inside a text, so the chunkers are generators over Arrow
batches of whole texts (one pass, no shuffle, memory of one batch); hierarchies
over sections are set-based.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import bounded_batches
from ..storage import cut
from .ranking import earlier_largest, neighbours

SIZE, OVERLAP = 800, 100
#: Boundaries that a piece of a long text prefers, best first.
BOUNDARIES = ("。\n", "。", "\n", "、")
#: Fixed value: what a child is called in its hierarchy.
CHILD_TITLE = "段落 "
#: Characters in an output batch, about.
BATCH_CHARS = 1 << 20


def cut_spans(ends: np.ndarray, size: int, overlap: int, whole_short: bool = False) -> Iterator[tuple[int, int, int]]:
    """(from, to, number of pieces so far) of chunks over a text whose pieces end at ``ends``, increasing.

    A chunk reaches to the last end within ``size`` of its begin, or takes the
    next piece whatever its length.  The one behind it begins ``overlap`` before
    its end; one no longer than that is repeated whole or, by default, not at
    all.  Cuts are found by searching the ends.
    """
    begin = taken = 0
    while taken < len(ends):
        taken = max(int(np.searchsorted(ends, begin + size, side="right")), taken + 1)
        end = int(ends[taken - 1])
        yield begin, end, taken
        if end - begin > overlap:
            begin = end - overlap
        elif not whole_short:
            begin = end


def _ends(pieces: list[str], gap: int = 0) -> np.ndarray:
    """Where the pieces end when they are joined with so many characters between them."""
    return np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + gap) - gap


def greedy_chunks(text: str, size: int = SIZE, overlap: int = OVERLAP, ends: str = "。\n") -> Iterator[str]:
    """Sentences up to ``size`` characters; blank ones are left out.

    A chunk repeats the tail of the one before if that is longer than the tail.
    """
    pieces = [p for p in re.findall(f"[^{ends}]*[{ends}]|[^{ends}]+", text) if p.strip()]
    joined = "".join(pieces)
    for begin, end, _ in cut_spans(_ends(pieces), size, overlap):
        yield joined[begin:end].strip()


# First lines that are headings, noise lines, and the characters that make a text Japanese.
HEADING_STARTS = (r"(\d+\.)+\d*\s+\S", r"第\d+[章節]\s+\S", r"(?i:SECTION|CHAPTER|APPENDIX)\s+\d", r"\d+\.\d+\s+[A-Z]", r"#{1,4}\s+\S")
PAGE_LINE = r"(?m)^\s*-?\s*\d+\s*-?\s*$"
RUNNING_HEAD = r"(?m)^(JAXA|NASA|ESA)\s+(技術参照文書|Technical Report)\s*$"
JAPANESE = "[\u3040-\u9fff]"
_HEADING = re.compile("|".join(HEADING_STARTS))


def tidy_chunk(text: str) -> str:
    """A chunk without blank runs, page numbers and running heads."""
    for pattern, to in ((r"\n{3,}", "\n\n"), (PAGE_LINE, ""), (RUNNING_HEAD, "")):
        text = re.sub(pattern, to, text)
    return text.strip()


def _parts(text: str, size: int) -> Iterator[str]:
    """The paragraphs of a text; one of over twice the size in stretches that end with sentences."""
    for p in re.split(r"\n\s*\n", text):
        p = p.strip()
        if len(p) <= 2 * size:
            if p:
                yield p
            continue
        sentences = [s for s in re.split(r"(?<=[。．.!?])\s*", p) if s]
        joined = "".join(sentences)
        yield from (joined[a:b] for a, b, _ in cut_spans(_ends(sentences), size, 0))


def paragraph_chunks(text: str, size: int = SIZE, overlap: int = 128, least: int = 50) -> Iterator[tuple[str, str]]:
    """(section, text) of chunks of whole paragraphs, each repeating the tail of the one before.

    The line feed before a paragraph doesn't count against ``size``.  A chunk's
    section is the last heading up to the paragraph behind it, in 80 characters.
    The last chunk is left out if it is shorter than ``least``.
    """
    if len(text) < least:
        return
    parts = list(_parts(text, size))
    if not parts:
        return
    joined = "\n".join(parts)
    # the last heading up to each part, and none in front of the first
    is_heading = np.fromiter((bool(_HEADING.match(p)) for p in parts), bool, len(parts))
    last = np.maximum.accumulate(np.where(is_heading, np.arange(len(parts)), -1))
    for begin, end, taken in cut_spans(_ends(parts, 1), size + 1, overlap, whole_short=True):
        if taken < len(parts) or end - begin >= least:
            at = last[min(taken, len(parts) - 1)]
            yield parts[at][:80] if at >= 0 else "", tidy_chunk(joined[begin:end])


def overlapping_pieces(text: str, size: int = 400, overlap: int = 50) -> Iterator[str]:
    """Windows of ``size`` characters that end behind the last boundary of the best kind.

    The ends of all boundaries are listed once for each kind; a window looks up
    the last of them that it holds.  An end within ``overlap`` characters of the
    start would move the next window backwards and isn't taken, so every window
    moves forward.
    """
    ends = [[m.end() for m in re.finditer(f"(?={re.escape(b)})", text)] for b in BOUNDARIES]
    ends = [[e + len(b) for e in kind] for kind, b in zip(ends, BOUNDARIES, strict=True)]
    start = stop = 0
    while stop < len(text):
        stop = start + size
        if stop < len(text):
            last = (kind[at - 1] for kind in ends if (at := bisect.bisect_right(kind, stop)))
            stop = next((e for e in last if e > start + overlap), stop)
        piece = text[start:stop].strip()
        if piece:
            yield piece
        start = max(stop - overlap, start + 1)  # the sum matters only where size <= overlap


def outlined(sections: DataFrame, doc: str = "doc_id", pos: str = "pos", depth: str = "depth", deepest: int = 4) -> DataFrame:
    """sections (doc, pos, number, title, depth from 1, text) with chunk_id, parent_id and hierarchy.

    The parent is the nearest section before with a smaller depth, else the
    document; the hierarchy lists the document and the headings down to the
    section itself.  It is built depth by depth, each one join.
    """
    ident = lambda p: F.concat_ws("_", F.col(doc).cast("string"), p.cast("string"))
    rows = cut(parents(sections.withColumn("__top", F.lit(0)), doc, pos, depth, deepest + 1).drop("__top"), "outline")
    heading = F.concat_ws(" ", "number", "title")
    none = F.lit(None).cast("int")
    known = None
    for d in range(1, deepest + 1):
        own = rows.filter(F.col(depth) == d)
        if known is None:
            own = own.withColumn("hierarchy", F.array(F.col(doc).cast("string"), heading))
        else:
            above = known.select(F.col(doc).alias("__doc"), F.col(pos).alias("__pos"), F.col("hierarchy").alias("__above"))
            own = own.join(above, (F.col(doc) == F.col("__doc")) & (F.col("parent_pos") == F.col("__pos")), "left")
            own = own.withColumn("hierarchy", F.concat(F.coalesce("__above", F.array(F.col(doc).cast("string"))), F.array(heading))).drop("__doc", "__pos", "__above")
        known = own if known is None else known.unionByName(own)
    parent = F.when(F.col("parent_pos").isNull(), F.col(doc).cast("string")).otherwise(ident(F.coalesce("parent_pos", none)))
    return known.withColumns({"chunk_id": ident(F.col(pos)), "parent_id": parent}).drop("parent_pos")


def child_chunks(sections: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
    """(chunk_id, parent_id, section_number, depth, hierarchy, text) of the pieces of long sections.

    ``sections`` has chunk_id, number, depth, hierarchy and text.  Only sections
    of more than ``size`` characters that fall into more than one piece have
    children; a child's hierarchy and number end with its own from 1.
    """

    def pieces(text):
        found = list(overlapping_pieces(text, size, overlap))
        return ((p,) for p in found) if len(found) > 1 else ()

    # null and short sections never reach Python
    made = cut_rows(sections.filter(F.length("text") > size), pieces, "text string", id_col="chunk_id")
    own = made.join(sections.select("chunk_id", "number", "depth", "hierarchy"), "chunk_id")
    n = (F.col("chunk_idx") + 1).cast("string")
    return own.select(F.concat("chunk_id", F.lit("_child_"), F.col("chunk_idx").cast("string")).alias("chunk_id"), F.col("chunk_id").alias("parent_id"), F.concat("number", F.lit("."), n).alias("section_number"), (F.col("depth") + 1).alias("depth"), F.concat("hierarchy", F.array(F.concat(F.lit(CHILD_TITLE), n))).alias("hierarchy"), "text")


def children_of_documents(docs: DataFrame, size: int = 400, overlap: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, parent_id, parent_md5, text) of the children that :func:`child_chunks` has for the sections of documents.

    For searches, which ask for no headings: sections and their pieces are cut in
    one pass, and nothing is written or exchanged.
    """

    def found(text):
        for pos, (*_, own) in enumerate(sections(text)):
            made = list(overlapping_pieces(own, size, overlap)) if len(own) > size else ()
            if len(made) > 1:
                mark = hashlib.md5(own.encode()).hexdigest()
                yield from ((pos, k, mark, p) for k, p in enumerate(made))

    rows = cut_rows(docs, found, "pos int, child int, parent_md5 string, text string", id_col=id_col, text_col=text_col)
    parent = F.concat_ws("_", F.col(id_col).cast("string"), F.col("pos").cast("string"))
    return rows.select(F.concat(parent, F.lit("_child_"), F.col("child").cast("string")).alias("chunk_id"), parent.alias("parent_id"), "parent_md5", "text")


def cut_rows(docs: DataFrame, split: Callable[[str], Iterator[tuple]], fields: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_idx, *fields) of every tuple that ``split`` gives for a text; null and empty texts have none."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    out = docs.sparkSession.createDataFrame([], f"`{id_col}` {kind.simpleString()}, chunk_idx int, {fields}").schema
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    own = [types[f.dataType.simpleString()] for f in out.fields[2:]]

    def run(batches):
        for batch in batches:
            ids: list = []
            numbers: list[int] = []
            rows: list[tuple] = []
            chars = 0

            def told(ids=ids, numbers=numbers, rows=rows, batch=batch):
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(own)
                made = pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int32()), *(pa.array(c, t) for c, t in zip(columns, own, strict=True))], names=out.names)
                for part in (ids, numbers, rows):
                    part.clear()
                return made

            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, row in enumerate(split(text) if text else ()):
                    ids.append(i)
                    numbers.append(n)
                    rows.append(row)
                    chars += sum(len(v) for v in row if isinstance(v, str))
                    if chars >= BATCH_CHARS:
                        yield told()
                        chars = 0
            yield told()

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, out)


def chunk(docs: DataFrame, split: Callable[[str], Iterator[str]] = greedy_chunks, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_idx, chunk_id, text) of every chunk; null and blank texts have none."""
    rows = cut_rows(docs, lambda text: ((c,) for c in split(text)), "text string", id_col=id_col, text_col=text_col)
    return rows.select(id_col, "chunk_idx", F.concat_ws("_", F.col(id_col).cast("string"), F.col("chunk_idx").cast("string")).alias("chunk_id"), "text")


def chunk_key(doc: Column, n: Column, text: Column) -> Column:
    """A chunk id that changes with the head of its text."""
    return F.concat_ws("_", doc.cast("string"), n.cast("string"), F.substring(F.md5(F.substring(text, 1, 100)), 1, 6))


def section_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = 128, least: int = 50) -> DataFrame:
    """(id, chunk_idx, chunk_id, section, language, text) of the paragraph chunks that still have ``least`` characters when tidied."""

    def split(text):
        return (c for c in paragraph_chunks(text, size, overlap, least) if len(c[1]) >= least)

    rows = cut_rows(docs, split, "section string, text string", id_col=id_col, text_col=text_col)
    japanese = F.length("text") - F.length(F.regexp_replace("text", JAPANESE, ""))
    # the id hashes the head of the chunk after it was tidied
    return rows.select(id_col, "chunk_idx", chunk_key(F.col(id_col), F.col("chunk_idx"), F.col("text")).alias("chunk_id"), "section", F.when(japanese / F.length("text") > 0.1, "ja").otherwise("en").alias("language"), "text")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 30) -> DataFrame:
    """(id, number, title, text) of paragraphs of at least so many characters; numbers count all paragraphs from 1."""
    rows = docs.select(id_col, F.posexplode(F.split(text_col, r"\n{2,}")).alias("n", "p"))
    title = F.when(F.length("p") > 50, F.concat(F.substring("p", 1, 50), F.lit("..."))).otherwise(F.col("p"))
    return rows.filter(F.length("p") >= least).select(id_col, (F.col("n") + 1).alias("number"), title.alias("title"), F.col("p").alias("text"))


# Heading patterns (number, title), and the depth that each gives.
HEADINGS = ((r"(\d+)\.\s+(.+)", 1), (r"(\d+\.\d+)\s+(.+)", 2), (r"(\d+\.\d+\.\d+)\s+(.+)", 3), (r"(\d+\.\d+\.\d+\.\d+)\s+(.+)", 4), (r"第(\d+)章\s+(.+)", 1), (r"\((\d+)\)\s+(.+)", 3))
# Headings of the structure of a text, marks of a line of contents, and the title of a text without headings.
STRUCTURE = (r"(\d+(?:\.\d+){0,3})\s+(.{2,50})", r"(第\s*\d+\s*[章節条項])\s+(.{1,40})", r"[（(](\d+)[）)]\s+(.{1,40})")
CONTENTS_MARK = r"\.{5,}|…{3,}"
WHOLE_TEXT = ("1", "本文")


def _headings(text: str, patterns) -> Iterator[tuple[int, int, int, str, str]]:
    """(start, end, pattern, number, title) of the headings at line starts, by start.

    All patterns are looked for ahead of each line start in one pass; a heading
    whose title runs on into the next line hides one of its own kind there.
    """
    ahead = re.compile("^(?=" + "|".join(f"(?P<k{k}>{p})" for k, p in enumerate(patterns)) + ")", re.M)
    kinds = ahead.groupindex
    hidden = [0] * len(patterns)
    for m in ahead.finditer(text):
        k = next(k for k in range(len(patterns)) if m.start(f"k{k}") >= 0)
        group = kinds[f"k{k}"]
        if m.start() >= hidden[k]:
            hidden[k] = m.end(group)
            yield m.start(), m.end(group), k, m[group + 1], m[group + 2]


def sections(text: str, headings=HEADINGS, most_title: int = 100, least: int = 20) -> Iterator[tuple[str, str, int, int, str]]:
    """(number, title, depth, start, text) of the sections of a text, the heading included; longer titles aren't headings, shorter sections are left out."""
    found = [(start, number, title.strip(), headings[k][1]) for start, _, k, number, title in _headings(text, [p for p, _ in headings]) if len(title.strip()) <= most_title]
    stops = [start for start, *_ in found[1:]] + [len(text)]
    for (start, number, title, depth), stop in zip(found, stops, strict=False):
        if len(own := text[start:stop].strip()) >= least:
            yield number, title, depth, start, own


def structure(text: str) -> Iterator[tuple[str, str, int, str, str, str]]:
    """(section_id, title, level, parent_id, breadcrumb, text) of the sections of a text; the whole text is one if it has no heading.

    A heading in a line of contents doesn't count.  The parent is the nearest
    section above with a lower level.
    """
    found = [(start, number.strip(), title.strip()) for start, end, _, number, title in _headings(text, STRUCTURE) if not re.search(CONTENTS_MARK, text[max(0, start - 5) : end])]
    if not found:
        number, title = WHOLE_TEXT
        yield number, title, 1, "", f"{number} {title}", text.strip()
        return
    open_: dict[int, tuple[str, str]] = {}
    for (start, number, title), stop in zip(found, [s for s, _, _ in found[1:]] + [len(text)], strict=True):
        level = 1 + (0 if number.startswith("第") else number.count("."))
        open_ = {k: v for k, v in open_.items() if k < level}
        parent, path = open_[max(open_)] if open_ else ("", "")
        path = f"{path} > {number} {title}" if path else f"{number} {title}"
        open_[level] = (number, path)
        yield number, title, level, parent, path, text[start:stop].strip()


def parents(rows: DataFrame, doc: str = "doc_id", pos: str = "pos", depth: str = "depth", deepest: int = 6) -> DataFrame:
    """rows with parent_pos: the nearest earlier row of the document that is shallower."""
    names = [f"__nearest{d}" for d in range(deepest)]
    out = earlier_largest(rows, [doc], [pos], {n: F.when(F.col(depth) == d, F.col(pos)) for d, n in enumerate(names)})
    nearest = [F.col(n) for n in names]
    best = F.lit(None).cast("int")
    for d in range(deepest):
        above = F.greatest(*nearest[:d]) if d > 1 else nearest[0] if d == 1 else F.lit(None)
        best = F.when(F.col(depth) == d, above.cast("int")).otherwise(best)
    return out.withColumn("parent_pos", best).drop(*names)


def section_id(doc: Column, name: str = "root") -> Column:
    return F.concat(F.lit("sec_"), F.substring(F.md5(F.concat_ws("_", doc, F.lit(name))), 1, 8))


def parent_number(number: Column) -> Column:
    """1.2.3 -> 1.2; nothing for a number without a dot."""
    return F.when(F.contains(number, F.lit(".")), F.regexp_replace(number, r"\.[^.]*$", "")).otherwise("")


def contents_key(number: Column) -> Column:
    """Sort key of a dotted number: its parts as integers, 0 for others."""
    return F.transform(F.split(number, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def breadcrumbs(rows: DataFrame, doc: str = "doc_id", number: str = "number", title: str = "title", deepest: int = 4) -> DataFrame:
    """rows with breadcrumb: the titles from the top section down, found by the prefixes of the number."""
    parts = F.split(number, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(deepest))), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    wide = rows.select(doc, number, F.posexplode(prefixes).alias("k", "p"))
    names = rows.groupBy(doc, F.col(number).alias("p")).agg(F.min(title).alias("t"))
    crumbs = wide.join(names, [doc, "p"]).groupBy(doc, number).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda s: s["t"]), " > ").alias("breadcrumb"))
    return rows.join(crumbs, [doc, number], "left")


def navigation(rows: DataFrame, doc: str = "doc_id", number: str = "number") -> DataFrame:
    """(doc, number, parent, n_children, previous, next) among sections with the same parent."""
    up = rows.select(doc, number, parent_number(F.col(number)).alias("parent"))
    children = up.groupBy(doc, F.col("parent").alias(number)).agg(F.count(F.lit(1)).alias("n_children"))
    out = neighbours(up, [doc, "parent"], [contents_key(F.col(number))], F.col(number))
    return out.join(children, [doc, number], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
