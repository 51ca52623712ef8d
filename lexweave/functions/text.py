"""Text functions from Column to Column.

Everything is a built-in expression, so it stays in the scan's stage.  Patterns
are parameters; their defaults are the fixed values below.  Null in, null out,
unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges, patterns and word lists that results depend on.
CJK = "぀-鿿"
HEADER = r"[A-Z]{4}-\d+-\d+[\w-]*\s*\n\s*(?:[ivxIVX]+|\d{1,4})\s*\n"
PAGE_LINE = r"(?m)^[ \t]*(?:[ivxIVX]+|\d{1,4})[ \t]*$\n?"
#: Begins at the start of a line only, so that a line is read once.
DOT_LINE = r"(?<![^\n])[^\n]*?\.{5}[^\n]*\n?"
SYMBOL_LINE = r"(?m)^[ \t]*[─━\-=_*#~]{5,}[ \t]*$\n?"
DISCLAIMER = r"(?i)免責条項|disclaimer"
REFERENCES = r"関連文書|参考文書|参照文書|適用文書|関係文書"
CROSS_REF = r"[A-Z]{4}-\d+-\d+(?:-\w+)?"
FULL_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
STANDARD = r"(?:JERG|JAXA|JIS|ISO|MIL|IEEE)[- ]?[\p{L}\p{N}_.-]+"
UNIT_NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?[\s\p{Z}]*(?:km|m|kg|W|V|A|MHz|GHz|dB|°C|Pa|N)"
PAGE_HEADER = r"JERG-\p{Nd}+-\p{Nd}+[\p{L}\p{N}_]*[\s\p{Z}]*\n[\s\p{Z}]*(\p{Nd}+)[\s\p{Z}]*\n"
PAGE_NUMBER = r"(?:^|\n)(\p{Nd}{1,4})(?:\n|\z)"
WIDE = "\u3000-\u9fff\uff00-\uffef"
ORGANISATIONS = (r"JAXA|宇宙航空研究開発機構", r"NASA|ESA|CNES|DLR", r"ISO[\s\p{Z}]*\p{Nd}+|JIS[\s\p{Z}]*[A-Z][\s\p{Z}]*\p{Nd}+")
REGULATIONS = (r"JERG-\p{Nd}{1,2}-\p{Nd}{3}(?:-[A-Z]+\p{Nd}+)?", r"MIL-(?:STD|SPEC)-\p{Nd}+[A-Z]?", r"ECSS-[A-Z]-[A-Z]{2}-\p{Nd}+", r"ISO[\s\p{Z}]*\p{Nd}+(?:-\p{Nd}+)?")
DEFINITION = r"「([^\n]{2,20})」[はとも]?(?:、|　|[\s\p{Z}])*([^\n]{5,80}?)(?:という|と定義|をいう|である)"
NUMBERED_HEADING = r"(\p{Nd}+(?:\.\p{Nd}+)+)[\s\p{Z}]+([^\n。]{5,40})"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case, longer than one character or not ASCII."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]{2,}+|[[\p{L}\p{N}]&&[^\x00-\x7f]]"), F.lit(0))


def mixed_tokens(c: Column) -> Column:
    """ASCII words in lower case, and overlapping character pairs of CJK runs (a single character stays)."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"([a-z0-9]+|[{CJK}]+)"), F.lit(1))

    def cut(r):
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))
        return F.when(r.rlike("^[a-z0-9]"), F.array(r)).otherwise(pairs)

    return F.flatten(F.transform(runs, cut))


def cjk_runs(c: Column) -> Column:
    """Runs of two CJK characters or more."""
    return F.regexp_extract_all(c, F.lit(f"([{CJK}]{{2,}})"), F.lit(1))


def first_distinct(items: Column, n: int) -> Column:
    return F.slice(F.array_distinct(items), 1, n)


def document_id(name: Column) -> Column:
    """File name without extension and without a trailing edition letter and notice number."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"[A-F]?(?:_N\d+)?$", "")


def clean_noise(c: Column, header: str = HEADER) -> Column:
    """Takes out running headers, page numbers, dot leaders and rules, and tidies white space."""
    for pattern, to in ((header, "\n"), (PAGE_LINE, ""), (DOT_LINE, ""), (SYMBOL_LINE, ""), (r"[ \t]+\n", "\n"), (r"\n {2,}", "\n"), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def is_contents(c: Column) -> Column:
    """A table of contents: over 30 % dots, or three dot-leader lines."""
    dots = F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    return (F.length(c) > 0) & ((dots / F.length(c) > 0.3) | (F.size(F.regexp_extract_all(c, F.lit(DOT_LINE), F.lit(0))) >= 3))


def chunk_type(c: Column) -> Column:
    return F.when(is_contents(c), "toc").when(c.rlike(DISCLAIMER), "disclaimer").when(c.rlike(REFERENCES), "references").otherwise("body")


def cross_references(c: Column, own: Column, pattern: str = CROSS_REF) -> Column:
    """Sorted distinct references in a text, other than the document itself whatever its edition letter."""
    base = lambda x: F.regexp_replace(x, r"[A-Z]$", "")
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)))
    return F.array_sort(F.filter(found, lambda r: base(r) != base(own)))


def section(c: Column) -> Column:
    """Struct of number and title of the first dotted heading whose title has few dots; empty strings if none."""
    folded = F.translate(c, FULL_DIGITS + "．", DIGITS + ".")
    lines = F.filter(F.split(folded, "\n"), lambda x: x.rlike(r"^\s*\d+(?:\.\d+){1,3}\.?\s+\S"))
    heads = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d+(?:\.\d+){1,3})", 1).alias("number"), strip(F.regexp_extract(x, r"^\s*\d+(?:\.\d+){1,3}\.?\s+(.*)$", 1)).alias("title")))
    good = F.filter(heads, lambda h: F.length(h["title"]) - F.length(F.replace(h["title"], F.lit("."), F.lit(""))) < 5)
    none = F.struct(F.lit("").alias("number"), F.lit("").alias("title"))
    return F.coalesce(F.get(good, F.lit(0)), none)


def page_number(c: Column) -> Column:
    """The number below a running header, else the first line of one to four digits if it is from 1 to 999."""
    digits = lambda x: F.translate(x, FULL_DIGITS, DIGITS).try_cast("int")
    below = digits(F.regexp_extract(c, PAGE_HEADER, 1))
    line = digits(F.regexp_extract(c, PAGE_NUMBER, 1))
    return F.coalesce(below, F.when(line.between(1, 999), line))


def brief_summary(c: Column, least_line: int = 5, lines: int = 3, most: int = 80) -> Column:
    """The first lines that say something, joined, at most so long."""
    kept = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: (F.length(x) > least_line) & ~F.contains(x, F.lit("......")))
    joined = F.array_join(F.slice(kept, 1, lines), " ")
    return F.when(F.length(joined) > most, F.concat(F.substring(joined, 1, most), F.lit("..."))).otherwise(joined)


def context_header(title: Column, section_title: Column, domain: Column, before: Column, after: Column) -> Column:
    """Lines that place a chunk in its document; parts that are null or empty are left out."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", part("Document", title), part("Section", section_title), part("Domain", domain), part("Before", before), part("After", after))


# Sentences that place a chunk.
ABOUT_SECTION = ("このチャンクはセクション ", " 「", "」に関する内容です。")
ABOUT_SENTENCE = ("このチャンクは「", "」に関する内容を含みます。")


def context_prefix(c: Column) -> Column:
    """A sentence with the number and title of a heading in the first 200 characters, else with the first sentence of the first 100."""
    heading = r"(?md)^(\p{Nd}+(?:\.\p{Nd}+)*)[\s\p{Z}]+([^\n]+?)$"
    number, title = (F.regexp_extract(F.substring(c, 1, 200), heading, k) for k in (1, 2))
    before, between, after = map(F.lit, ABOUT_SECTION)
    opening, end = map(F.lit, ABOUT_SENTENCE)
    sentence = F.substring_index(F.substring(c, 1, 100), "。", 1)
    return F.when(number != "", F.concat(before, number, between, F.substring(title, 1, 50), after)).otherwise(F.concat(opening, sentence, end))


def substitute(c: Column, pairs) -> Column:
    """Plain replacements in order."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


# Phrases of specifications and plainer ones, in order.
PLAIN_PHRASES = (
    ("当該", "この"), ("に係る", "に関する"), ("に関し", "について"), ("における", "での"), ("のための", "のための"), ("実施する", "行う"), ("確保する", "保証する"), ("及び", "および"), ("並びに", "また"),
    ("従って", "そのため"), ("ものとする", "こととする"), ("得る", "できる"), ("行うこと", "行う"), ("有する", "持つ"), ("を要する", "が必要"), ("当然のことながら", ""), ("なお、", "また、"),
)


def dual_records(chunk_id: Column, original: Column, simplified: Column, summary: Column, keywords: Column) -> Column:
    """The two records of a chunk: the plain text, to be searched, and the original, to be quoted; both name the chunk."""
    record = lambda kind, text: F.struct(F.concat(chunk_id, F.lit(f"_{kind}")).alias("chunk_id"), text.alias("text"), text.alias("search_text"), chunk_id.alias("original_chunk_id"), F.lit(kind).alias("index_type"), summary.alias("summary"), keywords.alias("keywords"))
    return F.array(record("simplified", simplified), record("original", original))


def rule_keywords(c: Column, standards: str = STANDARD, most: int = 10) -> Column:
    """Standard numbers and numbers with a unit, distinct, sorted, at most so many."""
    found = F.concat(F.regexp_extract_all(c, F.lit(standards), F.lit(0)), F.regexp_extract_all(c, F.lit(UNIT_NUMBER), F.lit(0)))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, most)


def short_or_brief(c: Column, least: int = 100, short: int = 50, most: int = 80) -> Column:
    """The head of a short text, else a longer head, with three dots if it was cut."""
    head = F.concat(F.substring(c, 1, most), F.when(F.length(c) > most, "...").otherwise(""))
    return F.when(F.length(c) < least, F.substring(c, 1, short)).otherwise(head)


def _all_of(c: Column, patterns) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in patterns])))


def abbreviations(c: Column, least: int = 2) -> Column:
    """Distinct words of ASCII capitals only, sorted; a word is a run of letters, digits and underscores of any script."""
    found = F.regexp_extract_all(c, F.lit(rf"(?<![\p{{L}}\p{{N}}_])([A-Z]{{{least},}})(?![\p{{L}}\p{{N}}_])"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def entities(c: Column) -> Column:
    """Struct of organizations, regulations and abbreviations, sorted, and defined_terms (term, definition) in order."""
    terms, meanings = (F.regexp_extract_all(c, F.lit(DEFINITION), F.lit(k)) for k in (1, 2))
    defined = F.zip_with(terms, meanings, lambda t, m: F.struct(strip(t).alias("term"), strip(m).alias("definition")))
    return F.struct(_all_of(c, ORGANISATIONS).alias("organizations"), _all_of(c, REGULATIONS).alias("regulations"), abbreviations(c).alias("abbreviations"), defined.alias("defined_terms"))


def named_entities(c: Column, head: int = 500) -> Column:
    """(id, name, type, description) of the numbered headings in the head of a text, then of the standards anywhere in it."""
    numbers, titles = (F.regexp_extract_all(F.substring(c, 1, head), F.lit(NUMBERED_HEADING), F.lit(k)) for k in (1, 2))
    names = F.zip_with(numbers, titles, lambda n, t: F.concat(n, F.lit(" "), strip(t)))
    as_entity = lambda kind, said: lambda n: F.struct(entity_id(n).alias("id"), n.alias("name"), F.lit(kind).alias("type"), F.concat(F.lit(said), n).alias("description"))
    standards = F.regexp_extract_all(c, F.lit(STANDARD), F.lit(0))
    return F.concat(F.transform(names, as_entity("CONCEPT", "セクション: ")), F.transform(standards, as_entity("STANDARD", "規格文書: ")))


# Fixed value: the title of a session in which the user said nothing.
UNTITLED = "無題セッション"


def session_title(c: Column, most: int = 50) -> Column:
    """The first message of the user on one line, cut with three dots; a fixed title for null."""
    line = strip(F.replace(c, F.lit("\n"), F.lit(" ")))
    return F.coalesce(F.concat(F.substring(line, 1, most), F.when(F.length(line) > most, "...").otherwise("")), F.lit(UNTITLED))


def entity_id(name: Column) -> Column:
    return F.substring(F.md5(F.lower(name)), 1, 12)


def language_flag(c: Column) -> Column:
    """ja if more than a tenth is CJK, else en."""
    n = F.length(F.regexp_replace(c, f"[^{CJK}]", ""))
    return F.when((F.length(c) > 0) & (n / F.length(c) > 0.1), "ja").otherwise("en")


def squeeze(c: Column) -> Column:
    """White space runs as one space, note numbers and wiki headings out."""
    c = F.regexp_replace(c, r"\[\d+\]", "")
    c = F.regexp_replace(c, r"={2,}[^=\n]*={2,}", "")
    return strip(F.regexp_replace(c, r"\s+", " "))


def tidy(c: Column) -> Column:
    """At most one blank line, at most one space, no white space at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def fingerprint(c: Column) -> Column:
    """Digest of the text in lower case with white space squeezed."""
    return F.md5(F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " "))


def dedup_key(c: Column) -> Column:
    """Digest of the stripped text in lower case; white space inside counts."""
    return F.md5(F.lower(strip(c)))


# Version marks in file names, tried in this order, and what stands before and after the number that is shown.
VERSION_PATTERNS = (
    (r"[Rr][Ee][Vv]\.?(\p{Nd}+)", "rev", ""),
    (r"[vV](\p{Nd}+(?:\.\p{Nd}+)*)", "v", ""),
    (r"第(\p{Nd}+)[版改]", "第", "版"),
    (r"[_\-](最終|final|確定|FINAL)", "最終", None),
    (r"(\p{Nd}{4}[-_]\p{Nd}{2}[-_]\p{Nd}{2})", "", ""),
    (r"[_\-\(](\p{Nd}{1,3})[_\-\).]", "", ""),
)


def version_mark(name: Column) -> Column:
    """The version in a file name without its extension, 1.0 if none."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]+$", "")
    out = F.lit("1.0")
    for pattern, before, after in reversed(VERSION_PATTERNS):
        found = F.regexp_extract(stem, pattern, 1)
        shown = F.lit(before) if after is None else F.concat(F.lit(before), found, F.lit(after))
        out = F.when(found != "", shown).otherwise(out)
    return out


def version_parts(version: Column) -> Column:
    """Array of major, minor, patch: the first three integers, 0 where missing."""
    n = F.transform(F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    return F.array(*[F.coalesce(F.get(n, F.lit(k)), F.lit(0).cast("long")) for k in range(3)])


def expiry_label(days: Column) -> Column:
    return F.when(days < 0, "expired").when(days == 0, "today").when(days <= 7, "critical").when(days <= 30, "warning").otherwise("info")


def html_text(c: Column) -> Column:
    """HTML as lines of text: scripts and styles out, block ends as line feeds, tags out, entities back, blank runs as one."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6])>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


# Openings of quoted mail, each a line of its own.
QUOTE_PATTERNS = (
    r"^>[^\n]*$",
    r"^On [^\n]+ wrote:$",
    r"^-{3,}[^\n]*(?i:Original Message)[^\n]*-{3,}$",
    r"^_{3,}$",
    r"^[^\n]*転送メッセージ[^\n]*$",
    r"^\p{Nd}{4}/\p{Nd}{2}/\p{Nd}{2}[^\n]+のメッセージ:$",
    r"^----[^\n]*メッセージ[^\n]*----$",
    r"^-{2,}[\s\p{Z}]*$",
)


def split_quote(c: Column, patterns=QUOTE_PATTERNS) -> Column:
    """Struct of body and quoted: the text before and from the earliest opening of a quotation, stripped."""
    before = F.get(F.split(c, "(?md)" + "|".join(f"(?:{p})" for p in patterns), 2), F.lit(0))
    return F.struct(strip(before).alias("body"), strip(F.substr(c, F.length(before) + 1)).alias("quoted"))


def html_markdown(c: Column) -> Column:
    """HTML as Markdown: headings, emphasis, code, links, items and paragraphs; other tags out, entities back, blank runs as one."""
    for pattern, to in MARKDOWN_RULES:
        c = F.regexp_replace(c, pattern, to)
    for entity, char in MARKDOWN_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


# Tags and what they become, in this order; entities, in this order.
MARKDOWN_RULES = (
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?is)<h1[^>]*>(.*?)</h1>", "# $1\n"),
    (r"(?is)<h2[^>]*>(.*?)</h2>", "## $1\n"),
    (r"(?is)<h3[^>]*>(.*?)</h3>", "### $1\n"),
    (r"(?is)<strong[^>]*>(.*?)</strong>", "**$1**"),
    (r"(?is)<b[^>]*>(.*?)</b>", "**$1**"),
    (r"(?is)<em[^>]*>(.*?)</em>", "*$1*"),
    (r"(?is)<code[^>]*>(.*?)</code>", "`$1`"),
    (r"(?is)<pre[^>]*>(.*?)</pre>", "```\n$1\n```"),
    (r"""(?is)<a[^>]*href=['"]([^'"]*)['"][^>]*>(.*?)</a>""", "[$2]($1)"),
    (r"(?is)<li[^>]*>(.*?)</li>", "- $1"),
    (r"(?is)<p[^>]*>(.*?)</p>", "$1\n"),
    (r"(?i)<br[^>]*>", "\n"),
    (r"<[^>]+>", ""),
)
MARKDOWN_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def address(c: Column) -> Column:
    """Struct of name and address of ``Name <address>``."""
    found = F.regexp_extract(c, r"<([^<>]+)>", 1)
    plain = strip(c)
    name = F.regexp_replace(strip(F.regexp_replace(c, r"<[^<>]*>", "")), "^\"|\"$", "")
    return F.struct(F.when(found != "", name).otherwise(F.lit("")).alias("name"), F.when(found != "", F.lower(found)).otherwise(F.lower(plain)).alias("address"))


def subject(c: Column) -> Column:
    """Without one reply or forward mark."""
    return strip(F.regexp_replace(c, r"(?i)^\s*(?:re|fwd?|転送)\s*[:：]\s*", ""))


# Phrases of the four status signals.
SIGNALS = {
    "completed": (
        "完了(しました|いたしました|です)", "対応(しました|いたしました|完了です)", "送付(しました|いたしました)", "提出(しました|いたしました)", "手配(しました|いたしました)",
        "確認(しました|いたしました|できました)", "承認(します|いたします|しました)", "了解(しました|いたしました|です)", "承知(しました|いたしました)", "手続き(を完了|しました)",
        "申請(しました|いたしました)", "取り計らいました", "処理(しました|いたしました|完了)", "解決(しました|しております)",
    ),
    "rejected": ("対応(できません|不可|難しい状況)", "(お断り|辞退)(させていただきます|いたします)", "難しい(状況|です)", "キャンセル(します|いたします)", "中止(します|になりました)", "取り止め"),
    "on_hold": ("保留(にします|とさせてください|中)", "一旦(待って|ペンディング)", "確認(中|してから)", "検討(中|します|させてください)", "持ち越し", "ペンディング"),
    "has_new_tasks": ("追加で", "加えて", r"また(、|。|[\s\p{Z}])", r"なお(、|。|[\s\p{Z}])", "それと", "もう一点", "別途"),
}


def signals(c: Column, phrases=None) -> Column:
    """Struct of one boolean for each signal."""
    return F.struct(*[c.rlike("|".join(p)).alias(k) for k, p in (phrases or SIGNALS).items()])


def status_of(found: Column) -> Column:
    """done before cancelled before waiting; null if none."""
    return F.when(found["completed"], "done").when(found["rejected"], "cancelled").when(found["on_hold"], "waiting")


def deadline(c: Column, now: Column) -> Column:
    """The deadline that a text states relative to ``now`` (a timestamp); null if none.

    Longer phrases come first, so the end of next month is not taken for the end of this one.
    """
    day = F.to_date(now)
    at = lambda d, h: F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), h, F.lit(0), F.lit(0))
    none, five = F.lit(0), F.lit(17)
    number = lambda p, k: F.regexp_extract(c, p, k).cast("int")
    ymd, md = r"(\d{4})[年/-](\d{1,2})[月/-](\d{1,2})", r"(\d{1,2})[月/](\d{1,2})日?"
    date = lambda y, m, d: F.to_timestamp_ntz(F.try_to_date(F.concat_ws("-", y.cast("string"), m.cast("string"), d.cast("string")), "y-M-d"))
    whole = date(F.regexp_extract(c, ymd, 1), F.regexp_extract(c, ymd, 2), F.regexp_extract(c, ymd, 3))
    this = date(F.year(day), F.regexp_extract(c, md, 1), F.regexp_extract(c, md, 2))
    later = date(F.year(day) + 1, F.regexp_extract(c, md, 1), F.regexp_extract(c, md, 2))
    friday = F.date_add(day, 4 - F.weekday(day))
    return (
        F.when(c.rlike(ymd), whole)
        .when(c.rlike(md), F.when(F.to_date(this) < day, later).otherwise(this))
        .when(c.rlike(r"来月末|(?i:end of next month)"), at(F.last_day(F.add_months(day, 1)), five))
        .when(c.rlike(r"月末|(?i:end of (?:the )?month)"), at(F.last_day(day), five))
        .when(c.rlike(r"来週|(?i:next week)"), at(F.date_add(friday, 7), five))
        .when(c.rlike(r"今週|(?i:this week)"), at(friday, five))
        .when(c.rlike(r"明日|(?i:tomorrow)"), at(F.date_add(day, 1), five))
        .when(c.rlike(r"今日|本日|(?i:today)"), at(day, five))
        .when(c.rlike(r"(\d+)\s*(?:日以内|日後|(?i:days?))"), F.to_timestamp_ntz(now) + F.make_dt_interval(number(r"(\d+)\s*(?:日以内|日後|(?i:days?))", 1)))
        .when(c.rlike(r"(\d+)\s*(?:週間|(?i:weeks?))"), F.to_timestamp_ntz(now) + F.make_dt_interval(7 * number(r"(\d+)\s*(?:週間|(?i:weeks?))", 1)))
    )


def estimate_tokens(c: Column) -> Column:
    """1.5 for each character that isn't ASCII, 0.3 for each that is, rounded down."""
    ascii_ = F.length(F.regexp_replace(c, r"[^\x00-\x7f]", ""))
    return F.floor((15 * (F.length(c) - ascii_) + 3 * ascii_) / 10).cast("long")


def estimate_message_tokens(c: Column) -> Column:
    """2 for each wide character, a quarter for any other, rounded down, and 4; 0 for an empty text."""
    cjk = F.length(F.regexp_replace(c, f"[^{WIDE}]", ""))
    return F.when(F.length(c) == 0, 0).otherwise(F.floor((8 * cjk + (F.length(c) - cjk)) / 4) + 4).cast("long")


def message_tokens(content: Column, tool_calls: Column | None = None) -> Column:
    """4 for a message, its content, and its tool calls (as JSON) if it has any."""
    own = F.lit(4) + estimate_message_tokens(F.coalesce(content, F.lit("")))
    return own if tool_calls is None else own + estimate_message_tokens(F.coalesce(tool_calls, F.lit("")))


def auto_tags(c: Column, rules: dict[str, list[str]]) -> Column:
    """Names of the rules of which a word occurs in the text, in the order of the rules."""
    low = F.lower(c)
    any_of = lambda words: F.greatest(*[F.contains(low, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(low, F.lit(words[0]))
    return F.filter(F.array(*[F.when(any_of(w), F.lit(k)) for k, w in rules.items()]), lambda x: x.isNotNull())


def searchable(breadcrumb: Column, plain: Column, original: Column, keywords: Column, summary: Column) -> Column:
    """The parts that hold something, a line each; a blank plain text gives way to the original."""
    blank = lambda x: strip(F.coalesce(x, F.lit(""))) == ""
    body = F.when(blank(plain), original).otherwise(plain)
    parts = F.array(F.when(~blank(breadcrumb), F.concat(F.lit("["), breadcrumb, F.lit("]"))), body, F.array_join(keywords, " "), summary)
    return F.array_join(F.filter(parts, lambda x: ~blank(x)), "\n")


def alpaca(instruction: Column, input_: Column, output: Column) -> Column:
    return F.struct(instruction.alias("instruction"), F.coalesce(input_, F.lit("")).alias("input"), output.alias("output"))


def chat_messages(instruction: Column, input_: Column, output: Column, system: str) -> Column:
    user = F.when(F.coalesce(input_, F.lit("")) != "", F.concat(instruction, F.lit("\n\n"), input_)).otherwise(instruction)
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", output))


def turn_text(instruction: Column, input_: Column, output: Column) -> Column:
    user = F.when(F.coalesce(input_, F.lit("")) != "", F.concat(instruction, F.lit("\n\n"), input_)).otherwise(instruction)
    return F.concat(F.lit("<start_of_turn>user\n"), user, F.lit("<end_of_turn>\n<start_of_turn>model\n"), output, F.lit("<end_of_turn>"))
