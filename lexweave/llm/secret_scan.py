"""Secret scans with a trigram index.

Every rule's regular expression is turned into a Boolean query over trigrams:
strings that any match must contain give conjunctions of their trigrams,
alternatives give disjunctions.  Texts are indexed in shards: a shard (a slice
of a batch of about ``BATCH_CHARS`` characters) gets one posting list for each
trigram that some query names, read off its bytes in one vectorised pass.  A
rule intersects and unites the postings that its query names and its regular
expression is run on the candidates alone; a rule without mandatory trigrams
scans its whole shard.  Postings never leave their shard, so nothing is
shuffled or collected.

Trigrams are taken from the UTF-8 bytes with A-Z folded to a-z, which keeps
every match of a case-sensitive or ASCII case-insensitive rule a candidate.

Defined cases: null text is the empty text; very long texts are searched whole,
in time that grows with their length; matches of one rule are leftmost
and do not overlap, those of different rules may; a match that fails the rule's
check is dropped and the search goes on behind it; equal rows are scanned each;
an empty table gives an empty result; other columns are kept by :func:`redact`
and not read by :func:`scan`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_arrow, span_sql, table
from .pieces import slices

BATCH_CHARS = 1 << 20
#: More alternatives than this are not multiplied out.
_MOST = 48


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Python regular expression and a check of a match."""

    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] | None = None
    base: bool = False
    #: The group that is the secret.
    group: int = 0


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 6


def _mixed(m: re.Match) -> bool:
    """Upper and lower case and a digit: not a word."""
    s = m[0]
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)


# A private key runs from BEGIN to its END line.  Without one, or with another BEGIN or END before it, it is the base64
# after the header: lines, or words of one line, of 16 characters at least, then shorter lines up to one that isn't base64.
# Line ends may be written as escapes; fields such as Proc-Type may come first.
_EOL = r"[\x20\t]*+(?:\r\n?|\n|(?:\\r)?\\n)[\x20\t]*+"
_B64 = r"[A-Za-z0-9+/]{16,}+={0,2}"
_FIELDS = rf"(?:{_EOL}[A-Za-z][A-Za-z0-9-]*+:\x20[^\r\n\\]*+)*+"
_SHORT = rf"{_EOL}[A-Za-z0-9+/]{{1,15}}+={{0,2}}(?=[\x20\t\"']*+(?:[\r\n\\]|\Z))"
_KEY_BODY = rf"(?:{_FIELDS}(?:{_EOL}|[\x20\t])++{_B64}(?:(?:{_EOL}|[\x20\t]++){_B64}|[\x20\t]++[A-Za-z0-9+/]{{0,15}}+={{1,2}}|{_SHORT})*+)?"
_PRIVATE_KEY = rf"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----(?:[^-]*+(?:-(?!----(?:BEGIN|END)\x20)[^-]*+)*+-----END \1PRIVATE KEY-----|{_KEY_BODY})"

#: Base kinds first, in the order in which equal starts are listed.
RULES: tuple[Rule, ...] = (
    Rule("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", _long_value, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", None, True),
    Rule("hex", r"[0-9a-f]{24,}", None, True),
    Rule("private_key", _PRIVATE_KEY),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[0-9A-Za-z-]{12,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}", _mixed),
    # of a run of token characters only the first eyJ can begin a match: what fails behind it fails behind later ones
    Rule("web_token", r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)", group=1),
    Rule("url_login", r"[a-z][a-z0-9+]{1,20}://[^\x00-\x20/:@]*+:[^\x00-\x20/@]{3,}+@[A-Za-z0-9.-]+"),
)

# A query is True (all documents), ("all", ...) or ("any", ...) of trigrams and queries.


def _both(kind: str, parts: list):
    """A conjunction or disjunction, with the trivial parts taken out."""
    if kind == "all":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("all", *dict.fromkeys(parts))
    return True if any(p is True for p in parts) or not parts else parts[0] if len(set(parts)) == 1 else ("any", *dict.fromkeys(parts))


def _of_strings(strings: set[str]):
    """What a text must have if it contains one of the strings."""
    out = []
    for s in sorted(strings):
        data = s.encode()
        out.append(_both("all", [data[i : i + 3] for i in range(len(data) - 2)]))
    return _both("any", out)


class _Reader:
    """Reads a regular expression into what its matches must contain.

    Every part gives (all strings that it can match, if few; the query that any
    match implies).  Whatever isn't literal text, a small character class, a
    group, an alternative or a repetition may match anything.
    """

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def more(self, token: str = "") -> bool:
        return self.text.startswith(token, self.at) if token else self.at < len(self.text)

    def take(self, token: str) -> bool:
        found = self.more(token)
        self.at += len(token) * found
        return found

    def next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def branches(self) -> tuple[set[str] | None, object]:
        found = [self.sequence()]
        while self.take("|"):
            found.append(self.sequence())
        if len(found) == 1:
            return found[0]
        query = _both("any", [q for _, q in found])
        few = all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= _MOST
        return (set().union(*(e for e, _ in found)) if few else None), query

    def sequence(self) -> tuple[set[str] | None, object]:
        known: set[str] = {""}
        whole, queries = True, []
        while self.more() and not self.more("|") and not self.more(")"):
            exact, query = self.repeated(*self.atom())
            if exact is not None and len(exact) * len(known) <= _MOST:
                known = {a + b for a in known for b in exact}
                continue
            queries += [_of_strings(known), query if exact is None else _of_strings(exact)]
            known, whole = {""}, False
        if whole:
            return known, _of_strings(known)
        return None, _both("all", [*queries, _of_strings(known)])

    def repeated(self, exact, query):
        low, high = 1, 1
        if self.take("*"):
            low, high = 0, None
        elif self.take("+"):
            low, high = 1, None
        elif self.take("?"):
            low, high = 0, 1
        elif m := re.compile(r"\{(\d*)(,?)(\d*)\}").match(self.text, self.at):
            self.at = m.end()
            low = int(m[1] or 0)
            high = low if not m[2] else int(m[3]) if m[3] else None
        else:
            return exact, query
        self.take("+") or self.take("?")  # possessive or lazy
        if (low, high) == (1, 1):
            return exact, query
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, True
        return None, (query if exact is None else _of_strings(exact)) if low else True

    def atom(self) -> tuple[set[str] | None, object]:
        c = self.next()
        if c == "(":
            return self.group()
        if c == "[":
            chars = self.members()
            return ({_fold(x) for x in chars}, True) if chars is not None and len(chars) <= 8 else (None, True)
        if c == "\\":
            chars = self.escape()
            return ({_fold(chars)}, True) if chars is not None else (None, True)
        if c in "^$":
            return {""}, True
        return (None, True) if c == "." else ({_fold(c)}, True)

    def group(self) -> tuple[set[str] | None, object]:
        looks = any(self.take(x) for x in ("?=", "?!", "?<=", "?<!"))
        if not looks and self.take("?"):
            if not re.compile(r"[aims]*:").match(self.text, self.at):
                raise ValueError(f"a group that isn't known at {self.at} of {self.text}")
            self.at = self.text.index(":", self.at) + 1
        found = self.branches()
        if not self.take(")"):
            raise ValueError(f"a group without an end in {self.text}")
        return ({""}, True) if looks else found

    def escape(self) -> str | None:
        """The character that an escape stands for; None for a class, a place or an earlier group."""
        c = self.next()
        if c == "x":
            self.at += 2
            return chr(int(self.text[self.at - 2 : self.at], 16))
        return {"n": "\n", "r": "\r", "t": "\t"}.get(c) if c.isalnum() else c

    def members(self) -> set[str] | None:
        """The characters of a class; None if they are many."""
        chars: set[str] | None = None if self.take("^") else set()
        first = True
        while first or not self.more("]"):
            first = False
            c = self.next()
            low = self.escape() if c == "\\" else c
            high = low
            if self.more("-") and not self.more("-]"):
                self.at += 1
                c = self.next()
                high = self.escape() if c == "\\" else c
            few = low is not None and high is not None and ord(high) - ord(low) < 8
            chars = chars | {chr(x) for x in range(ord(low), ord(high) + 1)} if few and chars is not None else None
        self.at += 1
        return chars


def _fold(c: str) -> str:
    return c.lower() if c.isascii() else c


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression; True if nothing is mandatory."""
    exact, query = _Reader(pattern).branches()
    return _of_strings(exact) if exact is not None else query


def _grams(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_grams, query[1:]))


class Scanner:
    """The rules, compiled, and the index of one shard at a time."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.grams = sorted(set().union(*(_grams(q) for _, _, q in self.rules)))
        self.number = np.zeros(1 << 24, np.int16)
        for k, g in enumerate(self.grams, 1):
            self.number[g[0] << 16 | g[1] << 8 | g[2]] = k
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        self.fold = fold

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """For each named trigram the sorted numbers of the texts that have it."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        data = self.fold[np.frombuffer(b"".join(texts), np.uint8)].astype(np.int32)
        if len(data) < 3:
            return {}
        found = self.number[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(found)
        end = np.cumsum(lens)
        doc = np.searchsorted(end, at, side="right")
        inside = at + 2 < end[doc]
        pairs = np.unique(found[at[inside]].astype(np.int64) * len(texts) + doc[inside])
        gram, doc = np.divmod(pairs, len(texts))
        cuts = np.searchsorted(gram, np.arange(1, len(self.grams) + 2))
        return {g: doc[cuts[k] : cuts[k + 1]] for k, g in enumerate(self.grams)}

    def candidates(self, query, index: dict[bytes, np.ndarray], count: int) -> np.ndarray:
        if query is True:
            return np.arange(count)
        if isinstance(query, bytes):
            return index.get(query, np.zeros(0, np.int64))
        parts = [self.candidates(q, index, count) for q in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "all" else np.union1d(out, p)
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of every match, sorted, for each text."""
        index = self.postings([t.encode() for t in texts])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in self.candidates(query, index, len(texts)).tolist():
                for m in pattern.finditer(texts[i]):
                    if rule.accept is None or rule.accept(m):
                        out[i].append((m.start(rule.group), k, m.end(rule.group)))
        for found in out:
            found.sort()
        return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive), by start and rule, of every row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, BATCH_CHARS):
                found = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in spans] for spans in scanner.scan(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, _SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", rules: Sequence[Rule] = RULES, mark: str = "[secret]") -> DataFrame:
    """The rows with every span, overlapping ones as one, replaced by ``mark``; texts without a span are unchanged."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    size_at = names.index(length_col) if length_col in names else None

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = list(texts)
            for a, b in slices(texts, BATCH_CHARS):
                for i, spans in enumerate(scanner.scan([t or "" for t in texts[a:b]]), a):
                    if spans:
                        parts, end = [], 0
                        for s, _, e in spans:
                            if s >= end:
                                parts += [texts[i][end:s], mark]
                            end = max(end, e)
                        out[i] = "".join([*parts, texts[i][end:]])
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            if size_at is not None:
                old = columns[size_at].to_pylist()
                columns[size_at] = pa.array([n if t == o else len(t) for n, t, o in zip(old, out, texts, strict=True)], batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, run, docs.schema)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = [r.kind for r in RULES if r.base]
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *map(count, base), F.sha2(F.encode(show(own), "UTF-8"), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


# SQL has its own forms of these kinds: its engine knows neither back references nor possessive quantifiers.
_PLAIN = {
    "web_token": r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "url_login": r"[a-z][a-z0-9+]{1,20}://[^\x00-\x20/:@]{1,80}:[^\x00-\x20/:@]{3,80}@[A-Za-z0-9.-]+",
}
_SHOW = "coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k, e){}, '')"
SQL = f"""
WITH {span_sql([(r.kind, _PLAIN.get(r.kind, r.pattern).replace("(?ai:", "(?i:")) for r in RULES])},
z AS (SELECT * FROM spans WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(g, '^(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?(.*)$', 1)) >= 6
  WHEN 'cloud_key' THEN regexp_matches(g, '[0-9]') AND regexp_matches(g, '[a-z]') AND regexp_matches(g, '[A-Z]') ELSE true END)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256({_SHOW.format(" FILTER (k < 3)")}) AS base_sha256, {_SHOW.format(" FILTER (kind IS NOT NULL)")} AS spans
FROM d LEFT JOIN z USING (r) GROUP BY d.r, d.doc_id
"""
