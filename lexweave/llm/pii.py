"""Personal data: patterns propose, checksums confirm, context adjusts the score.

DataFrame functions only.  A regular expression of each kind proposes leftmost
spans that do not overlap.  Their places are read off without a scan of their
own: the pieces between the matches (``split``) and the matches
(``regexp_extract_all``) alternate, so running lengths give code-point offsets;
texts without a match are never split.  Validators then confirm a span: Luhn's
digit for cards, mod 97 for bank accounts, number ranges for addresses and
digit counts for telephones.  A confirmed span starts with its kind's score,
words nearby that belong to the kind raise it, words that speak against it
lower it, and spans of the further kinds need ``LEAST_SCORE``; spans of the
base kinds (email, ip, card, phone) stay whatever their score.

A bank account begins with two capitals and two digits at the start of a word.
Capitals and digits, each after at most one space, may follow, and words behind
the account may look like more of it.  Its end is a space or the end of that
run, where mod 97 holds: at the length of its country, or, for countries that
aren't in ``ACCOUNT_LENGTHS``, the last such place within 34 characters.

Quantifiers are possessive wherever giving characters back can't lead to a
match, so that long runs cost linear time and no stack; places are running
sums over stretches, and context is looked up in short stretches of the text, so that many
matches cost linear time too.

Defined cases: null text is the empty text and has no span; very long texts are
searched whole; a match that fails
its check is dropped and the search goes on behind it, for accounts behind the
first four characters; of accounts that overlap the first counts; spans of different kinds
may overlap; equal rows are searched each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_out, running, span_sql, stretches, sums_before, table


@dataclass(frozen=True)
class Kind:
    """A kind of personal data; ``near`` and ``against`` are patterns of context words, in lower case."""

    name: str
    pattern: str
    score: float
    near: str
    against: str = r"(?:^|[^a-z])(?:example|sample|version|chapter|order no)(?:$|[^a-z])"
    base: bool = True


#: In the order in which spans are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"(?:^|[^a-z])(?:mail|e-mail|email|contact|write|correo)(?:$|[^a-z])"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"(?:^|[^a-z])(?:ip|host|server|address|login)(?:$|[^a-z])"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9]){15,}+", 0.8, r"(?:^|[^a-z])(?:card|visa|mastercard|credit|carte|karte|tarjeta)(?:$|[^a-z])"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, r"(?:^|[^a-z])(?:phone|tel|call|mobile|fax|telefon)(?:$|[^a-z])"),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+[A-Z0-9]?+))[A-Z]{2}[0-9]{2}", 0.8, r"(?:^|[^a-z])(?:iban|bank|account|konto|compte|cuenta)(?:$|[^a-z])", base=False),
    Kind("ssn", r"[0-9]++(?:-[0-9]++)++", 0.3, r"(?:^|[^a-z])(?:ssn|social security)(?:$|[^a-z])", base=False),
)
#: Characters of an account number by country, without spaces.
ACCOUNT_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
LEAST_SCORE = 0.5
#: Code points on each side of a span in which context words count.
WINDOW = 48
_RAISE, _LOWER = 0.25, 0.2


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def mod97(account: Column) -> Column:
    """The remainder by 97 of an account number whose first four characters go last and whose letters count from 10."""
    s = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    code = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substr(turned, i, F.lit(1))))
    step = lambda a, c: F.when(c < 65, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)
    return F.aggregate(code, F.lit(0), step)


_PART = "0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_VALID = {
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
    "ssn": lambda m: m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
}
_SPAN = "array<struct<start:int,end:int,text:string>>"


def _places(text: Column, matches: Column, pattern: str) -> Column:
    """(start, end, text) of the matches of a pattern."""
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), lambda p: F.length(p))
    before = sums_before(F.zip_with(gaps, matches, lambda g, m: g + F.length(m)))
    starts = F.zip_with(before, gaps, lambda b, g: b + g)
    found = F.zip_with(starts, matches, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("text")))
    return F.when(F.size(matches) == 0, F.array().cast(_SPAN)).otherwise(found)


def _account(run: Column) -> Column:
    """The account that a run of capitals, digits and spaces begins with; null if there is none."""
    groups = F.split(run, " ")
    begun = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda k: F.array_join(F.slice(groups, 1, k), " "))
    known = F.create_map(*[F.lit(x) for pair in ACCOUNT_LENGTHS.items() for x in pair])
    want = F.try_element_at(known, F.substr(run, F.lit(1), F.lit(2)))

    def holds(m):
        n = F.length(F.replace(m, F.lit(" "), F.lit("")))
        return n.between(15, 34) & F.coalesce(n == want, F.lit(True)) & (mod97(m) == 1)

    return F.try_element_at(F.filter(begun, holds), F.lit(-1))


def _accounts(text: Column, runs: Column, pattern: str) -> Column:
    """(start, end, text) of the accounts that the runs begin with and that don't overlap; a match of the pattern is four characters."""
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(runs)), lambda p: F.length(p))
    starts = F.zip_with(sums_before(F.transform(gaps, lambda g: g + 4)), gaps, lambda b, g: b + g)
    spans = F.zip_with(starts, F.transform(runs, _account), lambda s, a: F.struct(s.alias("start"), (s + F.length(a)).alias("end"), a.alias("text")))
    spans = F.filter(spans, lambda s: s["text"].isNotNull())
    fits = lambda free, s: s["start"] >= free
    stays = running(spans, F.lit(0), "int", lambda free, s: F.when(fits(free, s), s["end"]).otherwise(free), fits, "boolean")
    found = F.filter(F.zip_with(spans, stays, lambda s, stay: F.when(stay, s)), lambda s: s.isNotNull())
    return F.when(F.size(runs) == 0, F.array().cast(_SPAN)).otherwise(found)


def _around(parts: Column, s: Column) -> Column:
    """The text on both sides of a span, in lower case; ``parts`` are the text's stretches."""
    begin = F.greatest(s["start"] - WINDOW, F.lit(0))
    return F.lower(F.concat_ws(" ", cut_out(parts, begin, s["start"] - begin), cut_out(parts, s["end"], F.lit(WINDOW))))


def _score(kind: Kind, around: Column) -> Column:
    raw = F.lit(kind.score) + F.when(around.rlike(kind.near), _RAISE).otherwise(0.0) - F.when(around.rlike(kind.against), _LOWER).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 3)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and spans (kind, start, end, score), by kind as listed and start, of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.select("doc_id", "t", *[F.regexp_extract_all("t", F.lit(k.pattern), F.lit(int(k.name == "iban"))).alias(f"m_{k.name}") for k in kinds])
    rows = rows.select("doc_id", "t", *[(_accounts if k.name == "iban" else _places)(F.col("t"), F.col(f"m_{k.name}"), k.pattern).alias(f"s_{k.name}") for k in kinds])


    def valid(k: Kind) -> Column:
        found = F.col(f"s_{k.name}")
        return (F.filter(found, lambda s: _VALID[k.name](s["text"])) if k.name in _VALID else found).alias(f"s_{k.name}")

    rows = rows.select("doc_id", "t", *map(valid, kinds))
    any_span = F.lit(0)
    for k in kinds:
        any_span = any_span + F.size(f"s_{k.name}")
    parts = F.when(any_span > 0, stretches(F.col("t"))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", parts.alias("parts"), *[f"s_{k.name}" for k in kinds])

    def confirmed(k: Kind) -> Column:
        seen = F.transform(f"s_{k.name}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _around(F.col("parts"), s).alias("around")))
        scored = F.transform(seen, lambda s: F.struct(F.lit(k.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _score(k, s["around"]).alias("score")))
        return scored if k.base else F.filter(scored, lambda s: s["score"] >= LEAST_SCORE)

    parts = [confirmed(k) for k in kinds]
    return rows.select("doc_id", F.concat(*parts).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = [k.name for k in KINDS if k.base]
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *map(count, base), F.sha2(F.encode(show(own), "UTF-8"), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))


# Plain forms of the patterns: matching is linear there, so they need no possessive quantifiers.
_PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("card", r"[0-9](?:[ -]?[0-9])+"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"),
    ("ssn", r"[0-9]+(?:-[0-9]+)+"),
]
_SHOW = "coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY k, b){}, '')"
SQL = f"""
WITH {span_sql(_PLAIN)},
x AS (SELECT *, regexp_replace(g, '[^0-9]', '', 'g') AS n, replace(g, ' ', '') AS u FROM spans),
y AS (SELECT x.*, lower(substr(t, greatest(b - 48, 0) + 1, b - greatest(b - 48, 0)) || ' ' || substr(t, e + 1, 48)) AS near,
  list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN (length(n) - i) % 2 = 0 THEN substr(n, i, 1)::INT ELSE 2 * substr(n, i, 1)::INT - CASE WHEN substr(n, i, 1)::INT > 4 THEN 9 ELSE 0 END END)) AS luhn,
  CASE WHEN kind = 'iban' THEN list_reduce(list_transform(string_split(substr(u, 5) || substr(u, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) END AS rest,
  substr(t, b, 1) AS before FROM x JOIN d USING (r)),
z AS (SELECT * FROM y WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(g, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0
  WHEN 'card' THEN length(n) BETWEEN 16 AND 19 AND luhn % 10 = 0 WHEN 'phone' THEN length(n) BETWEEN 8 AND 15
  WHEN 'iban' THEN length(u) BETWEEN 15 AND 34 AND rest = 1 AND (b = 0 OR NOT regexp_matches(before, '[A-Za-z0-9]'))
  ELSE regexp_matches(g, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$') AND regexp_matches(near, '(^|[^a-z])(ssn|social security)($|[^a-z])') AND NOT regexp_matches(near, '(^|[^a-z])(example|sample|version|chapter|order no)($|[^a-z])') END)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256({_SHOW.format(" FILTER (k < 4)")}) AS base_sha256, {_SHOW.format(" FILTER (kind IS NOT NULL)")} AS spans
FROM d LEFT JOIN z USING (r) GROUP BY d.r, d.doc_id
"""
