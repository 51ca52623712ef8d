"""Keyword and vector retrieval, fusion and reranking.

Queries come as a table (query_id, terms), so that many questions are answered
in one job.  Where all scores are wanted, or those of some pairs, texts are
tokenised for the call: one pass keeps the postings of the queries' terms, so
what is written and exchanged grows with the matches, and the form whose weights
need the whole vocabulary takes a second one.  Up to ``MOST_TERMS`` terms are a
filter of the scan; more go through a join.  For the best k alone,
:mod:`.postings` keeps an index that is made in one pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType

from ..batches import bounded_batches
from ..storage import cut
from .dimension import is_small, small

K1, B, EPSILON = 1.5, 0.75, 0.25
MOST_TERMS = 2000


def _few_terms(queries: DataFrame) -> list[str] | None:
    """The distinct terms of the queries; None if they are more than ``MOST_TERMS``."""
    found = [r["term"] for r in queries.select(F.explode("terms").alias("term")).distinct().limit(MOST_TERMS + 1).collect()]
    return found if len(found) <= MOST_TERMS else None


def _checked(df: DataFrame, few: list[str] | None) -> DataFrame:
    """A table with a row for each of few terms is broadcast; of many it is if it turns out to be small."""
    return small(df) if few is None else F.broadcast(df)


def postings(chunks: DataFrame, queries: DataFrame, key: str, tokens: str = "tokens", few: list[str] | None = None) -> DataFrame:
    """(key, dl, term, tf), written: the queries' terms in every chunk; ``few`` are those terms, if they are few.

    dl is the chunk's length in tokens; every chunk has a row with a null term.
    """
    own = F.array_distinct(tokens) if few is None else F.array_intersect(tokens, F.array(*map(F.lit, few)).cast("array<string>"))
    kind = "array<struct<term:string,tf:bigint>>"
    head = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("tf"))).cast(kind)
    listed = F.transform(own, lambda t: F.struct(t.alias("term"), (F.size(tokens) - F.size(F.array_remove(tokens, t))).cast("long").alias("tf"))).cast(kind)
    rows = chunks.select(key, F.size(tokens).alias("dl"), F.explode(F.concat(head, listed)).alias("p")).select(key, "dl", "p.term", "p.tf")
    if few is None:
        wanted = queries.select(F.explode("terms").alias("term")).distinct()
        rows = rows.filter("term is null").unionByName(rows.join(wanted, "term", "left_semi").select(*rows.columns))
    return cut(rows, "postings")


def corpus_statistics(posted: DataFrame) -> DataFrame:
    """One row: the chunks with a token, and their mean length."""
    return posted.filter("term is null and dl > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    """(term, df) of the posted terms."""
    return posted.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(chunks: DataFrame, tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """((term, df) of all terms, one row of n, filled and total: chunks, those with a token, and all tokens), from one pass.

    The pass gives each chunk a null term beside its distinct ones, which
    carries the counts of chunks through the same aggregate.
    """
    marked = chunks.select(F.size(tokens).alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(tokens))).alias("term"))
    counted = marked.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.count_if((F.col("term").isNull()) & (F.col("dl") > 0)).alias("filled"), F.sum(F.when(F.col("term").isNull(), F.col("dl").cast("long"))).alias("total"))
    counted = cut(counted, "vocabulary")
    # a table of chunks that is empty has no such row
    sizes = counted.filter("term is null").agg(F.coalesce(F.max("df"), F.lit(0)).alias("n"), F.coalesce(F.max("filled"), F.lit(0)).alias("filled"), F.max("total").alias("total"))
    return counted.filter("term is not null").select("term", "df"), sizes


def _weight(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def bm25_plus_one(chunks: DataFrame, queries: DataFrame, *, key: str = "chunk_id", tokens: str = "tokens", keep_zero: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, key, score) with idf ln((N - df + .5) / (df + .5) + 1); chunks without a match score 0 if kept."""
    few = _few_terms(queries)
    posted = postings(chunks, queries, key, tokens, few)
    stats = corpus_statistics(posted)
    rows = posted.filter("term is not null").join(_checked(document_frequencies(posted), few), "term").join(small(_asked(queries)), "term").crossJoin(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    scored = rows.groupBy("query_id", key).agg(F.sum(F.col("times") * idf * _weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("score"))
    if not keep_zero:
        return scored
    every = posted.filter("term is null and dl > 0").select(key).crossJoin(small(queries.select("query_id")))
    return every.join(scored, ["query_id", key], "left").select("query_id", key, F.coalesce("score", F.lit(0.0)).alias("score"))


def bm25_okapi(chunks: DataFrame, queries: DataFrame, *, key: str = "chunk_id", tokens: str = "tokens", k1: float = K1, b: float = B, epsilon: float = EPSILON, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score) above 0 with idf ln(N - df + .5) - ln(df + .5), where a negative idf is epsilon times the vocabulary's mean.

    With ``allowed`` (query_id, key) only those pairs are scored; statistics are of all chunks.
    """
    few = _few_terms(queries)
    terms, sizes = vocabulary(chunks, tokens)
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighed = terms.crossJoin(F.broadcast(sizes)).withColumn("raw", raw)
    floor = weighed.agg((epsilon * F.avg("raw")).alias("floor"))
    idf = F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw"))
    idf = weighed.join(small(_asked(queries)), "term").crossJoin(F.broadcast(floor)).select("query_id", "term", "times", (F.col("total") / F.col("n")).alias("avgdl"), idf.alias("idf"))
    rows = postings(chunks, queries, key, tokens, few).filter("term is not null").join(_checked(idf, few), "term")
    if allowed is not None:
        rows = rows.join(allowed, ["query_id", key], "left_semi")
    scored = rows.groupBy("query_id", key).agg(F.sum(F.col("times") * F.col("idf") * _weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("score"))
    return scored.filter("score > 0")


def keyword_count(text: Column, terms: list[str]) -> Column:
    """How many of the distinct lower-case terms occur in the text as substrings."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(x)).cast("int") for x in dict.fromkeys(terms)), F.lit(0))


def top_k(scored: DataFrame, k: int, key: str = "chunk_id", score: str = "score") -> DataFrame:
    """The best k of each query, ties by key, with their rank from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, kind: str = "each") -> Column:
    """``each``: 1e-10 added to each norm; ``product``: 1e-8 added to their product; ``zero``: 0 if a norm is 0."""
    if kind == "each":
        return dot(a, b) / ((norm(a) + 1e-10) * (norm(b) + 1e-10))
    if kind == "product":
        return dot(a, b) / (norm(a) * norm(b) + 1e-8)
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)))


#: Components of the vectors in a block of the search, about.
BLOCK_COMPONENTS = 1 << 19
#: What single products may be off by.
_MARGIN = 1e-6


def _cosines(x: np.ndarray, q: np.ndarray, kind: str) -> np.ndarray:
    """Row by row, in the three forms of :func:`cosine`."""
    d, a, b = np.einsum("ij,ij->i", x, q), np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", q, q))
    if kind == "each":
        return d / ((a + 1e-10) * (b + 1e-10))
    if kind == "product":
        return d / (a * b + 1e-8)
    return np.where((a == 0) | (b == 0), 0.0, d / np.where(a * b == 0, 1.0, a * b))


class Masks:
    """Which of n places have one of some tags, from the places of each tag; those of the last lists of tags are kept."""

    def __init__(self, n: int, places: dict[str, np.ndarray], most: int = 64):
        self.n, self.places, self.most, self.made = n, places, most, {}

    def of(self, tags: list[str]) -> np.ndarray:
        name = tuple(tags)
        if name not in self.made:
            if len(self.made) >= self.most:
                self.made.pop(next(iter(self.made)))
            mask = np.zeros(self.n, bool)
            for t in tags:
                mask[self.places.get(t, [])] = True
            self.made[name] = mask
        return self.made[name]


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", kind: str = "each", threshold: float | None = None, block: int | None = None, tags: str | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): the best k vectors of each query (query_id, q), ties by key, and a score from the threshold on if there is one.

    Blocks of queries meet blocks of vectors, each pair in a task of its own
    that keeps k for each query; so neither side is broadcast or gathered.
    Vectors of other lengths than a query's, and null ones, don't meet it.  With
    ``tags`` (a list of both sides) a query meets only vectors that have one of
    its tags, and all if its list is null.  With ``digits`` scores are rounded
    before they are compared, but not before the threshold.
    """
    bounded_batches(vectors.sparkSession)
    kinds = vectors.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    marks = (F.col(tags) if tags else F.lit(None)).cast("array<string>").alias("tags")
    # written once: the sizes decide the number of blocks
    v = cut(vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"), marks), "search-vectors")
    q = cut(queries.filter("q is not null").select(F.col("query_id").alias("id"), F.col("q").cast("array<double>").alias("x"), marks), "search-queries")

    def blocks(df):
        total = df.agg(F.coalesce(F.sum(F.size("x")), F.lit(0))).first()[0]
        return max(1, math.ceil(total / (block or BLOCK_COMPONENTS)))

    n_v, n_q = blocks(v), blocks(q)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = v.select("id", "x", "tags", F.size("x").alias("n"), F.pmod(F.xxhash64("x"), F.lit(n_v)).cast("int").alias("a"), every(n_q).alias("b"))
    right = q.select("id", "x", "tags", F.size("x").alias("n"), every(n_v).alias("a"), F.pmod(F.xxhash64("x"), F.lit(n_q)).cast("int").alias("b"))

    def join(x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = x.combine_chunks(), y.combine_chunks()
        names = x.column("id").combine_chunks(), y.column("id").combine_chunks()
        out_q, out_v, out_s = [], [], []
        if x.num_rows and y.num_rows:
            m, w = (t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (x, y))
            m, w = np.nan_to_num(m), np.nan_to_num(w)
            length = np.sqrt(np.einsum("ij,ij->i", m, m))
            unit = m / np.where(length == 0, 1.0, length)[:, None]
            asked = y.column("tags").to_pylist()
            places: dict[str, list[int]] = {}
            if any(a is not None for a in asked):
                for at, own in enumerate(x.column("tags").to_pylist()):
                    for t in own or ():
                        places.setdefault(t, []).append(at)
            masks = Masks(len(m), {t: np.array(p) for t, p in places.items()})
            for i in range(0, len(w), 256):
                rough = w[i : i + 256] @ unit.T
                for r, own in enumerate(rough):
                    open_ = None if asked[i + r] is None else np.flatnonzero(masks.of(asked[i + r]))
                    own = own if open_ is None else own[open_]
                    size = float(np.sqrt(w[i + r] @ w[i + r])) or 1.0
                    # all that may be among the best by the exact score, whose order then decides
                    least = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -np.inf
                    at = np.flatnonzero(own >= least - _MARGIN * size)
                    at = at if open_ is None else open_[at]
                    score = _cosines(m[at], np.broadcast_to(w[i + r], (len(at), w.shape[1])), kind)
                    if threshold is not None:
                        at, score = at[score >= threshold], score[score >= threshold]
                    if digits is not None:
                        score = np.round(score, digits)
                    # equal scores at the end all stay: the key decides between them
                    if len(at) > k:
                        stay = score >= np.partition(score, len(score) - k)[len(score) - k]
                        at, score = at[stay], score[stay]
                    out_q += [i + r] * len(at)
                    out_v += at.tolist()
                    out_s += score.tolist()
        return pa.table({"query_id": names[1].take(pa.array(out_q, pa.int64())), key: names[0].take(pa.array(out_v, pa.int64())), "score": pa.array(out_s, pa.float64())})

    hits = left.groupBy("a", "b", "n").cogroup(right.groupBy("a", "b", "n")).applyInArrow(join, f"query_id {kinds[1]}, `{key}` {kinds[0]}, score double")
    return top_k(hits, k, key)


def reciprocal_rank_fusion(rankings: DataFrame, *, k: int = 60, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, rrf) from rows (query_id, list, rank, key): the sum of 1 / (k + rank); one that a list repeats adds each time."""
    return rankings.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


#: The order and the weights of the methods.
METHODS = (("bm25", 1.0), ("synonym", 0.8), ("vector", 0.9), ("summary", 0.7), ("llm_expand", 0.6), ("cross_ref", 0.5))


def weighted_fusion(hits: DataFrame, *, key: str = "chunk_id", methods=METHODS) -> DataFrame:
    """(query_id, key, score, methods) from hits (query_id, method, batch, key, score).

    A batch is divided by its best score (vectors are not) and weighted; a batch
    without a positive score is skipped.  In the order of methods and batches a
    chunk starts with its first score, a new method adds half of its own, and
    the same method again leaves the larger of both.
    """
    order = F.create_map(*[x for i, (m, _) in enumerate(methods) for x in (F.lit(m), F.lit(i))])
    weight = F.create_map(*[x for m, w in methods for x in (F.lit(m), F.lit(w))])
    best = hits.groupBy("query_id", "method", "batch").agg(F.max("score").alias("best"))
    rows = hits.join(best, ["query_id", "method", "batch"]).filter("best > 0 or method = 'vector'")
    share = F.when(F.col("method") == "vector", F.col("score")).otherwise(F.col("score") / F.col("best")) * weight[F.col("method")]
    rows = rows.select("query_id", key, F.struct(order[F.col("method")].alias("o"), "batch", "method", share.alias("s")).alias("h"))
    lists = rows.groupBy("query_id", key).agg(F.array_sort(F.collect_list("h")).alias("h"))
    none = F.struct(F.lit(None).cast("double").alias("s"), F.array().cast("array<string>").alias("m"))

    def step(acc, h):
        fused = F.when(acc["s"].isNull(), h["s"]).when(F.array_contains(acc["m"], h["method"]), F.greatest(acc["s"], h["s"])).otherwise(acc["s"] + 0.5 * h["s"])
        return F.struct(fused.alias("s"), F.array_union(acc["m"], F.array(h["method"])).alias("m"))

    folded = F.aggregate("h", none, step)
    return lists.withColumn("f", folded).select("query_id", key, F.col("f.s").alias("score"), F.col("f.m").alias("methods"))


def pairs_of(text: Column) -> Column:
    """Distinct pairs of adjacent characters in lower case, blank ones left out."""
    # split into characters once: a substring of the text would be looked for from its start for every pair
    letters = F.split(F.lower(text), "")
    others = F.size(letters) - 1
    grams = F.zip_with(F.slice(letters, F.lit(1), others), F.slice(letters, F.lit(2), others), lambda a, b: F.concat(a, b))
    return F.filter(F.array_distinct(grams), lambda g: (F.length(g) == 2) & (F.trim(g) != ""))


def pair_share(query: Column, text: Column) -> Column:
    """The share of the query's pairs among the text's; both are arrays of distinct pairs."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, text)) / F.size(query))


def shared_pairs(queries: DataFrame, texts: DataFrame, query_key: str, key: str) -> DataFrame:
    """(query_key, key, overlap) above 0, of queries (query_key, q) and texts (key, p) by their shares of common pairs.

    ``p`` has a text's distinct pairs, or is the whole text.  Queries that are
    few go to every task, where a product of matrices counts what they share
    with a batch of texts; nothing is exchanged, and whole texts are searched
    for the queries' pairs alone.  Of more, both sides meet by their pairs.
    """
    whole = isinstance(texts.schema["p"].dataType, StringType)
    own = queries.select(query_key, F.size("q").alias("n"), F.explode("q").alias("pair"))
    if is_small(own):
        texts = texts.withColumn("p", F.lower("p")) if whole else texts
        return _counted_pairs(queries.filter("size(q) > 0").select(query_key, "q").collect(), queries, texts, query_key, key)
    met = texts.select(key, F.explode(pairs_of(F.col("p")) if whole else "p").alias("pair")).join(own, "pair")
    return met.groupBy(query_key, key, "n").agg(F.count(F.lit(1)).alias("shared")).select(query_key, key, (F.col("shared") / F.col("n")).alias("overlap"))


#: Pairs times queries of a block, about, and pairs times texts of a step.
_PAIR_CELLS = 1 << 22
#: Bytes of texts that are searched for pairs at once, 16 at least.
_TEXT_BYTES = 1 << 20


def _places_in_lists(lists: pa.Array, known: list[str]):
    """(row, place in ``known``) of the pairs in lists of them."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    code = pc.fill_null(pc.index_in(lists.flatten(), pa.array(known, pa.string())), -1).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    yield row[code >= 0], code[code >= 0]


def _places_in_texts(texts: pa.Array, known: list[str]):
    """(row, place in ``known``, which is sorted) of the neighbours in texts, as often as they occur; whole texts, in stretches of bytes."""
    codes = np.array([ord(a) << 21 | ord(b) for a, b in known], np.int64)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, starts, data = texts.buffers()
    starts = np.frombuffer(starts, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    at, end = int(starts[0]), int(starts[-1])
    while at < end:
        stop = min(at + _TEXT_BYTES, end)
        first = at + np.flatnonzero((data[at:stop] & 0xC0) != 0x80)
        if stop < end:
            # the last character may go on, and the one before it is the next stretch's first
            stop, first, at = int(first[-1]), first[:-1], int(first[-2])
        else:
            at = end
        letters = np.frombuffer(data[first[0] : stop].tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = letters[:-1] << 21 | letters[1:]
        place = np.minimum(np.searchsorted(codes, pairs), len(codes) - 1)
        met = np.flatnonzero(codes[place] == pairs)
        row = np.searchsorted(starts, first[met], "right") - 1
        inside = first[met + 1] < starts[row + 1]
        yield row[inside], place[met][inside]


def _counted_pairs(asked: list, queries: DataFrame, texts: DataFrame, query_key: str, key: str) -> DataFrame:
    """:func:`shared_pairs` for queries whose pairs were counted to be few."""
    bounded_batches(texts.sparkSession)
    kinds = queries.schema[query_key].dataType.simpleString(), texts.schema[key].dataType.simpleString()
    names, lists = [r[query_key] for r in asked], [r["q"] for r in asked]
    kind = to_arrow_type(queries.schema[query_key].dataType)
    places = _places_in_texts if isinstance(texts.schema["p"].dataType, StringType) else _places_in_lists
    step = max(1, _PAIR_CELLS // max(1, len({p for q in lists for p in q})))

    def count(batches):
        ids, blocks = pa.array(names, kind), []
        for at in range(0, len(lists), step):
            part = lists[at : at + step]
            known = sorted({p for q in part for p in q})
            at_pair = {p: i for i, p in enumerate(known)}
            held = np.zeros((len(known), len(part)), np.float32)
            for i, q in enumerate(part):
                held[[at_pair[p] for p in q], i] = 1
            blocks.append((at, known, held, np.array([len(q) for q in part])))
        for batch in batches:
            for start, known, held, sizes in blocks:
                rows = max(1, _PAIR_CELLS // len(known))
                for i in range(0, batch.num_rows, rows):
                    own = batch.slice(i, rows)
                    met = np.zeros((own.num_rows, len(known)), np.float32)
                    for row, place in places(own.column(1), known):
                        met[row, place] = 1
                    shared = met @ held
                    a, b = np.nonzero(shared)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(b + start)), own.column(0).take(pa.array(a)), pa.array(shared[a, b].astype(np.float64) / sizes[b])], names=[query_key, key, "overlap"])

    return texts.select(key, "p").mapInArrow(count, f"`{query_key}` {kinds[0]}, `{key}` {kinds[1]}, overlap double")


def pair_overlap(query: Column, text: Column, most: int = 500) -> Column:
    """The share of the query's character pairs that the head of the text has; 0 without pairs.

    Where many queries meet many texts, form the pairs of each side once and use ``pair_share``.
    """
    return pair_share(pairs_of(query), pairs_of(F.substring(text, 1, most)))


def blend_rerank(hits: DataFrame, query: Column, text: Column, *, alpha: float = 0.5, head: int = 20, key: str = "chunk_id") -> DataFrame:
    """The first ``head`` hits by (1 - alpha) * score + alpha * pair overlap, then the rest as they were; position from 1.

    ``hits`` has query_id, rank, score and what query and text refer to.
    """
    inside = F.col("rank") <= head
    new = F.when(inside, (1 - alpha) * F.col("score") + alpha * pair_overlap(query, text)).otherwise(F.col("score"))
    rows = hits.withColumn("final", new)
    w = Window.partitionBy("query_id").orderBy(F.when(inside, 0).otherwise(1), F.when(inside, -F.col("final")).otherwise(0.0), "rank", key)
    return rows.withColumn("position", F.row_number().over(w))


def multi_representation(scored: DataFrame, weights: dict[str, float], *, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score, matched_via) from (query_id, key, rep_type, cosine): the best weighted representation plus 0.05 for each further one."""
    weight = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(w))])
    best = scored.groupBy("query_id", key, "rep_type").agg(F.max(F.col("cosine") * weight[F.col("rep_type")]).alias("s"))
    top = F.max(F.struct("s", "rep_type"))
    return best.groupBy("query_id", key).agg(top.alias("t"), F.count(F.lit(1)).alias("n")).select("query_id", key, (F.col("t.s") + 0.05 * (F.col("n") - 1)).alias("score"), F.col("t.rep_type").alias("matched_via"))


def confidence(score: Column) -> Column:
    return F.when(score >= 5, "high").when(score >= 3, "medium").otherwise("low")
