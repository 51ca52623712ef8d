"""Ranked lexical search: MaxScore over the shards of an inverted index.

**Index.**  Every task turns its documents into shards of bounded size: for each
term of a shard one row with its postings (ordinals and occurrences), the number
of documents, the most occurrences and the fewest terms of a document that holds
it; and one row with the shard's document ids and lengths.  No row depends on
statistics of the corpus, so the index is written once and serves any questions.

**Search.**  The corpus statistics are sums over the index.  A shard's upper
bound of a term is the score of its most occurrences in its shortest document.
Per shard and item the term lists are ordered by bound; the longest prefix whose
bounds add up to no more than the k-th best score so far is non-essential: a
document that holds only such terms can't qualify.  Documents are read from the
essential lists, window by window; the non-essential ones are probed, the
largest bound first, and only for documents whose score so far plus the bounds
still open exceeds the k-th best.  A shard hands on its k best for each item,
from which the k best of all follow in two steps.

Postings of a term never meet outside of their shard, so a word of every
document is no hot key.  Items come in blocks of bounded bytes: a block's terms
and weights are the only thing sent to tasks.

Terms are the maximal runs of ASCII letters and digits and of anything beyond
ASCII, A-Z lower-cased; scores are 64-bit integers as documented in ``SCALE``.

Defined cases: null and empty texts have no term and count for nothing; very
long texts are read whole (the score needs 50 * terms * documents below 2^63);
items without a term, or without one that the corpus holds, have no rows; items
equal in id and text are one item, items of one id and other text are ranked on
their own; equal scores are ordered by id, a null id last; repeated rows are
separate documents; an empty table on either side gives no rows; columns other
than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import bounded_batches, cut, quoted, table

#: A shard ends at this many documents (ordinals take two bytes) or bytes of text.
SHARD_DOCS, SHARD_BYTES = 1 << 15, 32 << 20

#: Score of a term: weight * (SCALE * tf // (1000 * tf + 20 * m)).
SCALE = 10**9

#: Results of an item in the production query.
BEST = 50

#: Bytes of a block of items.
BLOCK_BYTES = 8 << 20

#: Documents of the first window of a shard; each further one is twice as long.
FIRST_WINDOW = 512

#: Groups of shards whose best documents are cut to k before all meet.
GROUPS = 256

#: Letters and digits in lower case and all bytes beyond ASCII; the rest is a gap.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return text.translate(_FOLD).split()


def _narrow(values: np.ndarray) -> bytes:
    """Positive integers in one, two or four bytes each."""
    return values.astype(np.min_scalar_type(int(values.max()))).tobytes()


def _wide(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // count]).astype(np.int64)


class _Shard:
    """Collects documents and gives the rows of their shard."""

    def __init__(self):
        self.names = defaultdict(lambda: len(self.names))
        self.term, self.doc, self.tf = array("i"), array("i"), array("i")
        self.length, self.ids, self.bytes = [], [], 0

    def add(self, ident: pa.Scalar, text: bytes | None) -> None:
        found = Counter(terms_of(text)) if text else {}
        self.term.extend(map(self.names.__getitem__, found))
        self.tf.extend(found.values())
        self.doc.extend([len(self.ids)] * len(found))
        self.length.append(sum(found.values()))
        self.ids.append(ident)
        self.bytes += len(text or b"")

    def rows(self, shard: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        ids = pa.array(self.ids, schema.field("ids").type.value_type)
        by_id = pc.sort_indices(ids, null_placement="at_end").to_numpy().astype(np.int64)
        place = np.empty(len(by_id), np.int64)
        place[by_id] = np.arange(len(by_id))
        length = np.array(self.length, np.int64)[by_id]
        head = [pa.array([shard]), pa.array([None], pa.string()), pa.array([int((length > 0).sum())]), pa.array([int(length.sum())]), pa.array([0]), pa.array([length.tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(by_id)))]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(head, schema, strict=True)], schema=schema)
        term, doc, tf = (np.frombuffer(a, np.int32).astype(np.int64) for a in (self.term, self.doc, self.tf))
        doc = place[doc]
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        starts = np.searchsorted(term, np.arange(len(self.names) + 1))
        names = list(self.names)
        for at in range(0, len(names), 4096):
            spans = [(starts[i], starts[i + 1]) for i in range(at, min(at + 4096, len(names)))]
            few = [
                pa.array([shard] * len(spans)),
                pa.array([x.decode() for x in names[at : at + 4096]], pa.string()),
                pa.array([int(e - b) for b, e in spans]),
                pa.array([int(tf[b:e].max()) for b, e in spans]),
                pa.array([int(length[doc[b:e]].min()) for b, e in spans]),
                pa.array([doc[b:e].astype(np.uint16).tobytes() for b, e in spans], pa.binary()),
                pa.array([_narrow(tf[b:e]) for b, e in spans], pa.binary()),
                pa.nulls(len(spans), schema.field("ids").type),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(few, schema, strict=True)], schema=schema)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The inverted index, written: shard, term, n_docs, most, least, places, counts, ids.

    In the row of a shard's documents ``term`` is null, ``n_docs`` counts those
    with a term, ``most`` has the number of all their terms, ``places`` the
    lengths as 64-bit integers and ``ids`` the ids in order.  In a term's row
    ``most`` is the largest number of occurrences and ``least`` the fewest terms
    of a document that holds it.
    """
    if not 0 < shard_docs <= 1 << 16:
        raise ValueError("a shard has 1 to 65,536 documents")
    bounded_batches(docs.sparkSession)
    read = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    schema = StructType([StructField("shard", LongType()), StructField("term", StringType()), *[StructField(c, LongType()) for c in ("n_docs", "most", "least")], StructField("places", BinaryType()), StructField("counts", BinaryType()), StructField("ids", ArrayType(read.schema["id"].dataType))])
    arrow = _arrow_schema(schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, shard = TaskContext.get().partitionId(), 0, _Shard()
        for batch in batches:
            for ident, text in zip(batch.column(0), batch.column(1).cast(pa.large_string()).cast(pa.large_binary()), strict=True):
                shard.add(ident, text.as_py())
                if len(shard.ids) >= shard_docs or shard.bytes >= shard_bytes:
                    yield from shard.rows((task << 24) + number, arrow)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield from shard.rows((task << 24) + number, arrow)

    return cut(read.mapInArrow(build, schema), "lexical-index")


def _arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class _List:
    """A term's postings in a shard."""

    def __init__(self, w: int, most: int, least: int, n_docs: int, places: bytes, counts: bytes, m_of, m: np.ndarray):
        self.w, self.docs, self.tf, self.m = w, np.frombuffer(places, np.uint16).astype(np.int64), _wide(counts, n_docs), m
        self.bound = w * (SCALE * most // (1000 * most + 20 * m_of(least)))
        self.values: np.ndarray | None = None

    def score(self, at: np.ndarray) -> np.ndarray:
        """Scores of the postings ``at`` these places."""
        return self.w * (SCALE * self.tf[at] // (1000 * self.tf[at] + 20 * self.m[self.docs[at]]))

    def all(self) -> np.ndarray:
        if self.values is None:
            self.values = self.score(np.arange(len(self.docs)))
        return self.values


def best(lists: list[_List], n_docs: int, k: int, first_window: int = FIRST_WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Ordinals and scores of the k best documents, best first, and the number of postings that were scored."""
    lists = sorted(lists, key=lambda x: x.bound)
    bounds = np.cumsum([x.bound for x in lists])
    docs, scores, least, read = np.empty(0, np.int64), np.empty(0, np.int64), 0, 0
    begin, width = 0, first_window
    while begin < n_docs:
        end = min(n_docs, begin + width)
        # ordinals follow the ids, so a later document with the k-th best score doesn't qualify
        probed = int(np.searchsorted(bounds, least, side="right"))
        if probed == len(lists):
            break
        sums = np.zeros(end - begin, np.int64)
        for own in lists[probed:]:
            a, b = np.searchsorted(own.docs, (begin, end))
            sums[own.docs[a:b] - begin] += own.all()[a:b]
            read += int(b - a)
        at = np.flatnonzero(sums)
        got = sums[at]
        for i in range(probed - 1, -1, -1):
            may = got + bounds[i] > least
            at, got = at[may], got[may]
            if not len(at):
                break
            own = lists[i]
            p = np.minimum(np.searchsorted(own.docs, at + begin), len(own.docs) - 1)
            hit = np.flatnonzero(own.docs[p] == at + begin)
            got[hit] += own.score(p[hit])
            read += len(hit)
        may = got > least
        docs, scores = np.concatenate([docs, at[may] + begin]), np.concatenate([scores, got[may]])
        keep = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[keep], scores[keep]
        least = int(scores[-1]) if len(scores) == k else 0
        begin, width = end, 2 * width
    return docs, scores, read


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number for every distinct id and text), id, terms, bytes; written."""
    read = items.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).filter("text is not null").distinct()
    schema = StructType([read.schema["id"], StructField("mark", StringType()), StructField("terms", ArrayType(StringType()))])
    arrow = _arrow_schema(schema)

    def split(batches):
        for batch in batches:
            found = [sorted({t.decode() for t in terms_of(x.as_py())}) for x in batch.column(2).cast(pa.large_string()).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), batch.column(1).cast(arrow.field(1).type), pa.array(found, arrow.field(2).type)], schema=arrow)

    marked = read.select("id", F.md5(F.concat_ws("\x00", F.col("id").cast("string"), "text")).alias("mark"), "text")
    return cut(marked.mapInArrow(split, schema).filter("size(terms) > 0"), "lexical-items", few_files=True)


def search(index: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 for every item."""
    spark = index.sparkSession
    bounded_batches(spark)
    asked = _items(items, id_col, text_col)
    facts = index.filter("term is null").agg(F.sum("n_docs").alias("n"), F.sum("most").alias("total")).first()
    size = asked.agg(F.sum(F.expr("aggregate(terms, 64L, (s, t) -> s + 16 + length(t))")).alias("bytes")).first()["bytes"]
    id_type, doc_type = asked.schema["id"].dataType, index.schema["ids"].dataType.elementType
    names = StructType([StructField("item_id", id_type), StructField("rank", IntegerType()), StructField("doc_id", doc_type), StructField("score", LongType())])
    if not size or not facts["n"]:
        return spark.createDataFrame([], names)
    blocks = -(-size // block_bytes)
    found = None
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("mark"), F.lit(blocks)) == block).orderBy("id", "mark").collect() if blocks > 1 else asked.orderBy("id", "mark").collect()
        if own:
            ranked = _ranked(index, own, facts["n"], facts["total"], k, id_type, doc_type)
            ranked = cut(ranked, "lexical-best", few_files=True) if blocks > 1 else ranked
            found = ranked if found is None else found.unionByName(ranked)
    return found if found is not None else spark.createDataFrame([], names)


def _ranked(index: DataFrame, own: list, n: int, total: int, k: int, id_type, doc_type) -> DataFrame:
    """The best documents for a block of items."""
    spark = index.sparkSession
    # bounded by the bytes of a block
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in sorted({t for r in own for t in r["terms"]})], "term string"))
    held = index.join(wanted, "term")
    df = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.sum("n_docs").alias("n")).collect()}
    weights = {t: weight(n, d) for t, d in df.items()}
    weighed = [[t for t in r["terms"] if weights.get(t)] for r in own]
    out = StructType([StructField("item", IntegerType()), StructField("shard", LongType()), StructField("doc_id", doc_type), StructField("score", LongType())])
    arrow = _arrow_schema(out)

    def m_of(length):
        return 50 + 50 * length * n // total

    def find(rows: pa.Table) -> pa.Table:
        lists, head = {}, None
        for r in range(rows.num_rows):
            term = rows.column("term")[r].as_py()
            if term is None:
                head = r
        m = m_of(np.frombuffer(rows.column("places")[head].as_py(), np.int64))
        ids = rows.column("ids")[head].values
        for row in rows.drop_columns(["ids"]).to_pylist():
            if weights.get(row["term"]):
                lists[row["term"]] = _List(weights[row["term"]], row["most"], row["least"], row["n_docs"], row["places"], row["counts"], m_of, m)
        item, docs, scores = [], [], []
        for i, terms in enumerate(weighed):
            mine = [lists[t] for t in terms if t in lists]
            if mine:
                d, s, _ = best(mine, len(m), k)
                item.append(np.full(len(d), i, np.int32))
                docs.append(d)
                scores.append(s)
        if not item:
            return arrow.empty_table()
        place = np.concatenate(docs)
        shard = np.full(len(place), rows.column("shard")[head].as_py(), np.int64)
        return pa.Table.from_arrays([pa.array(np.concatenate(item)), pa.array(shard), ids.take(pa.array(place)).cast(arrow.field("doc_id").type), pa.array(np.concatenate(scores))], schema=arrow)

    columns = ["shard", "term", "n_docs", "most", "least", "places", "counts", "ids"]
    needed = held.select(*columns).unionByName(index.filter("term is null").select(*columns))
    near = needed.groupBy("shard").applyInArrow(find, out)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    near = near.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(GROUPS)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).filter(F.col("rank") <= k)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    # bounded by the bytes of a block
    names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(own)], StructType([StructField("item", IntegerType()), StructField("item_id", id_type)]))
    return near.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words
  FROM documents
), s AS (
  SELECT count(*)::BIGINT AS n_all, sum(len(words))::BIGINT AS n_terms FROM t WHERE len(words) > 0
), p AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM t) GROUP BY r, doc_id, n, term
), f AS (
  SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p CROSS JOIN s GROUP BY term, n_all
), q AS (
  SELECT DISTINCT item_id, text, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM benchmark
), c AS (
  SELECT item_id, text, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // n_terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) CROSS JOIN s GROUP BY item_id, text, r, doc_id
), k AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST, r))::INT AS rank, doc_id, score FROM c WHERE score > 0
)
SELECT * FROM k WHERE rank <= 50
"""
