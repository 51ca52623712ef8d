"""The pipeline's stages, each on what its predecessor kept."""

import collections
import hashlib

import corpus_pipeline as C
import sentencepiece
from odd import odd

from lexweave.llm import mixing, near_join, pieces, secret_scan


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["language", "near_duplicates", "secrets", "mixing", "pieces"]
    seen = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, data).cache()
        seen[name] = out.collect()
        if name != "pieces":
            assert out.columns == docs.columns
        docs = out
    assert len(seen["language"]) >= 0.98 * 200
    left = spark.createDataFrame(seen["near_duplicates"], spark.read.parquet(f"{data}/documents.parquet").schema)
    assert near_join.join(left).filter("n_links > 0").count() == 0
    assert 0 < len(seen["near_duplicates"]) < len(seen["language"])
    scanner = secret_scan.Scanner()
    assert not any(s for found in scanner.scan([r["text"] for r in seen["secrets"]]) for s in found)
    want = {r["doc_id"]: r["copies"] for r in mixing.copies(spark.createDataFrame(seen["secrets"], left.schema)).collect()}
    for i, n in want.items():
        assert sum(r["doc_id"] == i for r in seen["mixing"]) == n
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file())
    texts = {r["doc_id"]: r["text"] for r in seen["mixing"]}
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in seen["pieces"])
    assert C.run(spark, data).count() == len(seen["pieces"])


def odd_documents(spark):
    """The odd rows, with columns that have the names of those that operators add."""
    more = ["score", "lang_pred", "SHARES", "mark_of_text", "number_of_copy", "text_to_read", "plan_id", "component"]
    return odd(spark).selectExpr("*", *(f"'c' as `{c}`" for c in more if c not in odd(spark).columns), "1 as `a.b`")


def test_odd_tables(spark, tmp_path):
    odd_documents(spark).write.parquet(f"{tmp_path}/odd/documents.parquet")
    odd_documents(spark).limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for folder in ("odd", "empty"):
        docs = spark.read.parquet(f"{tmp_path}/{folder}/documents.parquet")
        whole = docs
        for name, stage in C.STAGES[:-1]:
            before, docs = docs, stage(spark, docs, f"{tmp_path}/{folder}").cache()
            assert docs.columns == whole.columns, name
            # each stage takes the table itself too, not only what its predecessor kept
            assert stage(spark, whole, f"{tmp_path}/{folder}").count() <= 2 * whole.count()
            assert docs.count() <= before.count() * (2 if name == "mixing" else 1)
        out = C.run(spark, f"{tmp_path}/{folder}").collect()
        assert len(out) == docs.count() and (folder == "empty") == (not out)
    first = C.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/odd/documents.parquet"), "").collect()
    assert all(r["text"] and r["text"].strip() for r in first) and len(first) >= 10


def test_whole_run_against_plain_code(spark, data):
    """run() on a small table: what each stage may keep, worked out from the stages' plain forms."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = C.run(spark, data).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file())
    scanner = secret_scan.Scanner()

    def clean(text):
        parts, end = [], 0
        for s, _, e in scanner.scan([text])[0]:
            if s >= end:
                parts += [text[end:s], "[secret]"]
            end = max(end, e)
        return "".join([*parts, text[end:]])

    shingles = {}
    for i, r in docs.items():
        w = (r["text"] or "").encode().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    ids = sorted({r["doc_id"] for r in out})
    for r in out:
        text = clean(docs[r["doc_id"]]["text"])
        assert r["ids"] == library.encode(text) and r["decoded_sha256"] == hashlib.sha256(library.decode(r["ids"]).encode()).hexdigest()
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            assert 5 * len(shingles[a] & shingles[b]) < 4 * len(shingles[a] | shingles[b])
    assert max(collections.Counter(r["doc_id"] for r in out).values()) <= 2
