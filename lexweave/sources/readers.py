"""Files to tables.

Readers go through Spark's own sources, so paths may be in any store that the
cluster can reach, and files are read by the executors.
"""

from __future__ import annotations

import email
import email.policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import bounded_batches
from .office import PARSERS, Parsed

#: Extensions of plain text; others give an error row unless a parser is passed.
TEXT_EXTENSIONS = ("txt", "md", "csv", "json", "log", "xml", "html")


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows with their file, bad lines with their file); blank lines are skipped, a path that isn't there is empty."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file")).filter("trim(value) <> ''")
    else:
        lines = spark.createDataFrame([], "value string, file string")
    parsed = lines.withColumn("r", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.filter("r is not null and r._bad is null").select("r.*", "file").drop("_bad")
    return good, parsed.filter("r is null or r._bad is not null").select("value", "file")


def comment_titles(spark: SparkSession, path: str) -> DataFrame:
    """(doc, title) of lines like ``- ID  # title``."""
    lines = spark.read.text(path)
    pattern = r"^\s*-\s*([A-Za-z0-9_-]+)\s+#\s*(.+?)\s*$"
    return lines.select(F.regexp_extract("value", pattern, 1).alias("doc"), F.regexp_extract("value", pattern, 2).alias("title")).filter("doc <> ''")


#: What a parser gives for a file, and what is told of it.
PARSED = "struct<text:string,pages:array<string>,tables:array<array<array<string>>>,metadata:map<string,string>,method:string,error:string>"
#: A file with less text than this is given to the extension's fallback.
LEAST_TEXT = 100


def parse_one(extension: str, content: bytes, parsers: dict, fallbacks: dict | None = None, force: tuple = (), least: int = LEAST_TEXT) -> dict:
    """What the parser of an extension finds in a file.

    A parser is a function from bytes to ``Parsed`` or to the text.  If it finds
    less than ``least`` characters, or the extension is one of ``force``, the
    fallback (say, one that reads the scanned image) is asked instead.  A parser
    that fails gives an empty text and its error.
    """

    def ask(parser):
        found = parser(content)
        return Parsed([found]) if isinstance(found, str) else found

    try:
        fallback = (fallbacks or {}).get(extension)
        found = ask(fallback if fallback and extension in force else parsers[extension])
        if fallback and extension not in force and len(found.text.strip()) < least:
            found = ask(fallback)
    except Exception as problem:  # a file that can't be parsed is a row with an error
        return {"text": "", "pages": [], "tables": [], "metadata": {}, "method": "", "error": str(problem)}
    return {"text": found.text, "pages": found.pages, "tables": found.tables, "metadata": found.metadata, "method": found.method, "error": None}


def parse_files(files: DataFrame, parsers: dict | None = None, fallbacks: dict | None = None, force: tuple = (), least: int = LEAST_TEXT) -> DataFrame:
    """files (path, content) with name, extension, size, sha256, text, pages, tables, metadata, method, error in place of the content.

    Plain text is decoded in the JVM, malformed bytes replaced; ``parsers`` by
    extension go before the built-in ones; other extensions give an error.
    """
    bounded_batches(files.sparkSession)
    parsers = PARSERS | (parsers or {})
    rest = [c for c in files.columns if c not in ("path", "content")]
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = files.select(*rest, "path", "content", name.alias("name"), ext.alias("extension"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))

    @F.pandas_udf(PARSED)
    def parse(extension: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = [parse_one(e, c, parsers, fallbacks, force, least) if e in parsers and c is not None else None for e, c in zip(extension, content, strict=True)]
        return pd.DataFrame([x or dict.fromkeys(("text", "pages", "tables", "metadata", "method", "error")) for x in out])

    known = F.col("extension").isin(*parsers)
    plain = F.col("extension").isin(*[e for e in TEXT_EXTENSIONS if e not in parsers])
    text = F.make_valid_utf8(F.col("content").cast("string"))
    none = F.lit(None).cast(PARSED)
    as_text = F.struct(text.alias("text"), F.array(text).alias("pages"), none["tables"].alias("tables"), none["metadata"].alias("metadata"), F.lit("plaintext").alias("method"), F.lit(None).cast("string").alias("error"))
    unknown = F.struct(F.lit("").alias("text"), none["pages"].alias("pages"), none["tables"].alias("tables"), none["metadata"].alias("metadata"), F.lit("").alias("method"), F.concat(F.lit("unsupported extension: "), "extension").alias("error"))
    rows = rows.withColumn("p", F.when(known, parse("extension", "content")).when(plain, as_text).otherwise(unknown))
    return rows.select(*rest, "path", "name", "extension", "size", "sha256", "p.*")


def documents(spark: SparkSession, path: str, parsers: dict | None = None, **options) -> DataFrame:
    """Every file below a folder, as :func:`parse_files` gives it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return parse_files(files.select("path", "content"), parsers, **options)


def whole_texts(parsed: DataFrame) -> DataFrame:
    """(path, text): the pages that have text, a line feed between them; nothing for a file that can't be read."""
    pages = F.filter(F.coalesce("pages", F.array().cast("array<string>")), lambda p: p != "")
    return parsed.select("path", F.array_join(pages, "\n").alias("text"))


def pages(parsed: DataFrame) -> DataFrame:
    """(path, page, text) of the pages that aren't blank, counted from 1."""
    return parsed.select("path", F.posexplode("pages").alias("k", "text")).filter(F.regexp_replace("text", r"(?U)\s+", "") != "").select("path", (F.col("k") + 1).alias("page"), "text")


def tables(parsed: DataFrame) -> DataFrame:
    """(path, table, row, cells) of the tables in files, counted from 1."""
    rows = parsed.select("path", F.posexplode("tables").alias("t", "rows")).select("path", "t", F.posexplode("rows").alias("r", "cells"))
    return rows.select("path", (F.col("t") + 1).alias("table"), (F.col("r") + 1).alias("row"), "cells")


MAIL = "message_id string, subject string, sender string, recipients array<string>, cc array<string>, date string, in_reply_to string, references array<string>, body_text string, body_html string, attachments array<string>"


def parse_mail(raw: bytes) -> dict | None:
    """The fields of a MIME message; None if it has no headers."""
    message = email.message_from_bytes(raw, policy=email.policy.default)
    if not message.keys():
        return None
    people = lambda k: [str(a.addr_spec).lower() for h in message.get_all(k, []) for a in h.addresses]
    body = {"plain": None, "html": None}
    files = []
    for part in message.walk():
        if part.get_content_disposition() == "attachment":
            files.append(part.get_filename() or "")
        elif part.get_content_maintype() == "text" and part.get_content_subtype() in body and body[part.get_content_subtype()] is None:
            try:
                body[part.get_content_subtype()] = part.get_content()
            except (LookupError, UnicodeDecodeError):
                body[part.get_content_subtype()] = part.get_payload(decode=True).decode("utf-8", "replace")
    return {
        "message_id": (message["message-id"] or "").strip() or None, "subject": str(message["subject"] or ""), "sender": (people("from") or [None])[0], "recipients": people("to"), "cc": people("cc"),
        "date": str(message["date"]) if message["date"] else None, "in_reply_to": (message["in-reply-to"] or "").strip() or None, "references": (message["references"] or "").split(),
        "body_text": body["plain"] or "", "body_html": body["html"] or "", "attachments": files,
    }


def mail(spark: SparkSession, path: str, since: str | None = None, parsers: dict | None = None) -> DataFrame:
    """Messages of the ``.eml`` files below a folder, changed since a time if one is given; unreadable ones are left out.

    ``parsers`` adds functions from bytes to the same fields for other extensions, say ``msg``.
    """
    known = {"eml": parse_mail} | (parsers or {})
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(known) + "}")
    if since:
        reader = reader.option("modifiedAfter", since)

    def run(batches):
        for pdf in batches:
            found = [m for p, c in zip(pdf["path"], pdf["content"], strict=True) if (m := known[p.rpartition(".")[2].lower()](c))]
            yield pd.DataFrame(found, columns=[f.split()[0] for f in MAIL.split(", ")])

    bounded_batches(spark)
    return reader.load(path).select("path", "content").mapInPandas(run, MAIL)


def atom_entries(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """title, summary, id, published of the entries of Atom feeds."""
    one = "(?s)<entry>.*?</entry>"
    rows = feeds.select(F.explode(F.regexp_extract_all(column, F.lit(one), F.lit(0))).alias("e"))
    field = lambda n: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{n}[^>]*>(.*?)</{n}>", 1), r"\s+", " ")).alias(n)
    return rows.select(field("title"), field("summary"), field("id"), field("published"))


def new_only(rows: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't there yet."""
    return rows.join(have.select(key).distinct(), key, "left_anti")


def dictionary(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension of parameters as a table."""
    return spark.createDataFrame(rows, schema)


def yaml_dictionary(spark: SparkSession, path: str):
    """The content of a YAML dictionary file, read through Spark; needs a YAML parser on the driver."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs the yaml module") from missing
    return yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"])


def register_views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Temporary views of the Parquet tables in a folder, for SQL."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


READERS = {"json": json_array, "documents": documents, "mail": mail, "titles": comment_titles}


def reader(kind: str):
    """A reader by name."""
    if kind not in READERS:
        raise ValueError(f"unknown source: {kind}")
    return READERS[kind]
