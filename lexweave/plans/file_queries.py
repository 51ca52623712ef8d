"""Files as rows: parsers run on the contents of tables that stand for folders of files."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from ..registry import query
from ..sources import readers
from ..sources.office import Parsed


def _by_paragraph(content: bytes) -> Parsed:
    """A parser for these tables: a page ends with a paragraph."""
    return Parsed(content.decode().split("</p>"), method="paragraphs")


def web_files(t):
    return t.pages.select(F.concat(F.lit("files/"), F.col("page_id").cast("string"), F.lit(".web")).alias("path"), F.encode("html", "UTF-8").alias("content"))


@query("s1_whole_texts", "SELECT 'files/' || page_id::VARCHAR || '.web' AS path, md5(array_to_string(list_filter(string_split(html, '</p>'), lambda p: p <> ''), chr(10))) AS text_md5 FROM pages")
def s1(t):
    return readers.whole_texts(readers.parse_files(web_files(t), {"web": _by_paragraph})).select("path", F.md5("text").alias("text_md5"))


@query("s2_pages", r"SELECT 'files/' || page_id::VARCHAR || '.web' AS path, k::INT AS page, md5(p) AS text_md5 FROM (SELECT page_id, unnest(string_split(html, '</p>')) AS p, generate_subscripts(string_split(html, '</p>'), 1) AS k FROM pages) WHERE regexp_replace(p, '\s+', '', 'g') <> ''")
def s2(t):
    return readers.pages(readers.parse_files(web_files(t), {"web": _by_paragraph})).select("path", "page", F.md5("text").alias("text_md5"))


@query("s3_fallback", """
WITH f AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN ' page ' || item_id::VARCHAR ELSE text END AS t FROM benchmark)
SELECT item_id, CASE WHEN length(trim(t)) < 100 THEN 'scan' ELSE 'plain' END AS method, md5(CASE WHEN length(trim(t)) < 100 THEN 'seen: ' || t ELSE t END) AS text_md5, NULL::VARCHAR AS error FROM f""")
def s3(t):
    content = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit(" page "), F.col("item_id").cast("string"))).otherwise(F.col("text"))
    files = t.benchmark.select("item_id", F.concat(F.col("item_id").cast("string"), F.lit(".scan")).alias("path"), F.encode(content, "UTF-8").alias("content"))
    plain = lambda c: Parsed([c.decode()], method="plain")
    scan = lambda c: Parsed(["seen: " + c.decode()], method="scan")
    return readers.parse_files(files, {"scan": plain}, {"scan": scan}).select("item_id", "method", F.md5("text").alias("text_md5"), "error")


def workbook(sheets: dict[str, list[list[str]]]) -> bytes:
    """An Excel file of text cells."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' for v in row) + "</row>" for row in rows)
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


@query("s4_tables", "SELECT 'r' || n_regionkey::VARCHAR || '.xlsx' AS path, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INT AS row, n_nationkey::VARCHAR || '|' || n_name AS cells, '=== シート: ' || r_name || ' ===' AS head FROM nation JOIN region ON r_regionkey = n_regionkey")
def s4(t):
    @F.pandas_udf("binary")
    def written(name: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([workbook({n: [[r["k"], r["n"]] for r in x]}) for n, x in zip(name, rows, strict=True)])

    rows = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("o"), F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("n")))).alias("rows"))
    named = rows.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    files = named.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".xlsx")).alias("path"), written("r_name", "rows").alias("content"))
    parsed = readers.parse_files(files)
    heads = parsed.select("path", F.substring_index("text", "\n", 1).alias("head"))
    return readers.tables(parsed).join(heads, "path").select("path", "row", F.array_join("cells", "|").alias("cells"), "head")
