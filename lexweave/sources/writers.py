"""Tables to files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def _enclosed(rows: DataFrame, opening: str, closing: str) -> DataFrame:
    """(value): each partition's lines between the brackets, with commas between them; a line at a time."""

    def run(batches):
        told = lambda lines: pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield told([opening])
        last = None
        for batch in batches:
            lines = [x for x in [last, *batch.column(0).to_pylist()] if x is not None]
            if lines:
                yield told([x + "," for x in lines[:-1]])
                last = lines[-1]
        yield told([x for x in (last, closing) if x is not None])

    return rows.mapInArrow(run, "value string")


def json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A JSON array of objects in each file; one file if the table has one partition."""
    _enclosed(df.select(F.to_json(F.struct(*df.columns)).alias("value")), "[", "]").write.mode(mode).text(path)


def json_dictionary(df: DataFrame, key: str, path: str, mode: str = "overwrite") -> None:
    """A JSON object in each file: the other columns as an object by the key."""
    rest = [c for c in df.columns if c != key]
    name = F.regexp_extract(F.to_json(F.array(F.col(key).cast("string"))), r"(?s)^\[(.*)\]$", 1)
    _enclosed(df.select(F.concat(name, F.lit(": "), F.to_json(F.struct(*rest))).alias("value")), "{", "}").write.mode(mode).text(path)


#: Fixed value: the mark that tells spreadsheets that a file is UTF-8.
BYTE_ORDER_MARK = "\ufeff"
# The columns of a table of tasks for spreadsheets.
TASK_COLUMNS = ("タスクID", "タイトル", "担当者", "依頼者", "期限", "優先度", "ステータス", "タグ", "説明")


def csv(df: DataFrame, path: str, lists: dict[str, str] | None = None, names: tuple[str, ...] | None = None) -> None:
    """CSV files for spreadsheets, each with the byte order mark and a header; array columns are joined by their separator."""
    for name, separator in (lists or {}).items():
        df = df.withColumn(name, F.array_join(name, separator))
    df = df.toDF(*(names or df.columns))
    df = df.withColumnRenamed(df.columns[0], BYTE_ORDER_MARK + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').option("emptyValue", "").csv(path)


def lines(df: DataFrame, column: str, path: str, mode: str = "append") -> None:
    """A log: one line of text for each row."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def report(title: str, df: DataFrame, group: str, line: Column, order: list) -> DataFrame:
    """(group, markdown): a heading and one bullet for each row of the group, in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return df.groupBy(group).agg(items.alias("i")).select(group, F.concat(F.lit(f"## {title} "), F.col(group).cast("string"), F.lit("\n"), F.array_join(F.transform("i", lambda x: F.concat(F.lit("- "), x["line"])), "\n")).alias("markdown"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` in place of the rows of ``old`` with the same key; to be written to another path than either is read from."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
