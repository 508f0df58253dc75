"""Statements from files and columns, as doc_id, source_file, text."""

from __future__ import annotations

import importlib.util
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.references import form_fields
from ..operators.classify import file_kind

PDF = "struct<text:string,pages:int,info:map<string,string>>"
#: Columns of the binaryFile source, which a stream must be told.
BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"
TRANSACTION = "array<struct<date:string,description:string,amount:double,balance:double>>"


def utf8(content: Column) -> Column:
    """Bytes as text whatever they are: what is not UTF-8 becomes replacement characters (U+FFFD); a byte-order mark stays."""
    return F.make_valid_utf8(content.cast("string"))


def decoded(files: DataFrame) -> DataFrame:
    """doc_id, source_file, kind, pages, info, text, error_code from path and content (as of the binaryFile source), and mime if it is there.

    A text is one page; a PDF has its count of pages and its information fields; other files have neither. Texts and
    files of unknown kinds are read as UTF-8 (see utf8). PDF needs the pypdf library where the executors run; without
    it such files have an error code and no text.
    """
    kind = file_kind(F.col("path"), F.col("mime") if "mime" in files.columns else None)
    has_pdf = importlib.util.find_spec("pypdf") is not None
    files = files.withColumn("pdf", F.pandas_udf(_pages, PDF)(F.when(kind == "pdf", F.col("content"))) if has_pdf else F.lit(None).cast(PDF))
    text = F.coalesce(F.when(kind != "pdf", utf8(F.col("content"))), F.col("pdf.text"))
    error = F.when(F.col("content").isNull(), "NO_FILE_BUFFER").when((kind == "pdf") & F.lit(not has_pdf), "PDF_LIBRARY_MISSING").when((kind == "pdf") & F.col("pdf.text").isNull(), "PARSER_ERROR")
    return files.select(F.xxhash64("path", "content").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("source_file"), kind.alias("kind"), F.when(kind == "text", 1).otherwise(F.col("pdf.pages")).alias("pages"), F.col("pdf.info").alias("info"), text.alias("text"), error.alias("error_code"))


def read_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Any number of files of any kind; each is one row, so they are read in parallel and one bad file stops no other."""
    return decoded(spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths))


def _pages(parts: pd.Series) -> pd.DataFrame:
    """PDF's fields of each file; nothing for null and for files that can't be read."""
    import io

    from pypdf import PdfReader

    out = []
    for b in parts:
        found = {"text": None, "pages": None, "info": None}
        if b is not None:
            try:
                reader = PdfReader(io.BytesIO(b))
                info = {str(k).lstrip("/"): str(v) for k, v in (reader.metadata or {}).items()}
                found = {"text": "\n".join(p.extract_text() or "" for p in reader.pages), "pages": len(reader.pages), "info": info}
            except Exception:  # noqa: BLE001 - a damaged file may raise anything, and must stop no other
                pass
        out.append(found)
    return pd.DataFrame(out, columns=["text", "pages", "info"]).astype({"pages": "Int32"})


def union_sources(**sources: DataFrame) -> DataFrame:
    """All rows of several tables with the name of the source in source_file; columns by name, missing ones null."""
    out = None
    for name, df in sources.items():
        df = df.withColumn("source_file", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def either_column(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """name: the first column where it has something, else the second. Both may be missing."""
    have = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in (first, second) if c in df.columns]
    return df.withColumn(name, F.coalesce(*have) if have else F.lit(None).cast("string"))


def json_transactions(body: Column) -> Column:
    """A request body as an array of transactions; null if it isn't one."""
    return F.from_json(body, TRANSACTION)


def form(body: Column) -> Column:
    return form_fields(body)


def database(spark: SparkSession, url: str, table: str, properties: dict | None = None, spread: str | None = None, parts: int = 8, where: Column | None = None) -> DataFrame:
    """Rows of a database table, read by several connections at once: the number or time column `spread` is cut into `parts` ranges between its least and greatest value, which one query asks for.

    where and the columns that are used are part of each connection's query. Rows without a value of spread are read too.
    """
    properties = properties or {}
    if spread is None:
        rows = spark.read.jdbc(url, table, properties=properties)
    else:
        name = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(spread)  # as this database quotes it
        ends = spark.read.jdbc(url, f"(SELECT MIN({name}) AS low, MAX({name}) AS high FROM {table}) ends", properties=properties).toDF("low", "high").first()
        if ends.low is None:
            rows = spark.read.jdbc(url, table, properties=properties)
        else:
            rows = spark.read.jdbc(url, table, column=spread, lowerBound=str(ends.low), upperBound=str(ends.high), numPartitions=parts, properties=properties)
    return rows if where is None else rows.where(where)


def by_key(spark: SparkSession, url: str, table: str, key: str, value, properties: dict | None = None) -> DataFrame:
    """Rows of a database table by key; the condition is part of the query that the database gets."""
    return database(spark, url, table, properties, where=F.col(key) == F.lit(value))
