"""Files and request bodies as tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
NOT_WORD = "The file is a zip archive, but no Word document."
NOT_TEXT = "Only PDF, Word (.docx) and plain text files can be read."
NO_PDF = "No PDF reader is installed."


def docx_text(content: bytes) -> str:
    """The text of a Word document, a blank line between paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = []
    for p in root.iter(f"{_WORD}p"):
        parts = []
        for node in p.iter():
            if node.tag == f"{_WORD}t":
                parts.append(node.text or "")
            elif node.tag in (f"{_WORD}tab", f"{_WORD}br"):
                parts.append("\t" if node.tag.endswith("tab") else "\n")
        lines.append("".join(parts))
    return "\n\n".join(lines)


def _read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        texts, errors = [], []
        for content, kind in zip(pdf["content"], pdf["kind"]):
            text, error = None, None
            if kind == "docx":
                try:
                    text = docx_text(content)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    error = NOT_WORD
            elif kind == "pdf":
                error = NO_PDF
            else:
                text = content.decode("utf-8", "replace").removeprefix("﻿")
            texts.append(text)
            errors.append(error)
        yield pd.DataFrame({"path": pdf["path"], "kind": pdf["kind"], "text": texts, "error": errors})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text, truncated, error) of the files at path. A file that can't be read is a row with its error;
    Spark's file source gives no row for a file without bytes."""
    files = spark.read.format("binaryFile").load(path)
    size_error = documents.file_error(F.col("length"))
    files = files.select("path", "content", documents.sniff(F.col("content")).alias("kind"), size_error.alias("_size_error"))
    good = files.filter("_size_error is null").select("path", "content", "kind").mapInPandas(_read, "path string, kind string, text string, error string")
    binary = F.when((F.col("kind") == "text") & documents.is_binary(F.col("text")), NOT_TEXT)
    good = good.withColumn("_in", documents.intake(F.col("text"), F.col("kind"))).withColumn("error", F.coalesce("error", binary, F.col("_in.error")))
    good = good.select("path", "kind", F.when(F.col("error").isNull(), F.col("_in.text")).alias("text"), F.col("_in.truncated").alias("truncated"), "error")
    bad = files.filter("_size_error is not null").select("path", "kind", F.lit(None).cast("string").alias("text"), F.lit(False).alias("truncated"), F.col("_size_error").alias("error"))
    return good.unionByName(bad)


def parse_bodies(bodies: DataFrame, col: str = "body") -> DataFrame:
    """bodies, a table or a stream, with question, language, text, body_ok (false for JSON that can't be parsed or isn't an object) and
    body_null (true for JSON's null)."""
    parsed = F.from_json(F.col(col), "question string, language string, text string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    whole = F.trim(F.col(col)).startswith("{")
    ok = F.coalesce(whole & F.col("_p._corrupt").isNull(), F.lit(False))
    null = F.coalesce(F.regexp_replace(F.col(col), r"[ \t\r\n]", "") == "null", F.lit(False))
    out = bodies.withColumn("_p", parsed)
    return out.select("*", F.col("_p.question").alias("question"), F.col("_p.language").alias("language"), F.col("_p.text").alias("text"), ok.alias("body_ok"), null.alias("body_null")).drop("_p")


def bodies_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of request bodies, one for each line of the text files that arrive at path, parsed. A body that can't be parsed is a row, too."""
    return parse_bodies(spark.readStream.options(**options).text(path).withColumnRenamed("value", "body"))
