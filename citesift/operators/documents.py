"""Document intake: format, gates, normalisation and truncation as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SPACE_CHARS, js_trim, megabytes, normalise, utf16_left, utf16_length

# The limits of files, documents and questions.
MAX_FILE_BYTES = 12 * 1024 * 1024
MIN_DOCUMENT, MAX_DOCUMENT = 200, 120_000
MIN_QUESTION, MAX_QUESTION = 5, 1000
NUL_WINDOW = 4096
DEFAULT_QUESTION = "Which rights, duties and risks does this document create, and what should be done first?"


def sniff(content: Column) -> Column:
    """pdf, docx or text by the first bytes."""
    head = F.substring(content, 1, 4)
    return F.when(head == F.lit(b"%PDF"), "pdf").when(head == F.lit(b"PK\x03\x04"), "docx").otherwise("text")


def file_error(size: Column) -> Column:
    return F.when(size == 0, "The file is empty.").when(size > MAX_FILE_BYTES, F.concat(F.lit("The file has "), megabytes(size), F.lit(" MB; 12 MB is the limit.")))


def is_binary(text: Column) -> Column:
    return F.contains(F.substring(text, 1, NUL_WINDOW), F.lit("\0"))


def intake(text: Column, kind: Column) -> Column:
    """text (normalised, cut), truncated, kind and error of an extracted text."""
    clean = normalise(text)
    length = utf16_length(clean)
    error = F.when(length < MIN_DOCUMENT, F.when(kind == "pdf", "The PDF holds almost no text; it may be a scan.").otherwise("The file holds too little readable text."))
    return F.struct(utf16_left(clean, MAX_DOCUMENT).alias("text"), (length > MAX_DOCUMENT).alias("truncated"), kind.alias("kind"), error.alias("error"))


def _short(text: Column, least: int) -> Column:
    """Null, or fewer than so many UTF-16 units when trimmed.

    Trimmed texts have so many characters if one that isn't white space comes that far behind the first such one, which is
    seen without reading the rest. Only others, which have so many bytes, are trimmed and encoded."""
    space = F.lit(SPACE_CHARS)
    reaches = F.ltrim(F.substr(F.ltrim(text, space), F.lit(least)), space) != ""
    return text.isNull() | F.when(reaches, False).when(F.octet_length(text) < least, True).otherwise(utf16_length(js_trim(text)) < least)


def _longer(text: Column, most: int) -> Column:
    """More than so many UTF-16 units. There are no fewer than characters and no more than bytes, so only texts between are encoded."""
    return F.when(F.length(text) > most, True).when(F.octet_length(text) <= most, False).otherwise(utf16_length(text) > most)


def question_status(question: Column) -> Column:
    """400 if too short when trimmed (or null), 413 if too long as it is, else 200."""
    return F.when(_short(question, MIN_QUESTION), 400).when(_longer(question, MAX_QUESTION), 413).otherwise(200)


def may_ask(question: Column) -> Column:
    """Whether a client sends a question at all: at least five UTF-16 units when trimmed."""
    return F.coalesce(utf16_length(js_trim(question)) >= MIN_QUESTION, F.lit(False))


def document_status(text: Column) -> Column:
    return F.when(_short(text, MIN_DOCUMENT), 400).when(_longer(text, MAX_DOCUMENT), 413).otherwise(200)


def question_or_default(question: Column) -> Column:
    trimmed = js_trim(question)
    return F.when(question.isNull() | (utf16_length(trimmed) <= 4), DEFAULT_QUESTION).otherwise(utf16_left(trimmed, MAX_QUESTION))


def query_question(url: Column) -> Column:
    """The first question of a URL's query, decoded, 1000 characters at most."""
    return utf16_left(F.try_url_decode(F.parse_url(url, F.lit("QUERY"), F.lit("question"))), MAX_QUESTION)
