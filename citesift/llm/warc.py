"""WARC derivatives: metadata and plain-text conversion records from responses."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of

CRLF = "\r\n"
#: Elements whose content isn't text, dropped whole; elements that end a line.
HIDDEN = ("script", "style", "head", "noscript", "template")
BREAKS = "p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|blockquote|pre"
#: Entities replaced in the text, in this order; numeric ones follow, and the ampersand comes last.
ENTITIES = (("nbsp", " "), ("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"))


def _id(kind: str, *parts: Column) -> Column:
    """A UUID URN fixed by what it names, so reruns give the same ids."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(block.cast("binary")))


_COMMENT = re.compile(r"<!--.*?-->", re.S)
_HIDDEN = [re.compile(rf"<{tag}(\s[^>]*)?>.*?</{tag}\s*>", re.S | re.I | re.A) for tag in HIDDEN]
_BREAK = re.compile(rf"</?({BREAKS})(\s[^>]*)?/?>", re.I | re.A)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.S | re.I | re.A)
_LINK = re.compile(r"<a[ \t\r\n][^>]*href=", re.I | re.A)


_NUMERIC = re.compile("&#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));")


def _character(entity: re.Match) -> str:
    """The character that a numeric entity names; one that names none stays as it is."""
    code = int(entity[1]) if entity[1] else int(entity[2], 16)
    return chr(code) if 0 < code < 0xD800 or 0xE000 <= code < 0x110000 else entity[0]


def plain_text(html: str) -> str:
    """The visible text of a page: hidden elements, comments and tags go, block elements end lines, entities are
    replaced, and white space is collapsed."""
    t = _COMMENT.sub("", html)
    for pattern in _HIDDEN:
        t = pattern.sub(" ", t)
    t = _TAG.sub("", _BREAK.sub("\n", t))
    for name, to in ENTITIES:
        t = t.replace(f"&{name};", to)
    t = _NUMERIC.sub(_character, t).replace("&amp;", "&")
    return re.sub(" ?\n[ \n]*", "\n", re.sub("[ \t\r\f\xa0]+", " ", t)).strip(" \n")


def title_of(html: str) -> str:
    found = _TITLE.search(html)
    return re.sub("[ \t\r\n\f]+", " ", found[1]) if found else ""


def _read_pages(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches_of(it, "payload"):
        pages = b.column("payload").to_pylist()
        cols = [pa.array([plain_text(x) for x in pages], pa.string()), pa.array([title_of(x) for x in pages], pa.string()), pa.array([len(_LINK.findall(x)) for x in pages], pa.int32())]
        yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "_text", "_title", "_links"])


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages (page_id, url, html): page_id, record_id, target_uri, date, http_headers, payload.

    Null html is an empty page, a null url an empty URI. Rows that repeat a page give the same record twice."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", _id("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, _digest(html)).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), html.alias("payload"))


def derivatives(found: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response.

    Returns page_id, record_type, record_id, refers_to (the response), target_uri, date, content_type, content_length, block_digest,
    source_digest (of the response's payload; as the source states it where found has a column source_digest that isn't null), block. The metadata
    lists the response's status, all its headers (http- before the name), its length and digest, its title, the number of links and of characters of its
    text. Work is by row, without a shuffle; an empty page gives an empty conversion. Repeated rows give repeated records, an empty table none; pages
    are read whole, in batches of about 16 MB or a single longer one. Further columns are dropped."""
    stated = F.col("source_digest").cast("string") if "source_digest" in found.columns else F.lit(None).cast("string")
    found = found.select("page_id", "record_id", "target_uri", "date", "http_headers", "payload", stated.alias("_stated"))
    fields = ", ".join(f"{name} {kind}" for name, kind in found.dtypes)
    read = found.mapInArrow(_read_pages, f"{fields}, _text string, _title string, _links int")
    rows = read.withColumn("_source", F.coalesce("_stated", _digest(F.col("payload"))))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    lines = F.filter(F.slice(F.split("http_headers", "\r?\n"), 2, 1 << 30), lambda x: x != "")
    folded = lambda x: F.startswith(x, F.lit(" ")) | F.startswith(x, F.lit("\t"))
    headers = F.array_join(F.transform(lines, lambda x: F.concat(F.when(folded(x), "").otherwise("http-"), x, F.lit(CRLF))), "")
    meta = F.concat(
        field("http-status", F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)), headers,
        field("payload-length", F.octet_length("payload").cast("string")), field("payload-digest", F.col("_source")), field("title", F.col("_title")),
        field("outlinks", F.col("_links").cast("string")), field("text-length", F.length("_text").cast("string")),
    )
    block = lambda kind, type_, body: F.struct(F.lit(kind).alias("record_type"), F.lit(type_).alias("content_type"), body.alias("block"))
    rows = rows.select("page_id", "record_id", "target_uri", "date", "_source", F.explode(F.array(block("metadata", "application/warc-fields", meta), block("conversion", "text/plain; charset=utf-8", F.col("_text")))).alias("r"))
    return rows.select(
        "page_id", F.col("r.record_type").alias("record_type"), _id("derived", F.col("r.record_type"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"),
        "target_uri", "date", F.col("r.content_type").alias("content_type"), F.octet_length("r.block").cast("long").alias("content_length"), _digest(F.col("r.block")).alias("block_digest"),
        F.col("_source").alias("source_digest"), F.col("r.block").alias("block"),
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """(page_id, record_type, record): each derivative as the bytes of a WARC/1.1 record."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.regexp_replace("target_uri", "[\\r\\n]", "")), line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF),
    )
    return records.select("page_id", "record_type", F.concat(head, F.col("block"), F.lit(CRLF * 2)).cast("binary").alias("record"))


def compressed(records: DataFrame) -> DataFrame:
    """Each record of record_bytes as a gzip member of its own, as WARC files hold them; members can be joined in any order."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([gzip.compress(x, mtime=0) for x in b.column(2).to_pylist()], pa.binary())], names=["page_id", "record_type", "member"])
    return records.mapInArrow(run, f"page_id {dict(records.dtypes)['page_id']}, record_type string, member binary")


#: What stands between two records, up to the minor version of the second.
_BETWEEN = "\r\n\r\nWARC/1."


def parse(piece: bytes) -> tuple[dict[str, str], bytes, bool]:
    """Headers (names in lower case), block, and whether the block has the length stated, of the bytes of one record. Its
    version line may lack all before the minor version."""
    head, _, rest = piece.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split(CRLF)[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}
    size = headers.get("content-length", "")
    whole = size.isdecimal() and len(rest) >= int(size)
    return headers, rest[: int(size)] if whole else rest, whole


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, headers, block, whole) of all records of the WARC files at path, plain or in gzip members.

    Plain files are cut into splits; a task holds one record at a time, never a file. A block that itself holds the start of a record is cut there: its
    record isn't whole, which the column tells."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [parse(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(h.items()) for h, *_ in found], pa.map_(pa.string(), pa.string())), pa.array([x for _, x, _ in found], pa.binary()), pa.array([w for *_, w in found])], names=["path", "headers", "block", "whole"])
    pieces = spark.read.option("lineSep", _BETWEEN).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))
    return pieces.filter(F.octet_length("piece") > 2).mapInArrow(run, "path string, headers map<string,string>, block binary, whole boolean")


def recorded_responses(records: DataFrame) -> DataFrame:
    """The responses among rows of read_records, as derivatives takes them: page_id (the record's id), record_id, target_uri, date, http_headers, payload, source_digest.

    Payloads are read as UTF-8, ill-formed bytes as U+FFFD; the digest is that of the source's WARC-Payload-Digest, or null."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            parts = [x.partition(b"\r\n\r\n") for x in b.column("block").to_pylist()]
            text = lambda k: pa.array([p[k].decode("utf-8", "replace") for p in parts], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text(0), text(2)], names=[*b.schema.names[:-1], "http_headers", "payload"])

    header = lambda name: F.try_element_at("headers", F.lit(name))
    named = records.filter(header("warc-type") == "response").select(
        header("warc-record-id").alias("page_id"), header("warc-record-id").alias("record_id"), F.coalesce(header("warc-target-uri"), F.lit("")).alias("target_uri"),
        F.coalesce(header("warc-date"), F.lit("")).alias("date"), header("warc-payload-digest").alias("source_digest"), "block",
    )
    return named.mapInArrow(run, "page_id string, record_id string, target_uri string, date string, source_digest string, http_headers string, payload string")


def _oracle() -> str:
    t = r"regexp_replace(payload, '(?s)<!--.*?-->', '', 'g')"
    for tag in HIDDEN:
        t = rf"regexp_replace({t}, '(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)</?({BREAKS})(\s[^>]*)?/?>', chr(10), 'g')"
    t = rf"regexp_replace({t}, '(?s)<[/!?a-zA-Z][^>]*>', '', 'g')"
    for name, to in ENTITIES:
        quoted = to.replace("'", "''")
        t = f"replace({t}, '&{name};', '{quoted}')"
    code = "CASE WHEN lower(e[3]) = 'x' THEN ('0x' || e[4:-2])::INT ELSE e[3:-2]::INT END"
    valid = f"({code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111)"
    entities = f"list_prepend({t}, list_distinct(regexp_extract_all({t}, '&#(?:[0-9]{{1,7}}|[xX][0-9a-fA-F]{{1,6}});')))"
    t = f"replace(list_reduce({entities}, lambda a, e: CASE WHEN {valid} THEN replace(a, e, chr({code})) ELSE a END), '&amp;', '&')"
    t = rf"regexp_replace(regexp_replace({t}, '[ \t\r\f\x{{A0}}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')"
    t = rf"regexp_replace({t}, '^[ \n]+|[ \n]+$', '', 'g')"
    uuid = lambda e: f"'<urn:uuid:' || regexp_replace(md5({e}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '\\1-\\2-\\3-\\4-') || '>'"
    nl = "chr(13) || chr(10)"
    return rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, 'sha1:' || sha1(payload) AS src, {t} AS txt, {uuid("'response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || target_uri || chr(10) || 'sha1:' || sha1(payload)")} AS rid FROM p),
b AS (
  SELECT *, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type, txt AS block FROM r
  UNION ALL
  SELECT *, 'metadata', 'application/warc-fields',
    'http-status: 200' || {nl} || 'http-Content-Type: text/html; charset=utf-8' || {nl} || 'http-Content-Length: ' || strlen(payload) || {nl} || 'payload-length: ' || strlen(payload) || {nl} || 'payload-digest: ' || src || {nl}
    || 'title: ' || regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\r\n\f]+', ' ', 'g') || {nl}
    || 'outlinks: ' || len(regexp_extract_all(payload, '(?i)<a[ \t\r\n][^>]*href=')) || {nl} || 'text-length: ' || length(txt) || {nl} FROM r)
SELECT page_id, record_type, {uuid("'derived' || chr(10) || record_type || chr(10) || rid")} AS record_id, rid AS refers_to, target_uri, '2024-01-01T00:00:00Z' AS date, content_type,
  strlen(block)::BIGINT AS content_length, 'sha1:' || sha1(block) AS block_digest, src AS source_digest
FROM b
"""


#: The same records in DuckDB, from the table pages.
ORACLE_SQL = _oracle()
