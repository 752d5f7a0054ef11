"""Quality rules: base counts of each text, and lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, stage, text_bytes

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Words in repeated windows, per cent of all words, at most.
MAX_REPEAT_PCT = 50
#: A line goes if more than this share of its host's documents hold it, and more than MIN_DOCS of them.
MAX_LINE_SHARE, MIN_DOCS = 0.05, 10
#: A document is depleted if fewer words are left, or a smaller share of its words.
MIN_LEFT, MIN_LEFT_SHARE = 20, 0.5

_PROFILE = pa.schema([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("text_hash", pa.int64()), ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32())),
])
_PROFILE_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, lines array<long>, line_words array<int>"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    count, until = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            count += i + 3 - max(i, until)
            until = i + 3
    return count


def line_key(line: bytes) -> bytes:
    """A line's words, lower-cased (A-Z), with single spaces."""
    return b" ".join(line.lower().split())


def _signed(data: bytes) -> int:
    h = xxhash.xxh64_intdigest(data, 42)
    return h - 2**64 if h >> 63 else h


def profile(text: bytes) -> tuple:
    words = text.split()
    inside = b"".join(words)
    chars = len(inside.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    counts: dict[int, int] = {}
    raw, n_lines = set(), 0
    for line in text.split(b"\n"):
        key = line_key(line)
        if key:
            n_lines += 1
            raw.add(line)
            h = _signed(key)
            counts[h] = counts.get(h, 0) + key.count(b" ") + 1
    return len(words), chars, symbols, n_lines - len(raw), repeat_words(words), _signed(text), list(counts), list(counts.values())


def _profiles(fields: pa.Schema):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it, "_text"):
            rows = list(zip(*(profile(t) for t in batch.column("_text").to_pylist())))
            cols = [batch.column(0), batch.column(1), *(pa.array(v, f.type) for v, f in zip(rows, _PROFILE))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "host", *_PROFILE.names])
    return run


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_line_share: float = MAX_LINE_SHARE, min_docs: int = MIN_DOCS, texts_only: bool = False) -> DataFrame:
    """Base counts of each text and the verdict of the line rule.

    Lines are compared by a hash of their lower-cased words. For each host the documents (rows) that hold a line are counted,
    each once however often it has the line; with texts_only equal texts count once, so that many copies of a clean document
    don't turn its lines into boilerplate. A line above both limits is removed from all documents of the host. A document is kept if
    its base counts pass and, where lines went, at least MIN_LEFT words and MIN_LEFT_SHARE of them are left.

    Returns for each input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_left (words that stay). Null and empty texts have zeros and fail. Null hosts are one host. Repeated rows give
    repeated rows of results.
    """
    id_type = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_bytes(text_col).alias("_text"))
    rows = slim.mapInArrow(_profiles(_PROFILE), f"doc_id {id_type}, host string, {_PROFILE_DDL}")
    rows = stage(rows.withColumn("host", F.coalesce(F.col("host"), F.lit("\0"))), "profiles")
    held = rows.select("host", "text_hash", F.explode("lines").alias("line"))
    whole, held = (rows.select("host", "text_hash").distinct(), held.distinct()) if texts_only else (rows, held)
    in_host = whole.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    held = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    # At most (lines of a text) / max_line_share lines of a host pass; Spark sees their size and picks the join.
    hot = held.filter(F.col("n") > min_docs).join(in_host, "host").filter(F.col("n") > max_line_share * F.col("docs")).select("host", "line")
    lines = rows.select("host", "text_hash", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("host", "text_hash", F.col("l.lines").alias("line"), F.col("l.line_words").alias("w"))
    # Texts that are equal lose the same lines, so one row of each is enough.
    gone = lines.distinct().join(hot, ["host", "line"]).groupBy("host", "text_hash").agg(F.sum("w").alias("gone"))
    out = rows.drop("lines", "line_words").join(gone, ["host", "text_hash"], "left").withColumn("n_left", F.col("n_words") - F.coalesce(F.col("gone"), F.lit(0)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    depleted = F.col("gone").isNotNull() & ((F.col("n_left") < MIN_LEFT) | (F.col("n_left") < MIN_LEFT_SHARE * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~depleted).alias("kept"), "n_left")
