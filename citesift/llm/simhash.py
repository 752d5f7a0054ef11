"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, small_batches, stage, text_bytes
from .components import components

#: Fingerprints link at this many differing bits or fewer; two segments then leave one with a single differing bit at most.
MAX_BITS, SEGMENTS, SEGMENT_BITS = 2, 2, 32
#: Signature groups of up to so many fingerprints are compared pair by pair; larger ones by finer variants.
PAIR_GROUP = 256
SHINGLE_WORDS = 3


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text: a bit is set if more than half of its shingles' XXH64 (seed 42) have it."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    k = max(1, n - shingle_words + 1)
    starts, stops = (ends - lens)[:k].tolist(), ends[min(n, shingle_words) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, k, 1 << 16):
        part = [joined[a:b] for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(42)), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > k, bitorder="little").view(np.uint64)[0])


def _fingerprints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(it, "_text", 1 << 20):
        fp = np.array([fingerprint(t) for t in batch.column("_text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; null and wordless texts have fingerprint zero."""
    slim = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("_text"))
    return slim.mapInArrow(_fingerprints, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


_SEGMENT = "shiftrightunsigned(fp, 32 * s) & 4294967295"
_OTHER = "shiftrightunsigned(fp, 32 * (1 - s)) & 4294967295"


def links(fps: DataFrame) -> DataFrame:
    """All links between distinct fingerprints (column fp) as pairs u, v, or as stars that join the same fingerprints.

    A signature is a segment with one of its bits taken out. Fingerprints within MAX_BITS share at least one, as one
    of the two segments differs in one bit at most. Groups of one signature drop out; the others are joined on the
    signature and each pair is verified. In a large group, a link means that the other segment differs in two bits at
    most, or in one where the signature's bit differs: its variants with two bits taken out, or with one and the
    signature's bit, meet exactly where there is a link, and each member links to the smallest of its variant. So a
    group costs no more than its size times a constant.
    """
    bits = F.expr("transform(sequence(0, 63), x -> struct(x div 32 AS s, x % 32 AS j))")
    signed = fps.select("fp", F.explode(bits).alias("b")).select("fp", F.col("b.s").cast("int").alias("s"), F.col("b.j").cast("int").alias("j"))
    signed = signed.select("fp", "s", "j", F.expr(f"shiftleft(cast(s * 32 + j AS bigint), 32) | (({_SEGMENT}) & ~shiftleft(1L, j))").alias("sig"))
    groups = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stage(signed.join(groups.hint("merge"), "sig"), "signatures")
    small = shared.filter(F.col("n") <= PAIR_GROUP).select("sig", "fp")
    pairs = small.alias("a").join(small.alias("b"), F.expr("a.sig = b.sig AND a.fp < b.fp")).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    pairs = pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
    large = shared.filter(F.col("n") > PAIR_GROUP)
    two = F.expr("flatten(transform(sequence(0, 31), a -> transform(sequence(a + 1, 32), b -> struct(a, b))))")
    variant = large.select("sig", "fp", "s", "j", F.explode(two).alias("x"))
    # b = 32 stands for the signature's own bit; otherwise that bit must agree.
    own = f"shiftright({_SEGMENT}, j) & 1"
    variant = variant.select("sig", "fp", "x", F.expr(f"({_OTHER}) & ~shiftleft(1L, x.a) & (CASE WHEN x.b = 32 THEN -1L ELSE ~shiftleft(1L, x.b) END)").alias("rest"), F.expr(f"CASE WHEN x.b = 32 THEN 2L ELSE {own} END").alias("own"))
    least = variant.groupBy("sig", "x", "rest", "own").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = variant.join(least.hint("merge"), ["sig", "x", "rest", "own"]).filter("u <> fp").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(stars).distinct()


def id_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (u, v) of ids whose components are the classes of near_duplicates, for callers that join further links to them: each row
    with the least id of its fingerprint, and the least ids of fingerprints that link. A row alone has no pair. Null ids aren't served."""
    with small_batches(docs.sparkSession):
        rows = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    copies = rows.join(fps.hint("merge"), "fp").filter("doc_id <> least").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    return copies.unionByName(by_least(links(fps.select("fp")), fps))


def by_least(linked: DataFrame, fps: DataFrame) -> DataFrame:
    """The links u, v of fingerprints as links of their least ids."""
    for x in "uv":
        linked = linked.join(fps.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_id")).hint("merge"), x)
    return linked.select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose SimHash fingerprints link at MAX_BITS or fewer, directly or through others.

    Returns for each input row: doc_id, fingerprint (16 hex digits), component_id (smallest id of the class, itself
    included; null ids are ignored unless there are no others), first (this row's id is that). Copies share a fingerprint, which is indexed once.
    """
    with small_batches(docs.sparkSession):
        rows = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    roots = components(links(fps.select("fp")))
    classed = stage(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    discard(fps)
    ids = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = classed.join(ids.hint("merge"), "root").select("fp", "component_id")
    out = rows.join(by_fp.hint("merge"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first"))
