"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands find candidates, exact sets verify them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, byte_views, discard, mix, small_batches, stage, text_bytes, word_hashes
from .components import components
from .simhash import by_least

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s ** BAND_ROWS) ** BANDS: 0.9996 at 0.8.
BANDS, BAND_ROWS = 20, 5
#: Groups of one band of up to so many sets are compared pair by pair: a small number, so that pairs grow as the
#: members do. The members of larger groups are compared where they share one of their rarest shingles, which finds all pairs.
PAIR_GROUP = 16
#: Buckets that shingles are counted in, to put the rare ones first: 2 MB, whatever the input's size. More tell more rare ones from frequent ones.
SKETCH = 1 << 18
#: Words of 64 bits that a set's shingles are folded into by parity: differing bits of two sets are no more than their differing shingles.
FOLD_WORDS = 16
#: Bytes of texts that are cut into shingles at once: their arrays take about 25 times as much.
TEXT_BYTES = 512 << 10
_EMPTY = np.uint64(0x5EED_0FAE_3E77_0001)
_CODES = np.random.default_rng(9).integers(0, 2**63, (2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle_words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of every text's shingles (lower-cased words in a row), and the n + 1 offsets of the
    texts. A text of fewer words is one shingle, and so is one without words."""
    words, at = word_hashes(data, offsets)
    n = len(at) - 1
    count = np.maximum(1, np.diff(at) - shingle_words + 1)
    doc = np.repeat(np.arange(n), count)
    first = at[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    end = at[1:][doc]
    h = np.full(len(doc), _EMPTY)
    for k in range(shingle_words if len(words) else 0):
        word = words[np.minimum(first + k, len(words) - 1)]
        h = np.where(first + k < end, mix(h * np.uint64(0x9E3779B97F4A7C15) + word), h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(n + 1))


def set_hashes(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, the same for equal sets."""
    return mix(np.add.reduceat(mix(h ^ _EMPTY), offsets[:-1]))


def band_hashes(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes (texts x BANDS) of the least shingles in BAND_ROWS orders each."""
    out = np.empty((len(offsets) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        sig = np.full(len(out), b + 1, np.uint64)
        for r in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
            sig = mix(sig * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((h ^ _CODES[0, r]) * _CODES[1, r], offsets[:-1]))
        out[:, b] = sig
    return out


def _sketcher(shingle_words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it, "_text", TEXT_BYTES):
            h, offs = shingle_sets(*byte_views(batch.column("_text")), shingle_words)
            bands = band_hashes(h, offs).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(offs), dtype=np.int32) * BANDS), pa.array(bands))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(set_hashes(h, offs).view(np.int64)), pa.array(np.diff(offs)), lists], names=["doc_id", "fp", "size", "bands"])
    return run


def _setter(shingle_words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it, "_text", TEXT_BYTES):
            h, offs = shingle_sets(*byte_views(batch.column("_text")), shingle_words)
            yield pa.RecordBatch.from_arrays([pa.array(set_hashes(h, offs).view(np.int64)), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(h.view(np.int64)))], names=["fp", "set"])
    return run


def _stars(members: DataFrame, key: str) -> DataFrame:
    """Each member of a group of one key with the group's pivot, which the key draws."""
    pivot = members.groupBy(key).agg(F.min_by(F.struct("fp", "size"), F.xxhash64("fp", key)).alias("p"))
    return members.join(pivot.hint("merge"), key).select(F.col("p.fp").alias("u"), F.col("p.size").alias("u_size"), F.col("fp").alias("v"), F.col("size").alias("v_size"))


def _pairs(members: DataFrame, key: str) -> DataFrame:
    """The pairs of members of one key that no link joins yet."""
    a, b = (members.select(F.col(key), F.col("fp").alias(x), F.col("size").alias(f"{x}_size"), F.col("root").alias(f"{x}_root")) for x in "uv")
    return a.join(b.hint("merge"), key).filter("u < v AND u_root <> v_root").select("u", "u_size", "v", "v_size")


def _bucket_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's sets fall into each bucket."""
    total = np.zeros(SKETCH, np.int64)
    for batch in it:
        total += np.bincount(batch.column("set").flatten().to_numpy() & (SKETCH - 1), minlength=SKETCH)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])


def folded(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """n x FOLD_WORDS words: bit by bit, whether an odd number of a set's shingles falls on the bit. of: the set of each shingle."""
    bits = FOLD_WORDS * 64
    odd = np.bincount(of * bits + (h >> 20 & (bits - 1)), minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view(np.int64)


def _prefixer(shared, similarity: float):
    """For mapInArrow: the rarest shingles of each set, as many as two sets of the similarity must share one of, with the folded set."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for whole in it:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                column = batch.column("set")
                offsets, h = column.offsets.to_numpy().astype(np.int64), column.flatten().to_numpy()
                offsets = offsets - offsets[0]
                sizes = np.diff(offsets)
                of = np.repeat(np.arange(batch.num_rows), sizes)
                order = np.lexsort((h, counts[h & (SKETCH - 1)], of))
                first = sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + 1
                kept = order[np.arange(len(h)) - np.repeat(offsets[:-1], sizes) < first[of]]
                rows, fold = pa.array(of[kept]), folded(h, of, batch.num_rows)[of[kept]]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).take(rows) for x in ("fp", "size", "root")), pa.array(h[kept]), *(pa.array(np.ascontiguousarray(fold[:, k])) for k in range(FOLD_WORDS))],
                    names=["fp", "size", "root", "h", *(f"w{k}" for k in range(FOLD_WORDS))],
                )
    return run


def _rare_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of members (fp, size, root) that no link joins yet and that share one of their rarest shingles.

    Of two sets with the similarity, each shares so many shingles with the other that some are among its rarest: with shingles in one order,
    the first size - ceil(similarity * size) + 1 of both meet. So no pair is missed, however large the group. The order is by the counts of
    SKETCH buckets of shingles, so a block that very many members share pairs none of them, as its shingles come last. Members of a shingle's
    most frequent root are only compared with those of others, and only pairs leave the join whose folded sets differ in no more bits than
    sets of the similarity can differ in shingles."""
    spark = members.sparkSession
    rows = stage(members.join(sets.hint("merge"), "fp").select("fp", "size", "root", "set"), "large-sets")
    often = rows.select("set").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SKETCH, np.int64)
    counts[often.column("bucket").to_numpy()] = often.column("n").to_numpy()
    words = [f"w{k}" for k in range(FOLD_WORDS)]
    with small_batches(spark):
        rare = stage(rows.mapInArrow(_prefixer(spark.sparkContext.broadcast(counts), similarity), f"fp long, size long, root long, h long, {', '.join(f'{w} long' for w in words)}"), "rare-shingles")
    by_root = rare.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n"))
    main = by_root.groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("h", "main")
    parted = stage(rare.join(main.hint("merge"), "h"), "parted-shingles")
    side = lambda df, x: df.select("h", *(F.col(c).alias(f"{x}_{c}") for c in ("fp", "size", "root", *words)))
    both = side(parted.filter("root <> main"), "u").join(side(parted, "v").hint("merge"), "h")
    alike = F.least("u_size", "v_size") >= similarity * F.greatest("u_size", "v_size") - 1e-6
    differ = sum(F.bit_count(F.col(f"u_{w}").bitwiseXOR(F.col(f"v_{w}"))) for w in words)
    near = differ <= (F.col("u_size") + F.col("v_size")) * (1 - similarity) / (1 + similarity) + 1e-6
    found = both.filter((F.col("u_root") != F.col("v_root")) & alike & near).select(F.col("u_fp").alias("u"), "u_size", F.col("v_fp").alias("v"), "v_size").distinct()
    out = stage(found, "rare-pairs")
    discard(rows, rare, parted)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have the similarity, of which sizes too far apart rule out some beforehand."""
    near = pairs.filter(F.col("u") != F.col("v")).filter(F.least("u_size", "v_size") >= similarity * F.greatest("u_size", "v_size") - 1e-6)
    near = near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    near = near.join(sets.select(F.col("fp").alias("u"), F.col("set").alias("a")).hint("merge"), "u").join(sets.select(F.col("fp").alias("v"), F.col("set").alias("b")).hint("merge"), "v")
    common = F.size(F.array_intersect("a", "b"))
    return near.filter(common * (1 + similarity) >= similarity * (F.size("a") + F.size("b")) - 1e-6).select("u", "v")


def links(fps: DataFrame, sets_of, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links between distinct sets (columns fp, size, bands) as pairs u, v. sets_of gives the sets (fp, set) of a table of fps.

    First each member of a band's group is compared with one of them, which joins most of a family of copies at a cost
    in proportion to its size. Then all pairs that are still apart are compared: in groups of up to PAIR_GROUP one by one, among the members of larger
    groups where they share one of their rarest shingles, which leaves out no pair of the similarity."""
    signed = fps.select("fp", "size", F.explode("bands").alias("sig"))
    groups = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stage(signed.join(groups.hint("merge"), "sig"), "bands")
    with small_batches(fps.sparkSession):
        sets = stage(sets_of(shared.select("fp").distinct()), "sets")
    linked = stage(_verified(_stars(shared, "sig"), sets, similarity), "star-links")
    roots = components(linked)
    labelled = shared.join(roots.hint("merge"), shared.fp == roots.node, "left").select("sig", "n", "fp", "size", F.coalesce("root", "fp").alias("root"))
    labelled = stage(labelled, "labelled-bands")
    parted = labelled.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("sig")
    parted = stage(labelled.join(parted.hint("merge"), "sig"), "parted-bands")
    small, large = parted.filter(F.col("n") <= PAIR_GROUP), parted.filter(F.col("n") > PAIR_GROUP)
    rare = _rare_pairs(large.select("fp", "size", "root").distinct(), sets, similarity)
    pairs = _pairs(small, "sig").unionByName(rare)
    out = stage(linked.unionByName(_verified(pairs, sets, similarity)), "near-links")
    discard(shared, sets, linked, labelled, parted, rare)
    return out


def _searched(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, fp), the distinct sets (fp, least id) and the links between these."""
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("_text"))
    with small_batches(docs.sparkSession):
        rows = stage(slim.mapInArrow(_sketcher(shingle_words), f"doc_id {kind}, fp long, size long, bands array<long>"), "sketches")
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands")), "distinct-sets")

    def sets_of(wanted: DataFrame) -> DataFrame:
        ids = fps.join(wanted.hint("merge"), "fp", "left_semi").select(F.xxhash64("least").alias("_at")).distinct()
        texts = slim.withColumn("_at", F.xxhash64("doc_id")).join(ids.hint("merge"), "_at", "left_semi").select("_text")
        return texts.mapInArrow(_setter(shingle_words), "fp long, set array<long>").join(wanted.hint("merge"), "fp", "left_semi").dropDuplicates(["fp"])

    return rows.select("doc_id", "fp"), fps, links(fps.select("fp", "size", "bands"), sets_of, similarity)


def id_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (u, v) of ids whose components are the classes of near_duplicates, as simhash.id_links gives them."""
    rows, fps, linked = _searched(docs, id_col, text_col, shingle_words, similarity)
    copies = rows.join(fps.select("fp", "least").hint("merge"), "fp").filter("doc_id <> least").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    return copies.unionByName(by_least(linked, fps))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Classes of documents whose shingle sets have a Jaccard similarity of similarity or more, directly or through others.

    Returns for each input row: doc_id, component_id (smallest id of the class, itself included), first (this row's id is
    that). Null and wordless texts are one class. Sets are of 64-bit hashes; equal ones are searched once."""
    rows, fps, linked = _searched(docs, id_col, text_col, shingle_words, similarity)
    roots = components(linked)
    classed = stage(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    discard(fps)
    ids = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = classed.join(ids.hint("merge"), "root").select("fp", "component_id")
    out = rows.join(by_fp.hint("merge"), "fp")
    return out.select("doc_id", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first"))
