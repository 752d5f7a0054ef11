"""The corpus pipeline: documents through the stages below, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.llm import bpe, common, exact_dedup, minhash, mixing, simhash, toxicity
from citesift.llm.components import components


#: The column that numbers the rows of a table, and others that the stages add and drop again. A table that brings one of the others is refused.
ROW, KEY, SCORE, REJECTED, COPIES, COPY = (f"_pipeline_{x}" for x in ("row", "key", "score", "rejected", "copies", "copy"))


def _columns(docs: DataFrame) -> list[str]:
    """The columns of docs by their quoted names, which may hold dots, spaces and quotes."""
    taken = {KEY, SCORE, REJECTED, COPIES, COPY} & set(docs.columns)
    if taken:
        raise ValueError(f"columns that the stages use themselves: {', '.join(sorted(taken))}")
    return ["`" + name.replace("`", "``") + "`" for name in docs.columns]


def _row() -> Column:
    return F.monotonically_increasing_id().alias(ROW)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row in ROW, read from a written table. A number made while reading would follow the
    scan's partitions, which Spark cuts by the cores it has when it plans, so it isn't the same in every plan."""
    return docs if ROW in docs.columns else common.stage(docs.select("*", _row()), "numbered")


def _keyed(docs: DataFrame) -> DataFrame:
    """Numbered rows with a key of their own: the id (null last), a hash of the row, so that the least of a group doesn't depend on the
    order of rows, and the row's number, which tells equal rows apart."""
    hashed = F.xxhash64(*(quoted for quoted, (name, kind) in zip(_columns(docs), docs.dtypes) if name != ROW and "map<" not in kind and "variant" not in kind))
    return docs.withColumn(KEY, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), hashed.alias("hash"), F.col(ROW).alias("row")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Numbered docs without the rows whose keys gone has."""
    return docs.join(gone.select(F.col("_gone.row").alias(ROW)), ROW, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects. It learns from all folds but one of the labelled documents.

    Null and empty texts, repeated rows and rows without an id are judged like any other; without labels nothing is learnt and
    a neutral score stays below every threshold or at 0.5. Of every stage: an empty table gives an empty one, texts are
    taken whole, and further columns come back unchanged."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, common.crc_bucket() != 0)
    return toxicity.score_documents(docs, model, names=(SCORE, REJECTED)).filter(~F.col(REJECTED)).select(*_columns(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal normalised texts: the longest, then the one of the smallest id (null last), then of the
    least hash of the row. Null counts as empty, and empty texts are one group."""
    rows = _numbered(docs)
    marked = exact_dedup.exact_dedup(_keyed(rows), id_col=KEY)
    return _without(rows, marked.filter("not kept").select(F.col(KEY).alias("_gone"))).select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: that of the smallest id (null last), then of the least hash of the row. Two
    rows are linked if their SimHash fingerprints differ in simhash.MAX_BITS bits or fewer, as op9 finds them, or if they share 0.8 or more of their
    five-word shingles, which fingerprints don't show. Texts of fewer than five words are near copies if their words are equal."""
    rows = _numbered(docs)
    keyed = _keyed(rows)
    # Links of either way are searched for components once, so classes of both that share a row are one.
    linked = common.stage(simhash.id_links(keyed, id_col=KEY).unionByName(minhash.id_links(keyed, id_col=KEY)), "near-rows")
    roots = components(linked.select(F.col("u.row").alias("u"), F.col("v.row").alias("v")))
    keys = linked.select(F.col("u").alias("a")).unionByName(linked.select(F.col("v").alias("a"))).distinct()
    classed = common.stage(keys.join(roots.hint("merge"), F.col("a.row") == F.col("node")).select("a", "root"), "near-classes")
    least = classed.groupBy("root").agg(F.min("a").alias("first"))
    gone = classed.join(least.hint("merge"), "root").filter(F.col("a.row") != F.col("first.row"))
    return _without(rows, gone.select(F.col("a").alias("_gone"))).select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words are taken no time. Rows of one id are drawn apart,
    and null sources are one source."""
    rows = _numbered(docs)
    taken = mixing.mix_sources(_keyed(rows), id_col=KEY, draw_col="doc_id").filter("copies > 0").select(F.col("doc_id.row").alias(ROW), F.col("copies").alias(COPIES))
    rows = rows.join(taken, ROW)
    return rows.withColumn(COPY, F.explode(F.sequence(F.lit(1), F.col(COPIES)))).select(*_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token count and the digests of ids and decoded bytes of each document, with its source. Null counts as empty."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.digests(docs.withColumn(KEY, F.struct("doc_id", "source")), path, public_tokenizers.PATTERN, id_col=KEY)
    with common.small_batches(spark):
        return common.stage(found.select("doc_id.doc_id", "doc_id.source", "n_tokens", "ids_sha256", "decoded_sha256"), "encoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("mix_sources", mix), ("byte_bpe", encode),
]
#: The classifier and the shingle sets can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table. Each table between two stages is written with its rows' numbers."""
    docs = common.read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir).drop(ROW).select("*", _row()), name)
    _, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
