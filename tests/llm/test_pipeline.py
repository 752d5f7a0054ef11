"""The pipeline's stages, and the SQL of the training-data queries."""

from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from citesift.llm import bpe, common, queries
from tests.llm.conftest import CLASHES, ROWS
from tests.test_queries import rows


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, sf_dir).toPandas()) == rows(con.sql(queries.ORACLE_SQL[name]).df())


def test_stages_on_odd_rows(spark, docs, sf_dir):
    at = common.stage(docs, "odd")
    for name, stage in corpus_pipeline.STAGES:
        out = common.stage(stage(spark, at, sf_dir), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.select(*("`" + c.replace("`", "``") + "`" for c in CLASHES)).distinct().collect() == [tuple(CLASHES.values())], name
        at = out
    empty = common.stage(docs.limit(0), "empty")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_own_columns_are_refused(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        with pytest.raises(ValueError, match="use themselves"):
            stage(spark, docs.withColumn(corpus_pipeline.KEY, docs.doc_id), sf_dir)


def test_rows_keep_their_numbers_when_the_cores_change(spark, real):
    """Numbers are written with the table: other splits, as after the loss of an executor, don't move them."""
    table = common.stage(real.select("*", corpus_pipeline._row()), "numbered")
    before = {r.doc_id: r[corpus_pipeline.ROW] for r in table.collect()}
    gone = common.stage(table.filter("doc_id % 3 = 0").select(corpus_pipeline.ROW), "gone")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", 64)
    try:
        again = spark.read.parquet(table._stage_path)
        assert {r.doc_id: r[corpus_pipeline.ROW] for r in again.collect()} == before
        left = again.join(gone, corpus_pipeline.ROW, "left_anti").collect()
        assert left and all(r.doc_id % 3 for r in left) and len(left) + gone.count() == len(before)
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_copies_leave_one_row(spark, docs, sf_dir):
    got = corpus_pipeline.drop_copies(spark, common.stage(docs, "odd"), sf_dir).collect()
    key = lambda t: "".join((t or "").split())
    assert Counter(key(r.text) for r in got) == Counter({key(t) for _, t, *_ in ROWS})
    assert sorted(r.doc_id for r in got if r.text and "zwei" in r.text) == [5]


def test_near_copies_leave_one_row(spark, docs, sf_dir):
    near = corpus_pipeline.drop_near_copies(spark, common.stage(docs, "odd"), sf_dir).collect()
    texts = [r.text for r in near]
    assert sum("zwei" in (t or "") for t in texts) == 1 and sum(not (t or "").strip() for t in texts) == 1


def test_mix_takes_effect(spark, docs, sf_dir):
    from citesift.llm import mixing

    table = common.stage(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), "odd")
    want = {r.doc_id: r.copies for r in mixing.mix_sources(table).collect()}
    got = Counter(r.doc_id for r in corpus_pipeline.mix(spark, table, sf_dir).collect())
    assert got == Counter({k: v for k, v in want.items() if v})


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    texts = {r.doc_id: r.text for r in common.read_documents(spark, sf_dir).select("doc_id", "text").collect()}
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = out.collect()
    assert got and all(r.n_tokens == len(library.encode_ordinary(texts[r.doc_id])) for r in got)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 0")
    clean = {r.doc_id for r in labels.collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, common.read_documents(spark, sf_dir), sf_dir).collect()}
    assert len(clean - kept) <= 0.02 * len(clean)
