"""What the pipeline's steps hold in a Python worker."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from citesift.llm import bpe, common, minhash, simhash


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.encode() for t in texts])], names=["doc_id", "_text"])


@pytest.mark.parametrize("step", [minhash._sketcher(5), minhash._setter(5), simhash._fingerprints])
def test_steps_drop_what_another_left(step):
    kept = bpe._encoder({bytes([i]): i for i in range(256)}, 1, r"\S+")
    assert list(common.batches_of(iter([batch(["a b"])]), "_text", keep="bpe")) and kept in bpe._ENCODERS.values()
    assert sum(x.num_rows for x in step(iter([batch(["a b", "c"])]))) == 2 and not bpe._ENCODERS


@pytest.mark.parametrize("step", [minhash._sketcher(5), minhash._setter(5)])
def test_shingles_take_bounded_memory(step):
    """Of a batch of 16 MB, no more than a small part is worked on at once."""
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(9999)}" for _ in range(500)) for _ in range(50)] * 110
    whole = batch(texts)
    tracemalloc.start()
    try:
        assert sum(x.num_rows for x in step(iter([whole]))) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()


def test_batches_for_python_are_small(spark):
    sizes = spark.range(0, 20_000, 1, 1).selectExpr("id", "repeat('x', 1000) AS t").mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in it), "n long")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    with common.small_batches(spark):
        got = [r.n for r in common.stage(sizes, "sizes").collect()]
    assert sum(got) > 20_000_000 and max(got) < 2 * common.SMALL_BATCH
    assert spark.conf.get(key) == was
