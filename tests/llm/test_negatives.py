"""Hard negatives against brute force over all pairs."""

import math
import random
from collections import Counter

import duckdb
import numpy as np

from citesift.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute_force(rows, is_anchor, low=80, high=100, n=5):
    usable = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(256 * float(x)) for x in v], label))
    out = []
    for at, (i, q, label) in enumerate(usable):
        if i is None or not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(q, v)), j, other, k) for k, (j, v, other) in enumerate(usable)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for ps, p in [(s[0], s[1]) for s in scored if s[2] == label and s[3] != at][:n]:
            held = [(s[0], s[1]) for s in scored if s[2] != label and low * ps <= 100 * s[0] <= high * ps][:n]
            out += [(i, p, r, j, ps, ns) for r, (ns, j) in enumerate(held, 1)]
    return Counter(out)


def mined(df, **kw):
    return Counter(tuple(r) for r in negatives.mine(df, lambda c: c % 100 == 0, **kw).collect())


def test_op12_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table]
    got = queries.op12_hard_negatives(spark, sf_dir)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_force(rows, lambda i: i % 100 == 0)
    assert Counter(tuple(r) for r in got.collect()) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert Counter(con.sql(queries.OP12_SQL).fetchall()) == want


def test_odd_rows(spark):
    rng = random.Random(3)
    v = lambda d=6: [rng.choice((0.0, 0.25, -0.5, 1.0, rng.random())) for _ in range(d)]
    rows = [(i, v(), rng.choice((0, 1, 2))) for i in range(400)]
    same = v()
    rows += [(i, same, i % 2) for i in range(1000, 1300)]  # copies, some of them anchors
    rows += [(200, rows[200][1], rows[200][2])] * 2 + [(300, v(), 1), (None, v(), 1), (None, same, 0), (1000, same, 0)]
    rows += [(500, None, 1), (600, v(), None), (700, [1.0, None], 1), (800, [float("nan")] * 6, 1), (900, [float("inf"), 1.0], 0), (2000, [], 0), (2001, [], 1), (2100, v(3), 2), (2101, v(9), 1), (2200, [0.0] * 6, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute_force(rows, lambda i: i % 100 == 0)
    assert len(want) > 250 and mined(df) == want
    # Blocks of few anchors give the same rows.
    was, negatives.ANCHORS = negatives.ANCHORS, 3
    try:
        assert mined(df) == want
    finally:
        negatives.ANCHORS = was


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice((0, 4, 6)) for _ in range(4)], i % 3) for i in range(300)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute_force(rows, lambda i: i % 100 == 0)


def test_empty_tables_and_further_columns(spark):
    df = spark.createDataFrame([(1, [1.0], 1, "x", 2), (100, [1.0], 1, "x", 2)], "id long, e array<float>, l long, q string, `a.b` int").repartition(2)
    assert negatives.mine(df.filter("id < 0"), lambda c: c % 100 == 0, "id", "e", "l").count() == 0
    assert negatives.mine(df, lambda c: c == 7, "id", "e", "l").count() == 0
    assert negatives.mine(df, lambda c: c % 100 == 0, "id", "e", "l").count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x, q = np.floor(rng.normal(0, 60, (500, 17))), np.floor(rng.normal(0, 60, (40, 17)))
    books = negatives.fit_codebooks(x[:100])
    codes, off = negatives.encode(x, books)
    anchors = negatives._Anchors(list(range(40)), [0] * 40, [1] * 40, q, books).ready()
    scores, reach = anchors.bounds(codes, off)
    exact = x @ q.T
    assert (np.abs(exact - scores) <= reach).all() and reach.mean() < np.linalg.norm(q, axis=1).mean() * np.linalg.norm(x, axis=1).mean() / 3
