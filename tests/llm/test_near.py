"""Near-duplicates by shingle sets, and the pipeline's stage, against brute force over all pairs."""

import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from citesift.llm import bpe, common, components, exact_dedup, minhash, mixing, simhash


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def classes(texts, least=0.8):
    """The number of the first text of each text's class."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def edited(rnd, families=25, copies=4, words=150):
    """Texts with edited copies, whose similarities lie on both sides of 0.8, and a few odd texts."""
    out = []
    for _ in range(families):
        base = [f"w{rnd.randrange(3000)}" for _ in range(words)]
        out.append(" ".join(base))
        for _ in range(copies):
            t = list(base)
            for at in rnd.sample(range(words), rnd.choice([1, 1, 2, 30])):
                t[at] = f"new{rnd.randrange(10**6)}"
            out.append(" ".join(t))
    rnd.shuffle(out)
    return [*out, "four words are short", "Four  words\nARE short", "", None]


@pytest.mark.parametrize("pair_group", [256, 3])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, pair_group):
    monkeypatch.setattr(minhash, "PAIR_GROUP", pair_group)
    texts = edited(random.Random(11))
    want = classes(texts)
    assert len(set(want)) < len(texts) - 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == dict(enumerate(want))


def test_large_groups_lose_no_pair(spark):
    """A block that 600 documents share, about 0.68 alike, and 60 pairs of 0.82 among them."""
    rnd = random.Random(5)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    block = words(164)
    texts = [block + words(37) for _ in range(480)]
    for _ in range(60):
        tail = words(37)
        texts += [block + tail, block + tail[:18] + words(19)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert all(got[480 + 2 * k + 1] == 480 + 2 * k for k in range(60)) and len(set(got.values())) == 540


def test_stage_drops_edited_copies(spark, sf_dir):
    texts = edited(random.Random(12))
    table = common.stage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "edited")
    got = Counter(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, sf_dir).collect())
    assert got == Counter(set(classes(texts)))


def test_stage_drops_what_fingerprints_link(spark, sf_dir):
    """a and b differ in two bits at most and share less than 0.8 of their shingles; c shares more with b alone."""
    rnd = random.Random(21)
    alike = lambda x, y: len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
    far = lambda x, y: (simhash.fingerprint(x.encode()) ^ simhash.fingerprint(y.encode())).bit_count()
    a = [f"w{rnd.randrange(10**6)}" for _ in range(200)]

    def changed(t, n):
        t = list(t)
        for at in rnd.sample(range(0, 200, 10), n):
            t[at] = f"new{rnd.randrange(10**6)}"
        return t
    b = next(t for t in (changed(a, 5) for _ in range(20_000)) if far(" ".join(a), " ".join(t)) <= simhash.MAX_BITS)
    c = next(t for t in (changed(b, 3) for _ in range(20_000)) if alike(" ".join(b), " ".join(t)) >= 0.8 and far(" ".join(b), " ".join(t)) > simhash.MAX_BITS and far(" ".join(a), " ".join(t)) > simhash.MAX_BITS)
    a, b, c = map(" ".join, (a, b, c))
    assert alike(a, b) < 0.8 and alike(a, c) < 0.8
    for texts in ([a, b], [a, b, c], [c, a, b]):
        table = common.stage(spark.createDataFrame([*enumerate([*texts, "something else altogether"])], "doc_id long, text string"), "bits")
        assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, sf_dir).collect()) == [0, len(texts)]


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mix])
def test_stages_hold_when_scans_are_cut_anew(spark, sf_dir, monkeypatch, stage):
    """The splits of a written table change between two plans of a stage, as when an executor is lost or added."""
    rows = [(i // 2, f"{'long ' * (2000 * (i % 3))} text {i // 4}", "a", str(i)) for i in range(240)]
    table = common.stage(spark.createDataFrame(rows, "doc_id long, text string, source string, mark string").repartition(4), "cut")
    want = Counter(tuple(r) for r in stage(spark, table, sf_dir).collect())
    key, written = "spark.sql.files.maxPartitionBytes", common.stage
    was, sizes = spark.conf.get(key), [1000, 128 << 20]

    def cut_anew(df, name):
        out = written(df, name)
        sizes.reverse()
        spark.conf.set(key, sizes[0])
        return out
    for module in (common, exact_dedup, minhash, mixing):
        monkeypatch.setattr(module, "stage", cut_anew)
    try:
        got = [Counter(tuple(r) for r in stage(spark, table, sf_dir).collect())]
        spark.conf.set(key, 1000)
        got.append(Counter(tuple(r) for r in stage(spark, table, sf_dir).collect()))
    finally:
        spark.conf.set(key, was)
    assert got == [want, want]


def test_stages_after_the_classifier_equal_brute_force(spark, sf_dir):
    rnd = random.Random(13)
    rows = [(i, t, "ab"[rnd.randrange(2)]) for i, t in enumerate(edited(rnd, families=12))]
    rows += [(i + 1000, t.replace(" ", "  "), s) for i, t, s in rows[::4] if t]
    at = common.stage(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "whole")
    for _, stage in corpus_pipeline.STAGES[1:]:
        at = common.stage(stage(spark, at, sf_dir), "whole")
    got = Counter((r.doc_id, r.source, r.n_tokens) for r in at.collect())

    best = {}
    for i, t, s in rows:
        key = "".join((t or "").split())
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
    left = [r for r in rows if r[0] in {i for _, i in best.values()}]
    roots = classes([t for _, t, _ in left])
    left = [r for k, r in enumerate(left) if roots[k] == k]
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = {i: len((t or "").split()) for i, t, _ in left}
    sources = sorted({s for *_, s in left})
    sizes = [sum(words[i] for i, _, s in left if s == x) for x in sources]
    targets = mixing.water_fill(sizes, [1, 2, 3][: len(sources)])
    assert {k[0] for k in got} <= set(words)
    for x, size, target in zip(sources, sizes, targets):
        taken = 0
        for i, t, s in left:
            if s == x:
                copies = got.pop((i, s, len(library.encode_ordinary(t or ""))), 0)
                assert copies in ({int(target / size), int(target / size) + 1} if words[i] else {0})
                taken += copies * words[i]
        assert abs(taken - target) < max(words.values())
    assert not got


def test_stage_searches_components_once(spark, sf_dir, monkeypatch):
    """The links of both ways are one table for the components; minhash searches its stars' besides."""
    runs = []
    counted = lambda links: runs.append(1) or components.components(links)
    for module in (corpus_pipeline, simhash, minhash):
        monkeypatch.setattr(module, "components", counted)
    texts = edited(random.Random(12))[:40]
    table = common.stage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "edited")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, sf_dir).collect())
    assert got == sorted(set(classes(texts))) and len(runs) <= 2
