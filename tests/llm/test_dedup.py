"""Exact dedup, SimHash and suffix-array dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from citesift.llm import components, exact_dedup, simhash, suffix_dedup
from tests.llm.conftest import ROWS


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(n, []).append((-len(t or ""), i is None, i))
    out = []
    for n, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        out += [(m[2], best[2], len(members), m == best, hashlib.sha256(n.encode()).hexdigest()) for m in members]
    return Counter(out)


@pytest.mark.parametrize("block", [1024, 7])
def test_exact(docs, block):
    got = exact_dedup.exact_dedup(docs, block_bytes=block).collect()
    assert Counter(tuple(r) for r in got) == brute_exact([r[:2] for r in ROWS])


def test_exact_with_hot_blocks(spark, monkeypatch):
    rows = [(i, "same text everywhere" if i % 3 else f"own {i} " * 9) for i in range(900)]
    monkeypatch.setattr(exact_dedup, "HOT_PARTS", 4)
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=8).collect()
    assert Counter(tuple(r) for r in got) == brute_exact(rows)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert exact_dedup.exact_dedup(none).count() == simhash.near_duplicates(none).count() == suffix_dedup.remove_repeats(none).count() == 0


def test_exact_plan_is_native(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def fingerprint(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, bits=2):
    todo, roots = set(fps), {}
    while todo:
        open_ = [todo.pop()]
        members = list(open_)
        while open_:
            x = open_.pop()
            near = {y for y in todo if (x ^ y).bit_count() <= bits}
            todo -= near
            open_ += near
            members += near
        for m in members:
            roots[m] = min(members)
    return roots


@pytest.mark.parametrize("pair_group", [256, 1])
def test_links_of_planted_fingerprints(spark, monkeypatch, pair_group):
    monkeypatch.setattr(simhash, "PAIR_GROUP", pair_group)
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for x in list(fps)[:25]:
        for _ in range(4):
            x ^= 1 << rnd.randrange(64)
            x ^= 1 << rnd.randrange(64) if rnd.random() < 0.5 else 0
            x ^= 1 << rnd.randrange(64) if rnd.random() < 0.2 else 0
            fps.add(x)
    fps |= {0, 1, 2**63}
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node % 2**64: r.root for r in components.components(simhash.links(df)).collect()}
    want = brute_classes(fps)
    by_root = {}
    for x in fps:
        by_root.setdefault(got.get(x, signed(x)), set()).add(x)
    want_sets = {}
    for x in fps:
        want_sets.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, want_sets.values()))


def test_near_duplicates(docs):
    got = simhash.near_duplicates(docs).collect()
    fps = [fingerprint(t) for _, t, *_ in ROWS]
    roots = brute_classes(fps)
    ids = {}
    for (i, *_), f in zip(ROWS, fps):
        if i is not None:
            ids[roots[f]] = min(ids.get(roots[f], i), i)
    want = Counter((i, f"{f:016x}", ids.get(roots[f])) for (i, *_), f in zip(ROWS, fps))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_long_chain_is_one_component(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (3, 4)], "u long, v long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == dict.fromkeys(range(n + 1), 0)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(0, 60)))
        s = a.tolist()
        assert suffix_dedup.suffix_array(a).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_removed(rows):
    first = {}
    big = 2**63
    data = [((big if i is None else i), i, (t or "").encode()) for i, t in rows]
    for k, _, t in data:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            first[w] = min(first.get(w, big), k)
    out = Counter()
    for k, i, t in data:
        kept, n, spans = suffix_dedup.cut(t, [(p, p + 50) for p in range(len(t) - 49) if first[t[p : p + 50]] < k])
        out[i, len(t), n, spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_remove_repeats(docs):
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()) == brute_removed([r[:2] for r in ROWS])


def test_remove_planted_passages(spark, monkeypatch):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [text(15) for _ in range(4)] + ["ab" * 40]
    rows = [(i * 7 % 101, " ".join(rnd.choice(shared) if rnd.random() < 0.3 else text(12) for _ in range(rnd.randint(0, 6)))) for i in range(90)]
    rows += [(500, rows[3][1]), (501, rows[3][1] + "x")]
    monkeypatch.setattr(suffix_dedup, "_BATCH", 2000)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.remove_repeats(df, texts=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_removed(rows)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_near_copies_of_the_real_table(real):
    rows = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(real).collect())
    assert got == brute_removed(rows)
