"""Registered queries against brute force over the smallest tables."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

from citesift.llm import bpe, mixing, quality, queries

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return "".join(" " if c in SPACE else c for c in text or "").split(" ") if text else []


@pytest.fixture(scope="module")
def table(real):
    return real.select("doc_id", "text", "source").collect()


def test_op5_equals_the_library(spark, sf_dir, table):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = {}
    for r in table:
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode_bytes(ids)))
    got = queries.op5_byte_bpe(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(table)


def test_op3_keeps_its_contract(spark, sf_dir, table):
    size = {r.doc_id: sum(map(bool, words_of(r.text))) for r in table}
    source = {r.doc_id: r.source for r in table}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    total = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    targets = dict(zip(names, mixing.water_fill([total[s] for s in names], [1 + i % 3 for i in range(len(names))])))
    got = queries.op3_mix_sources(spark, sf_dir).collect()
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and abs(r.target - targets[s]) < 1e-6 * max(1, targets[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert len(got) == len(table) and sum(targets.values()) == pytest.approx(sum(size.values()))
    for s in names:
        assert abs(taken[s] - targets[s]) <= max(n for i, n in size.items() if source[i] == s)
    assert Counter(tuple(r) for r in queries.op3_mix_sources(spark, sf_dir).collect()) == Counter(tuple(r) for r in got)


def test_op6_equals_brute_force(spark, sf_dir, table):
    key = lambda line: " ".join(w for w in words_of(line) if w).translate({c: c + 32 for c in range(65, 91)})
    docs, held = Counter(r.source for r in table), Counter()
    for r in table:
        held.update({(r.source, key(line)) for line in (r.text or "").split("\n") if key(line)})
    hot = {k for k, n in held.items() if n > quality.MIN_DOCS and n > quality.MAX_LINE_SHARE * docs[k[0]]}
    want = {}
    for r in table:
        words = [w for w in words_of(r.text) if w]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        repeat = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
        lines = [x for x in (r.text or "").split("\n") if key(x)]
        gone = sum(len(key(x).split(" ")) for x in lines if (r.source, key(x)) in hot)
        failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        depleted = gone > 0 and (len(words) - gone < quality.MIN_LEFT or len(words) - gone < quality.MIN_LEFT_SHARE * len(words))
        want[r.doc_id] = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(repeat), failed, not failed and not depleted)
    got = queries.op6_quality_rules(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got} == want
