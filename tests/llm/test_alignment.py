"""Alignment against a plain version that tokenizes whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from citesift.llm import alignment, queries

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    def __init__(self):
        self.a, self.b = tokenizers.Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(x): x for x in keep} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in keep)}
        self.a_bytes = lambda i: bytes(letter[c] for c in self.a.id_to_token(i))
        self.b_bytes = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if any(b"".join(map(f, ids)) != (" " + text).encode() for f, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            return []
        ends = []
        for f, ids in ((self.a_bytes, a), (self.b_bytes, b)):
            at, out = 0, []
            for i in ids:
                at += len(f(i))
                out.append(at)
            ends.append(out)
        both, out = sorted(set(ends[0]) & set(ends[1])), []
        i = j = 0
        for end in both:
            x = y = ()
            while i < len(a) and ends[0][i] <= end:
                x, i = (*x, a[i]), i + 1
            while j < len(b) and ends[1][j] <= end:
                y, j = (*y, b[j]), j + 1
            out.append((x, y))
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def want(plain, rows):
    grouped = [(i, plain.groups(t)) for i, t in rows]
    count, best = Counter(), defaultdict(int)
    for _, groups in grouped:
        count.update({(a, b) for x, y in groups for a in x for b in y})
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = Counter()
    for i, groups in grouped:
        links = [(a, b) for x, y in groups for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out[i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha] += 1
    return out, count


def got(found):
    return Counter(tuple(r) for r in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_op11_equals_plain_python(spark, sf_dir, real, plain):
    rows = [(r.doc_id, r.text) for r in real.collect()]
    assert got(queries.op11_alignment(spark, sf_dir)) == want(plain, rows)[0]


def test_odd_texts(spark, docs, plain):
    odd = ["▁ under", "a᠎ b", "a ᠎b", "tab\t x  two", " lead", "trail ", "  ", "\n", "x\x1c y", "﻿a ﻿b", "é ́e", "日本語 テキスト", "🏳️‍🌈 flags 🇫🇷", "<|endoftext|> <s> </s> <unk>", "don't we'll  I'm", " a  b", " x  y", "q" * 3000, "a1 " * 200, "\0 \0"]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(100 + i, t) for i, t in enumerate(odd)] + [(100, odd[0]), (102, odd[2])]
    found = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), *PATHS)
    expected, count = want(plain, rows)
    assert got(found.documents) == expected
    assert {((r.a, r.b), r.documents) for r in found.links.collect()} == set(count.items())
    assert got(alignment.align(docs, *PATHS).documents) == want(plain, rows[: docs.count()])[0]
    assert alignment.align(docs.filter("doc_id > 1000"), *PATHS).documents.count() == 0


def test_rare_groups_are_joined(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_GROUPS", 5)
    monkeypatch.setattr(alignment, "BATCH_GROUPS", 7)
    rng = random.Random(1)
    words = ["the", "tokenization", "naïve", "don't", "x=y+1;", "überfluß", "a", "12345", "日本"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)]
    assert got(alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), *PATHS).documents) == want(plain, rows)[0]


ALIGNER = None


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sab1.▁é語 ́​"), st.characters(codec="utf-8")), max_size=30))
def test_units_have_the_tokens_of_texts(plain, text):
    global ALIGNER
    ALIGNER = ALIGNER or alignment.Aligner(*PATHS)
    import pyarrow as pa
    units, _, names = ALIGNER.cut(pa.array([text]))
    assert ALIGNER.cuts and "".join(f" {names[u]}" for u in units.tolist()) == f" {text}"
    ALIGNER.learn([n for n in {names[u] for u in units.tolist()} if n not in ALIGNER.units])
    ids = [ALIGNER.units[names[u]] for u in units.tolist()]
    joined = ";".join(ALIGNER.unit_text[i] for i in ids)
    expected = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain.groups(text))
    assert (joined if not any(ALIGNER.unit_sizes[i][3] for i in ids) else "") == expected or not text


def test_units_are_tokenized_together_as_alone():
    """New words cost no text of their own, and have the same groups; if tokens of a joined text go across, units are taken one by one."""
    rng = random.Random(2)
    units = list(dict.fromkeys("".join(rng.choices("abcsté'.1語\u0301%-", k=rng.randint(1, 9))) for _ in range(500)))
    units += ["", " x", "x ", "\n", "tab\t", "'s", "a\n\nb", "\u200b", "x" * 3000, "<|endoftext|>"]
    together, alone, crossed = (alignment.Aligner(*PATHS) for _ in range(3))
    given, encoded = [], together._a_encoded
    together._a_encoded = lambda texts: given.append(len(texts)) or encoded(texts)
    crossed._a_encoded = lambda texts: encoded([t + " more" * (t.count(" ") > 9) for t in texts])
    together.learn(units)
    crossed.learn(units)
    for u in units:
        alone.learn([u])
    assert sum(given) < len(units) / 10
    found = [{u: (x.unit_text[i], tuple(x.unit_sizes[i].tolist())) for u, i in x.units.items()} for x in (together, alone, crossed)]
    assert found[0] == found[1] == found[2] and list(alone.units) == units


@given(st.lists(st.lists(st.integers(0, 2**20), min_size=5, max_size=5), max_size=20).map(lambda rows: rows + rows[::2]))
def test_distinct_rows(rows):
    import numpy as np
    found = np.array(rows, np.int64).reshape(-1, 5)
    places, which = alignment._distinct_rows(found)
    assert found[places][which].tolist() == rows and len(places) == len(set(map(tuple, rows)))


def test_keys_keep_ids():
    for a, b in (([1], [2]), ([65535] * 254, [0]), ([1] * 300, [2] * 70_000), ([70_000], [1])):
        x, y = alignment.key_ids(alignment.group_key(a, b))
        assert (x.tolist(), y.tolist()) == (a, b)
