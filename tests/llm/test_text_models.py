"""Classifiers, language models, quality rules, mixing, BPE and WARC."""

import math
import pickle
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citesift.llm import bpe, common, langid, lm, mixing, quality, toxicity, warc
from tests.llm.conftest import ROWS

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_word_hashes_tell_words_apart():
    texts = [b"A b\x0bc  a", b"", b" ", b"x" * 200_000 + b" x", "é É".encode(), b"a"]
    data, offs = common.byte_views(pa.array(texts, pa.binary()))
    h, w, head = common.word_hashes(data, offs, (1,))
    want = [x for t in texts for x in t.lower().split()]
    assert np.diff(w).tolist() == [len(t.split()) for t in texts] and len(h) == len(want)
    assert len(set(zip(h.tolist(), want))) == len(set(want)) == len(set(h.tolist()))
    assert len(set(zip(head.tolist(), (x[:1] for x in want)))) == len({x[:1] for x in want})


# toxicity


def _toxic_docs(spark, n=600):
    rnd = random.Random(1)
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(20, 60))]
        if i % 4 == 0:
            words[rnd.randrange(len(words))] = rnd.choice(["vilezz", "grimzz"])
        rows.append((i, " ".join(words), "en", "a", int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    return docs, spark.createDataFrame([(r[0], r[4]) for r in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity_learns_and_leaves_clean_alone(spark, docs):
    texts, labels = _toxic_docs(spark)
    model = toxicity.fit(texts, labels, common.crc_bucket() != 0)
    held = toxicity.score_documents(texts, model).filter(common.crc_bucket() == 0).collect()
    assert len(held) > 80
    right = sum((r._score >= 0.5) == (r.doc_id % 4 == 0) for r in held)
    assert right >= 0.97 * len(held) and not any(r._rejected and r.doc_id % 4 for r in held)
    odd = toxicity.score_documents(docs, model)
    assert odd.count() == len(ROWS) and odd.filter("_score is null or _score < 0 or _score > 1").count() == 0
    assert set(odd.columns) == {*docs.columns, "_score", "_rejected"}


def test_toxicity_learns_from_all_tasks_and_whole_texts(spark, monkeypatch):
    """Words in the middle of texts of 40 000 are learnt, and the documents are dealt to several tasks."""
    texts, labels = _toxic_docs(spark)
    monkeypatch.setattr(toxicity, "TASK_DOCS", 200, raising=False)
    monkeypatch.setattr(toxicity, "STEPS", 200)
    long = texts.withColumn("text", F.when(F.col("doc_id") % 30 == 0, F.concat("text", F.lit(" "), F.repeat(F.lit("abc "), 20_000), F.expr("array_join(transform(sequence(1, 400), i -> concat('late', i)), ' ')"), F.repeat(F.lit(" abc"), 20_000))).otherwise(F.col("text")))
    model = toxicity.fit(long, labels, common.crc_bucket() != 0)
    words, _ = toxicity.slots(np.frombuffer(b" ".join(b"late%d" % i for i in range(1, 401)), np.uint8), np.array([0, sum(len(b"late%d " % i) for i in range(1, 401)) - 1]))
    assert (model.rows[words] > 0).all()


def test_toxicity_leaves_no_shuffle_files_and_sends_small_models(spark, monkeypatch):
    """Each round's shuffle files go when its weights are written, and a model is sent without its table of slots."""
    assert len(pickle.dumps(toxicity.untrained(np.arange(10)))) < 1 << 20

    def held() -> int:
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return sum(f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data"))

    texts, labels = _toxic_docs(spark)
    monkeypatch.setattr(toxicity, "STEPS", 60)
    size = texts.agg(F.sum(F.length("text"))).first()[0]
    before = held()
    model = toxicity.fit(texts, labels, common.crc_bucket() != 0)
    assert len(model.used) and held() - before < size


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, common.crc_bucket() != 0)
    assert toxicity.score_documents(docs, model).count() == len(ROWS)
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


# languages


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(2)
    grams = {}
    for x in "ab":
        s = np.concatenate([[1, 1, 1], rng.integers(97, 101, 60), [1]]).astype(np.uint32)
        g, c = np.unique(np.lib.stride_tricks.sliding_window_view(s, langid.ORDER), axis=0, return_counts=True)
        grams[x] = (g, c)
    model = langid.build(grams)
    for ctx in ([1, 1, 1], [97, 98, 99], [5, 5, 97], [97, 97, 97]):
        # All symbols of a model, and one it never saw, which has the share of all unseen.
        for j, x in enumerate("ab"):
            known = set(grams[x][0].ravel().tolist()) & (set(grams[x][0][:, -1].tolist()))
            p = sum(math.exp(langid.log_probs(model, np.array([*ctx, y], np.uint32), langid.ORDER, np.array([3]))[0, j]) for y in [*known, 500])
            assert abs(p - 1) < 1e-4


def test_language_id(spark, docs):
    rnd = random.Random(4)
    sets = {"xx": "abcde", "yy": "cdefg"}
    rows = [(i, " ".join("".join(rnd.choice(sets[x]) for _ in range(5)) for _ in range(30)), x) for i in range(200) for x in [("xx", "yy")[i % 2]]]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(texts, common.crc_bucket() != 0)
    got = langid.identify(texts, model).join(texts, "doc_id").filter(common.crc_bucket() == 0).collect()
    assert len(got) > 20 and all(r.lang == r.lang_pred for r in got)
    odd = langid.identify(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    und = Counter(r.doc_id for r in odd if r.lang_pred == "und")
    assert und == Counter({3: 1, 4: 1, 5: 1, None: 1, 11: 1})
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(texts.limit(0), F.lit(True))).collect()} == {"und"}
    strange = spark.createDataFrame([(1, "жщю " * 40)], "doc_id long, text string")
    assert langid.identify(strange, model).first().rejected


# mixing


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.water_fill([300, 0, 30], [1, 2, 3]) == [240, 0, 90]
    assert mixing.water_fill([], []) == []


@given(st.lists(st.tuples(st.integers(1, 50), st.floats(0.01, 0.99)), max_size=60), st.integers(0, 1000))
@settings(max_examples=100, deadline=None)
def test_pivotal_keeps_mass(items, seed):
    sizes, parts = np.array([a for a, _ in items], int), np.array([b for _, b in items])
    x, held = mixing.pivotal(sizes, parts, np.random.default_rng(seed).random(len(items)))
    assert abs((sizes * x).sum() - (sizes * parts).sum()) < 1e-6 * max(1, len(items))
    assert all(v in (0.0, 1.0) for i, v in enumerate(x) if i != held)


def test_pivotal_is_fair():
    rng = np.random.default_rng(0)
    total = np.zeros(4)
    for _ in range(4000):
        x, held = mixing.pivotal(np.array([1, 2, 3, 4]), np.full(4, 0.4), rng.random(4))
        if held >= 0:
            x[held] = rng.random() < x[held]
        total += x
    assert np.abs(total / 4000 - 0.4).max() < 0.04


def test_mix(docs, real):
    got = mixing.mix_sources(docs).collect()
    want = Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, r.size) for r in got) == want
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    a = mixing.mix_sources(real).orderBy("doc_id").collect()
    assert a == mixing.mix_sources(real.repartition(7)).orderBy("doc_id").collect()
    by = {}
    for r in a:
        s = by.setdefault(r.source, [0, r.target, 0])
        s[0] += r.taken
        s[2] = max(s[2], r.size)
    assert all(abs(taken - target) <= most for taken, target, most in by.values())
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mix_keeps_large_ids_beside_null(spark):
    rows = [(2**60 + 1, "a b c", "s"), (2**60 + 3, "a b", "s"), (None, "a", "s"), (5, "b " * 9, "t")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in got} == {2**60 + 1, 2**60 + 3, None, 5} and {r.doc_id: r.size for r in got}[2**60 + 3] == 2


def test_pivotal_ends_on_a_short_document():
    rng = np.random.default_rng(5)
    for _ in range(100):
        sizes = np.sort(np.ceil(rng.lognormal(4, 1.5, 400)))[::-1]
        part = rng.uniform(0.3, 0.7)
        x, held = mixing.pivotal(sizes, np.full(400, part), rng.uniform(size=400), rng.uniform(size=400))
        assert abs((sizes * x).sum() - part * sizes.sum()) < 1e-6 * sizes.sum() and ((x < 1e-9) | (x > 1 - 1e-9)).sum() >= 399
        assert held < 0 or sizes[held] <= np.median(sizes)


def test_pivotal_keeps_expectations():
    rng = np.random.default_rng(6)
    sizes, parts = np.array([900.0, 400, 390, 60, 50, 50, 9, 4, 3, 1]), np.full(10, 0.37)
    mean = np.zeros(10)
    for _ in range(6000):
        mean += mixing.pivotal(sizes, parts, rng.uniform(size=10), rng.uniform(size=10))[0] / 6000
    assert np.abs(mean - 0.37).max() < 0.03


# BPE


@pytest.fixture(scope="module")
def coder():
    ranks = bpe.load_ranks(PATH)
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=80) | st.lists(st.sampled_from(["ab", "the", " ", "\n", "'s", "aa", "ción", "12", "😀", "--", "=="]), max_size=40).map("".join))
@settings(max_examples=300, deadline=None)
def test_encode_equals_the_library(coder, text):
    ours, theirs = coder
    ids = ours.encode(text)
    assert ids == theirs.encode_ordinary(text)
    for step in (1, 3):
        assert "".join(bpe.decode_stream(ids, ours.transducer.tokens, step)) == text


def test_long_pieces_and_resets(coder, monkeypatch):
    ours, theirs = coder
    for t in ("a" * 3000, "ab" * 2000, " " * 2000, "-=" * 1500, "x" * 100_000):
        assert ours.encode(t) == theirs.encode_ordinary(t)
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 50)
    monkeypatch.setattr(bpe, "MAX_WORDS", 5)
    for t in ("unzählige Wörter gehen verloren", "el niño pequeño " * 5):
        assert ours.encode(t) == theirs.encode_ordinary(t)


@given(st.lists(st.text(min_size=1, max_size=20) | st.sampled_from(["ab", " the", "unzählige", "日本語", "\0"]), max_size=30))
@settings(max_examples=100, deadline=None)
def test_pieces_together_and_alone_have_the_same_tokens(coder, pieces):
    data = [p.encode() for p in pieces]
    tokens, counts = coder[0].transducer.encode_together(data)
    ends = np.cumsum(counts).tolist()
    assert [tuple(tokens[s:e].tolist()) for s, e in zip([0, *ends], ends)] == [coder[0].transducer.encode(d) for d in data]


def test_words_of_a_batch_go_through_the_transducer_together(coder, monkeypatch):
    """Rare words cost no walk of their own, byte by byte; only pieces too long to remember do."""
    ours, theirs = coder
    alone, encode = [], ours.transducer.encode
    monkeypatch.setattr(ours.transducer, "encode", lambda piece: alone.append(piece) or encode(piece))
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choices("abcdeéß語", k=rnd.randint(1, 12))) for _ in range(50)) for _ in range(40)] + ["", "=" * 100 + " " + "z" * 90, "x"]
    for _ in range(2):
        ids, at = ours.encode_all(texts)
        assert [ids[s:e].tolist() for s, e in zip(at, at[1:])] == [theirs.encode_ordinary(t) for t in texts]
    assert set(alone) == {b"=" * 100, b" " + b"z" * 90} and max(map(len, ours.known)) <= bpe.MAX_WORD
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 50)
    monkeypatch.setattr(bpe, "MAX_WORDS", 5)
    monkeypatch.setattr(bpe, "TOGETHER_BYTES", 20)
    for t in texts:
        assert ours.encode(t) == theirs.encode_ordinary(t)


@given(st.lists(st.binary(max_size=4), max_size=12))
def test_utf8_stream(parts):
    s = bpe.Utf8Stream()
    assert "".join([*map(s.feed, parts), s.close()]) == b"".join(parts).decode("utf-8", "replace")


def test_encode_and_decode_tables(docs):
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert Counter(tuple(r) for r in back.collect()) == Counter((i, t or "") for i, t, *_ in ROWS)
    assert bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    assert bpe.digests(docs, PATH, public_tokenizers.PATTERN).count() == len(ROWS)


# quality


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30))
def test_repeat_words(words):
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    assert quality.repeat_words(words) == len(hit)


def test_quality(spark, docs):
    got = quality.quality_rules(docs)
    want = Counter()
    for i, t, *_ in ROWS:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) for r in got.collect()) == want
    assert quality.quality_rules(docs.limit(0)).count() == 0
    rnd = random.Random(2)
    line = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(12))
    banner = "accept all cookies to go on " * 20
    rows = [(i, "\n".join([banner if i % 2 else line(), *(line() for _ in range(1 if i % 4 == 1 else 30))]), "h") for i in range(200)]
    rows += [(1000 + i, rows[0][1], "h") for i in range(100)]  # copies of a clean text
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(table, texts_only=True).collect()}
    assert all(kept[i] == (i % 4 != 1) for i in range(200)) and all(kept[1000 + i] for i in range(100))
    # Counted by documents, lines of 101 of 300 go.
    kept = {r.doc_id: r.kept for r in quality.quality_rules(table).collect()}
    assert all(kept[i] == (i % 4 != 1 and i != 0) for i in range(200)) and not any(kept[1000 + i] for i in range(100))


# scoring


def test_base_scores(docs, real):
    for df in (docs, real):
        rows = df.select("doc_id", "text").collect()
        fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
        toks = [[*(r.text or "").encode().lower().split(), None] for r in rows]
        count = Counter(t for r, ts in zip(rows, toks) if fold(r.doc_id) != 1 for t in ts)
        n, v = sum(count.values()), len(count)
        want = sorted((-1 if r.doc_id is None else r.doc_id, fold(r.doc_id) == 1, len(ts), sum(count[t] > 0 for t in ts), n, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) for r, ts in zip(rows, toks))
        got = lm.score_documents(df, common.crc_bucket() != 1).collect()
        ours = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
        assert [x[:5] for x in ours] == [x[:5] for x in want]
        assert all(math.isclose(a[5], b[5], rel_tol=1e-9) for a, b in zip(ours, want))
        assert all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    w = lm.Weights(rng.normal(size=(lm.ROWS, 16)).astype(np.float32), rng.normal(size=(lm.ROWS, 16)).astype(np.float32), np.zeros(16, np.float32), np.zeros((16, 16), np.float32))
    f = np.repeat(rng.integers(0, 2**62, (lm.FEATURES, 1)).astype(np.uint64), 256, axis=1)
    assert abs(np.exp(lm.class_log_probs(w, f, np.arange(256, dtype=np.int32))).sum() - 1) < 1e-3


def test_scoring_without_training_rows(docs):
    got = lm.score_documents(docs, F.lit(False)).collect()
    assert len(got) == len(ROWS) and all(r.n_known == 0 and r.train_tokens == 0 and r.held_out for r in got)
    assert lm.score_documents(docs.limit(0), F.lit(True)).count() == 0


# WARC


def test_derivatives_round_trip(spark, tmp_path, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = spark.createDataFrame([(1, None, None), (None, "http://a/", "<p>a &lt;b&gt;<br>c</p><script>x</script>"), (2, "http://b/", "no tags"), (2, "http://b/", "no tags")], "page_id long, url string, html string")
    records = warc.derivatives(warc.responses(odd)).collect()
    assert len(records) == 8 and {r.record_type for r in records} == {"metadata", "conversion"}
    assert "a <b>\nc" in {r.block for r in records} and all(r.content_length == len(r.block.encode()) for r in records)
    made = warc.derivatives(warc.responses(pages))
    members = warc.compressed(warc.record_bytes(made)).collect()
    (tmp_path / "x.warc.gz").write_bytes(b"".join(bytes(m.member) for m in members))
    back = {r.headers["warc-record-id"]: r for r in warc.read_records(spark, str(tmp_path)).collect()}
    want = made.collect()
    assert len(back) == len(want) == 2 * pages.count()
    for r in want:
        got = back[r.record_id]
        assert bytes(got.block).decode() == r.block and got.headers["warc-refers-to"] == r.refers_to and got.headers["warc-block-digest"] == r.block_digest
    assert all(r.whole for r in back.values())
    assert warc.derivatives(warc.responses(odd.limit(0))).count() == 0


def test_text_of_entities_and_hidden_elements():
    assert warc.plain_text("<p>a&#8217;s &#x2014; &amp;#39; &#39;b&#39; &#0;&#xD800;&nbsp; c</p>") == "a’s — &#39; 'b' &#0;&#xD800; c"
    assert warc.plain_text("<NOSCRIPT >x</noscript\n><template>y</template><style a=1>z</style>t<!-- u --><br/>v") == "t\nv"


def test_responses_of_a_warc_file_keep_headers_and_digests(spark, tmp_path):
    http = b"HTTP/1.1 404 Not Found\r\nServer: old\r\nX-Long: a\r\n b\r\nContent-Type: text/html\r\n\r\n<title> T </title>gone\r\n\r\nand done"
    head = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:uuid:{}>\r\nWARC-Date: 2020-02-02T00:00:00Z\r\nWARC-Target-URI: http://x/\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: {}\r\n\r\n"
    record = lambda kind, i, block: head.format(kind, i, len(block)).encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record("warcinfo", 0, b"software: x\r\n") + record("response", 1, http) + record("request", 2, b"GET / HTTP/1.1\r\n\r\n"))
    records = warc.read_records(spark, str(tmp_path))
    assert sorted(r.headers["warc-type"] for r in records.filter("whole").collect()) == ["request", "response", "warcinfo"]
    made = {r.record_type: r for r in warc.derivatives(warc.recorded_responses(records)).collect()}
    meta = made["metadata"].block
    assert "http-status: 404\r\nhttp-Server: old\r\nhttp-X-Long: a\r\n b\r\nhttp-Content-Type: text/html\r\n" in meta and "payload-digest: sha1:ABC\r\n" in meta
    for r in made.values():
        assert r.refers_to == "<urn:uuid:1>" and r.source_digest == "sha1:ABC" and r.date == "2020-02-02T00:00:00Z" and r.target_uri == "http://x/"
    assert made["conversion"].block == "T gone\n and done".replace("\n ", "\n")
