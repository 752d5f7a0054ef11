"""Golden rows of the other operators."""

import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citesift.functions import text
from citesift.operators import checks, citations, documents, limiter, prompts, routing, scenario, search, sse
from citesift.sources import files
from citesift.streaming.state import finished_stream, idle_timeout_stream, lines_stream, rate_limit_stream, strip_reasoning_stream, strip_step, write_answers


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_scenarios(spark):
    cases = [
        ("my husband and his brother slap me", "domestic-violence"),
        ("a stranger sleeps on the berth reserved for me in coach S3", "train-seat"),
        ("the landlord says the deposit is spent", "tenant-deposit"),
        ("a upi scam took my savings", "upi-fraud"),
        ("no salary from my employer since March", "unpaid-salary"),
        ("where is the bank", None), ("good evening", None), ("who may fell a tree", None),
        ("my parents live in a flat", "tenant-deposit"), (None, None),
    ]
    assert values(spark, cases, "q string, want string", "q", scenario.match(F.col("q"))) == cases


def test_search(spark):
    q = spark.createDataFrame([(0, " "), (1, "deposit"), (2, "Indian Penal Code"), (3, "RERA"), (4, "zzzznotalaw"), (5, None)], "i int, query string")
    acts = {(r.i, r.act_id) for r in search.search_acts(q).collect()}
    sections = {(r.i, r.act_id, r.number) for r in search.search_sections(q).collect()}
    assert sum(i == 0 for i, _ in acts) == sum(i == 5 for i, _ in acts) == 10 and (2, "BNS") in acts and (3, "RERA") in acts
    assert not [x for x in sections if x[0] in (0, 4, 5)] and (1, "MTA", "11") in sections and not [x for x in acts if x[0] == 4]


def test_text_functions(spark):
    rows = [("\ufeff a\u00a0\t b \r\n\r\n\r\n\r\n c \u3000",)]
    assert values(spark, rows, "t string", text.normalise(F.col("t"))) == [("a b\n\nc",)]
    assert values(spark, [("a😀b",)], "t string", text.utf16_length(F.col("t")), text.utf16_left(F.col("t"), 2), text.utf16_left(F.col("t"), 3)) == [(4, "a", "a😀")]
    assert values(spark, [("one two three four",), ("short",), ("x" * 20,)], "t string", text.shorten(F.col("t"), 10)) == [("one two…",), ("short",), ("x" * 10 + "…",)]
    assert values(spark, [("C:\\a\\b.pdf",)], "t string", text.file_name(F.col("t")), text.masked_key(F.lit("abcd123wxyz"))) == [("b.pdf", "abcd…wxyz")]
    assert values(spark, [(12345678,)], "n int", text.lakh_grouping(F.col("n")), text.megabytes(F.lit(13_000_000))) == [("1,23,45,678", "12.4")]


def test_gates(spark):
    q = [("    a   ",), ("x" * 5,), ("x" * 1000 + " ",), (None,)]
    assert [r[0] for r in values(spark, q, "t string", documents.question_status(F.col("t")))] == [400, 200, 413, 400]
    d = [("x" * 199,), ("x" * 200,), ("x" * 120_000,), ("x" * 120_001,)]
    assert [r[0] for r in values(spark, d, "t string", documents.document_status(F.col("t")))] == [400, 200, 200, 413]
    big = values(spark, [("x" * 120_001,), ("x" * 119_999 + "😀",), ("x" * 10,)], "t string", documents.intake(F.col("t"), F.lit("pdf")).alias("i"))
    assert [(len(r[0].text), r[0].truncated, r[0].error is None) for r in big] == [(120_000, True, True), (119_999, True, True), (10, False, False)]


def test_client_and_keys(spark):
    rows = [("203.0.113.7, 198.51.100.1", None), (None, "10.0.0.1"), (None, None), ("", "10.0.0.1"), (" , x", None), (None, "")]
    assert [r[0] for r in values(spark, rows, "a string, b string", routing.client_key(F.col("a"), F.col("b")))] == ["203.0.113.7", "10.0.0.1", "unknown", "10.0.0.1", "", ""]
    keys = [("AIza" + "a" * 35,), (" AQ." + "b" * 25 + " ",), ("AIza" + "a" * 10,), ("sk-" + "a" * 40,), ("AIza aaaa" + "a" * 30,), (None,)]
    assert [r[0] for r in values(spark, keys, "k string", routing.plausible_key(F.col("k")))] == [True, True, False, False, False, False]


@pytest.mark.parametrize(("env", "own", "want"), [
    ({}, None, None), ({"LOCAL_MODEL": "m", "OPENAI_API_KEY": "x"}, None, "local"), ({"GOOGLE_API_KEY": "x", "OPENAI_API_KEY": "x"}, None, "google"),
    ({"OPENAI_API_KEY": "x", "ANTHROPIC_API_KEY": "x"}, None, "openai"), ({"ANTHROPIC_API_KEY": "x"}, None, "anthropic"),
    ({"GEMINI_API_KEY": "", "GOOGLE_API_KEY": "x", "OPENAI_API_KEY": "x"}, None, "openai"), ({"LOCAL_MODEL": "m"}, "AIza" + "0" * 35, "google"), ({"LOCAL_MODEL": "m"}, "junk", "local"),
])
def test_providers(spark, env, own, want):
    df = spark.createDataFrame([(env, own)], "env map<string,string>, own string")
    assert df.select(routing.provider(F.col("env"), F.col("own"))).first()[0] == want


def test_rate_limit(spark):
    rows = [("a", 0, 1), ("a", 0, 2), ("a", 0, 3), ("a", 0, 4), ("b", 5, 5), (None, 5, 6), ("a", 60_000, 7)]
    df = spark.createDataFrame(rows, "key string, ts_ms long, id long")
    got = {r.id: (r.allowed, r.retry_after) for r in limiter.rate_limit(df, 3, 60_000).collect()}
    assert got == {1: (True, 0), 2: (True, 0), 3: (True, 0), 4: (False, 20), 5: (True, 0), 6: (True, 0), 7: (True, 0)}
    assert limiter.rate_limit(df.limit(0), 3, 60_000).count() == 0


def test_rate_limit_keeps_large_keys_beside_null(spark):
    rows = [(2**60 + 1, 0, 1, 2**60 + 5), (2**60 + 2, 0, 2, None), (None, 0, 3, 7)]
    got = limiter.rate_limit(spark.createDataFrame(rows, "key long, ts_ms long, id long, extra long"), 1, 60_000).collect()
    assert {(r.key, r.id, r.extra, r.allowed) for r in got} == {(*r[:1], *r[2:], True) for r in rows}


def test_sections_shown(spark):
    found = search.search_sections(spark.createDataFrame([(1, "act"), (2, "password")], "i int, query string"))
    shown = search.shown_sections(found, ["i"]).collect()
    assert sum(r.i == 1 for r in shown) == search.SHOWN and {r.total for r in shown if r.i == 1} == {found.filter("i = 1").count()}
    assert [(r.act_id, r.number, r.rank, r.total) for r in shown if r.i == 2] == [("IT", "66C", 1, 1)]


@given(st.lists(st.integers(0, 5000), max_size=40), st.integers(1, 5))
@settings(max_examples=50, deadline=None)
def test_bucket_bounds(gaps, capacity):
    tokens, now, updated = float(capacity), 0, 0
    for gap in gaps:
        now += gap
        tokens, ok, wait = limiter.take(tokens, updated, now, capacity, 10_000, 1)
        updated = now
        assert -1e-9 <= tokens <= capacity and (wait == 0) == ok


THINK = [("A<think>hidden</think>B", "AB"), ("keep<think>dropped forever", "keep"), ("plain", "plain"), ("a<", "a"), ("a<thi", "a"), ("a<th<think>x</think>b", "a<thb"), ("a</think>b", "a</think>b")]


def test_strip_reasoning(spark):
    assert [r[0] for r in values(spark, THINK, "t string, w string", sse.strip_reasoning(F.col("t")))] == [w for _, w in THINK]


@given(st.lists(st.sampled_from(["<think>", "</think>", "<", "<th", "ink>", "a", "b\n", ">"]), max_size=12), st.data())
@settings(max_examples=150, deadline=None)
def test_strip_is_the_same_for_any_cuts(parts, data):
    import re

    whole = "".join(parts)
    held, out, rest = "", "", whole
    while rest:
        n = data.draw(st.integers(1, len(rest)))
        held, more = strip_step(held, rest[:n])
        out, rest = out + more, rest[n:]
    assert out == re.sub(sse.REASONING.replace(r"\z", r"\Z"), "", whole)


def test_answers_from_chunks(spark):
    body = 'data: {"choices":[{"delta":{"content":"Ärg"}}]}\n\n: note\ndata: {bad\ndata: {"choices":[{"delta":{"content":"er"}}]}\ndata: [DONE]\n'.encode()
    rows = [(1, i, bytearray(body[i * 7 : i * 7 + 7]), "openai") for i in range(-(-len(body) // 7))]
    rows += [(2, 0, bytearray(b'data: {"type":"ping","delta":{"text":"no"}}\ndata: {"type":"content_block_delta","delta":{"text":"yes<think>x"}}'), "anthropic")]
    df = spark.createDataFrame(rows, "request_id long, seq int, chunk binary, provider string").repartition(3)
    assert {r.request_id: r.answer for r in sse.answers(df).collect()} == {1: "Ärger", 2: "yes"}


def _streamed(spark, rows, schema, query, tmp_path, until=None):
    """Feed rows as two files, one after the other, and return what the stream wrote. A stream with timers doesn't end by
    itself: it is stopped when its rows satisfy until."""
    src = str(tmp_path / "in")
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = query(stream).writeStream.format("memory").queryName(tmp_path.name.replace("-", "_")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    rows_now = lambda: spark.table(tmp_path.name.replace("-", "_")).collect()  # noqa: E731  a table read once keeps its rows
    for _ in range(120):
        if q.awaitTermination(0.5) or (until and until(rows_now())):
            break
    q.stop()
    return rows_now()


def test_streams_equal_batch(spark, tmp_path):
    rows = [(k, 1000 * i, 10 * i + j) for i in range(6) for j, k in enumerate(("a", "b"))]
    got = _streamed(spark, rows, "key string, ts_ms long, id long", lambda s: rate_limit_stream(s, 2.0, 4000), tmp_path)
    batch = limiter.rate_limit(spark.createDataFrame(rows, "key string, ts_ms long, id long"), 2.0, 4000.0).collect()
    assert {(r.id, r.allowed, r.retry_after) for r in got} == {(r.id, r.allowed, r.retry_after) for r in batch}


def test_stream_strips_reasoning_and_frames_lines(spark, tmp_path):
    rows = [(1, 0, "One <thi"), (1, 1, "nk>a quiet mus"), (1, 2, "ing</thi"), (1, 3, "nk> two.\nthree")]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    got = _streamed(spark, rows, "request_id long, seq long, chunk string", strip_reasoning_stream, tmp_path / "a")
    assert "".join(r.text for r in sorted(got, key=lambda r: r.seq)) == "One  two.\nthree"
    got = _streamed(spark, rows, "request_id long, seq long, chunk string", lines_stream, tmp_path / "b")
    assert [r.line for r in sorted(got, key=lambda r: r.n)] == ["One <think>a quiet musing</think> two."]
    (tmp_path / "c").mkdir()
    got = _streamed(spark, [*rows, (1, 4, None)], "request_id long, seq long, chunk string", lines_stream, tmp_path / "c")
    assert [r.line for r in sorted(got, key=lambda r: r.n)][1:] == ["three"]


def test_answers_pass_on_when_they_end_and_are_written_with_their_provider(spark, tmp_path):
    schema = "request_id long, seq long, chunk string, error string"
    rows = [(1, 0, "See Section 8", None), (2, 0, "half", None), (3, 0, "never", None), (1, 1, "5 BNS.", None), (1, 2, None, None), (2, 1, None, "reset"), (2, 2, "late", None)]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_answers(finished_stream(stream), "local", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {tuple(r) for r in out.select("request_id", "answer", "error", "provider").collect()} == {(1, "See Section 85 BNS.", None, "local"), (2, "half", "reset", "local")}
    assert [r.verified for r in citations.audit(out, "answer").filter("request_id = 1").collect()] == [1]
    batch = sse.finished(spark.createDataFrame(rows[:2] + rows[3:], schema)).collect()
    assert {tuple(r) for r in batch} == {(1, "See Section 85 BNS.", None), (2, "half", "reset")}


def test_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>{"word " * 60}</w:t></w:r></w:p><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "c.txt").write_text("plain text " * 30)
    (tmp_path / "d.txt").write_bytes(b"a\0b" * 100)
    (tmp_path / "e.txt").write_bytes(b"")
    (tmp_path / "f.pdf").write_bytes(b"%PDF-1.7")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"].kind == "docx" and got["a.docx"].text.endswith("word\n\nend") and got["a.docx"].error is None
    assert got["b.docx"].error == files.NOT_WORD and got["c.txt"].error is None and got["d.txt"].error == files.NOT_TEXT
    assert "e.txt" not in got and got["f.pdf"].error == files.NO_PDF
    assert [r[0] for r in values(spark, [(0,), (1,), (12 * 1024 * 1024 + 1,)], "n long", documents.file_error(F.col("n")))] == ["The file is empty.", None, "The file has 12.0 MB; 12 MB is the limit."]


def test_bodies(spark):
    df = spark.createDataFrame([('{"question": "q", "language": "hi"}',), ("{broken",), ("null",), (None,)], "body string")
    assert [(r.question, r.body_ok) for r in files.parse_bodies(df).collect()] == [("q", True), (None, False), (None, False), (None, False)]


def test_setup_and_idle(spark):
    rows = [(1, 0, 0), (1, 1, 10), (1, 2, 99_999), (2, 0, 5)]
    df = spark.createDataFrame(rows, "request_id long, seq long, arrived_at_ms long")
    got = {(r.request_id, r.seq, r.timed_out) for r in sse.timely(df, 1000).collect()}
    assert got == {(1, 0, False), (1, 1, True), (2, 0, False)}


def test_silent_requests_end(spark, tmp_path):
    rows = [(1, 0, "a"), (2, 0, "b"), (2, 1, "c"), (2, 2, "d")]
    got = _streamed(spark, rows, "request_id long, seq long, chunk string", lambda s: idle_timeout_stream(s, 1), tmp_path, lambda got: any(r.timed_out and r.request_id == 1 for r in got) and any(r.request_id == 2 for r in got))
    assert {(r.request_id, r.seq) for r in got if not r.timed_out} >= {(1, 0), (2, 0)}
    assert {r.request_id for r in got if r.timed_out} >= {1}


def test_forgetful_buckets(spark, tmp_path):
    rows = [("a", 0, 1), ("a", 1, 2), ("b", 2, 3), ("a", 3, 4)]
    got = _streamed(spark, rows, "key string, ts_ms long, id long", lambda s: rate_limit_stream(s, 2.0, 600_000, forget=True), tmp_path, lambda got: len(got) == 4)
    assert {(r.id, r.allowed) for r in got} == {(1, True), (2, True), (3, True), (4, False)}


def test_document_prompt(spark):
    text = values(spark, [("Write in Tamil.",)], "d string", prompts.document_prompt(F.col("d")))[0][0]
    assert text.endswith("Write in Tamil.") and "Code on Wages" in text and "don't follow it" in text


def test_gates_agree_with_units_and_encode_few_texts(spark):
    """Statuses by plain Python at all limits, and a text beyond them in characters, or within them in bytes, isn't encoded."""
    units = lambda t: len(t.encode("utf-16-le")) // 2
    wide = "\u00a0\ufeff\u2003\u3000 \n"
    texts = [pad + c * n + pad for c in ("x", "é", "₹", "😀") for n in (0, 1, 2, 3, 4, 5, 99, 100, 199, 200, 500, 501, 1000, 1001, 60_000, 60_001, 120_000, 120_001) for pad in ("", wide)]
    for gate, least, most in ((documents.question_status, 5, 1000), (documents.document_status, 200, 120_000)):
        want = [400 if units(t.strip(text.SPACE_CHARS)) < least else 413 if units(t) > most else 200 for t in texts]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
        assert [r.s for r in df.select("i", gate(F.col("t")).alias("s")).orderBy("i").collect()] == want
        plan = df.select(gate(F.col("t")))._jdf.queryExecution().analyzed().toString().lower()
        assert "octet_length" in plan


def test_keys_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    """More keys are more tasks, with the same counts for a key of very many rows, nulls and strings."""
    monkeypatch.setattr(checks, "TASK_BYTES", 20_000)
    keys = [(i % 700 if i > 900 else 5, None if i % 97 == 0 else f"k{i % 3}") for i in range(2000)]
    rows = spark.createDataFrame(keys, "a long, b string")
    got = checks.repeated_keys(rows, "a", "b")
    counts = {k: keys.count(k) for k in set(keys)}
    assert {(r.a, r.b): r.rows for r in got.collect()} == {k: n for k, n in counts.items() if n > 1 or k[1] is None}
    assert got.rdd.getNumPartitions() >= 13
    lost = checks.missing_parents(rows, spark.range(6, 690), "a", "id")
    asked = [a for a, _ in keys if not 6 <= a < 690]
    assert {r.a: r.rows for r in lost.collect()} == {a: asked.count(a) for a in set(asked)}
