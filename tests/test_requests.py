"""Requests as streams: every stream form equals its batch form, and its state ends."""

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from citesift.operators import citations, limiter, sse
from citesift.streaming import requests as rq
from citesift.streaming.state import finished_stream, idle_timeout_stream, lines_stream, rate_limit_stream

ASKED = "session_id string, request_id long, requested_at timestamp, provider string"
SENT = "session_id string, request_id long, seq long, arrived_at timestamp, chunk binary, error string"
SETUP, IDLE = {"cloud": 3000, "local": 12_000}, {"cloud": 4500, "local": 18_000}
T0 = datetime(2026, 1, 1)
at = lambda ms: T0 + timedelta(milliseconds=ms)


def event(provider, text):
    if provider == "google":
        return json.dumps({"candidates": [{"content": {"parts": [{"text": text[:2]}, {"text": text[2:]}]}}]}, ensure_ascii=False)
    if provider == "anthropic":
        return json.dumps({"type": "content_block_delta", "delta": {"text": text}}, ensure_ascii=False)
    return json.dumps({"choices": [{"delta": {"content": text}}]}, ensure_ascii=False)


def body(rng, provider):
    """The bytes of an answer, with comments, broken events, reasoning across events, and characters of up to four bytes."""
    out = ": hello\n\n"
    for part in ("Nach Section 85 <thi", "nk>heimlich 😀", "es</think> of the BNS ", "तथा ₹ 500 😀. ", "See Section 12", "3 of the PWDVA.\n"):
        out += f"data: {event(provider, part)}\r\n\n"
        if rng.random() < 0.3:
            out += rng.choice(["data: {broken\n", "data:\n", "event: x\n", "data: [DONE]\n", "data: null\n", 'data: {"choices": []}\n'])
    return out.encode()[: -3 if rng.random() < 0.3 else None]


def cut(rng, data):
    places = sorted(rng.sample(range(1, len(data)), rng.randint(3, 12)))
    return [data[a:b] for a, b in zip([0, *places], [*places, len(data)])]


def scene(seed, n=60):
    """Requests of some sessions that end in every way, and their chunks."""
    rng = random.Random(seed)
    asked, sent = [], []
    for i in range(n):
        provider, session = rng.choice(["google", "openai", "anthropic", "local"]), f"s{rng.randrange(n // 2)}" if rng.random() < 0.7 else None
        now = rng.randrange(0, 60_000)
        asked.append((session, i, at(now), provider))
        kind = rng.choice(["done", "done", "idle", "setup", "error", "silent", "cut off"])
        now += rng.randrange(12_500, 20_000) if kind == "setup" else rng.randrange(10, 2900)
        pieces = cut(rng, body(rng, provider)) if kind != "silent" else []
        for seq, piece in enumerate(pieces):
            if kind == "error" and seq == len(pieces) - 1:
                sent.append((session, i, seq, at(now), None, "connection reset"))
                break
            sent.append((session, i, seq, at(now), piece, None))
            now += 19_000 if kind == "idle" and seq == 2 else rng.randrange(1, 900)
        if kind not in ("cut off", "silent", "error"):
            sent.append((session, i, len(pieces), at(now), None, None))
    sent += rng.sample(sent, 10)  # repeated
    sent += [(None, 9000 + i, 0, at(1000), b"data: {}\n", None) for i in range(3)]  # of no request
    return asked, sent


def arrive(spark, rows, schema, path, time, rng, disorder=2000, step=6000):
    """Write rows in files, one for each micro-batch, out of order by up to disorder ms."""
    batches = defaultdict(list)
    for r in rows:
        late = (r[time] - T0).total_seconds() * 1000 + rng.randrange(disorder)
        batches[int(late // step)].append(r)
    for k in range(max(batches) + 1):
        part = batches[k]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/{k:04d}")


def streams(spark, tmp_path, asked, sent, seed=1):
    rng = random.Random(seed)
    # The last row moves the watermark behind all others.
    last = [("end", -1, at(10_000_000), "local"), ("end", -2, at(20_000_000), "local")]
    arrive(spark, [*asked], ASKED, tmp_path / "asked", 2, rng)
    arrive(spark, sent, SENT, tmp_path / "sent", 3, rng)
    for k, r in enumerate(last):
        spark.createDataFrame([r], ASKED).coalesce(1).write.parquet(str(tmp_path / "asked" / f"9{k:03d}"))
    # One folder for each micro-batch, read in the order of their names' times of writing.
    read = lambda schema, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
    return read(ASKED, "asked"), read(SENT, "sent")


def row_set(df):
    return {r.request_id: (r.session_id, r.provider, r.status, r.answer, r.error, r.chunks, r.ended_at) for r in df.collect()}


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    """The scene as a stream, delivered, with the progress of its last batch."""
    tmp = tmp_path_factory.mktemp("scene")
    asked, sent = scene(7)
    a, s = streams(spark, tmp, asked, sent)
    seen = []
    shown = lambda df: citations.audit(df, "answer")
    delivery = rq.Delivery(str(tmp / "answers"), str(tmp / "log"), shown)
    query = rq.deliver(rq.answers_stream(a, s, "10 seconds", SETUP, IDLE, 60_000), delivery, str(tmp / "cp"))
    query.awaitTermination(300)
    seen = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return tmp, asked, sent, seen, delivery


def test_stream_equals_batch(spark, replay):
    tmp, asked, sent, _, _ = replay
    batch = row_set(sse.ended(spark.createDataFrame(asked, ASKED), spark.createDataFrame(sent, SENT), SETUP, IDLE))
    assert set(Counter(x[2] for x in batch.values())) == {"done", "idle", "setup", "error", "cancelled"}
    answers, log = spark.read.parquet(str(tmp / "answers")), spark.read.parquet(str(tmp / "log"))
    shown = {k: v for k, v in batch.items() if v[2] in rq.ANSWERED}
    got = {k: v for k, v in row_set(answers).items()}
    assert got == shown and answers.count() == len(shown)
    lines = {r.request_id: (r.provider, r.line) for r in log.collect()}
    assert lines.keys() - {-1, -2} == {k for k, v in batch.items() if v[2] in ("idle", "setup", "error")} | {9000, 9001, 9002}
    assert all(lines[k] == (v[1], f"[{v[1]}] the stream broke off: connection reset") for k, v in batch.items() if v[2] == "error")


def test_answers_are_whole_and_audited(spark, replay):
    tmp, asked, _, _, _ = replay
    done = spark.read.parquet(str(tmp / "answers")).filter("status = 'done' and answer like '%PWDVA.%'").collect()
    assert len(done) > 3
    for r in done:
        assert r.answer == "Nach Section 85  of the BNS तथा ₹ 500 😀. See Section 123 of the PWDVA.\n"
        assert (r.verified, r.unverified, r.uncited) == (1, 1, False) and r.provider == {i: p for _, i, _, p in asked}[r.request_id]


def test_both_timeouts_are_told_apart_in_one_run(spark, replay):
    found = {r.status for r in spark.read.parquet(str(replay[0] / "answers")).collect()}
    levels = {r.level: r.line.split("] ")[1] for r in spark.read.parquet(str(replay[0] / "log")).filter("line like '%no %chunk%'").collect()}
    assert "idle" in found and levels == {"warn": "no chunk came in time; the answer was closed", "error": "no first chunk came in time"}


def test_state_ends(replay):
    seen = replay[3]
    # Of the two last rows, which moved the watermark, each still has its state, its place in the session and its timer.
    assert max(seen) > 100 and seen[-1] <= 6


def test_a_replayed_batch_adds_nothing(spark, replay):
    tmp, _, _, _, delivery = replay
    before = [sorted(map(str, spark.read.parquet(str(tmp / t)).collect())) for t in ("answers", "log")]
    number = spark.read.parquet(str(tmp / "answers")).agg(F.max("batch_id")).first()[0]
    columns = [f.split()[0] for f in rq.ANSWER.split(", ")]
    again = spark.read.parquet(str(tmp / "answers")).filter(F.col("batch_id") == number).select(*columns)
    logged = spark.read.parquet(str(tmp / "log")).filter(F.col("batch_id") == number)
    rows = [tuple(r) for r in again.collect()] + [("", r.request_id, r.provider, "setup", None, None, 0, r.ended_at) for r in logged.collect() if "no first" in r.line] + [
        ("", r.request_id, r.provider, "orphan", None, None, 0, r.ended_at) for r in logged.collect() if "without a request" in r.line]
    batch = spark.createDataFrame(rows, rq.ANSWER)
    for _ in range(2):
        delivery(batch, number)
    assert [sorted(map(str, spark.read.parquet(str(tmp / t)).collect())) for t in ("answers", "log")] == before


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_any_cuts_give_the_same_text(data):
    raw = data.draw(st.one_of(st.binary(max_size=60), st.builds(lambda s: body(random.Random(s), "openai"), st.integers(0, 99))))
    raw = raw.replace(b"\xff", b"data: " + event("openai", "é<think>x</think>\U0001f600<").encode() + b"\n")
    cuts = sorted(data.draw(st.lists(st.integers(0, len(raw)), max_size=9)))
    whole, parts = rq.Decoder("openai"), rq.Decoder("openai")
    want = whole.feed(raw) + whole.finish()
    assert "".join(parts.feed(raw[a:b]) for a, b in zip([0, *cuts], [*cuts, len(raw)])) + parts.finish() == want
    assert len(parts.held) < 16 and b"\n" not in parts.line


def test_deltas_equal_the_expressions(spark):
    cases = [(p, e) for p in ("google", "openai", "anthropic", "local", "other") for e in (
        event("google", "abc"), event("openai", "x y"), event("anthropic", "é"), "{broken", "null", "[]", "{}", '{"choices":[{"delta":{}}]}', '{"choices":[{"delta":{"content":null}}]}',
        '{"type":"ping"}', '{"candidates":[{"content":{"parts":[{},{"text":"b"}]}}]}', '{"candidates":[]}', '{"choices":[{"delta":{"content":"q"},"x":1},{"delta":{"content":"no"}}]}')]
    df = spark.createDataFrame(cases, "provider string, payload string")
    for r in df.withColumn("text", sse.delta(F.col("payload"), F.col("provider"))).collect():
        assert rq.delta_text(r.payload, r.provider) == (r.text or ""), (r.provider, r.payload)


def test_batch_cases(spark):
    asked = [("s", 1, at(0), "openai"), ("s", 2, at(1000), "openai"), (None, 3, at(0), "local"), (None, 4, at(0), "openai"), (None, 5, at(0), None), ("t", 6, at(5), "openai"), ("t", 7, at(5), "openai")]
    line = f"data: {event('openai', 'hi')}\n".encode()
    sent = [("s", 1, 0, at(999), line, None), ("s", 1, 1, at(1000), None, None), ("s", 2, 0, at(1500), line[:9], None), ("s", 2, 1, at(1600), line[9:-1], None), ("s", 2, 2, at(1700), None, None), (None, 3, 0, at(11_999), line, None),
            (None, 3, 1, at(12_000), line[:-1], "gone"), (None, 4, 1, at(10), line, None), (None, 5, 0, at(3000), line, None)]
    got = row_set(sse.ended(spark.createDataFrame(asked, ASKED), spark.createDataFrame(sent, SENT), SETUP, IDLE))
    assert {k: v[2:6] for k, v in got.items()} == {
        1: ("cancelled", None, None, 1), 2: ("done", "hi", None, 2), 3: ("error", "hi", "gone", 1), 4: ("setup", None, None, 0), 5: ("idle", "", None, 1), 6: ("cancelled", None, None, 0), 7: ("setup", None, None, 0),
    }
    empty = sse.ended(spark.createDataFrame([], ASKED), spark.createDataFrame([], SENT))
    assert empty.count() == 0


def test_buckets_by_event_time_equal_batch_and_end(spark, tmp_path):
    rng = random.Random(5)
    schema = "key string, ts_ms long, id long"
    rows = [(rng.choice("aab") if i % 9 else None, rng.randrange(0, 40_000), i) for i in range(200)] + [("a", 777, 1000)] * 3
    t0 = int(T0.timestamp() * 1000)
    rows = [(k, t0 + ts, i) for k, ts, i in rows]
    batches = defaultdict(list)
    for r in rows:
        batches[(r[1] - t0 + rng.randrange(3000)) // 4000].append(r)
    for k in sorted(batches):
        spark.createDataFrame(batches[k], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
    for k, later in enumerate((9_000_000, 9_900_000, 9_999_000)):
        spark.createDataFrame([("z", t0 + later, 5000 + k)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"9{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = rate_limit_stream(stream, 3.0, 6000, lateness="5 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = Counter(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("key is null or key <> 'z'").select("key", "id", "allowed", "retry_after").collect())
    want = Counter(tuple(r) for r in limiter.rate_limit(spark.createDataFrame(rows, schema), 3.0, 6000.0).select("key", "id", "allowed", "retry_after").collect())
    assert got == want and any(not k[2] for k in want)
    rows_left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows_left) > 10 and rows_left[-1] <= 4


def test_older_streams_end_their_state(spark, tmp_path):
    rows = [(1, 0, "a\nb"), (1, 1, None), (2, 0, "open"), (3, 0, "x<thi"), (3, 1, None)]
    for name, apply, schema in (("lines", lines_stream, "request_id long, seq long, chunk string"), ("idle", lambda s: idle_timeout_stream(s, 600_000), "request_id long, seq long, chunk string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name / "in"))
        query = apply(stream).writeStream.format("memory").queryName(f"older_{name}").option("checkpointLocation", str(tmp_path / name / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert left[-1] <= (1 if name == "lines" else 3), (name, left)  # of request 2 alone, with its timer
    assert finished_stream


def test_a_session_is_read_and_written_once_for_a_batch():
    """State calls don't grow with a session's rows: each is a round trip between Python and Spark."""
    calls = Counter()

    class Store:
        def __init__(self):
            self.rows, self.timers = {}, set()

        def getListState(self, name, *_):
            return self._state(name, lambda: [*self.rows.get(name, ())])

        def getValueState(self, name, *_):
            return self._state(name, lambda: self.rows.get(name))

        def getMapState(self, name, *_):
            return self._state(name, lambda: None)

        def registerTimer(self, at_ms):
            calls["timer"] += 1
            self.timers.add(at_ms)

        def deleteTimer(self, at_ms):
            calls["timer"] += 1
            self.timers.discard(at_ms)

        def _state(store, name, get):
            class State:
                def get(self):
                    calls["get"] += 1
                    return get()

                def put(self, value):
                    calls["put"] += 1
                    store.rows[name] = value

                update = put

                def iterator(self):
                    calls["get"] += 1
                    return iter(())

                def __getattr__(self, call):
                    raise AssertionError(f"{call} for each entry")

                def clear(self):
                    calls["clear"] += 1
                    store.rows.pop(name, None)

            return State()

    class Timer:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    Event = lambda request, kind, seq, ms, chunk, provider: Row(request_id=request, kind=kind, seq=seq, arrived_at=at(ms), chunk=chunk, error=None, provider=provider)
    line = b"data: " + event("openai", "hi").encode() + b"\n"
    rows = [x for i in range(300) for x in (Event(i, "chunk", 1, 20_000 * i + 20, None, None), Event(i, "chunk", 0, 20_000 * i + 10, line, None), Event(i, "request", None, 20_000 * i, None, "openai"))]
    store, answers = Store(), rq.Answers(SETUP, IDLE, 60_000)
    answers.init(store)
    for half in (rows[:450], rows[450:]):
        assert not list(answers.handleInputRows(("s",), iter(half), None))
    assert len(store.timers) == 1
    end = int(at(20_000 * 310).timestamp() * 1000)
    ended = list(answers.handleExpiredTimer(("s",), Timer(end), Timer(store.timers.pop())))
    assert [(r.request_id, r.status, r.answer, r.chunks) for r in ended] == [(i, "done", "hi", 1) for i in range(300)]
    assert sum(calls.values()) <= 25 and not store.rows and not store.timers
