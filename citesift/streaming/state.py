"""Keyed state over streams: rate limits, and answers that arrive in chunks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.limiter import take

#: How long a finished request is known as such, by the clock.
LINGER_MS = 600_000
#: A closed reasoning block; an open one; and the beginning of its tag at the end of a text.
_BLOCK, _OPEN, _BEGUN = re.compile(r"<think>.*?</think>", re.S), "<think>", re.compile(r"<(?:t(?:h(?:i(?:nk?)?)?)?)?\Z")
#: What can be held of an open block: all but the last letter of its closing tag.
_TAIL = len("</think>") - 1


def strip_step(held: str, chunk: str) -> tuple[str, str]:
    """Take one chunk: what is held back from now on, and the text to emit.

    Closed blocks go. After the last of them an open block holds back its tag and the end of what it says so far, in which
    the closing tag may have begun; else the beginning of a tag at the very end is held."""
    *shown, rest = _BLOCK.split(held + chunk)
    at = rest.find(_OPEN)
    if at >= 0:
        return _OPEN + rest[at + len(_OPEN) :][-_TAIL:], "".join(shown) + rest[:at]
    begun = _BEGUN.search(rest)
    at = begun.start() if begun else len(rest)
    return rest[at:], "".join(shown) + rest[:at]


def _plain(values: list) -> pd.Series:
    """Strings as objects: the state operator takes no chunked string arrays."""
    return pd.Series(values, dtype=object)


class Buckets(StatefulProcessor):
    """One token bucket for each key. With forget, a bucket not used for a window is dropped: it would be full again."""

    def __init__(self, capacity: float, window_ms: int, cost: float = 1.0, forget: bool = False):
        self.capacity, self.window_ms, self.cost, self.forget = capacity, window_ms, cost, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens double, updated_ms long", self.window_ms if self.forget else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts_ms", "id"], kind="stable")
        state = self.bucket.get()
        tokens, updated = (state[0], state[1]) if state is not None else (self.capacity, int(pdf["ts_ms"].iloc[0]))
        allowed, wait = [], []
        for ts in pdf["ts_ms"].tolist():
            ts = max(ts, updated)  # a late request can't drain what came after it
            tokens, ok, retry = take(tokens, updated, ts, self.capacity, self.window_ms, self.cost)
            updated = ts
            allowed.append(ok)
            wait.append(retry)
        self.bucket.update((float(tokens), int(updated)))
        yield pd.DataFrame({"key": _plain([key[0]] * len(pdf)), "id": pdf["id"].to_numpy(), "allowed": allowed, "retry_after": wait})

    def close(self) -> None:
        pass


class OrderedBuckets(StatefulProcessor):
    """One token bucket for each key, by the times of the requests: each waits until the watermark has passed it, so that all before it have been
    decided, and a bucket goes when the watermark passes the time at which it is full again."""

    def __init__(self, capacity: float, window_ms: int, cost: float = 1.0):
        self.capacity, self.window_ms, self.cost = capacity, window_ms, cost

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, updated_ms long")
        self.waiting = handle.getMapState("waiting", "ts_ms long, id long", "times int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            at = (row.ts_ms, row.id)
            self.waiting.updateValue(at, ((self.waiting.getValue(at)[0] if self.waiting.containsKey(at) else 0) + 1,))
            self.handle.registerTimer(row.ts_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((tuple(at), times[0]) for at, times in self.waiting.iterator() if at[0] <= now)
        state = self.bucket.get()
        tokens, updated = (state[0], state[1]) if state is not None else (self.capacity, now)
        for (ts, request), times in due:
            if state is None:
                state, updated = (), ts
            for _ in range(times):
                tokens, allowed, wait = take(tokens, updated, ts, self.capacity, self.window_ms, self.cost)
                updated = ts
                yield Row(key=key[0], id=request, allowed=allowed, retry_after=wait)
            self.waiting.removeKey((ts, request))
        rate = self.capacity / self.window_ms
        if tokens + (now - updated) * rate >= self.capacity:  # a full bucket is like none
            self.bucket.clear()
            return
        if due:
            self.bucket.update((float(tokens), int(updated)))
        # At once, if rounding left a little of the time that it takes to fill.
        self.handle.registerTimer(max(now + 1, updated + math.ceil((self.capacity - tokens) / rate)))

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, capacity: float, window_ms: int, cost: float = 1.0, forget: bool = False, lateness: str | None = None) -> DataFrame:
    """(key, id, allowed, retry_after) for a stream of (key string, ts_ms long, id long).

    With lateness, as for a watermark, requests are decided in the order of ts_ms, then id, however they arrive, once they are that much older
    than the newest; so a replay decides as the batch form does, and a bucket's state ends when it is full. Requests later than that are dropped.
    Without it each micro-batch is decided at once. forget then bounds the state by the keys of the last window. It goes by the clock, so it is for
    live requests whose ts_ms is the time of arrival."""
    if lateness is not None:
        timed = requests.withColumn("_ts", F.timestamp_millis("ts_ms")).withWatermark("_ts", lateness)
        return timed.groupBy("key").transformWithState(OrderedBuckets(capacity, window_ms, cost), "key string, id long, allowed boolean, retry_after int", "append", "eventTime")
    processor = Buckets(capacity, window_ms, cost, forget)
    return requests.groupBy("key").transformWithStateInPandas(processor, "key string, id long, allowed boolean, retry_after int", "append", "processingTime" if forget else "none")


class Answers(StatefulProcessor):
    """Chunks of an answer to text without reasoning, whatever the cuts between chunks. What is held back when a request ends,
    by a row without a chunk, is dropped, as an unfinished tag is; its state ends with it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        state = self.held.get()
        held = (state[0] or "") if state is not None else ""
        for n, chunk in zip(pdf["seq"].tolist(), pdf["chunk"].tolist()):
            held, out = strip_step(held, chunk or "")
            if out:
                yield pd.DataFrame({"request_id": [key[0]], "seq": [n], "text": _plain([out])})
        if pdf["chunk"].isna().any():
            self.held.clear()
        else:
            self.held.update((held,))

    def close(self) -> None:
        pass


def strip_reasoning_stream(chunks: DataFrame) -> DataFrame:
    """(request_id, seq, text) for a stream of (request_id long, seq long, chunk string); a null chunk ends a request and its state."""
    return chunks.groupBy("request_id").transformWithStateInPandas(Answers(), "request_id long, seq long, text string", "append", "none")


class Lines(StatefulProcessor):
    """Whole lines of a request's chunks; the unfinished last line waits for the next chunk, or for the row without a chunk
    that ends the request, which passes it on and ends the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "line string, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        state = self.rest.get()
        line, n = (state[0] or "", state[1]) if state is not None else ("", 0)
        *lines, line = (line + "".join(x or "" for x in pdf["chunk"])).split("\n")
        if pdf["chunk"].isna().any():
            lines = [*lines, line] if line else lines
            self.rest.clear()
        else:
            self.rest.update((line, n + len(lines)))
        yield pd.DataFrame({"request_id": [key[0]] * len(lines), "n": range(n, n + len(lines)), "line": _plain(lines)})

    def close(self) -> None:
        pass


def lines_stream(chunks: DataFrame) -> DataFrame:
    """(request_id, n, line) for a stream of (request_id long, seq long, chunk string); a null chunk ends a request."""
    return chunks.groupBy("request_id").transformWithStateInPandas(Lines(), "request_id long, n long, line string", "append", "none")


class Finished(StatefulProcessor):
    """The whole answer of a request, once: at the row without a chunk that ends it. An error ends it too, and what came before stays.
    Of a finished request the id stays for a while, against late chunks, then nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", "text string")
        self.ended = handle.getValueState("ended", "ended boolean", LINGER_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            return
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for chunk, error in zip(pdf["chunk"].tolist(), pdf["error"].tolist()):
            if isinstance(chunk, str) and not isinstance(error, str):
                self.parts.appendValue((chunk,))
                continue
            text = "".join(x[0] for x in self.parts.get())
            self.parts.clear()
            self.ended.update((True,))
            yield pd.DataFrame({"request_id": [key[0]], "answer": _plain([text]), "error": _plain([error if isinstance(error, str) else None])})
            return

    def close(self) -> None:
        pass


def finished_stream(chunks: DataFrame) -> DataFrame:
    """(request_id, answer, error) when a request ends, for a stream of (request_id long, seq long, chunk string, error string). A row
    without a chunk ends it, as does one with an error, whose partial answer is kept. Nothing is passed on before, so an audit of the
    answers never sees half a section number."""
    return chunks.groupBy("request_id").transformWithStateInPandas(Finished(), "request_id long, answer string, error string", "append", "processingTime")


def write_answers(answers: DataFrame, provider: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of answers to Parquet with the provider that gave them, and stop when the input is read."""
    named = answers.withColumn("provider", F.lit(provider))
    return named.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class Idle(StatefulProcessor):
    """Passes chunks on, and ends a request from which no chunk came for idle_ms: later chunks are dropped for a while. A row without a chunk
    ends a request, too, and its state."""

    def __init__(self, idle_ms: int, linger_ms: int = LINGER_MS):
        self.idle_ms, self.linger_ms = idle_ms, linger_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "timer_ms long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        state = self.last.get()
        if state is not None and state[1]:
            return
        if state is not None:
            self.handle.deleteTimer(state[0])
        if pdf["chunk"].isna().any():
            self.last.clear()
        else:
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.last.update((at, False))
        yield pd.DataFrame({"request_id": [key[0]] * len(pdf), "seq": pdf["seq"].to_numpy(), "chunk": _plain(pdf["chunk"].tolist()), "timed_out": [False] * len(pdf)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.get()[1]:
            self.last.clear()
            return
        at = timerValues.getCurrentProcessingTimeInMs() + self.linger_ms
        self.handle.registerTimer(at)
        self.last.update((at, True))
        yield pd.DataFrame({"request_id": [key[0]], "seq": [-1], "chunk": _plain([None]), "timed_out": [True]})

    def close(self) -> None:
        pass


def idle_timeout_stream(chunks: DataFrame, idle_ms: int) -> DataFrame:
    """(request_id, seq, chunk, timed_out) for a stream of (request_id long, seq long, chunk string): the chunks, and a row
    with timed_out and seq -1 for a request that fell silent. What came before stays."""
    return chunks.groupBy("request_id").transformWithStateInPandas(Idle(idle_ms), "request_id long, seq long, chunk string, timed_out boolean", "append", "processingTime")
