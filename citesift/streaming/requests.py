"""Requests as streams: chunks of bytes in, whole answers out, in keyed state that ends; and where the answers go.

All times are those of the rows, so a replay gives what the live run gave: a request's end is passed on when the watermark has
reached it, as nothing that arrives later can change it any more."""

from __future__ import annotations

import codecs
import json
from bisect import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import SPACE_CHARS
from ..operators.routing import log_line
from ..operators.sse import IDLE_MS, SETUP_MS
from .state import strip_step

DONE, IDLE, SETUP, ERROR, CANCELLED, ORPHAN = "done", "idle", "setup", "error", "cancelled", "orphan"
#: Statuses whose text so far is an answer; the others give none.
ANSWERED = (DONE, IDLE, ERROR)


def _text(value: object) -> str:
    """A JSON value as text: strings as they are, null and missing ones as nothing."""
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


def delta_text(payload: str, provider: str | None) -> str:
    """The text of one event by its provider's protocol. Malformed events, and those of other shapes, have none."""
    try:
        event = json.loads(payload, parse_constant=_no_constant)
        if provider == "google":
            return "".join(_text(part.get("text")) for part in (event["candidates"][0].get("content") or {}).get("parts") or [])
        if provider in ("openai", "local"):
            return _text((event["choices"][0].get("delta") or {}).get("content"))
        if provider == "anthropic" and event.get("type") == "content_block_delta":
            return _text((event.get("delta") or {}).get("text"))
    except (ValueError, LookupError, TypeError, AttributeError, RecursionError):
        pass
    return ""


@dataclass
class Decoder:
    """Bytes of an answer to its text, whatever the cuts between chunks. Between two chunks it holds the bytes of a line that
    hasn't ended (so a character's bytes are decoded together, once its line is whole) and the part of the text that may belong to a reasoning tag."""

    provider: str | None
    line: bytes = b""
    held: str = ""

    def feed(self, chunk: bytes) -> str:
        *lines, self.line = (self.line + chunk).split(b"\n")
        return "".join(self._shown(line.decode("utf-8", "replace")) for line in lines)

    def finish(self) -> str:
        """The text of a last line without an end. Bytes of a character that never came whole are dropped."""
        last, self.line = codecs.getincrementaldecoder("utf-8")("replace").decode(self.line), b""
        return self._shown(last)

    def _shown(self, line: str) -> str:
        line = line.strip(SPACE_CHARS)
        data = line[5:].strip(SPACE_CHARS) if line.startswith("data:") else ""
        if not data or data == "[DONE]":
            return ""
        self.held, text = strip_step(self.held, delta_text(data, self.provider))
        return text


def _ms(at: datetime) -> int:
    """Milliseconds of a time that Spark gives without its zone, in that of the machine."""
    return round(at.timestamp() * 1000)


def _at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).astimezone().replace(tzinfo=None)


ANSWER = "session_id string, request_id long, provider string, status string, answer string, error string, chunks long, ended_at timestamp"


#: A row that came before those in front of it: its place, and what _take gets of it.
_EVENT = "place: long, kind: string, at_ms: long, chunk: binary, error: string, provider: string"


@dataclass
class _State:
    """What the state says of a request between two batches."""

    request_id: int
    provider: str | None = None
    asked_ms: int | None = None
    next: int = 0
    started: bool = False
    last_ms: int = 0
    cancel_ms: int | None = None
    status: str | None = None
    error: str | None = None
    end_ms: int = 0
    gone: bool = False
    due_ms: int = 0
    line: bytes = b""
    held: str = ""
    parts: list[str] = field(default_factory=list)
    ahead: dict[int, tuple] = field(default_factory=dict)

    SCHEMA = (
        "request_id long, provider string, asked_ms long, next long, started boolean, last_ms long, cancel_ms long, status string, error string, end_ms long, gone boolean,"
        f" due_ms long, line binary, held string, parts array<string>, ahead array<struct<{_EVENT}>>"
    )

    def row(self) -> tuple:
        *plain, ahead = (getattr(self, f) for f in self.__dataclass_fields__)
        return *plain, [(place, *event) for place, event in ahead.items()]

    @classmethod
    def of(cls, row: tuple) -> _State:
        *plain, line, held, parts, ahead = row
        return cls(*plain, bytes(line or b""), held or "", list(parts or ()), {x[0]: tuple(x[1:]) for x in ahead or ()})


class Answers(StatefulProcessor):
    """One answer for each request of a session. See answers_stream for the rules.

    A session's open requests are one list, read and written once for a batch, with one timer, at the earliest time for which one
    of them waits: a call for each row or request takes longer than all else. Of those that have ended the ids stay for a while."""

    def __init__(self, setup_ms: dict[str, int], idle_ms: dict[str, int], linger_ms: int):
        self.setup_ms, self.idle_ms, self.linger_ms = setup_ms, idle_ms, linger_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requests = handle.getListState("requests", _State.SCHEMA)
        self.gone = handle.getMapState("gone", "request_id long", "asked_ms long, due_ms long")
        self.timer = handle.getValueState("timer", "timer_ms long")

    def _limit(self, s: _State) -> int:
        return (self.idle_ms if s.started else self.setup_ms)["local" if s.provider == "local" else "cloud"]

    def _load(self) -> dict[int, _State]:
        found = {s.request_id: s for s in map(_State.of, self.requests.get())}
        return found | {request: _State(request, asked_ms=asked, gone=True, due_ms=due) for (request,), (asked, due) in self.gone.iterator()}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self._load()
        order = sorted((s.asked_ms, s.request_id) for s in known.values() if s.asked_ms is not None)
        fresh: set[int] = set()
        decoders: dict[int, Decoder] = {}
        changed: set[int] = set()
        for row in rows:
            at, request = _ms(row.arrived_at), row.request_id
            s = known.get(request)
            if s is None:
                s = known[request] = _State(request)
                fresh.add(request)
                changed.add(request)
            if request in fresh and not s.next:
                s.last_ms = max(s.last_ms, at)
            place = 0 if row.kind == "request" else row.seq + 1
            if s.gone or s.status or place < s.next:
                continue
            changed.add(request)
            event = (row.kind, at, row.chunk, row.error, row.provider)
            if place > s.next:
                s.ahead.setdefault(place, event)
                continue
            if row.kind == "request":
                changed |= self._follow(order, known, request, at)
            decoder = decoders.get(request)
            if decoder is None:
                decoder = decoders[request] = Decoder(s.provider, s.line, s.held)
            self._take(s, decoder, event)
            while not s.status and s.next in s.ahead:
                self._take(s, decoder, s.ahead.pop(s.next))
        for request, decoder in decoders.items():
            known[request].line, known[request].held = decoder.line, decoder.held
        for request in changed:
            self._wait(known[request])
        if changed:
            self._save(known)
        yield from ()

    def _follow(self, order: list[tuple[int, int]], known: dict[int, _State], request: int, at: int) -> set[int]:
        """The request ends the one before it in the session, and the one after ends it; requests may come in any order. Returns those that change."""
        place = bisect(order, (at, request))
        order.insert(place, (at, request))
        s = known[request]
        s.asked_ms = at
        if place + 1 < len(order):
            s.cancel_ms = order[place + 1][0]
        if not place:
            return {request}
        before = known[order[place - 1][1]]
        before.cancel_ms = at if before.cancel_ms is None else min(before.cancel_ms, at)
        return {request, before.request_id}

    def _take(self, s: _State, decoder: Decoder, event: tuple) -> None:
        """The next row of a request, in order."""
        kind, at, chunk, error, provider = event
        s.next += 1
        if kind == "request":
            s.provider = decoder.provider = provider
            s.last_ms = at
        elif at - s.last_ms > self._limit(s):
            s.status, s.end_ms = (IDLE if s.started else SETUP), s.last_ms + self._limit(s)
            s.next -= 1
        elif error is not None or chunk is None:
            s.status, s.error, s.end_ms = (DONE if error is None else ERROR), error, at
            s.next -= 1
        else:
            s.started, s.last_ms = True, max(s.last_ms, at)
            text = decoder.feed(bytes(chunk))
            if text:
                s.parts.append(text)

    def _wait(self, s: _State) -> None:
        """Set what a request waits for: its end, if that is known, else its time limit."""
        if s.gone:
            return
        if s.status:
            due = s.end_ms
        elif s.asked_ms is None:  # chunks of a request that isn't known
            due = s.last_ms + self.linger_ms
        else:
            due = s.last_ms + self._limit(s) + 1
        s.due_ms = due if s.cancel_ms is None else min(due, s.cancel_ms)

    def _save(self, known: dict[int, _State], fired: bool = False) -> None:
        """Write the open requests back, and move the timer to the earliest time that a request waits for. fired: it has just gone off."""
        rows = [s.row() for s in known.values() if not s.gone]
        self.requests.put(rows) if rows else self.requests.clear()
        was = None if fired else self.timer.get()
        due = min((s.due_ms for s in known.values()), default=None)
        if was and was[0] == due:
            return
        if was:
            self.handle.deleteTimer(was[0])
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self._load()
        # All that the watermark has passed, as timers of each would go off in this batch.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for s in sorted((s for s in known.values() if s.due_ms <= now), key=lambda s: (s.due_ms, s.request_id)):
            if s.gone:
                self.gone.removeKey((s.request_id,))
                del known[s.request_id]
                continue
            yield self._end(key[0], s)
            # A finished id stays for a while, so that what comes late doesn't open it again and what it followed is known.
            until = max(s.end_ms, s.due_ms) + self.linger_ms
            if until <= now:
                del known[s.request_id]
            else:
                known[s.request_id] = _State(s.request_id, asked_ms=s.asked_ms, gone=True, due_ms=until)
                self.gone.updateValue((s.request_id,), (s.asked_ms, until))
        self._save(known, fired=True)

    def _end(self, session: str, s: _State) -> Row:
        """The row of a request whose end the watermark has reached."""
        if s.asked_ms is None:
            s.status, s.end_ms = ORPHAN, s.due_ms
        elif not s.status:
            s.status, s.end_ms = (IDLE if s.started else SETUP), s.last_ms + self._limit(s)
        if s.cancel_ms is not None and s.cancel_ms <= s.end_ms:
            s.status, s.error, s.end_ms = CANCELLED, None, s.cancel_ms
        answer = None
        if s.status in ANSWERED:
            answer = "".join(s.parts)
            if s.status != ERROR:  # the line that an error cut off isn't shown
                answer += Decoder(s.provider, s.line, s.held).finish()
        return Row(session_id=session, request_id=s.request_id, provider=s.provider, status=s.status, answer=answer, error=s.error, chunks=max(s.next - 1, 0), ended_at=_at(s.end_ms))

    def close(self) -> None:
        pass


def answers_stream(requests: DataFrame, chunks: DataFrame, lateness: str = "10 seconds", setup_ms: dict[str, int] = SETUP_MS, idle_ms: dict[str, int] = IDLE_MS, linger_ms: int | None = None) -> DataFrame:
    """(session_id, request_id, provider, status, answer, error, chunks, ended_at): one row for each request when it has ended.

    requests: a stream of (session_id string, request_id long, requested_at timestamp, provider string). chunks: a stream of
    (session_id string, request_id long, seq long from 0, arrived_at timestamp, chunk binary, error string); a row without a chunk ends the answer, a row with an
    error breaks it off. Rows may come in any order and cut bytes anywhere, and repeated ones count once; rows later than lateness behind
    the newest of both streams are dropped. A request without a session is a session of its own.

    status is done; idle or setup, if no chunk came for idle_ms after another or setup_ms after the request (by local or cloud); error;
    cancelled, if a later request of the session (by time, then id) came before the end; or orphan, for chunks whose request isn't there within linger_ms.
    answer is the text of the events in the bytes by the provider's protocol, without reasoning: all of it, or what came before silence or an error
    (then without the line that was cut off). setup, cancelled and orphan have none. The state of a request holds one line,
    the text so far and the rows ahead of a gap. When it has ended it shrinks to its id, which goes after linger_ms."""
    linger = linger_ms if linger_ms is not None else 2 * max(*setup_ms.values(), *idle_ms.values())
    null = lambda kind: F.lit(None).cast(kind)
    asked = requests.select("session_id", "request_id", F.lit("request").alias("kind"), null("long").alias("seq"), F.col("requested_at").alias("arrived_at"), null("binary").alias("chunk"), null("string").alias("error"), "provider")
    sent = chunks.select("session_id", "request_id", F.lit("chunk").alias("kind"), "seq", "arrived_at", F.col("chunk").cast("binary").alias("chunk"), "error", null("string").alias("provider"))
    # One watermark for both: a stream in which nothing happens doesn't hold the other back.
    events = asked.unionByName(sent).withWatermark("arrived_at", lateness)
    events = events.withColumn("session_id", F.coalesce("session_id", F.concat(F.lit("request "), F.col("request_id").cast("string"))))
    return events.groupBy("session_id").transformWithState(Answers(dict(setup_ms), dict(idle_ms), linger), ANSWER, "append", "eventTime", eventTimeColumnName="ended_at")


def log_lines(answers: DataFrame) -> DataFrame:
    """(request_id, provider, level, line, ended_at): a line for each request that didn't end well, its detail cut as in every log."""
    said = {IDLE: "no chunk came in time; the answer was closed", SETUP: "no first chunk came in time", ERROR: "the stream broke off", ORPHAN: "chunks came without a request"}
    status = F.col("status")
    what = F.coalesce(*(F.when(status == k, F.lit(v)) for k, v in said.items()))
    detail = F.concat(what, F.when(F.col("error").isNotNull(), F.concat(F.lit(": "), F.col("error"))).otherwise(F.lit("")))
    line = F.concat(F.lit("["), F.coalesce("provider", F.lit("unknown")), F.lit("] "), log_line(detail))
    return answers.filter(status.isin(*said)).select("request_id", "provider", F.when(status == IDLE, "warn").otherwise("error").alias("level"), line.alias("line"), "ended_at")


@dataclass(frozen=True)
class Delivery:
    """Tables for a stream of answers: those to show under answers, with whatever columns they have, and lines about the others under log.

    A batch goes to a folder of its number in each table, in place of what is there, so a batch that runs again adds
    nothing, and one that was cut off is made whole. Readers see the number as the column batch_id."""

    answers: str
    log: str
    shown: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the state is worked out once for both tables
        try:
            kept = self.shown(batch.filter(F.col("status").isin(*ANSWERED)))
            for df, path in ((kept, self.answers), (log_lines(batch), self.log)):
                df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            batch.unpersist()


def deliver(answers: DataFrame, delivery: Delivery, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the delivery of a stream of answers; without a trigger, of what is there."""
    return answers.writeStream.foreachBatch(delivery).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
