"""Streamed answers: chunks to lines, events to text, reasoning removed. Batch forms; see streaming for state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim

#: A reasoning block, closed or not, or the beginning of its tag at the end; one pass, as two would meet the pieces of others.
REASONING = r"(?s)<think>.*?(?:</think>|\z)|<(?:t(?:h(?:i(?:nk?)?)?)?)?\z"
IDLE_MS = {"cloud": 45_000, "local": 180_000}
SETUP_MS = {"cloud": 30_000, "local": 120_000}


def joined(chunks: DataFrame, id_col: str = "request_id", order_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
    """(request_id, body): the chunks of each request in order. Bytes are joined before they are decoded, so characters
    cut between chunks stay whole. A request's answer is bounded by its token limit."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.hex(F.col(chunk_col).cast("binary")).alias("c"))))
    body = F.decode(F.unhex(F.array_join(F.transform(parts, lambda x: x["c"]), "")), "UTF-8")
    return chunks.groupBy(id_col).agg(body.alias("body"))


def payloads(body: Column) -> Column:
    """The data of every event line, in order; empty lines and the end mark are left out."""
    lines = F.transform(F.split(body, "\n"), js_trim)
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: js_trim(F.substring(x, F.lit(6), F.length(x))))
    return F.filter(data, lambda x: (x != "") & (x != "[DONE]"))


def delta(payload: Column, provider: Column) -> Column:
    """The text of one event; null for malformed JSON and events without text."""
    google = F.array_join(F.from_json(F.get_json_object(payload, "$.candidates[0].content.parts"), "array<struct<text:string>>")["text"], "")
    chat = F.get_json_object(payload, "$.choices[0].delta.content")
    anthropic = F.when(F.get_json_object(payload, "$.type") == "content_block_delta", F.get_json_object(payload, "$.delta.text"))
    return F.when(provider == "google", google).when(provider.isin("openai", "local"), chat).when(provider == "anthropic", anthropic)


def strip_reasoning(text: Column) -> Column:
    return F.regexp_replace(text, REASONING, "")


def answers(chunks: DataFrame, provider_col: str = "provider") -> DataFrame:
    """(request_id, answer) from chunks with a provider each: joined, framed, decoded and without reasoning."""
    who = chunks.groupBy("request_id").agg(F.min(provider_col).alias("provider"))
    texts = joined(chunks).join(who, "request_id")
    deltas = F.transform(payloads(F.col("body")), lambda p: F.coalesce(delta(p, F.col("provider")), F.lit("")))
    return texts.select("request_id", strip_reasoning(F.array_join(deltas, "")).alias("answer"))


def timely(chunks: DataFrame, idle_ms: int = IDLE_MS["cloud"]) -> DataFrame:
    """Chunks up to the first gap of more than idle_ms; later ones are cut and the request's last chunk is marked timed_out."""
    w = Window.partitionBy("request_id").orderBy("arrived_at_ms", "seq")
    gap = (F.col("arrived_at_ms") - F.lag("arrived_at_ms").over(w) > idle_ms).cast("int")
    late = chunks.withColumn("_late", F.sum(F.coalesce(gap, F.lit(0))).over(w))
    out = late.withColumn("timed_out", F.coalesce(F.lead("_late").over(w) > 0, F.lit(False)))
    return out.filter("_late = 0").drop("_late")


def ended(requests: DataFrame, chunks: DataFrame, setup_ms: dict[str, int] = SETUP_MS, idle_ms: dict[str, int] = IDLE_MS) -> DataFrame:
    """(session_id, request_id, provider, status, answer, error, chunks, ended_at): how each request ended, by the rules of the stream form
    (streaming.requests.answers_stream, which has the columns and the rules), from whole tables."""
    at = lambda c: F.unix_millis(F.col(c))
    local = lambda limits: F.when(F.col("provider") == "local", limits["local"]).otherwise(limits["cloud"])
    session = F.coalesce("session_id", F.concat(F.lit("request "), F.col("request_id").cast("string")))
    asked = requests.select(session.alias("session_id"), "request_id", "provider", at("requested_at").alias("_asked"))
    asked = asked.withColumn("_cancel", F.lead("_asked").over(Window.partitionBy("session_id").orderBy("_asked", "request_id")))
    w = Window.partitionBy("request_id").orderBy("seq")
    sent = chunks.dropDuplicates(["request_id", "seq"]).select("request_id", "seq", F.col("chunk").cast("binary").alias("chunk"), "error", at("arrived_at").alias("_at"))
    rows = sent.join(asked.select("request_id", "provider", "_asked"), "request_id")
    rows = rows.withColumn("_last", F.greatest("_asked", F.max("_at").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    rows = rows.withColumns({"_gap": F.col("seq") != F.row_number().over(w) - 1, "_limit": F.when(F.col("seq") == 0, local(setup_ms)).otherwise(local(idle_ms))})
    stop = F.when(F.col("_gap") | (F.col("_at") - F.col("_last") > F.col("_limit")), "late").when(F.col("error").isNotNull(), "error").when(F.col("chunk").isNull(), "done")
    rows = rows.withColumn("_stop", stop).withColumn("_stops", F.count("_stop").over(w))
    # Rows up to the first that stops the request, and that one.
    rows = rows.filter((F.col("_stops") == 0) | (F.col("_stops") == 1) & F.col("_stop").isNotNull())
    flowing = F.col("_stop").isNull()
    parts = F.array_sort(F.collect_list(F.when(flowing, F.struct("seq", F.hex("chunk").alias("c")))))
    ends = rows.groupBy("request_id").agg(
        F.count_if(flowing).alias("chunks"), F.max(F.when(flowing, F.col("_at"))).alias("_at"), F.max("_stop").alias("_stop"), F.max("error").alias("error"),
        F.max(F.when(F.col("_stop").isin("error", "done"), F.col("_at"))).alias("_ended"), F.unhex(F.array_join(F.transform(parts, lambda x: x["c"]), "")).alias("_body"),
    )
    out = asked.join(ends, "request_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    quiet = F.when(F.col("chunks") > 0, F.greatest("_asked", "_at") + local(idle_ms)).otherwise(F.col("_asked") + local(setup_ms))
    out = out.withColumn("_ended", F.coalesce("_ended", quiet))
    status = F.when(F.col("_cancel") <= F.col("_ended"), "cancelled").when(F.col("_stop").isin("error", "done"), F.col("_stop")).when(F.col("chunks") > 0, "idle").otherwise("setup")
    out = out.withColumns({"status": status, "_ended": F.when(status == "cancelled", F.col("_cancel")).otherwise(F.col("_ended"))})
    text = F.make_valid_utf8(F.coalesce("_body", F.lit(b"")).cast("string"))
    text = F.when(F.col("status") == "error", F.regexp_replace(text, r"[^\n]*\z", "")).otherwise(text)
    deltas = F.transform(payloads(text), lambda p: F.coalesce(delta(p, F.col("provider")), F.lit("")))
    answer = F.when(F.col("status").isin("done", "idle", "error"), strip_reasoning(F.array_join(deltas, "")))
    return out.select("session_id", "request_id", "provider", "status", answer.alias("answer"), F.when(F.col("status") == "error", F.col("error")).alias("error"), "chunks", F.timestamp_millis("_ended").alias("ended_at"))


def setup_timed_out(requested_at_ms: Column, first_at_ms: Column, limit_ms: int = SETUP_MS["cloud"]) -> Column:
    return first_at_ms.isNull() | (first_at_ms - requested_at_ms > limit_ms)


def latest(requests: DataFrame) -> DataFrame:
    """The latest request of each session; earlier ones are abandoned."""
    return requests.groupBy("session_id").agg(F.max_by("request_id", F.struct("ts", "request_id")).alias("request_id"))


def until_error(chunks: DataFrame, error_col: str = "error") -> DataFrame:
    """Chunks before a request's first error, and the row that has it, whose chunk becomes null: what came before stays."""
    w = Window.partitionBy("request_id").orderBy("seq")
    failed = F.sum(F.col(error_col).isNotNull().cast("int")).over(w)
    kept = chunks.withColumn("_failed", failed).filter((F.col("_failed") == 0) | (F.col("_failed") == 1) & F.col(error_col).isNotNull())
    return kept.withColumn("chunk", F.when(F.col(error_col).isNull(), F.col("chunk"))).drop("_failed")


def finished(chunks: DataFrame, error_col: str = "error") -> DataFrame:
    """(request_id, answer, error) of plain text chunks: whole answers, or what came before the first error."""
    kept = until_error(chunks, error_col)
    errors = kept.groupBy("request_id").agg(F.max(error_col).alias("error"))
    return joined(kept).withColumnRenamed("body", "answer").join(errors, "request_id")


def one_shot(answer: Column) -> Column:
    """An answer that came at once, as a stream of a single chunk; an empty one is an upstream error."""
    empty = F.coalesce(js_trim(answer), F.lit("")) == ""
    return F.struct(F.when(empty, 502).otherwise(200).alias("status"), F.when(~empty, answer).alias("chunk"))
