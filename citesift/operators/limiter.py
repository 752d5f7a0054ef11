"""Token buckets by key, over a table of requests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Requests and window of questions and of documents.
CHAT_LIMIT, DOCUMENT_LIMIT, WINDOW_MS = 12, 6, 60_000


def take(tokens: float, updated_ms: int, now_ms: int, capacity: float, window_ms: float, cost: float) -> tuple[float, bool, int]:
    """Refill a bucket and take cost from it: tokens left, allowed, seconds to wait. A refusal takes nothing."""
    rate = capacity / window_ms
    tokens = min(capacity, tokens + (now_ms - updated_ms) * rate)
    if tokens >= cost:
        return tokens - cost, True, 0
    return tokens, False, max(1, math.ceil((cost - tokens) / rate / 1000))


def rate_limit(requests: DataFrame, capacity: float, window_ms: float, key_col: str = "key", ts_col: str = "ts_ms", id_col: str = "id", cost: float = 1.0) -> DataFrame:
    """requests with allowed and retry_after (seconds), as one bucket for each key decides in the order of time, then id.

    Keys are dealt to tasks and sorted there; a task holds one bucket at a time, however many requests a key has. A null key is a key.
    Columns pass through Arrow unchanged, 64-bit integers beside nulls too, whatever their names."""
    names = requests.columns
    key_at, ts_at, id_at = (names.index(c) for c in (key_col, ts_col, id_col))
    # Names with dots and such don't pass through Arrow, so columns go by place.
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(requests.schema.fields))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens, updated = object(), capacity, 0
        for batch in it:
            allowed, wait = [], []
            for key, ts in zip(batch.column(key_at).to_pylist(), batch.column(ts_at).to_pylist()):
                if key != last:
                    last, tokens, updated = key, capacity, ts
                tokens, ok, retry = take(tokens, updated, ts, capacity, window_ms, cost)
                updated = ts
                allowed.append(ok)
                wait.append(retry)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_()), pa.array(wait, pa.int32())], names=[*batch.schema.names, "allowed", "retry_after"])

    dealt = requests.toDF(*(f"c{i}" for i in range(len(names)))).repartition(F.col(f"c{key_at}")).sortWithinPartitions(f"c{key_at}", f"c{ts_at}", f"c{id_at}")
    return dealt.mapInArrow(run, f"{fields}, allowed boolean, retry_after int").toDF(*names, "allowed", "retry_after")
