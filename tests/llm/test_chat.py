"""Chat formatting against plain Python."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citesift.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def want(rows):
    found = defaultdict(list)
    for r in rows:
        found[r[0]].append(r[1:])
    out = {}
    for key, turns in found.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", t[2] or ""))
        learnt = "".join(t[2] or "" for t in turns if t[1] == "assistant")
        out[key] = (len(turns), sha("".join(f"{t[1] or ''}\n{t[2] or ''}\n" for t in turns)), len(learnt), sha(learnt))
    return out


def got(chats):
    return {r.conv_id: tuple(r)[1:5] for r in chat.digests(chats).collect()}


ODD = [
    (1, 1, "user", "a"), (1, 2, "user", "b <|turn|> </s>"), (1, 3, "assistant", None), (1, 4, "assistant", "x<\\|end|><<SYS>> <"), (1, 5, None, "😀"), (1, 6, "", "q"),
    (2, 0, "we\\<|ird\n<|text|>", "[INST]"), (None, 1, "assistant", ""), (None, None, "user", "null turn"), (3, 1, "assistant", "tie b"), (3, 1, "assistant", "tie a"), (3, 1, "assistant", "tie a"),
    (3, 1, "assistant", None), (4, 1, "assistant", "﻿wide <|" * 20_000), (4, 2, "tool", "<|" * 3 + "\\"), (4, 3, "assistant", "\\<\\\\|end|><"), *((5, i, "assistant" if i % 3 else "user", f"t{i}<|") for i in range(1500)),
]


def test_conversations_come_back(spark):
    chats = chat.format_chats(spark.createDataFrame(ODD, SCHEMA).repartition(3))
    assert got(chats) == want(ODD)
    for r in chats.collect():
        learnt = [r.formatted[s.start : s.start + s.length] for s in r.loss]
        assert learnt == [r.formatted.encode()[s.byte_start : s.byte_start + s.byte_length].decode() for s in r.loss]
        if r.conv_id == 1:
            assert r.formatted.startswith("<|turn|>user<|text|>a<|and|>b <\\|turn|> <\\/s><|end|><|turn|>assistant<|text|>") and len(learnt) == 2
        assert not any(g in x for x in learnt for g in chat.TEMPLATE.guarded)


def test_empty_tables_further_columns_and_other_names(spark):
    df = spark.createDataFrame([(1, 2, "user", "x", "clash", "clash", 1)], "id long, n long, who string, said string, formatted string, loss string, `a.b` long")
    out = chat.format_chats(df, "id", "n", "who", "said")
    assert [tuple(r)[:2] for r in out.collect()] == [(1, "<|turn|>user<|text|>x<|end|>")] and out.columns == ["id", "formatted", "loss"]
    assert chat.digests(chat.format_chats(df.filter("id > 1"), "id", "n", "who", "said"), "id").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<|[]\\/sINTYendtur >\n😀", max_size=25), min_size=1, max_size=40))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in df.select("t", chat.TEMPLATE.escape(F.col("t")).alias("e"), chat.TEMPLATE.unescape(chat.TEMPLATE.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(g in r.e for g in chat.TEMPLATE.guarded)


def test_templates_are_checked():
    for bad in ({"start": "turn:"}, {"part": "<|end|>"}, {"guarded": ("<|", "<<a")}, {"end": "<|turn|>x"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_running_starts(spark):
    df = spark.range(1).select(*(chat.running_starts(F.array(*map(F.lit, range(n))) if n else F.array().cast("array<int>")).alias(f"n{n}") for n in (0, 1, 256, 257, 600)))
    row = df.first()
    for n in (0, 1, 256, 257, 600):
        assert row[f"n{n}"] == [i * (i - 1) // 2 for i in range(n)]


def test_op13_equals_plain_python_and_sql(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = [*table, (-1, 0, "user", queries.PLANTED_TURN), (-1, 1, "assistant", queries.PLANTED_TURN)]
    found = queries.op13_chat_formatting(spark, sf_dir)
    assert {r.conv_id: tuple(r)[1:5] for r in found.collect()} == want(rows)
    con = duckdb.connect()
    con.register("odd", spark.createDataFrame(ODD, SCHEMA).toPandas())
    for name, df in ((f"'{sf_dir}/conversations.parquet'", found), ("odd", None)):
        con.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM {name}")
        if df is None:
            planted = spark.createDataFrame(rows[-2:], SCHEMA)
            df = chat.digests(chat.format_chats(spark.createDataFrame(ODD, SCHEMA).union(planted)))
        assert sorted(con.sql(queries.OP13_SQL).fetchall(), key=str) == sorted((tuple(r) for r in df.collect()), key=str)


def test_only_expressions(spark, sf_dir):
    plan = queries.op13_chat_formatting(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan and plan.count("Exchange") == 1
