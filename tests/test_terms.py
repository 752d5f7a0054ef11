"""Strict citations, terms from tables, substring search and checks against plain versions."""

import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citesift.operators import checks, citations, documents, limiter, prompts, scenario, search, strict, terms
from citesift.sources import files, registry


def cited(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    rows = strict.citation_rows(df, "i").collect()
    return [sorted((r.start, r.code or r.act_id, r.number, r.section, r.status, r.by_parent) for r in rows if r.i == i) for i in range(len(texts))]


def test_one_number_serves_one_citation(spark):
    text = "Section 85 of the BNS, Section 12 of the PWDVA"
    plain = spark.createDataFrame([(0, text)], "i long, text string").select(F.explode(citations.extract(F.col("text"))).alias("c")).select("c.act_id", "c.number").collect()
    assert {tuple(r) for r in plain} == {("BNS", "85"), ("PWDVA", "12"), ("BNS", "12")}  # the plain form keeps its phantom
    got = cited(spark, text, "BNSS Section 173 BNS Section 85", "Sec. 17 of the Code on Wages, later Section 17 of the Code on Wages", "See Section 5 of the Fictional Thing Act; section 85 BNS", None, "", "no law", "BNS Section 85; Section 85 BNS", "s. 1 ipc" * 3000)
    assert got == [
        [(0, "BNS", "85", "85", "verified", False), (23, "PWDVA", "12", "12", "verified", False)],
        [(0, "BNSS", "173", "173", "verified", False), (17, "BNS", "85", "85", "verified", False)],
        [(0, "WAGES", "17", "17", "verified", False)],
        [(4, None, "5", None, "unrecognised", False), (42, "BNS", "85", "85", "verified", False)],
        [], [], [], [(0, "BNS", "85", "85", "verified", False)], [],
    ]


def test_old_numbers_find_the_sections_of_today(spark):
    got = cited(spark, "Section 420 IPC", "Section 85 IPC", "s. 498A of the Indian  Penal Code", "Section 154(3) CrPC", "Section 406 IPC and Section 405 IPC", "Section 318 BNS")
    assert got == [
        [(0, "IPC", "420", "318", "verified", False)], [(0, "IPC", "85", None, "unknown-section", False)], [(0, "IPC", "498A", "85", "verified", False), (0, "IPC", "498A", "86", "verified", False)],
        [(0, "CRPC", "154(3)", "173", "verified", True)], [(0, "IPC", "406", "316", "verified", False), (20, "IPC", "405", "316", "verified", False)], [(0, "BNS", "318", "318", "verified", False)],
    ]
    rows = strict.concordance_rows()
    assert ("IPC", "415", "BNS", "318", True) in rows and ("IPC", "420", "BNS", "318", True) in rows and ("IPC", "498A", "BNS", "86", False) in rows
    assert {(c, n) for c, n, *_ in rows if c == "IPC"} >= {("IPC", x) for x in ("503", "506", "378", "379", "416", "419", "323")} and all(not n.islower() for _, n, *_ in rows)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Section 85 ", "BNS", "of the ", "PWDVA", ", ", "😀 ", "section 12(1) ", "IPC", ". ", "The Old Act ", "s.3 ", "", "é"]), max_size=14).map("".join), min_size=1, max_size=25))
def test_places_are_those_of_the_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in df.select("text", strict.mentions(F.col("text")).alias("ms")).collect():
        spans = [(m.start, m.end) for m in r.ms]
        assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert all(r.text.replace("", "�")[m.start : m.end] == m.raw for m in r.ms)
        assert len({(m.code or m.act_id, m.number) if m.act_id else m.raw.lower() for m in r.ms}) == len(r.ms)


def plain_hits(texts, words):
    out = set()
    for i, t in texts:
        for w in set(words) - {None}:
            if t is not None and w in t:
                out.add((i, w, sum(t.startswith(w, k) for k in range(len(t))) if w else 1, t.find(w)))
    return out


def test_term_hits(spark, monkeypatch):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choices("ab ü😀", k=rng.randint(0, 40)))) for i in range(80)] + [(90, None), (91, ""), (91, "aaaa"), (92, "ab" * 30_000)]
    words = ["a", "ab", "aa", "b ü", "😀", "😀a", "", None, "ab", "zzz", "ab" * 300]
    df, table = spark.createDataFrame(texts, "i long, text string").repartition(3), spark.createDataFrame([(w, "x") for w in words], "term string, `a.b` string")
    rows = terms.term_hits(df, table, "i").collect()
    assert {tuple(r) for r in rows} == plain_hits(texts, words) and len(rows) == len(set(rows)) + 1  # two texts of id 91 hold the empty term
    monkeypatch.setattr(terms, "MAX_BYTES", 200)
    assert {tuple(r) for r in terms.term_hits(df, table, "i").collect()} == plain_hits(texts, words)
    assert terms.term_hits(df, table.filter("term = 'zzz'"), "i").count() == 0 and terms.term_hits(df, table.filter("false"), "i").count() == 0
    assert terms.term_hits(df.filter("false"), table, "i").count() == 0


def test_names_and_scenarios_by_tables_equal_the_literals(spark):
    names = ["The BNS, 2023", "code of criminal procedure", "Maharashtra Tenancy Act", "Audit Act", "nothing", None, "", "ipc and crpc", "Indian Railways Act 1989"]
    df = spark.createDataFrame(list(enumerate(names)), "i long, name string")
    want = {tuple(r) for r in df.select("i", citations.resolve_act(F.col("name"))).collect()}
    assert {tuple(r) for r in terms.resolve_names(df, registry.aliases(spark), "i", "name").collect()} == want
    asked = ["My parents live in a flat", "landlord deposit husband beat", "upi scam", "train", None, "", "White SEAT berth rent"]
    q = spark.createDataFrame(list(enumerate(asked)), "i long, question string")
    signals = registry.scenarios(spark).select("scenario_id", "priority", F.explode("signals").alias("keyword"))
    want = {tuple(r) for r in q.select("i", scenario.match(F.col("question"))).collect()}
    assert {(r.i, r.scenario_id) for r in terms.match_scenarios(q, signals, "i").collect()} == want


def test_contained(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choices("abcü😀", k=rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "abc" * 20_000), (62, "abcabc")]
    needles = [(i, "".join(rng.choices("abcü😀", k=rng.randint(0, 5)))) for i in range(120)] + [(200, None), (201, "zz"), (202, "abca"), (202, "abca"), (203, "abcz")]
    t, n = spark.createDataFrame(texts, "i long, text string").repartition(3), spark.createDataFrame(needles, "k long, needle string").repartition(2)
    got = Counter(tuple(r) for r in search.contained(t, n, "i", "k").collect())
    assert got == Counter((k, i) for k, w in needles for i, x in texts if w and x is not None and w in x)
    assert search.contained(t, n.filter("needle = ''"), "i", "k").count() == 0 and search.contained(t.filter("false"), n, "i", "k").count() == 0
    plan = search.contained(t, n, "i", "k")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_gram_numbers_differ_by_size():
    one, two, three = (set(search.gram_numbers("\0a\0\0ab😀\U0010ffff", k).tolist()) for k in (1, 2, 3))
    assert not (one & two or two & three or one & three) and min(three) >= 0 > max(two | one)
    assert len(two) == 6 and len(search.gram_numbers("aaaa", 3)) == 1 and len(search.gram_numbers("a", 2)) == 0


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "b")], "k long, v string")
    assert {tuple(r) for r in checks.repeated_keys(df, "k", "v").collect()} == {(1, "a", 2), (2, None, 1)}
    assert {tuple(r) for r in checks.missing_parents(df, df.filter("k < 3").select(F.col("v").alias("p")), "v", "p").collect()} == {(None, 1), ("b", 1)}
    assert checks.repeated_keys(registry.sections(spark), "act_id", "number").count() == 0 and checks.repeated_keys(registry.acts(spark), "act_id").count() == 0
    assert checks.missing_parents(registry.sections(spark), registry.acts(spark), "act_id", "act_id").count() == 0
    assert checks.repeated_keys(registry.aliases(spark), "alias").count() == 0 and checks.repeated_keys(registry.helplines(spark), "number").count() == 0


def test_gates_fences_and_bodies(spark, tmp_path):
    df = spark.createDataFrame([("hello",), (" hey ",), (None,), ("😀😀😀",)], "q string")
    assert [r[0] for r in df.select(documents.may_ask(F.col("q"))).collect()] == [True, False, False, True]
    fences = [r[0] for r in spark.range(50).select(prompts.new_fence()).collect()]
    assert len(set(fences)) == 50 and {len(f) for f in fences} == {36}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"question": "why so", "language": "hi"}\n{broken\nnull\n')
    stream = files.bodies_stream(spark, str(tmp_path / "in"))
    query = stream.writeStream.format("memory").queryName("bodies").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.question, r.body_ok, r.body_null) for r in spark.table("bodies").collect()} == {("why so", True, False), (None, False, False), (None, False, True)}
    assert "Latin script" in {r.code: r.directive for r in registry.languages(spark).collect()}["hinglish"] and registry.helplines(spark).filter("detail is null").count() == 0


def test_limits_take_any_column_names(spark):
    df = spark.createDataFrame([("a", 1, 1, 5, 6), ("a", 2, 2, 7, 8)], "`the.key` string, ts_ms long, id long, `a b` long, c0 long")
    got = limiter.rate_limit(df, 1.0, 60_000.0, key_col="the.key")
    assert got.columns == [*df.columns, "allowed", "retry_after"] and [r.allowed for r in got.orderBy("id").collect()] == [True, False] and got.first()["a b"] in (5, 7)
