"""Golden rows of the citation audit, and its plan."""

import time

import pytest
from pyspark.sql import functions as F

from citesift.operators import citations, scenario
from citesift.sources import registry

CASES = [
    ("The officer wrote Section 85 BNS on the form.", ["BNS 85 verified"]),
    ("Late flats fall under RERA Section 18, says the letter.", ["RERA 18 verified"]),
    ("The charge is Section 66D of the IT Act, 2000 and no other.", ["IT 66D verified"]),
    ("They pleaded Section 66C of the IT Act only.", ["IT 66C verified"]),
    ("Both Section 12 of the PWDVA and Section 18 of the PWDVA were named", ["PWDVA 12 verified", "PWDVA 18 verified"]),
    ("Count one is Section 85 BNS. Count two repeats BNS Section 85 in full.", ["BNS 85 verified"]),
    ("The hearing was put off for a month.", []),
    ("It quotes Section 5 of the Lighthouse Keepers Act 1999 at length.", ["None 5 unrecognised"]),
    ("Charges: Section 85 BNS and Section 12 of the PWDVA. The clerk added Section 999 BNS.", ["BNS 85 verified", "PWDVA 12 verified", "BNS 999 unknown-section"]),
    ("Section 85 of the BNS, Section 12 of the PWDVA", ["BNS 85 verified", "PWDVA 12 verified", "BNS 12 unknown-section"]),
    ("Section 17 of the Code on Wages", ["WAGES 17 verified"]),
    ("BNS Section 3035", ["BNS 303 verified"]),
    ("Section 1234 BNS", []),
    ("BNS Section 85th", ["BNS 85TH unknown-section"]),
    ("Sections 12 and 18 of the PWDVA", []),
    ("u/s 85 BNS", []),
    ("Section 66(a) of the IT Act", []),
    ("Section 7 of the Prevention of Corruption Act", []),
    ("SECTION 5 OF THE FAKE ACT", []),
    ("Section 11 of the Maharashtra Tenancy Act", ["MTA 11 verified"]),
    ("Section 5 of the Audit Act", ["IT 5 unknown-section"]),
    ("Sec. 17 of the Code on Wages; Section 17 of the Code on Wages", ["WAGES 17 verified", "None 17 unrecognised"]),
    ("**Section 85** of the BNS", []),
    ("**Section 85 of the BNS**", ["BNS 85 verified"]),
    ("Model Tenancy Act, 2021 (Section 11)", ["MTA 11 verified"]),
    ("Section 420 IPC", ["BNS 420 unknown-section"]),
    ("Section\u00a085 BNS", ["BNS 85 verified"]),
    ("éSection 85 BNS", ["BNS 85 verified"]),
    ("Section 19 of the PWDVA; Section 19(2) of the PWDVA", ["PWDVA 19 verified", "PWDVA 19(2) verified"]),
    ("Section 2(11) of the CPA; Section 2(9) of the CPA", ["CPA 2(11) verified", "CPA 2(9) unknown-section"]),
    (None, []),
    ("", []),
]


@pytest.fixture(scope="module")
def audited(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    return {r.i: r for r in citations.audit(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_golden(audited, i):
    got = [f"{c.act_id} {c.number} {c.status}" for c in audited[i].citations]
    assert got == CASES[i][1]
    assert audited[i].verified == sum(x.endswith(" verified") for x in got) and audited[i].unverified == len(got) - audited[i].verified
    assert audited[i].uncited == (not got)


def test_cautions_and_urls(spark):
    rows = [("PWDVA", "19(2)"), ("BNS", "999"), ("Imaginary Act", "5"), ("CrPC", "173"), ("CPA", "2(11)")]
    df = spark.createDataFrame(rows, "act string, number string")
    a, b, c, d, e = (r.c for r in df.select(citations.verify_citation(F.lit("x"), F.col("act"), F.col("number")).alias("c")).collect())
    assert (a.status, a.caution is not None, a.heading) == ("verified", True, "Residence orders")
    assert b.status == "unknown-section" and "999" not in b.url
    assert c.status == "unrecognised" and c.url is None
    assert d.act_id == "BNSS" and d.status == "verified" and d.caution is None
    assert e.status == "verified" and e.caution is None


def test_hostile_text_is_quick(spark):
    df = spark.createDataFrame([("Section " + "9" * 500 + " of the " + "A" * 500 + " Act " + "Aa " * 5000,)], "text string")
    citations.audit(df).collect()
    start = time.time()
    citations.audit(df).collect()
    assert time.time() - start < 5


def test_array_form_has_no_shuffle(spark):
    df = spark.createDataFrame([("Section 85 BNS",)], "text string")
    assert "Exchange" not in citations.audit(df)._jdf.queryExecution().executedPlan().toString()


def test_relational_form_broadcasts(spark):
    df = spark.createDataFrame([("BNS", "85"), ("PWDVA", "19(2)"), (None, "5")], "act_id string, number string")
    out = citations.verify_rows(df)
    assert [(r.status, r.by_parent) for r in out.orderBy("number").collect()] == [("verified", True), ("unrecognised", False), ("verified", False)]
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()


def test_registry_is_consistent():
    ids = {a[0] for a in registry.ACTS}
    keys = [(a, n.upper()) for a, n, _, _ in registry.SECTIONS]
    assert len(ids) == len(registry.ACTS) == 10 and len(set(keys)) == len(keys) == 52
    assert {a for a, _ in keys} == ids == set(registry.ALIASES)
    assert all(p for a, _, _, p in registry.SECTIONS if a in ("BNS", "BNSS"))
    assert all(len(r[4]) > 40 for r in registry.section_rows()) and len({r[4] for r in registry.section_rows()}) == 52 and all(len(r[6]) > 30 for r in registry.act_rows())
    assert sum(len(x) for x in registry.ALIASES.values()) == 33
    assert [n for n, _, primary, _ in registry.HELPLINES if primary] == ["112", "1091", "1930", "15100"]
    assert {n for s in registry.SCENARIOS for n in s[2]} <= {h[0] for h in registry.HELPLINES}


def test_canned_answers_cite_the_registry_and_name_their_helplines(spark):
    rows = citations.audit(registry.scenarios(spark), "answer").collect()
    assert len(rows) == 5
    for r in rows:
        assert r.verified >= 3 and r.unverified == 0 and len(r.answer) > 800 and all(n in r.answer for n in r.helplines)


def test_plan_resolves_each_mention_once(spark):
    df = spark.createDataFrame([("Section 85 BNS",)], "text string")
    plan = citations.audit(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 10 and plan.count("regexp_extract_all(") == 3


def test_canned_questions_find_their_scenario(spark):
    rows = registry.scenarios(spark).select("scenario_id", scenario.match(F.col("question")).alias("found")).collect()
    assert all(r.scenario_id == r.found for r in rows)
