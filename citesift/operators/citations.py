"""Citation audit: extract, resolve, verify, deduplicate and summarise statutory citations, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once
from ..functions.text import EDGE_AFTER, EDGE_BEFORE, SPACE, WIDE_SPACE, escaped, js_trim
from ..sources import registry

# The shape of a number, the key words before it, the last words of statute names, and the three patterns.
NUMBER = r"\d{1,3}[A-Za-z]{0,2}(?:\(\d+[a-z]?\))?"
KEYWORD = r"(?:sections?|sec\.?|s\.)"
CASED_KEYWORD = r"(?:[Ss]ections?|[Ss]ec\.?|[Ss]\.)"
STATUTE_ENDS = "Act|Sanhita|Code|Adhiniyam|Rules|Regulations"

NAMES = "|".join(escaped(a) for _, a in registry.sorted_aliases())
#: A number, then an act known by name.
NUMBER_FIRST = f"(?i){EDGE_BEFORE}{KEYWORD}{SPACE}*({NUMBER}){SPACE}*(?:of{SPACE}+)?(?:the{SPACE}+)?({NAMES}){EDGE_AFTER}"
#: An act known by name, then a number; nothing need follow the number.
ACT_FIRST = rf"(?i){EDGE_BEFORE}({NAMES}){EDGE_AFTER}(?:,?{SPACE}*\d{{4}})?[{WIDE_SPACE},]*[(\[]?{SPACE}*{KEYWORD}{SPACE}*({NUMBER})"
#: A number, then any words that look like a statute's name.
ANY_STATUTE = rf"{EDGE_BEFORE}{CASED_KEYWORD}{SPACE}*({NUMBER}){SPACE}+of{SPACE}+(?:[Tt]he{SPACE}+)?((?:[A-Z][A-Za-z0-9_()'-]*{SPACE}+){{0,6}}?(?:{STATUTE_ENDS})){EDGE_AFTER}"
#: Every pattern needs a key word before a digit.
CANDIDATE = rf"(?i)s(?:ec(?:tions?)?)?\.?{SPACE}*\d"

VERIFIED, UNKNOWN, UNRECOGNISED = "verified", "unknown-section", "unrecognised"


def _map(pairs: Iterable[tuple[str, str]]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def act_needle(name: Column) -> Column:
    """An act's name as its aliases are looked for in it: lower case, without commas, stops and years, single spaces."""
    needle = F.regexp_replace(F.lower(name), "[,.]", " ")
    needle = F.regexp_replace(needle, rf"{EDGE_BEFORE}(?:19|20)\d{{2}}{EDGE_AFTER}", " ")
    return js_trim(F.regexp_replace(needle, f"{SPACE}+", " "))


def resolve_act(name: Column) -> Column:
    """The id of the act whose longest alias the name contains, or null."""
    needle = act_needle(name)
    known = F.array(*(F.struct(F.lit(act).alias("act"), F.lit(alias).alias("alias")) for act, alias in registry.sorted_aliases()))
    held = F.element_at(F.transform(F.array(needle), lambda n: F.get(F.filter(known, lambda a: F.contains(n, a["alias"])), 0)["act"]), 1)
    # A name that is an alias contains no longer one.
    return F.coalesce(F.try_element_at(_map((alias, act) for act, alias in registry.sorted_aliases()), F.lower(name)), held)


def source_url(act_id: Column) -> Column:
    # Characters that browsers leave as they are, besides letters and digits.
    return F.try_element_at(_map((a[0], registry.SOURCE_BASE + quote(f"{a[2]} {a[3]}", safe="-_.!~*'()")) for a in registry.ACTS), act_id)


def verify(raw: Column, act_id: Column, number: Column) -> Column:
    """The citation of a section of an act: exact, else by its parent with a caution, else unknown; unrecognised without an act."""
    headings = _map((f"{act}:{n.upper()}", heading) for act, n, heading, _ in registry.SECTIONS)
    names = _map((a[0], a[1]) for a in registry.ACTS)
    heading = lambda act, n: F.try_element_at(headings, F.concat_ws(":", act, n))
    above = F.when(F.contains(number, F.lit("(")), F.nullif(F.regexp_extract(number, r"^(\d{1,3}[A-Z]{0,2})\(", 1), F.lit("")))
    found = F.struct(raw.alias("raw"), act_id.alias("act"), number.alias("n"), heading(act_id, number).alias("exact"), above.alias("above"))

    def cited(c: Column) -> Column:
        by_parent = F.when(c["exact"].isNull() & c["above"].isNotNull(), heading(c["act"], c["above"]))
        return F.struct(*(c[k].alias(k) for k in ("raw", "act", "n", "exact", "above")), by_parent.alias("parent"), F.try_element_at(names, c["act"]).alias("name"))

    def citation(c: Column) -> Column:
        caution = (
            F.when(c["act"].isNull(), F.lit("This law isn't in the registry, so the reference couldn't be checked."))
            .when(c["exact"].isNotNull(), F.lit(None).cast("string"))
            .when(c["parent"].isNotNull(), F.concat(F.lit("Section "), c["above"], F.lit(" of the "), c["name"], F.lit(" is confirmed; its sub-clause wasn't checked.")))
            .otherwise(F.concat(F.lit("The registry doesn't hold Section "), c["n"], F.lit(" of the "), c["name"], F.lit("; check it at the source.")))
        )
        heading = F.coalesce(c["exact"], c["parent"])
        status = F.when(c["act"].isNull(), UNRECOGNISED).when(heading.isNotNull(), VERIFIED).otherwise(UNKNOWN)
        return F.struct(
            c["raw"].alias("raw"), c["act"].alias("act_id"), c["n"].alias("number"), status.alias("status"),
            heading.alias("heading"), source_url(c["act"]).alias("url"), caution.alias("caution"),
        )

    return once(once(found, cited), citation)


def verify_citation(raw: Column, act_name: Column, number: Column) -> Column:
    return verify(raw, resolve_act(act_name), F.upper(js_trim(number)))


def matches(text: Column, pattern: str, act_group: int, number_group: int) -> Column:
    """All matches of one pattern, left to right: raw, act (its name), number. The text is searched once; a match alone gives
    the same groups again, as nothing outside it was looked at but the edges of words."""
    part = lambda raw, group: F.regexp_extract(raw, pattern, group)
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda raw: F.struct(raw.alias("raw"), part(raw, act_group).alias("act"), F.upper(part(raw, number_group)).alias("number")),
    )


def mentions(text: Column) -> Column:
    """The references of a text as an array (raw, act_id, number), in the order of pattern and place; of equal ones the first
    stays, and unresolved fragments of longer resolved ones go. Null texts have none."""
    found = F.concat(matches(text, NUMBER_FIRST, 2, 1), matches(text, ACT_FIRST, 1, 2), matches(text, ANY_STATUTE, 2, 1))
    found = F.transform(found, lambda m: F.struct(m["raw"].alias("raw"), resolve_act(m["act"]).alias("act_id"), m["number"].alias("number")))
    key = lambda c: F.coalesce(F.concat(c["act_id"], F.lit(":"), c["number"]), F.lower(c["raw"]))

    def unique(found: Column) -> Column:
        def firsts(keys: Column) -> Column:
            return F.filter(found, lambda c, i: F.array_position(keys, F.get(keys, i)) == i + 1)
        return F.when(F.size(found) < 2, found).otherwise(once(F.transform(found, key), firsts))

    def unshadowed(cs: Column) -> Column:
        held = lambda c: F.exists(cs, lambda o: o["act_id"].isNotNull() & (F.length(o["raw"]) > F.length(c["raw"])) & F.contains(o["raw"], c["raw"]))
        return F.filter(cs, lambda c: c["act_id"].isNotNull() | ~held(c))

    none = F.array().cast("array<struct<raw:string,act_id:string,number:string>>")
    return F.when(text.rlike(CANDIDATE), once(once(found, unique), unshadowed)).otherwise(none)


def extract(text: Column) -> Column:
    """The citations of a text as an array: its mentions, verified."""
    return F.transform(mentions(text), lambda m: verify(m["raw"], m["act_id"], m["number"]))


def audit(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with citations, verified, unverified and uncited."""
    docs = docs.withColumn("citations", extract(F.col(text_col)))
    verified = F.size(F.filter("citations", lambda c: c["status"] == VERIFIED))
    return docs.withColumns({"verified": verified, "unverified": F.size("citations") - verified, "uncited": F.size("citations") == 0})


def rows(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """A row for each citation; texts without any keep one row of nulls."""
    cited = docs.select(F.col(id_col), F.explode_outer(extract(F.col(text_col))).alias("c"))
    return cited.select(id_col, "c.*")


def mention_rows(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, raw, act_id, number): a row for each mention, not yet verified; texts without any have no row."""
    return docs.select(F.col(id_col), F.explode_outer(mentions(F.col(text_col))).alias("m")).select(id_col, "m.*").filter("raw is not null")


def verify_rows(cited: DataFrame) -> DataFrame:
    """The relational form: a table with act_id and number, joined to the registry (52 rows, broadcast) exactly, then by parent."""
    spark = cited.sparkSession
    known = registry.sections(spark).select("act_id", F.upper("number").alias("number"), "heading")
    parent = F.nullif(F.regexp_extract(F.upper("number"), r"^(\d{1,3}[A-Z]{0,2})\(", 1), F.lit(""))
    out = cited.withColumn("number", F.upper(js_trim(F.col("number")))).withColumn("_parent", parent)
    out = out.join(F.broadcast(known), ["act_id", "number"], "left")
    out = out.join(F.broadcast(known.select("act_id", F.col("number").alias("_parent"), F.col("heading").alias("_above"))), ["act_id", "_parent"], "left")
    status = F.when(F.col("act_id").isNull(), UNRECOGNISED).when(F.col("heading").isNotNull() | F.col("_above").isNotNull(), VERIFIED).otherwise(UNKNOWN)
    return out.withColumns({"status": status, "by_parent": F.col("heading").isNull() & F.col("_above").isNotNull()}).drop("_parent", "_above")


def status_label(status: Column) -> Column:
    return F.when(status == VERIFIED, "Verified").when(status == UNKNOWN, "Unconfirmed section").otherwise("Unknown law")
