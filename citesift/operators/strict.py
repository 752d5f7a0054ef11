"""Strict citations: every place in a text serves one citation, and numbers of repealed codes are looked up as such.

The plain form (citations) searches three patterns independently, so "Section 85 of the BNS, Section 12 of the PWDVA" also gives a BNS 12 that nobody wrote,
and it reads a number of a repealed code as one of the code that replaced it. Here matches have places, of overlapping ones one is chosen,
and old numbers go through the registry's concordance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import once, running_starts
from ..sources import registry
from .citations import ACT_FIRST, ANY_STATUTE, CANDIDATE, NUMBER_FIRST, UNKNOWN, UNRECOGNISED, VERIFIED, resolve_act

#: A private character that marks the ends of matches; a text's own count as another character of the same length.
_MARK, _OTHER = "\ue000", "\ufffd"
#: Patterns with the groups of the act's name and of the number.
PATTERNS = ((NUMBER_FIRST, 2, 1), (ACT_FIRST, 1, 2), (ANY_STATUTE, 2, 1))
# Repealed codes, by the names that texts call them.
OLD_CODES = {"IPC": ("ipc", "indian penal code"), "CRPC": ("crpc", "code of criminal procedure")}
#: Old numbers as the registry writes them: a code, then numbers; a word behind a number says that it is only part of the section.
_OLD = re.compile(r"\b(IPC|CrPC)((?: (?:\d+[A-Z]*|[a-z]+))+)")
_OLD_NUMBER = re.compile(r"(\d+[A-Z]*)((?: (?!and\b)[a-z]+)?)")


def concordance_rows() -> list[tuple[str, str, str, str, bool]]:
    """(code, old_number, act_id, number, whole) parsed out of the registry's notes on what a section was before."""
    found = []
    for _, act, number, _, _, before, _ in registry.section_rows():
        for code, numbers in _OLD.findall(before or ""):
            found += [(code.upper(), old, act, number, not part) for old, part in _OLD_NUMBER.findall(numbers)]
    return found


def concordance(spark: SparkSession) -> DataFrame:
    """Old numbers and the sections that hold their matter now: a section may have several, and an old number several sections."""
    return spark.createDataFrame(concordance_rows(), "code string, old_number string, act_id string, number string, whole boolean")


def placed_matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern with their places: an array of (start, end, raw), from 0, in code points. The text is searched once."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), f"({pattern})", f"{_MARK}$1{_MARK}")

    def pieces(split: Column) -> Column:
        starts = running_starts(F.transform(split, lambda x: F.length(x)))
        rows = once(starts, lambda s: F.transform(split, lambda x, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(x)).alias("end"), x.alias("raw"))))
        # Every other piece is a match.
        return F.filter(rows, lambda _, i: i % 2 == 1)

    return once(F.split(marked, _MARK), pieces)


def _code_of(name: Column) -> Column:
    """The repealed code that an act's name calls, or null."""
    said = F.regexp_replace(F.lower(name), r"\s+", " ")
    return F.coalesce(*(F.when(said.isin(*names), F.lit(code)) for code, names in OLD_CODES.items()))


def _found(text: Column) -> Column:
    """All matches of all patterns: start, end, pattern, raw, act_id, code, number."""
    def rows(order: int, pattern: str, act: int, number: int) -> Column:
        # Patterns are parenthesised once more above, so groups of the bare pattern are taken from the match alone.
        part = lambda raw, group: F.regexp_extract(raw, pattern, group)
        named = lambda m, name: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(order).alias("pattern"), m["raw"].alias("raw"),
            resolve_act(name).alias("act_id"), _code_of(name).alias("code"), F.upper(part(m["raw"], number)).alias("number"),
        )
        return F.transform(placed_matches(text, pattern), lambda m: once(part(m["raw"], act), lambda name: named(m, name)))

    return F.concat(*(rows(i, *p) for i, p in enumerate(PATTERNS)))


_ROW = "struct<start:bigint,end:bigint,pattern:int,raw:string,act_id:string,code:string,number:string>"


def _chosen(found: Column) -> Column:
    """Matches that don't overlap. Those of known acts go first: as many as can stand side by side (the one that ends first, then what
    starts behind it, and so on); others stay where they touch none of these."""
    by_end = lambda a, b: (F.when(a["end"] != b["end"], F.when(a["end"] < b["end"], -1).otherwise(1)).when(a["pattern"] < b["pattern"], -1).when(a["pattern"] > b["pattern"], 1).otherwise(0))
    known = F.array_sort(F.filter(found, lambda m: m["act_id"].isNotNull()), by_end)
    none = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast(f"array<{_ROW}>").alias("kept"))
    add = lambda acc, m: F.when(m["start"] >= acc["end"], F.struct(m["end"].alias("end"), F.concat(acc["kept"], F.array(m)).alias("kept"))).otherwise(acc)
    kept = F.aggregate(known, none, add, lambda acc: acc["kept"])
    apart = lambda kept: F.filter(found, lambda m: m["act_id"].isNull() & ~F.exists(kept, lambda k: (k["start"] < m["end"]) & (m["start"] < k["end"])))
    return once(kept, lambda k: F.concat(k, apart(k)))


def mentions(text: Column) -> Column:
    """The citations of a text that don't overlap, in the order of their places: an array of (start, end, raw, act_id, code, number).
    start and end count code points from 0. code is the repealed code (IPC or CRPC) whose number it is. Of equal ones (act, code and number, or raw
    where the act isn't known) the first stays. Null texts have none."""
    key = lambda m: F.when(m["act_id"].isNotNull(), F.concat_ws(":", F.coalesce(m["code"], m["act_id"]), m["number"])).otherwise(F.lower(m["raw"]))
    ordered = F.array_sort(once(once(_found(text), lambda f: f.cast(f"array<{_ROW}>")), _chosen))
    firsts = lambda rows: once(F.transform(rows, key), lambda keys: F.filter(rows, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1))
    short = lambda rows: F.transform(rows, lambda m: F.struct(*(m[k].alias(k) for k in ("start", "end", "raw", "act_id", "code", "number"))))
    none = F.array().cast("array<struct<start:bigint,end:bigint,raw:string,act_id:string,code:string,number:string>>")
    return F.when(text.rlike(CANDIDATE), short(once(ordered, firsts))).otherwise(none)


def verify_rows(cited: DataFrame) -> DataFrame:
    """A table with act_id, code and number, verified against the registry: section (the number it has today), status, by_parent, heading.

    A number of a repealed code is looked up in the concordance and gives a row for each section that holds its matter now (whole sections before
    parts of them); it never counts as a number of the code that replaced it. Sub-clauses fall back on their section, in both."""
    spark = cited.sparkSession
    known = registry.sections(spark).select("act_id", F.upper("number").alias("_key"), "heading")
    old = concordance(spark).select(F.col("code").alias("_code"), F.col("old_number").alias("_old"), F.col("number").alias("_now"), "whole")
    number = F.upper(F.col("number"))
    parent = F.nullif(F.regexp_extract(number, r"^(\d{1,3}[A-Z]{0,2})\(", 1), F.lit(""))
    rows = cited.withColumns({"_number": number, "_parent": F.coalesce(parent, number)})
    # All relations here have some dozens of rows.
    rows = rows.join(F.broadcast(old), (F.col("code") == F.col("_code")) & (F.col("_old") == F.col("_parent")), "left")
    rows = rows.withColumns({"_number": F.when(F.col("code").isNull(), F.col("_number")).otherwise(F.col("_now")), "_parent": F.when(F.col("code").isNull(), F.col("_parent")).otherwise(F.col("_now"))})
    exact = known.withColumnRenamed("_key", "_number")
    rows = rows.join(F.broadcast(exact), ["act_id", "_number"], "left")
    rows = rows.join(F.broadcast(known.select("act_id", F.col("_key").alias("_parent"), F.col("heading").alias("_above"))), ["act_id", "_parent"], "left")
    section = F.when(F.col("heading").isNotNull(), F.col("_number")).when(F.col("_above").isNotNull(), F.col("_parent"))
    status = F.when(F.col("act_id").isNull(), UNRECOGNISED).when(section.isNotNull(), VERIFIED).otherwise(UNKNOWN)
    of_old = F.col("code").isNotNull() & F.contains(F.col("number"), F.lit("("))
    by_parent = section.isNotNull() & (F.col("heading").isNull() | of_old)
    out = rows.withColumns({"section": section, "status": status, "by_parent": by_parent, "heading": F.coalesce("heading", "_above")})
    return out.drop("_code", "_old", "_now", "_number", "_parent", "_above")


def citation_rows(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, start, end, raw, act_id, code, number, section, status, by_parent, heading, whole): the strict citations of each text, a row
    for each section that a citation finds, and one where it finds none. Texts without citations have no row."""
    found = docs.select(F.col(id_col), F.explode(mentions(F.col(text_col))).alias("m")).select(id_col, "m.*")
    return verify_rows(found).select(id_col, "start", "end", "raw", "act_id", "code", "number", "section", "status", "by_parent", "heading", "whole")
