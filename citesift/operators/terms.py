"""Which of many terms a text contains: an automaton over tables of terms, in one pass over each text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .citations import act_needle
from .scenario import MIN_SIGNALS

#: Bytes of the terms of one automaton. More terms are dealt to several, each of which reads the texts once.
MAX_BYTES = 16 << 20
_built: tuple = (None, None)


def _automaton(terms: list[str]):
    """The automaton of a broadcast list of terms, which a worker builds once."""
    global _built
    if _built[0] is not terms:
        import ahocorasick

        made = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            made.add_word(term, i)
        made.make_automaton()
        _built = terms, made
    return _built[1]


def _scan(shared) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        automaton = _automaton(terms)
        for batch in it:
            rows, found, times, first = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                hits: dict[int, list[int]] = {}
                for end, k in automaton.iter(text):
                    hit = hits.get(k)
                    if hit is None:
                        hits[k] = [1, end - len(terms[k]) + 1]
                    else:
                        hit[0] += 1
                rows += [i] * len(hits)
                found += [terms[k] for k in hits]
                times += [h[0] for h in hits.values()]
                first += [h[1] for h in hits.values()]
            ids = batch.column("id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.string()), pa.array(times, pa.int64()), pa.array(first, pa.int64())], ["id", "term", "times", "first"])

    return run


def term_hits(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str = "text", term_col: str = "term") -> DataFrame:
    """(id, term, times, first): a row for each text and each distinct term that it contains, with the number of places (which may
    overlap) and the first of them, in code points from 0.

    Terms are a table of any size: those of up to MAX_BYTES are one automaton, which is broadcast; more are dealt to several by their hash. A text is
    searched for all terms of an automaton at once. An empty term is in every text, once at the start; null texts and terms have no rows.
    Rows of texts that repeat an id are texts of their own."""
    spark = texts.sparkSession
    distinct = terms.select(F.col(term_col).alias("term")).filter("term is not null").distinct().persist()
    total, empty = distinct.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0)), F.count_if(F.col("term") == "")).first()
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    kind, found = rows.schema["id"].dataType.simpleString(), []
    parts = -(-total // MAX_BYTES)
    for k in range(parts):
        held = distinct.filter((F.col("term") != "") & (F.pmod(F.xxhash64("term"), F.lit(parts)) == k)).toArrow().column("term").to_pylist()
        if held:
            found.append(rows.mapInArrow(_scan(spark.sparkContext.broadcast(sorted(held))), f"id {kind}, term string, times long, first long"))
    if empty or not found:
        found.append(rows.filter(F.lit(bool(empty))).select("id", F.lit("").alias("term"), F.lit(1).cast("long").alias("times"), F.lit(0).cast("long").alias("first")))
    distinct.unpersist()
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id", id_col)


def _once_each(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    return df.select(id_col, text.alias("text"))


def resolve_names(names: DataFrame, aliases: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(id, act_id): the act whose longest alias the name contains, of equally long ones that of the least ordinal; null where none is.

    aliases: a table (act_id, alias, ordinal), its aliases in lower case. The same answer as citations.resolve_act, for any number of aliases. Ids are unique."""
    known = aliases.select(F.col("alias").alias("term"), "act_id", "ordinal")
    hits = term_hits(_once_each(names, id_col, act_needle(F.col(name_col))), aliases, id_col, "text", "alias").join(known, "term")
    best = hits.groupBy(id_col).agg(F.min_by("act_id", F.struct((-F.length("term")).alias("l"), "ordinal")).alias("act_id"))
    return names.select(id_col).join(best, id_col, "left")


def match_scenarios(questions: DataFrame, signals: DataFrame, id_col: str, question_col: str = "question", least: int = MIN_SIGNALS) -> DataFrame:
    """(id, scenario_id, hits): the scenario with most distinct key words in the question, of equal ones that of the least priority;
    null where none has as many as least.

    signals: a table (scenario_id, priority, keyword), its key words in lower case. The same answer as scenario.match, for any number of scenarios. Ids are unique."""
    known = signals.select(F.col("keyword").alias("term"), "scenario_id", "priority").distinct()
    hits = term_hits(_once_each(questions, id_col, F.lower(F.col(question_col))), signals, id_col, "text", "keyword").join(known, "term")
    counted = hits.groupBy(id_col, "scenario_id", "priority").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= least)
    best = counted.groupBy(id_col).agg(F.max_by(F.struct("scenario_id", "hits"), F.struct("hits", (-F.col("priority")).alias("p"))).alias("best"))
    return questions.select(id_col).join(best, id_col, "left").select(id_col, "best.scenario_id", "best.hits")
