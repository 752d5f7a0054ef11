"""Substring search, for many queries at once: of the registry, and of texts of any number by postings of their trigrams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim
from ..sources import registry

#: Sections shown for a query; the count is that of all.
SHOWN = 25
#: Characters of an index entry.
GRAM = 3
_POINT_BITS = 21


def _needles(queries: DataFrame, query_col: str) -> DataFrame:
    return queries.withColumn("_needle", F.lower(js_trim(F.coalesce(F.col(query_col), F.lit("")))))


def search_acts(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """(query columns, act_id): acts whose names, summary, predecessor or domain hold the query. An empty query finds all."""
    acts = registry.acts(queries.sparkSession)
    hay = F.lower(F.concat_ws(" ", "short_name", "title", "summary", F.coalesce("replaces", F.lit("")), "domain"))
    acts = acts.select("act_id", F.col("ordinal").alias("act_ordinal"), hay.alias("_hay"))
    return _needles(queries, query_col).join(F.broadcast(acts), F.contains("_hay", "_needle")).drop("_hay", "_needle")


def search_sections(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """(query columns, act_id, number): sections whose number, heading, text, predecessor or act holds the query. An empty query finds none."""
    spark = queries.sparkSession
    names = registry.acts(spark).select("act_id", "short_name", "title")
    both = registry.sections(spark).join(F.broadcast(names), "act_id", "left")
    hay = F.lower(F.concat_ws(" ", "number", "heading", "plain", F.coalesce("previously", F.lit("")), "short_name", "title"))
    both = both.select("act_id", "number", F.col("ordinal").alias("section_ordinal"), hay.alias("_hay"))
    return _needles(queries, query_col).join(F.broadcast(both), (F.col("_needle") != "") & F.contains("_hay", "_needle")).drop("_hay", "_needle")


def shown_sections(found: DataFrame, by: list[str], limit: int = SHOWN) -> DataFrame:
    """The first sections of each query's results, in the order of the registry, with total: how many there are in all."""
    w = Window.partitionBy(*by)
    ranked = found.withColumns({"rank": F.row_number().over(w.orderBy("section_ordinal")), "total": F.count(F.lit(1)).over(w)})
    return ranked.filter(F.col("rank") <= limit)


def result_line(acts: Column, sections: Column) -> Column:
    """The line above the results, with plurals."""
    some = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))
    return F.concat(some(acts, "act"), F.lit(", "), some(sections, "section"))


def gram_numbers(text: str, size: int) -> np.ndarray:
    """The distinct runs of so many characters (GRAM at most) in a text as numbers, which tell runs of all sizes apart."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = len(points) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    code = np.zeros(n, np.int64)
    for k in range(size):
        code = code << _POINT_BITS | points[k : k + n]
    # Whole runs are numbers from 0, shorter ones lie below, each size in its own range.
    return np.unique(code if size == GRAM else -1 - code - sum(1 << _POINT_BITS * k for k in range(1, size)))


def _indexed(sizes: list[int] | None) -> Callable:
    """For mapInArrow: (key, gram) for each distinct gram of a text, of all sizes, or of its own where none are given."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                grams = [np.concatenate([gram_numbers(t, k) for k in sizes or (min(len(t), GRAM),)]) for t in batch.column(1).to_pylist()]
                of = pa.array(np.repeat(np.arange(batch.num_rows), [len(g) for g in grams]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(np.concatenate(grams))], ["key", "gram"])

    return run


def contained(texts: DataFrame, needles: DataFrame, text_id: str, needle_id: str, text_col: str = "text", needle_col: str = "needle") -> DataFrame:
    """(needle_id, text_id): every needle with every text that contains it, as they are written, without a nested loop over both.

    Texts are indexed by their distinct trigrams (single characters and pairs for needles as short as that). Each distinct needle is
    looked up by the one of its grams that fewest texts have; a needle with a gram that no text has drops out; what the gram
    finds is verified. An empty needle asks for nothing and finds nothing; null texts and needles have no rows.
    Ids of texts are unique; needles may repeat."""
    known = needles.select(F.col(needle_id).alias("_of"), F.col(needle_col).alias("_needle")).filter("_needle is not null")
    held = texts.select(F.col(text_id).alias("_id"), F.col(text_col).alias("_text")).filter("_text is not null")
    distinct = known.select("_needle").filter("_needle <> ''").distinct()
    sizes = sorted(r[0] for r in distinct.select(F.least(F.length("_needle"), F.lit(GRAM))).distinct().collect())  # at most GRAM numbers
    if not sizes:
        return known.select(F.col("_of").alias(needle_id)).join(held.select(F.col("_id").alias(text_id)), F.lit(False))
    kind = held.schema["_id"].dataType.simpleString()
    postings = held.mapInArrow(_indexed(sizes), f"key {kind}, gram long").toDF("_id", "_gram")
    often = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    asked = distinct.select("_needle", F.col("_needle").alias("_cut")).mapInArrow(_indexed(None), "key string, gram long").toDF("_needle", "_gram").join(often, "_gram", "left")
    rarest = asked.groupBy("_needle").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.count_if(F.col("_n").isNull()).alias("_without")).filter("_without = 0")
    candidates = rarest.join(postings, "_gram").select("_needle", "_id")
    found = candidates.join(held, "_id").filter(F.contains("_text", "_needle")).select("_needle", "_id")
    return known.join(found, "_needle").select(F.col("_of").alias(needle_id), F.col("_id").alias(text_id))


def sections_of_acts(asked: DataFrame, act_col: str = "act_id") -> DataFrame:
    """asked with number, heading and section_ordinal: a row for each section of the act that a row names, in the order of the registry."""
    known = registry.sections(asked.sparkSession).select(F.col("act_id").alias("_act"), "number", "heading", F.col("ordinal").alias("section_ordinal"))
    return asked.join(F.broadcast(known), F.col(act_col) == F.col("_act")).drop("_act")


def sections_per_act(spark) -> DataFrame:
    return registry.sections(spark).groupBy("act_id").agg(F.count(F.lit(1)).alias("n_sections"))


def sections_of(spark, act_id: str) -> DataFrame:
    return registry.sections(spark).filter(F.col("act_id") == act_id).orderBy("ordinal")
