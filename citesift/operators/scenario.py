"""Scenario of a question by key words: the most distinct key words win, two at least; of a tie the first scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import registry

MIN_SIGNALS = 2


def match(question: Column) -> Column:
    """The scenario's id, or null. Key words match inside words."""
    text = F.lower(question)
    scored = [
        F.struct(sum(F.contains(text, F.lit(w)).cast("int") for w in words).alias("hits"), F.lit(-i).alias("first"), F.lit(name).alias("id"))
        for i, (name, _, _, words) in enumerate(registry.SCENARIOS)
    ]
    best = F.greatest(*scored)
    return F.when(best["hits"] >= MIN_SIGNALS, best["id"])


def answered(questions: DataFrame, question_col: str = "question") -> DataFrame:
    """questions with scenario_id and the scenario's label and answer, null where none matches."""
    known = registry.scenarios(questions.sparkSession).select("scenario_id", "label", "answer")
    return questions.withColumn("scenario_id", match(F.col(question_col))).join(F.broadcast(known), "scenario_id", "left")
