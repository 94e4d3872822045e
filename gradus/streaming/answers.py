"""Scoring of a stream of model responses against a static problem table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import compare_smart


def stream_scores(responses: DataFrame, problems: DataFrame) -> DataFrame:
    """Responses (problem_id, prediction) joined with the problems (problem_id, answer) and scored batch by batch."""
    joined = responses.join(problems.select("problem_id", "answer"), "problem_id")
    return joined.withColumn("score", compare_smart(F.col("prediction"), F.col("answer")).cast("double"))
