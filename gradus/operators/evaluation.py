"""Evaluation of predictions against a problem table: one status for each problem, means over those evaluated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import typed
from . import rows as R

STATUSES = ("no_ground_truth", "missing_prediction", "extraction_failed", "success", "error")


class Evaluator:
    """Holds a comparator, by name or as a function of two sides (see functions/typed.py); exact by default."""

    def __init__(self, comparator: str | typed.Comparator | None = None):
        self.comparator = comparator or "exact"

    def set_comparator(self, comparator: str | typed.Comparator) -> Evaluator:
        if comparator is None:
            raise ValueError("a comparator is needed")
        self.comparator = comparator
        return self

    def evaluate(self, pred: Column, truth: Column) -> Column:
        return typed.evaluated(pred, truth, self.comparator)

    def evaluate_dataset(
        self,
        problems: DataFrame,
        predictions: DataFrame | None = None,
        extract: Callable[[DataFrame], Column] | None = None,
        *,
        key: str = "problem_id",
    ) -> DataFrame:
        """Every problem once, with `status`, `score` and `result`.

        `problems` has a typed `answer`. `predictions` (key, `prediction`: typed or raw) wins over `extract`, which
        gives a prediction from the problem's columns; one of them is needed. In the order of STATUSES: a problem
        without an answer, without a prediction, whose extraction gives null, that was compared, and whose comparison
        gave null. Only a success has a score that counts; other rows have 0. Of predictions that repeat a key the
        first by value counts; those of unknown problems are left out. Null keys match nothing.
        """
        if predictions is None and extract is None:
            raise ValueError("predictions or an extractor are needed")
        if predictions is not None:
            first = predictions.groupBy(key).agg(F.min(F.struct("prediction.value", "prediction.category", "prediction.unit")).alias("_first"))
            one = F.col("_first")
            side = F.when(one.isNotNull(), F.struct(one["value"].alias("value"), one["category"].alias("category"), one["unit"].alias("unit")))
            joined = problems.join(first, key, "left").withColumn("prediction", side).drop("_first")
            absent = "missing_prediction"
        else:
            joined = problems.withColumn("prediction", extract(problems))
            absent = "extraction_failed"
        pred, truth = F.col("prediction"), F.col("answer")
        has_truth, has_pred = truth.isNotNull() & truth["value"].isNotNull(), pred.isNotNull() & pred["value"].isNotNull()
        joined = joined.withColumn("result", F.when(has_truth & has_pred, self.evaluate(pred, truth)))
        score = F.col("result.accuracy_score")
        status = F.when(~has_truth, "no_ground_truth").when(~has_pred, absent).when(score.isNull(), "error").otherwise("success")
        return joined.withColumns({"status": status, "score": F.when(status == "success", score).otherwise(0.0)})


def summary(evaluated: DataFrame, domain: str = "domain", problem_type: str = "problem_type") -> DataFrame:
    """kind (overall, domain, problem_type), value, accuracy, total, evaluated and failed in one pass."""
    listed = F.array(
        F.struct(F.lit("overall").alias("kind"), F.lit("").alias("value")),
        F.struct(F.lit("domain").alias("kind"), F.coalesce(F.col(domain), F.lit("Unknown")).alias("value")),
        F.struct(F.lit("problem_type").alias("kind"), F.coalesce(F.col(problem_type), F.lit("unknown")).alias("value")),
    )
    good = F.col("status") == "success"
    return (
        evaluated.select("status", "score", F.explode(listed).alias("x"))
        .groupBy("x.kind", "x.value")
        .agg(
            F.coalesce(F.avg(F.when(good, F.col("score"))), F.lit(0.0)).alias("accuracy"),
            F.count(F.lit(1)).alias("total"),
            F.count_if(good).alias("evaluated"),
            F.count_if(~good).alias("failed"),
        )
    )


def status_counts(evaluated: DataFrame) -> DataFrame:
    return R.statistics(evaluated, ["status"]).where("kind = 'status'").select(F.col("value").alias("status"), "n")
