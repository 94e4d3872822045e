"""Row operators of an ordered problem table: filters, positions, samples, folds, statistics, evaluation.

Order is a column, `pos`, never the physical order. Samples take the least md5 keys, so they are reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import normalise_domain


def filter_by_domains(df: DataFrame, domains: Sequence[str], column: str = "domain") -> DataFrame:
    wanted = [d.lower().replace(" ", "_").replace("-", "_") for d in domains]
    return df.where(normalise_domain(F.col(column)).isin(wanted) if wanted else F.lit(False))


def filter_by_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.where(F.lower(F.col(column)).isin([v.lower() for v in values]))


def filter_by_keywords(df: DataFrame, words: Sequence[str], fields: Sequence[str], case_sensitive: bool = False) -> DataFrame:
    """Rows in which any of the fields contains any of the words; a null reads 'None'."""
    tests = []
    for field in (f for f in fields if f in df.columns):
        text = F.coalesce(F.col(field).cast("string"), F.lit("None"))
        for word in words:
            tests.append(text.contains(word) if case_sensitive else F.lower(text).contains(word.lower()))
    return df.where(reduce(or_, tests, F.lit(False)))


def select_positions(df: DataFrame, positions: Sequence[int], pos: str = "pos") -> DataFrame:
    """Rows by position, in the order asked for and as often; positions outside are left out. Adds `nth`."""
    asked = df.sparkSession.createDataFrame(list(enumerate(positions)), f"nth long, {pos} long")
    return df.join(F.broadcast(asked), pos)


def slice_positions(df: DataFrame, step: slice, n: int, pos: str = "pos") -> DataFrame:
    found = range(*step.indices(n))
    if not len(found):
        return df.where(F.lit(False))
    at = F.col(pos)
    return df.where(at.between(min(found), max(found)) & ((at - found[0]) % abs(found.step) == 0))


def _sorted_once(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named and context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return df if context._jsc.sc().getCheckpointDir().isEmpty() else df.checkpoint()


def with_position(df: DataFrame, order: str | Sequence[str], pos: str = "pos") -> DataFrame:
    """Number the rows from 0 by a sort key: places inside the sorted partitions plus the partitions' counts before
    them. Both branches must read the same partitions, so where a checkpoint folder is named the sorted rows are stored
    first; without one (local sessions) both plans sort the same way."""
    placed = _sorted_once(df.orderBy(order)).withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), "_part").withColumn(pos, F.col("_before") + inside).drop("_at", "_part", "_before")


def first_by_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row for each key, the first by the order: an aggregation with map-side combining, no window."""
    rest = [c for c in df.columns if c != key]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(key).agg(best.alias("_first")).select(key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def sample_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(sample_key(key, seed), key).limit(n)


def sample_balanced(df: DataFrame, per_group: int, group: str, key: str, seed: int = 0) -> DataFrame:
    nth = F.row_number().over(W.partitionBy(group).orderBy(sample_key(key, seed), key))
    return df.withColumn("_nth", nth).where(F.col("_nth") <= per_group).drop("_nth")


def folds(df: DataFrame, k: int, n: int, pos: str = "pos") -> DataFrame:
    """Adds `fold`: k runs of n div k rows, of which the last takes the remainder."""
    return df.withColumn("fold", F.least(F.floor(F.col(pos) / max(1, n // k)), F.lit(k - 1)).cast("long"))


def cross_validation(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """Adds `fold`: the counted rows, shuffled by the sample key, in k folds."""
    placed = with_position(df.withColumn("_key", sample_key(key, seed)), ["_key", key], "_pos")
    return folds(placed, k, df.count(), "_pos").drop("_key", "_pos")


def statistics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts in total and by each key in one pass: kind, value, n."""
    listed = F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("value")), *[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])
    return df.select(F.explode(listed).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def evaluate(problems: DataFrame, predictions: DataFrame, correct: Column, key: str = "problem_id") -> DataFrame:
    """Every problem once: status success or missing_prediction, and score. Predictions must have unique keys; those
    of unknown problems are left out."""
    joined = problems.join(predictions, key, "left")
    missing = F.col("prediction").isNull()
    return joined.withColumns(
        {"status": F.when(missing, "missing_prediction").otherwise("success"), "score": F.when(~missing, correct.cast("double"))}
    )


def accuracy(evaluated: DataFrame, by: str | None = None, unknown: str = "Unknown") -> DataFrame:
    """Mean score of evaluated rows only, 0 without any, and counts; overall or by a column."""
    aggs = [
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("evaluated"),
    ]
    if by is None:
        return evaluated.agg(*aggs)
    return evaluated.groupBy(F.coalesce(F.col(by), F.lit(unknown)).alias(by)).agg(*aggs)
