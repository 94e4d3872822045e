"""Mixing sources to target weights by a Pfair schedule.

Each source's documents, in the order of their identifiers, form blocks of about as many characters. Integer weights
w out of their sum W give block k of a source the release floor(k*W/w) and the deadline ceil((k+1)*W/w) in slots, and
earliest deadline first among the released blocks gives every slot one block, so that after t slots a source has had
less than one block more or less than t*w/W. The schedule repeats after W slots: it is worked out once for W slots,
and every block then finds its slot by itself. When a source has run out, its later slots stay empty and the others
keep their proportions.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, non_null_id, place_among, shuffle_partitions, stored, stored_table


def pfair(weights: list[int]) -> list[list[int]]:
    """The slots of each source in one period of sum(weights) slots; weights are positive integers."""
    period, slots = sum(weights), [[] for _ in weights]
    release = [(0, i) for i in range(len(weights))]
    heapq.heapify(release)
    ready: list[tuple[int, int]] = []
    for slot in range(period):
        while release and release[0][0] <= slot:
            i = heapq.heappop(release)[1]
            heapq.heappush(ready, (-(-(len(slots[i]) + 1) * period // weights[i]), i))
        i = heapq.heappop(ready)[1]
        slots[i].append(slot)
        if len(slots[i]) < weights[i]:
            heapq.heappush(release, (len(slots[i]) * period // weights[i], i))
    return slots


def mix(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    *,
    default_weight: int = 1,
    block_chars: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
    max_slots: int = 1_000_000,
) -> DataFrame:
    """One row per input row: doc_id, source, block (from 0 in its source), slot, release, deadline, place, then
    `carried`, a struct of the columns named in `carry`, if there are any.

    Ordered by slot and place the rows are the mixture; `place` counts characters of the source before the document
    and orders a block's documents. A document belongs to the block in which its first character falls. Every row
    stays. Sources that `weights` doesn't name have the default weight; weights are positive integers. A null source
    is a source of its own. Rows that repeat an identifier are ordered by length; a null text has no characters and a
    null identifier sorts first. An empty table gives an empty result; other columns are ignored. The driver works
    out one period; if that has more than `max_slots` slots (the sum of the sources' weights), it is an error.
    """
    weights = weights or {}
    if min([default_weight, *weights.values()]) < 1:
        raise ValueError("weights are positive integers")
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("chars"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    ).withColumn("id", non_null_id())
    narrow = stored_table(rows.select("source", "chars", "id"))
    # One source may hold a third of all rows, so its running sum is taken within ranges of the identifier first.
    parts = shuffle_partitions(spark)
    cuts = narrow.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    keys = {"part": place_among(cuts, F.col("id")), "key": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))}
    rows, narrow = rows.withColumns(keys), narrow.withColumns(keys)
    sums = narrow.groupBy("key", "part").agg(F.sum("chars").alias("sum"), F.first("source").alias("source"))
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = stored(sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum"))
    each = stored(sums.groupBy("key").agg(F.first("source").alias("source")))
    if each.count() > max_slots:
        raise ValueError(f"more than {max_slots} sources")
    found = sorted(each.collect())
    units = [default_weight if r.source is None else weights.get(r.source, default_weight) for r in found]
    if sum(units) > max_slots:
        raise ValueError(f"a period has {sum(units)} slots, more than {max_slots}")
    slots, period = pfair(units), sum(units)
    pattern = spark.createDataFrame(
        [(r.key, units[i], k, slot) for i, r in enumerate(found) for k, slot in enumerate(slots[i])],
        "key string, weight long, nth long, at long",
    )
    inside = W.partitionBy("key", "part").orderBy("id", "chars").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("sum", F.coalesce(F.sum("chars").over(inside), F.lit(0)))
    placed = placed.join(broadcast_if_small(sums.drop("source")), ["key", "part"])
    placed = placed.withColumn("place", F.col("before") + F.col("sum"))
    placed = placed.withColumn("block", F.floor(F.col("place") / block_chars))
    each = spark.createDataFrame([(r.key, units[i]) for i, r in enumerate(found)], "key string, weight long")
    placed = placed.join(broadcast_if_small(each), "key").withColumn("nth", F.col("block") % F.col("weight"))
    placed = placed.join(broadcast_if_small(pattern.drop("weight")), ["key", "nth"])
    return placed.select(
        "doc_id",
        "source",
        "block",
        (F.expr("block div weight") * period + F.col("at")).alias("slot"),
        F.expr(f"block * {period} div weight").alias("release"),
        F.expr(f"((block + 1) * {period} + weight - 1) div weight").alias("deadline"),
        "place",
        *(["carried"] if carry else []),
    )
