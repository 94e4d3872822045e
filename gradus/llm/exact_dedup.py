"""Exact deduplication by a distributed content sort.

Rows are range-partitioned by sampled splitters over a bounded key made of the content (its first characters, then a
hash of the whole), sorted externally by the whole normalised bytes, and each run of equal neighbours, compared in
full, is reduced to one identifier. The splitters stay small however long the texts are.

A text with more copies than one task should hold is cut into several runs (a salt by identifier) before the sort;
the runs' results, one row for each, are then combined, again by the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, non_null_id, stored, whole

#: Characters of the content in the partitioning key.
PREFIX = 32


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    run_rows: int = 2048,
    run_bytes: int = 32 << 20,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the smallest
    (`keep="min"`) or largest identifier stays. Of rows that repeat that identifier exactly one has kept = true.
    A null identifier sorts before all others and is given back as null. `run_rows` and `run_bytes` bound what one
    task sorts as equal; larger groups are cut into runs. An empty table gives an empty result; other columns are
    ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    best = F.min if keep == "min" else F.max
    # Full lower-casing is coarser than A-Z, so texts that are equal share the key; the sort then compares A-Z only.
    keyed = whole(docs, id_col, text_col).select(
        non_null_id().alias("id"),
        "text",
        F.substring(F.lower("text"), 1, PREFIX).alias("head"),
        F.xxhash64(F.lower("text")).alias("hash"),
    )
    large = stored(
        keyed.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
        .withColumn("runs", F.ceil(F.greatest(F.col("rows") / run_rows, F.col("bytes") / run_bytes)))
        .where("rows > 1 AND runs > 1")
        .select("hash", F.least("rows", "runs").alias("runs"))
    )
    any_large = not large.isEmpty()
    if any_large:
        keyed = keyed.join(broadcast_if_small(large), "hash", "left").withColumn(
            "run", F.when(F.col("runs").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("id"), F.col("runs"))).cast("long")
        )
    # Without large groups there is no salt: a constant would be folded out of the window's keys but not out of the
    # partitioning, and the whole texts be shuffled again.
    keys = ["head", "hash", "run"] if any_large else ["head", "hash"]
    ranged = keyed.repartitionByRange(*keys).withColumn("norm", ascii_lower(F.col("text"))).drop("text")
    if not any_large:
        ranged = ranged.withColumn("run", F.lit(0).cast("long"))
    order = F.asc("id") if keep == "min" else F.desc("id")
    run = W.partitionBy(*keys, "norm").orderBy(order)
    every = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    runs = ranged.select(
        "id",
        "run",
        "norm",
        F.row_number().over(run).alias("nth"),
        F.first("id").over(every).alias("keep"),
        F.count(F.lit(1)).over(every).alias("size"),
    ).withColumn("sha", F.sha2("norm", 256))
    if any_large:
        total = (
            runs.where("run > 0 AND nth = 1")
            .groupBy("norm")
            .agg(F.first("sha").alias("sha"), best("keep").alias("all_keep"), F.sum("size").alias("all_size"))
            .drop("norm")
        )
        rest = runs.where("run = 0").drop("norm")
        parts = runs.where("run > 0").drop("norm").join(broadcast_if_small(stored(total)), "sha")
        parts = parts.select(
            "id",
            "run",
            F.when(F.col("keep") == F.col("all_keep"), F.col("nth")).otherwise(F.col("nth") + 1).alias("nth"),
            F.col("all_keep").alias("keep"),
            F.col("all_size").alias("size"),
            "sha",
        )
        runs = rest.unionByName(parts)
    real = lambda c: F.when(F.col(c) != F.lit(-(2**63)), F.col(c))
    return runs.select(
        real("id").alias("doc_id"),
        real("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("nth") == 1).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
