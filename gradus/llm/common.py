"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null identifier inside the operators; it sorts before every real one.
NULL_ID = -(2**63)
#: Rows a broadcast side may have; beyond it the join is left to shuffle.
BROADCAST_ROWS = 20_000
#: The white space of all word and line rules.
SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in, others a table of 26 letters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def whole(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only `doc_id` and `text` (null: empty) of a table, so that no other column can clash."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def non_null_id(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def crc_mod(n: int, col: str = "doc_id") -> Column:
    """crc32 of the identifier written as text, modulo n; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once for each row. A plain projection may be inlined into the lambdas that use
    it, and then be computed anew for each element; no rule inlines through a generator."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def place_among(cuts: Sequence[int], value: Column) -> Column:
    """How many of the sorted cuts are at or below the value, by a binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    listed = F.lit(list(cuts))
    steps = F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))])
    further = lambda at, step: F.when(F.get(listed, at + step - 1) <= value, at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), further)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_checkpoint_dir(spark: SparkSession) -> SparkSession:
    """Use the shared folder of the cluster. Only a local session, which has one machine, may do without: it gets a
    temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gradus-"))
    return spark


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Of queries that run inside, the shuffle files go when each has ended, not when the driver collects garbage.
    Only for queries whose results are written, since their plans aren't read again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a stored table is known to have few rows; else let it shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def _new_folder(spark: SparkSession) -> str:
    """A folder in the shared one that goes when the session's JVM ends, or with unstored()."""
    with_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/gradus-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored_table(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back; unlike a checkpoint its columns can be pruned."""
    spark = df.sparkSession
    path = _new_folder(spark)
    with shuffles_removed(spark):
        df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at, table._stored_as = path, None
    return table


def bucketed_table(df: DataFrame, by: str) -> DataFrame:
    """As stored_table, for few but large rows: bucketed by a column, so that a cogroup by it doesn't move this side.
    Every row fills a row group of its own."""
    spark, name = df.sparkSession, f"gradus_{uuid.uuid4().hex}"
    path = _new_folder(spark)
    how = {"path": path, "compression": "zstd", "parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    with shuffles_removed(spark):
        df.write.options(**how).bucketBy(shuffle_partitions(spark), by).saveAsTable(name)
    table = spark.table(name)
    table._stored_at, table._stored_as = path, name
    return table


def unstored(table: DataFrame) -> None:
    """Delete what stored_table() or bucketed_table() wrote; nothing may read it any more."""
    spark = table.sparkSession
    if table._stored_as:
        spark.sql(f"DROP TABLE IF EXISTS {table._stored_as}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def components(links: DataFrame) -> DataFrame:
    """Of undirected links (a, b), both directions given: (node, component), the smallest node that links reach.

    Labels take the least of their neighbours' and then jump to the label's own label, so that even long chains end
    after about log2 of their length rounds. Each round is stored, which keeps plans short.
    """
    labels = stored(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = (
            links.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("near"))
            .withColumnRenamed("a", "node")
        )
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("far"))
        fresh = stored(
            lower.join(jump, "low").select("node", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("label")).alias("moved"))
        )
        labels = fresh.select("node", "label")
        if fresh.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
