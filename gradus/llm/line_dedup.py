"""Line deduplication: first occurrences over range-partitioned line hashes, kept as bitmaps per document.

Only hashes, identifiers and positions move; a document's text meets its bitmap in one last join. A line that very
many documents hold is cut by a salt of the document: the first occurrence is streamed within each part, and the
parts' first occurrences, at most one document for each part, are then streamed once more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, non_null_id, shuffle_partitions, stored


def _rows(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    carried = F.struct(*carry) if carry else F.lit(None)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), carried.alias("carried")
    )
    rows = rows if carry else rows.drop("carried")
    return rows.withColumns({"id": non_null_id(), "version": F.xxhash64("text")})


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Of each document that loses lines: id, version (hash of its text), words, n_dropped.

    `words` is the compressed keep bitmap: (word, bits) for each 64 lines of which one is dropped, sorted by word; a
    set bit keeps its line, and words that aren't listed keep all.
    """
    lines = _rows(docs, id_col, text_col).select(
        "id", "version", F.posexplode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("pos", "line")
    )
    keyed = (
        lines.withColumn("key", F.btrim("line", F.lit(SPACE)))
        .where(F.length("key") >= min_chars)
        .select(
            "id",
            "version",
            "pos",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("second"), "key").alias("h2"),
            F.pmod(F.xxhash64("id"), F.lit(shuffle_partitions(docs.sparkSession))).alias("salt"),
        )
    )
    part = W.partitionBy("h1", "h2", "salt").orderBy("id", "pos")
    parts = stored(keyed.repartitionByRange("h1", "h2", "salt").withColumn("first_id", F.first("id").over(part)))
    heads = parts.where("id = first_id").drop("first_id").repartitionByRange("h1", "h2")
    heads = heads.withColumn("first_id", F.first("id").over(W.partitionBy("h1", "h2").orderBy("id", "pos")))
    dropped = parts.where("id <> first_id").select("id", "version", "pos")
    dropped = dropped.unionByName(heads.where("id <> first_id").select("id", "version", "pos"))
    return (
        dropped.groupBy("id", "version", F.floor(F.col("pos") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
        .groupBy("id", "version")
        .agg(
            F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("words"),
            F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        )
    )


def _dense(words: Column) -> Column:
    """One long for each 64 lines as far as a line is dropped."""
    by_word = F.map_from_entries(words)
    last = F.element_at(words, -1)["word"]
    return F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.element_at(by_word, w), F.lit(-1)))


def line_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, words (keep bitmap, null: all kept), text (kept lines),
    then the columns named in `carry` as they are.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least `min_chars`
    code points that occur in several documents keep their lines in the smallest identifier only, where repeated
    lines all stay. Null and empty texts have one empty line. Rows that repeat an identifier count as one document;
    a null identifier counts as the smallest. An empty table gives an empty result; other columns are ignored.
    """
    maps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    maps = maps.withColumn("dense", _dense(F.col("words")))
    joined = _rows(docs, id_col, text_col, carry).join(maps.hint("shuffle_hash"), ["id", "version"], "left")
    lines = F.split("text", "\n", -1)

    def stays(_line: Column, pos: Column) -> Column:
        word = F.get(F.col("dense"), F.shiftright(pos, 6))
        return F.coalesce(F.getbit(word, F.pmod(pos, F.lit(64))), F.lit(1)) == 1

    return joined.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "words",
        F.when(F.col("words").isNull(), F.col("text"))
        .otherwise(F.array_join(F.filter(lines, stays), "\n"))
        .alias("text"),
        *[F.col("carried")[c].alias(c) for c in carry],
    )
