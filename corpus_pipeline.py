"""A corpus pipeline over `documents`: language ID, line dedup, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import language_id
from gradus.llm.byte_bpe import bpe_encode
from gradus.llm.common import broadcast_if_small, crc_mod, non_null_id, stored, stored_table, unstored
from gradus.llm.line_dedup import line_dedup
from gradus.llm.mixing import mix
from gradus.llm.ngram_jaccard import ngram_jaccard
from gradus.llm.queries import WEIGHTS

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (no letter, null) or with an unsure one; `lang` becomes the prediction.

    Null and repeated identifiers stay as they are. Without training rows all documents go; an empty table stays empty.
    """
    model = language_id.fit(docs, crc_mod(3) != 1)
    kept = language_id.language_id(docs, model, carry=["text", "source"]).where("lang_pred <> 'und' AND score >= 0.5")
    return kept.select(
        "doc_id", "text", F.col("lang_pred").alias("lang"), "source", F.length("text").cast("long").alias("n_chars")
    )


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep each line of some length in its first document only.

    Every row stays, if need be with an empty text; null texts become empty. Rows that repeat an identifier count as
    one document, a null identifier as the smallest. An empty table stays empty.
    """
    kept = line_dedup(docs, carry=["lang", "source"])
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row stays, with the smallest identifier.

    Documents without words are no group and stay. A null identifier counts as the smallest. Rows that repeat an
    identifier are told apart by their text; of rows that repeat both, one stays. An empty table stays empty.
    """
    found = ngram_jaccard(docs, decide=True).select(non_null_id().alias("id"), "version", "kept", "n_shingles")
    texts = found.groupBy("id", "version").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("words")
    )
    decided = stored(texts.where("NOT kept OR (rows > 1 AND words > 0)").select("id", "version", F.col("kept").alias("again")))
    rows = docs.select("*", non_null_id().alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"))
    rows = rows.join(broadcast_if_small(decided, 200_000), ["id", "version"], "left")
    stay = rows.where("again IS NULL")
    if not decided.where("again").isEmpty():
        one = F.first(F.struct(*docs.columns)).alias("row")
        stay = stay.select(docs.columns).unionByName(rows.where("again").groupBy("id", "version").agg(one).select("row.*"))
    return stay.select("doc_id", "text", "lang", "source", "n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents in the order of the mixture: the rows of the written files, file by file.

    Every row stays as it is, null and repeated ones too; a null source is a source of its own, rows that repeat an
    identifier are ordered by length. An empty table stays empty.
    """
    mixed = mix(docs, WEIGHTS, carry=["text", "lang", "source", "n_chars"]).repartitionByRange("slot", "place")
    return mixed.sortWithinPartitions("slot", "place").select("doc_id", "carried.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of what they decode to.

    Each row by itself: null and empty texts have no tokens, repeated rows repeat their ids. An empty table gives an
    empty one.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_encode(docs, path, public_tokenizers.PATTERN, digests=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each but the last is written and read again, and goes when the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = stored_table(stage(spark, docs, sf_dir))
        if before is not None:
            unstored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
