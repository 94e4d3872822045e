"""The operN queries over the whole documents table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality
from .byte_bpe import bpe_encode
from .common import crc_mod
from .exact_dedup import exact_dedup
from .fingerprints import edit_likeness
from .line_dedup import line_dedup
from .mixing import mix
from .ngram_jaccard import ngram_jaccard
from .pitman_yor import lm_scores
from .token_counts import token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), keep="max")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_encode(_documents(spark, sf_dir), path, public_tokenizers.PATTERN, ids=False, digests=True)


#: Target weights of the mixture; sources that aren't named weigh 1.
WEIGHTS = {"src0": 4, "src1": 2, "src2": 3}


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir), WEIGHTS)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(_documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.quality(_documents(spark, sf_dir), labels, crc_mod(5) != 0)
    return out.select("doc_id", (crc_mod(5) == 0).alias("held_out"), "score", "predicted")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = language_id.language_id(docs, language_id.fit(docs, crc_mod(3) != 1))
    return out.select("doc_id", (crc_mod(3) == 1).alias("held_out"), "lang_pred", "score")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(_documents(spark, sf_dir))


def op9_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(_documents(spark, sf_dir), crc_mod(7) != 2)
    return out.select("doc_id", (crc_mod(7) == 2).alias("held_out"), *out.columns[1:])


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_line_dedup, op3_byte_bpe, op4_mix_sources, op5_ngram_jaccard, op6_quality, op7_language_id, op8_fingerprints, op9_pitman_yor_lm, op10_token_counts)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)""",
    "op2_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id <> first_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                       FILTER (WHERE first_id IS NULL OR doc_id = first_id), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id""",
    "op5_ngram_jaccard": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[ \\t\\n\\x0B\\f\\r]+'),
                             lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (s)
      WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles,
       (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_similar, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id""",
}
