"""Language identification: word log frequencies first, shorter and shorter character n-grams for unseen words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, stored
from .prefix_bpe import Memo

#: Runs of letters (and of the few numerals that count as alphanumeric but aren't digits).
WORDS = re.compile(r"[^\W\d_]+")
LONGEST = 5
UNKNOWN = "und"


class WordFirst:
    """For each language the log frequency of each known word and of each n-gram of 1 to LONGEST characters."""

    def __init__(self, counts: dict[str, Counter], docs: dict[str, int]):
        """`counts`: of each language, how often each word occurs; `docs`: how many documents it has."""
        self.languages = sorted(docs)
        self.prior = np.log(np.array([docs[x] for x in self.languages], float) / max(1, sum(docs.values())))
        self.words = self._table({x: counts.get(x, Counter()) for x in self.languages})
        grams = {n: {x: Counter() for x in self.languages} for n in range(1, LONGEST + 1)}
        for language in self.languages:
            for word, count in counts.get(language, {}).items():
                for n, found in grams.items():
                    for gram in self.grams(word, n):
                        found[language][gram] += count
        self.by_length = [self._table(grams[n]) for n in range(LONGEST, 0, -1)]

    @staticmethod
    def grams(word: str, n: int) -> list[str]:
        """n-grams of a word that is marked at both ends; a single mark is none."""
        marked = f"^{word}$" if n > 1 else word
        return [marked[i : i + n] for i in range(len(marked) - n + 1)]

    def _table(self, counts: dict[str, Counter]) -> dict[str, tuple[float, ...]]:
        keys = set().union(*counts.values()) if counts else set()
        total = {x: sum(c.values()) + 0.5 * len(keys) for x, c in counts.items()}
        return {k: tuple(math.log((counts[x][k] + 0.5) / total[x]) for x in self.languages) for k in keys}

    def word(self, word: str) -> tuple[float, ...]:
        known = self.words.get(word)
        if known is not None:
            return known
        for n, table in zip(range(LONGEST, 0, -1), self.by_length, strict=True):
            found = [table[g] for g in self.grams(word, n) if g in table]
            if found:
                return tuple(sum(x) / len(found) for x in zip(*found, strict=True))
        return (0.0,) * len(self.languages)


class Scorer:
    """Scores texts, with the vectors of words remembered by row of a matrix."""

    def __init__(self, model: WordFirst, limit: int = 150_000):
        self.model, self.limit = model, limit
        self._fresh()

    def _fresh(self) -> None:
        self.rows = Memo(self._add, self.limit * 2)
        self.matrix, self.used = np.zeros((1024, len(self.model.languages))), 0

    def _add(self, word: str) -> int:
        if self.used == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[self.used] = self.model.word(word)
        self.used += 1
        return self.used - 1

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.languages or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        if self.used > self.limit:
            self._fresh()
        rows = list(map(self.rows.__getitem__, WORDS.findall(text.lower())))
        total = self.model.prior + self.matrix[rows].sum(axis=0)
        chance = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.languages[best], float(chance[best] / chance.sum())


def fit(docs: DataFrame, train: Column, *, per_language: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> WordFirst:
    """Learn from at most `per_language` whole documents of each language, those of the least hashes among the rows
    where `train` holds and the language isn't null; a bounded sample, so that the model stays small. Rows that repeat
    identifier, language and text count once. Words are counted in Spark; without training rows the model is empty.

    Hashes are ranked without texts, and only those below a bound of the language that leaves about four times as many
    as are wanted; if repeated rows leave fewer than wanted, all are ranked.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col).alias("at")
    )
    keys = rows.select("lang", "at", F.xxhash64("text").alias("version"))
    sizes = stored(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    share = F.least(4.0 * per_language / F.col("n"), F.lit(1.0))
    few = keys.join(broadcast_if_small(sizes), "lang").where(F.col("at").cast("double") * 2.0**-64 + 0.5 <= share)
    nth = F.row_number().over(W.partitionBy("lang").orderBy("at", "version"))

    def least(keys: DataFrame) -> DataFrame:
        distinct = keys.select("lang", "at", "version").distinct()
        return stored(distinct.withColumn("nth", nth).where(F.col("nth") <= per_language).drop("nth"))

    sample = least(few)
    found = sample.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
    if not sizes.join(found, "lang", "left").where(F.coalesce("found", F.lit(0)) < F.least("n", F.lit(per_language))).isEmpty():
        sample = least(keys)
    taken = rows.withColumn("version", F.xxhash64("text")).join(broadcast_if_small(sample), ["lang", "at", "version"])
    taken = taken.dropDuplicates(["lang", "at", "version"])
    words = taken.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    counts: dict[str, Counter] = {}
    for lang, word, n in words.groupBy("lang", "word").count().toLocalIterator():
        counts.setdefault(lang, Counter())[word] = n
    return WordFirst(counts, {r[0]: r[1] for r in sample.groupBy("lang").count().collect()})


def language_id(
    docs: DataFrame, model: WordFirst, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, then the columns named in `carry` as they are.

    Whole texts are scored: the sum over words, unseen ones by their longest known n-grams, and the prior. `score` is
    the posterior of the predicted language. A null text, one without letters and any text under a model without
    languages are `und` with score 0. Null and repeated identifiers are given back as they are. An empty table gives
    an empty result; other columns are ignored.
    """
    # A text that is carried goes to Python once.
    once = text_col in carry and docs.schema[text_col].dataType == T.StringType()
    others = [c for c in carry if not (once and c == text_col)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("scored"), *others)
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            *(docs.schema[c] for c in carry),
        ]
    )
    place = {c: k for k, c in enumerate(others, 2)} | ({text_col: 1} if once else {})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    *(batch.column(place[c]) for c in carry),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(score, schema)
