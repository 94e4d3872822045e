"""Exact Jaccard self-join of word 5-gram sets, with classes of equal sets and connected components.

The metric-space join with documents as pivots can't be used here: nearly all pairs of documents share no shingle and
lie at distance exactly 1, so the windows of twice the radius put nearly every document in every region (figures in
the README). What is kept of it is the shape: regions that similar documents must share, windows that copy documents
at a boundary into the next region, and an exact join inside each region. The regions come from a pigeonhole:

* Sizes of similar sets differ by at most the threshold's ratio. Documents fall in bands of size; those within that
  ratio of the upper edge are copied into the next band.
* In a band, similar sets differ in at most k shingles, so when the shingles' hash space is cut in k + 1 ranges, they
  agree entirely on one range. A region is a band, a range and the content on it. A few ranges more make sure that
  they agree on one that isn't empty; only sets with still more empty ranges take part in regions without content.
* Regions of more than `region` sets are joined otherwise: their sets' shingles are ordered by how rare they are
  among them, and similar sets share a shingle of their first ones, as many as may differ and one more.

Candidates are verified on the whole sets. Equal sets are one class, of which only one set takes part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import (
    SPACE,
    ascii_lower,
    broadcast_if_small,
    components,
    computed,
    non_null_id,
    shuffle_partitions,
    stored,
    stored_table,
    whole,
)


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """Adds `set`, the sorted distinct shingle hashes, and its 128-bit digest."""
    words = F.split(F.btrim(ascii_lower(F.col("text")), F.lit(SPACE)), "[ \\t\\n\\x0B\\f\\r]+")
    hashed = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
    rows = computed(rows, "words", hashed).drop("text")
    at = lambda i, k: F.get(F.col("words"), i + k)
    many = F.transform(
        F.sequence(F.lit(0), F.size("words") - width), lambda i: F.xxhash64(*[at(i, k) for k in range(width)])
    )
    few = F.when(F.size("words") == 0, F.array().cast("array<bigint>")).otherwise(
        F.array(F.xxhash64(F.size("words"), "words"))
    )
    shingles = F.when(F.size("words") >= width, many).otherwise(few)
    rows = computed(rows, "set", F.sort_array(F.array_distinct(shingles))).drop("words")
    return rows.withColumns(
        {"n": F.size("set"), "d1": F.xxhash64(F.lit("first"), "set"), "d2": F.xxhash64(F.lit("second"), "set")}
    )


class Bands:
    """Bands of set sizes and the number of ranges in each, for similarity of at least percent/100."""

    WIDE = 4

    def __init__(self, percent: int):
        self.percent = percent
        self.ratio = 100 / percent
        self.edge = math.log(self.ratio) * self.WIDE * (1 + 1e-9)

    def of(self, n: Column) -> Column:
        """The bands of a set: its own and, within the ratio of the upper edge, the next."""
        own = F.floor(F.log(n) / self.edge).cast("int")
        next_ = F.floor((F.log(n) + math.log(self.ratio) * (1 + 1e-6)) / self.edge).cast("int")
        return F.when(n == 0, F.array(F.lit(-1))).when(own == next_, F.array(own)).otherwise(F.array(own, next_))

    def spare(self, apart: Column) -> Column:
        """Ranges beyond the pigeonhole's: as many as few sets of the band have ranges without a shingle. Then similar
        sets agree on a range that isn't empty, unless both have more empty ranges than that."""
        empty = apart * math.exp(-(100 + self.percent) / (100 - self.percent) / 2 * (self.percent / 100) ** (self.WIDE + 1))
        return F.when(apart < 24, 0).otherwise(F.ceil(empty + 4 * F.sqrt(empty)) + 1).cast("int")

    def apart(self, band: Column) -> Column:
        """The most shingles in which two similar sets of the band may differ."""
        largest = F.ceil(F.exp((band + 1) * self.edge))
        return F.floor(largest * (2 * (100 - self.percent) / (100 + self.percent)) + 1e-6).cast("int")


def _signatures(rows: DataFrame, bands: Bands) -> DataFrame:
    """Adds `signatures`, a hash of each region of a set in its band; hashes that collide only cost a verification."""
    rows = rows.withColumn("apart", bands.apart(F.col("band"))).withColumn("spare", bands.spare(F.col("apart")))
    rows = computed(rows, "m", F.when(F.col("band") < 0, 0).otherwise(F.col("apart") + F.col("spare") + 1))

    def range_of(s: Column) -> Column:
        return F.least(F.floor((s.cast("double") * 2.0**-64 + 0.5) * F.col("m")).cast("int"), F.col("m") - 1)

    item = lambda i: F.get(F.col("set"), i)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("set") - 1), lambda i: (i == 0) | (range_of(item(i)) != range_of(item(i - 1)))
    )
    rows = computed(rows, "starts", F.when(F.col("n") > 0, starts).otherwise(F.array().cast("array<int>")))
    full = F.transform(
        "starts",
        lambda start, k: F.xxhash64(
            "band",
            range_of(item(start)),
            F.slice("set", start + 1, F.coalesce(F.get(F.col("starts"), k + 1), F.size("set")) - start),
        ),
    )
    taken = F.transform("starts", lambda start: range_of(item(start)))
    every = F.when(F.col("m") > 0, F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array().cast("array<int>"))
    empty = F.transform(F.array_except(every, taken), lambda c: F.xxhash64("band", c, F.lit("empty")))
    many_empty = F.col("m") - F.size("starts") > F.col("spare")
    return rows.withColumn("signatures", F.when(many_empty, F.concat(full, empty)).otherwise(full))


def _similar(a: Column, b: Column, common: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of sets that share one of their rarest shingles, a < b."""
    flat = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    often = flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(W.partitionBy("node").orderBy("often", "shingle"))
    head = flat.join(often, "shingle").withColumn("rank", rank)
    head = head.where((F.col("often") > 1) & (F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
    a = head.select("shingle", F.col("node").alias("a"), F.col("n").alias("n_a"))
    b = head.select("shingle", F.col("node").alias("b"), F.col("n").alias("n_b"))
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return a.join(b, "shingle").where((F.col("a") < F.col("b")) & fits).select("a", "b")


#: Longs of the parity sketch of a set.
PARITIES = 16


def _may_be_similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Drop pairs that can't be similar, before whole sets move. A sketch has the parities of the shingles by hash;
    sets differ in at least as many shingles as their sketches differ in bits."""
    shingles = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    bit = F.expr("shiftleft(1L, cast(shingle & 63 AS int))")
    word = F.expr(f"pmod(shiftright(shingle, 6), {PARITIES})")
    sketches = stored(
        shingles.withColumns({"bit": bit, "word": word})
        .groupBy("node")
        .agg(
            F.first("n").alias("n"),
            *[F.coalesce(F.bit_xor(F.when(F.col("word") == k, F.col("bit"))), F.lit(0)).alias(f"p{k}") for k in range(PARITIES)],
        )
    )
    sides = [broadcast_if_small(sketches.toDF(x, *[f"{x}_{c}" for c in sketches.columns[1:]]), 200_000) for x in ("a", "b")]
    apart = sum(F.bit_count(F.col(f"a_p{k}").bitwiseXOR(F.col(f"b_p{k}"))) for k in range(PARITIES))
    allowed = (100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n"))
    return pairs.join(sides[0], "a").join(sides[1], "b").where(allowed).select("a", "b")


def ngram_jaccard(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 90,
    width: int = 5,
    region: int = 32,
    decide: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, n_similar, component_id, and if asked to `decide` kept and version.

    Words are runs without ASCII white space, A-Z lower-cased. A set holds the distinct `width`-word shingles, of
    fewer words their whole sequence; null, empty and blank texts have an empty set and link with nothing. Two rows
    link when 100 * intersection >= percent * union. n_similar counts the other rows linked directly, component_id is
    the smallest identifier reachable. `kept` holds for one row of each component, one of those with the smallest
    identifier, and for rows with an empty set; `version` is a hash of the text. Rows that repeat an identifier count
    as documents of their own. A null identifier counts as the smallest and is given back as null. Every link is found, at any size of group. An empty
    table gives an empty result; other columns are ignored.
    """
    bands, parts = Bands(percent), shuffle_partitions(docs.sparkSession)
    rows = whole(docs, id_col, text_col).select(
        non_null_id().alias("id"), "text", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("version")
    )
    rows = _sets(rows, width).withColumn("band", F.explode(bands.of(F.col("n"))))
    first = F.col("band") == F.element_at(bands.of(F.col("n")), 1)
    table = stored_table(
        _signatures(rows, bands).select("row", "id", "version", "n", "d1", "d2", first.alias("first"), "signatures")
    )
    # Classes of equal sets. A class may hold a third of all rows, so it is counted in parts before it is joined.
    mine = table.where("first").select("row", "id", "version", "n", "d1", "d2", F.pmod("row", F.lit(parts)).alias("part"))
    split = stored(
        mine.groupBy("d1", "d2", "part").agg(
            F.min("row").alias("row"), F.min(F.struct("id", "row")).alias("id"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n")
        )
    )
    classes = stored_table(
        split.groupBy("d1", "d2").agg(
            F.min("row").alias("node"), F.min("id").alias("id"), F.sum("size").alias("size"), F.first("n").alias("n")
        )
    )
    # Regions: each set meets those before it in the region, at most `region` of them.
    nodes = classes.where("n > 0").select(F.col("node").alias("row")).hint("shuffle_hash")
    spread = table.select("row", "n", "signatures").join(nodes, "row", "left_semi")
    spread = spread.select(F.col("row").alias("node"), "n", F.explode("signatures").alias("signature"))
    near = W.partitionBy("signature").orderBy("node")
    met = spread.repartition("signature").select(
        "signature",
        "node",
        "n",
        F.collect_list(F.struct("node", "n")).over(near.rowsBetween(-region, -1)).alias("before"),
        F.row_number().over(near).alias("nth"),
    )
    met = stored(met.where("nth > 1"))
    smaller = F.least("n", F.col("other.n")) * 100 >= F.greatest("n", F.col("other.n")) * percent
    candidates = (
        met.select("node", "n", F.explode("before").alias("other")).where(smaller)
        .select(F.col("other.node").alias("a"), F.col("node").alias("b"))
    )
    large = met.where(F.col("nth") == region + 2).select("signature")
    crowded = not large.isEmpty()
    if crowded:
        many = stored(spread.join(large, "signature", "left_semi").select("node").distinct())
        needed = candidates.select(F.explode(F.array("a", "b")).alias("node")).union(many).distinct()
    else:
        needed = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = stored(classes.join(needed, "node").select("node", "id.id", "d1", "d2"))
    texts = whole(docs, id_col, text_col).select(non_null_id().alias("id"), "text")
    texts = texts.join(broadcast_if_small(chosen.toDF("node", "id", "e1", "e2"), 200_000), "id")
    sets = _sets(texts, width).where("d1 = e1 AND d2 = e2").dropDuplicates(["node"])
    sets = stored_table(sets.select("node", "set"))
    if crowded:
        candidates = candidates.union(_rare_first(sets.join(many, "node", "left_semi"), percent))
    pairs = _may_be_similar(stored(candidates.where("a <> b").distinct()), sets, percent)
    side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").where(
        _similar(F.size("set_a"), F.size("set_b"), common, percent)
    )
    links = stored(links.select("a", "b"))
    both = stored(links.union(links.select("b", "a")))
    linked = both.join(classes.select(F.col("node").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("more"))
    found = components(both)
    least = (
        found.join(classes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least"))
    )
    found = found.join(least, "component").select("node", "least")
    result = (
        classes.join(linked.withColumnRenamed("a", "node"), "node", "left")
        .join(found, "node", "left")
        .select(
            "d1",
            "d2",
            F.when(F.col("n") == 0, 0).otherwise(F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("similar"),
            F.coalesce("least", "id").alias("least"),
        )
    )
    # Back to the rows by way of the parts, of which no class has more than there are partitions.
    labelled = split.select("d1", "d2", "part").join(result, ["d1", "d2"])
    out = mine.join(labelled, ["d1", "d2", "part"])
    real = lambda c: F.when(c != F.lit(-(2**63)), c)
    return out.select(
        real(F.col("id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.col("similar").cast("long").alias("n_similar"),
        real(F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least.id"))).alias("component_id"),
        *([((F.col("n") == 0) | (F.col("row") == F.col("least.row"))).alias("kept"), "version"] if decide else []),
    )
