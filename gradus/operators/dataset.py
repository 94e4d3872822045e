"""A problem table with its order, split and info: the row operators of rows.py under the names users look for.

Plans stay lazy; only what asks for a row, a count or a list runs a job. Order is the column `pos`, numbered from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.columns import strip
from ..sources import loaders
from . import rows as R


def has_solution() -> Column:
    return strip(F.coalesce("solution", F.lit(""))) != ""


def is_multiple_choice() -> Column:
    """Only MC; MultipleMC isn't."""
    return F.coalesce(F.col("problem_type") == "MC", F.lit(False))


def is_open_ended() -> Column:
    return F.coalesce(F.col("problem_type") == "OE", F.lit(False))


def domain_name(column: str = "domain") -> Column:
    """'Unknown' for null and empty."""
    return F.when(F.coalesce(column, F.lit("")) == "", "Unknown").otherwise(F.col(column))


def field(df: DataFrame, name: str, default: object = None) -> Column:
    """A column, else a key of the JSON in additional_fields, else the default."""
    if name in df.columns:
        return F.coalesce(F.col(name).cast("string"), F.lit(default).cast("string"))
    if "additional_fields" in df.columns:
        return F.coalesce(F.get_json_object("additional_fields", f"$.{name}"), F.lit(default).cast("string"))
    return F.lit(default).cast("string")


def short(column: str = "question", chars: int = 50) -> Column:
    """One line about a problem: its identifier, domain and the beginning of its question."""
    return F.format_string("%s [%s] %s...", F.coalesce("problem_id", F.lit("")), domain_name(), F.substring(F.coalesce(column, F.lit("")), 1, chars))


class ProblemSet:
    def __init__(self, df: DataFrame, info: Mapping[str, object] | None = None, split: str = "test", *, order: str | Sequence[str] | None = None):
        """`order` sorts rows that have no dense `pos` yet."""
        if order is not None:
            keys = [f"_by_{k}" for k, _ in enumerate([order] if isinstance(order, str) else order)]
            named = dict(zip(keys, [order] if isinstance(order, str) else order, strict=True))
            df = df.withColumns({k: F.col(c) for k, c in named.items()})
            df = R.with_position(df.drop("pos"), keys).drop(*keys)
        self.df, self._info, self.split = df, dict(info or {}), split

    def _with(self, df: DataFrame) -> ProblemSet:
        """Rows that were left out leave gaps, so the rest is numbered anew."""
        return ProblemSet(df, self._info, self.split, order="pos")

    @property
    def name(self) -> str:
        return str(self._info.get("name", type(self).__name__))

    def get_info(self) -> dict:
        return dict(self._info)

    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self) -> Iterator[Row]:
        return self.df.orderBy("pos").toLocalIterator()

    def __getitem__(self, at: int | slice) -> Row | ProblemSet:
        n = len(self)
        if isinstance(at, slice):
            found = R.slice_positions(self.df, at, n)
            step = at.indices(n)[2]
            turned = found.withColumn("pos", F.col("pos") if step > 0 else -F.col("pos"))
            return self._with(turned)
        place = at + n if at < 0 else at
        if not 0 <= place < n:
            raise IndexError(at)
        return self.df.where(F.col("pos") == place).first()

    def filter(self, condition: Column) -> ProblemSet:
        return self._with(self.df.where(condition))

    def filter_by_domains(self, domains: Sequence[str]) -> ProblemSet:
        """Requested names are normalised, and unknown ones mean 'other'."""
        return self._with(R.filter_by_domains(self.df, [d for d in domains if isinstance(d, str)]))

    def filter_by_domain(self, domain: str) -> ProblemSet:
        return self.filter_by_domains([domain])

    def filter_by_keywords(self, words: Sequence[str], fields: Sequence[str] = ("question", "solution", "answer"), case_sensitive: bool = False) -> ProblemSet:
        return self._with(R.filter_by_keywords(self.df, words, fields, case_sensitive))

    def select(self, positions: Sequence[int]) -> ProblemSet:
        """In the order asked for, repeats too; negative and too large positions are left out."""
        found = R.select_positions(self.df, positions)
        return self._with(found.drop("pos").withColumnRenamed("nth", "pos"))

    def get_by_id_safe(self, problem_id: str) -> Row | None:
        """The first row with the identifier; rows without one go by problem_{pos}."""
        key = F.coalesce("problem_id", F.concat(F.lit("problem_"), "pos"))
        return self.df.where(key == problem_id).orderBy("pos").limit(1).first()

    def get_by_id(self, problem_id: str) -> Row:
        row = self.get_by_id_safe(problem_id)
        if row is None:
            raise KeyError(problem_id)
        return row

    def ids(self) -> DataFrame:
        """Each identifier once, in the order of its first row."""
        key = F.coalesce("problem_id", F.concat(F.lit("problem_"), F.col("pos").cast("string"))).alias("problem_id")
        return self.df.groupBy(key).agg(F.min("pos").alias("pos")).orderBy("pos")

    def get_all_ids(self) -> list[str]:
        return [r.problem_id for r in self.ids().toLocalIterator()]

    def map(self, **columns: Column) -> DataFrame:
        """The expressions, row by row in order."""
        return self.df.orderBy("pos").select(*[c.alias(n) for n, c in columns.items()])

    def take(self, n: int) -> ProblemSet:
        return ProblemSet(self.df.where(F.col("pos") < n), self._info, self.split)

    def head(self, n: int = 5) -> ProblemSet:
        return self.take(n)

    def tail(self, n: int = 5) -> ProblemSet:
        """The last rows, in their order."""
        first = max(0, len(self) - max(0, n))
        return ProblemSet(self.df.where(F.col("pos") >= first).withColumn("pos", F.col("pos") - first), self._info, self.split)

    def sample(self, n: int, seed: int = 0) -> ProblemSet:
        """In the random order of the sample key."""
        keyed = R.sample(self.df, max(0, n), "pos", seed).withColumn("_key", R.sample_key("pos", seed))
        out = ProblemSet(keyed, self._info, self.split, order="_key")
        return ProblemSet(out.df.drop("_key"), self._info, self.split)

    def sample_balanced(self, column: str, per_group: int, seed: int = 0) -> ProblemSet:
        """At most so many of each value, groups in the order of their first row; a null is a group."""
        first = self.df.groupBy(F.col(column).alias("_g")).agg(F.min("pos").alias("_first"))
        taken = R.sample_balanced(self.df, per_group, column, "pos", seed)
        joined = taken.join(first, F.col(column).eqNullSafe(F.col("_g"))).withColumn("_key", R.sample_key("pos", seed))
        placed = R.with_position(joined.withColumnRenamed("pos", "_old"), ["_first", "_key"]).drop("_old", "_first", "_key", "_g")
        info = self._info | {"balanced_on": column, "samples_per_category": per_group}
        return ProblemSet(placed, info, self.split)

    def cross_validation(self, k: int = 5, seed: int = 0) -> list[tuple[ProblemSet, ProblemSet]]:
        """(train, validation) of each fold; train is all but the fold."""
        placed = R.cross_validation(self.df, k, "pos", seed)
        return [(self._with(placed.where(F.col("fold") != i).drop("fold")), self._with(placed.where(F.col("fold") == i).drop("fold"))) for i in range(k)]

    def extend(self, other: ProblemSet) -> ProblemSet:
        """All rows of both, the other's behind; columns that one lacks are null."""
        moved = other.df.withColumn("pos", F.col("pos") + len(self))
        return ProblemSet(self.df.unionByName(moved, allowMissingColumns=True), self._info, self.split)

    def get_statistics(self) -> DataFrame:
        return R.statistics(self.df, [c for c in ("domain", "problem_type", "language") if c in self.df.columns])

    def problems_by_domain(self) -> DataFrame:
        return self.df.groupBy(domain_name().alias("domain")).count()

    def domains(self) -> list[str]:
        return [r.domain for r in self.df.select(domain_name().alias("domain")).distinct().orderBy("domain").collect()]

    def to_json(self) -> DataFrame:
        return self.df.orderBy("pos").select(loaders.as_json(self.df.drop("pos")).alias("json"))

    def save(self, path: str) -> None:
        loaders.save_envelope(self.df, path, self._info, self.split)

    @classmethod
    def load(cls, spark, path: str, schema: str | None = None) -> ProblemSet:
        df, info, split = loaders.load_envelope(spark, path, schema)
        return cls(df, info, split)

    def copy(self) -> ProblemSet:
        return ProblemSet(self.df, self._info, self.split)

    def __repr__(self) -> str:
        return f"{type(self).__name__}(name={self.name!r}, split={self.split!r}, columns={len(self.df.columns)})"

    def __str__(self) -> str:
        return f"{self.name} ({self.split}): {len(self)} problems"


def field_statistics(df: DataFrame, fields: Sequence[str] = ("domain", "subject", "difficulty", "tag", "language", "dataset"), images: str | None = None) -> DataFrame:
    """kind, value, n: the total, the columns, the values of each field that the table has (null: 'unknown'), and rows
    with and without images. One pass; an empty table gives no rows."""
    listed = [F.struct(F.lit("total").alias("kind"), F.lit("").alias("value"))]
    listed += [F.struct(F.lit("field").alias("kind"), F.lit(c).alias("value")) for c in df.columns]
    listed += [F.struct(F.lit(f"{c}_distribution").alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in fields if c in df.columns]
    if images in df.columns:
        listed.append(F.struct(F.lit("images").alias("kind"), F.when(F.coalesce(images, F.lit(False)), "with").otherwise("without").alias("value")))
    return df.select(F.explode(F.array(*listed)).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def validate(df: DataFrame, required: Sequence[str] = ("problem_id", "question"), *, key: str = "problem_id", record: str | None = None, pos: str | None = None) -> DataFrame:
    """One row: valid, rows, issues, warnings, drifted and duplicates.

    An empty table isn't valid, nor is one whose first row lacks a required field: a column, or, where the table has a
    map column `record` with each row's fields, one of its keys; a null counts as there. `drifted` counts rows whose
    keys aren't those of the first row by `pos`, `duplicates` identifiers that occur again; both only warn.
    """
    none = F.array().cast("array<string>")
    wanted = F.array(*[F.lit(c) for c in required]) if required else none
    keys = F.array_sort(F.map_keys(record)) if record else F.array_sort(F.array(*[F.lit(c) for c in df.columns]))
    rows = df.select((F.col(key) if key in df.columns else F.lit(None)).cast("string").alias("key"), keys.alias("keys"), (F.col(pos) if pos else F.lit(0)).alias("at"))
    # By identifier and keys first, with map-side combining; the number of kinds of rows is small.
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    again = groups.agg(F.count_if((F.col("n") > 1) & F.col("key").isNotNull()).alias("duplicates"))
    kinds = rows.groupBy("keys").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    whole = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min_by("keys", "at").alias("first"), F.min_by("n", "at").alias("alike"))
    lacking = F.array_except(wanted, F.coalesce("first", none))
    issues = F.when(F.col("rows") == 0, F.array(F.lit("the table is empty"))).when(
        F.size(lacking) > 0, F.array(F.concat(F.lit("missing fields: "), F.array_join(lacking, ", ")))
    ).otherwise(none)
    drifted = F.when(F.col("rows") > 0, F.col("rows") - F.col("alike")).otherwise(0).cast("long")
    warnings = F.filter(
        F.array(
            F.when(drifted > 0, F.format_string("%d rows have other fields than the first", drifted)),
            F.when(F.col("duplicates") > 0, F.format_string("%d identifiers occur again", F.col("duplicates"))),
        ),
        lambda x: x.isNotNull(),
    )
    return whole.crossJoin(F.broadcast(again)).select(  # one row each
        (F.size(issues) == 0).alias("valid"), "rows", issues.alias("issues"), warnings.alias("warnings"), drifted.alias("drifted"), "duplicates"
    )
