"""Readers of the seven benchmark layouts into one problem schema, and the dataset envelopes as source and sink.

Every reader names its schema, so that nothing is inferred, and gives the columns of PROBLEM. `pos` orders the rows as
the files have them; it has gaps. Rows that can't be read are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import typed
from ..functions.columns import image_paths, strip
from ..functions.text import extract_options, normalise_language
from ..operators import rows as R

#: The columns of a problem table. What a data set has besides is JSON in additional_fields.
PROBLEM = (
    "pos", "problem_id", "question", "answer", "answer_category", "answer_unit", "solution", "domain", "language",
    "problem_type", "options", "correct_option", "image_paths", "difficulty", "source", "additional_fields",
)
_NULL = {"pos": "long", "options": "array<string>", "correct_option": "int", "image_paths": "array<string>"}
PROBLEM_TYPES = ("MC", "OE", "MultipleMC")


def domain_map(names: Mapping[str, str]) -> Callable[[Column], Column]:
    """Looks a data set's own domain names up; others are 'other'."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return lambda name: F.coalesce(F.element_at(table, name), F.lit("other"))


def problem_type(options: Column) -> Column:
    """Multiple choice takes more than one option."""
    return F.when(F.size(options) > 1, "MC").otherwise("OE")


def _problems(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Fill the schema; the answer becomes what typed.from_raw makes of it, all columns that aren't used go to
    additional_fields."""
    columns = {"language": F.lit("en"), "problem_type": F.lit("OE"), "pos": F.monotonically_increasing_id()} | columns
    columns["source"] = F.lit(source)
    null = lambda c: F.lit(None).cast(_NULL.get(c, "string"))
    kind, unit = columns.get("answer_category", F.lit(None).cast("string")), columns.get("answer_unit", F.lit(None).cast("string"))
    made = typed.from_raw(columns["answer"], kind, columns["problem_type"], unit)
    columns |= {"answer": made["value"], "answer_category": made["category"], "answer_unit": made["unit"]}
    return df.select(*[columns.get(c, null(c)).cast(_NULL.get(c, "string")).alias(c) for c in PROBLEM])


def _extra(*names: str) -> Column:
    """JSON of further columns; nulls are left out."""
    return F.to_json(F.struct(*names))


def missing_fields(problems: DataFrame) -> DataFrame:
    """problem_id and the names of its required fields that are null or empty, where there are any."""
    lacking = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in ("problem_id", "question")]
    found = problems.select("problem_id", F.filter(F.array(*lacking), lambda x: x.isNotNull()).alias("missing"))
    return found.where(F.size("missing") > 0)


def invalid_types(problems: DataFrame) -> DataFrame:
    return problems.where(F.col("problem_type").isNotNull() & ~F.col("problem_type").isin(*PROBLEM_TYPES))


def canonical(problems: DataFrame) -> DataFrame:
    """A domain that equals a known value stays, others too, exactly as written; image paths are never null. A problem
    type that isn't one is an error when the row is computed."""
    known = F.col("problem_type").isNull() | F.col("problem_type").isin(*PROBLEM_TYPES)
    checked = F.when(known, F.col("problem_type")).otherwise(F.raise_error(F.concat(F.lit("no problem type: "), "problem_type")).cast("string"))
    return problems.withColumns({"problem_type": checked, "image_paths": F.coalesce("image_paths", F.array().cast("array<string>"))})


def absolute(paths: Column, root: str) -> Column:
    """Relative paths below the data set's folder; null gives an empty list."""
    under = lambda p: F.when(p.rlike("^(/|[a-z]+://)"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))
    return F.transform(F.coalesce(paths, F.array().cast("array<string>")), under)


UGPHYSICS = {
    "AtomicPhysics": "atomic_physics", "ClassicalElectromagnetism": "classical_electromagnetism", "ClassicalMechanics": "classical_mechanics",
    "Electrodynamics": "electrodynamics", "GeometricalOptics": "geometrical_optics", "QuantumMechanics": "quantum_mechanics",
    "Relativity": "relativity", "SemiconductorPhysics": "semiconductor_physics", "Solid-StatePhysics": "solid_state_physics",
    "StatisticalMechanics": "statistical_mechanics", "TheoreticalMechanics": "theoretical_mechanics", "Thermodynamics": "thermodynamics",
    "WaveOptics": "wave_optics",
}


def ugphysics(spark: SparkSession, root: str, languages: Sequence[str] = ("en",), per_domain: int | None = None, seed: int = 0) -> DataFrame:
    """{domain}/{language}.jsonl, one JSON object a line; the folder is the domain. At most `per_domain` of each."""
    schema = "index string, problem string, answers string, answer_type string, unit string, solution string, topic string, language string"
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(root)
    at = F.split(F.input_file_name(), "/")
    df = df.withColumns({"file": F.regexp_extract(F.element_at(at, -1), r"^(.+)\.jsonl$", 1), "folder": F.element_at(at, -2)})
    df = df.where(F.col("file").isin(list(languages)) & F.coalesce("index", "problem", "answers").isNotNull())
    kind = F.when(F.col("answer_type") == "NV", "number").when(F.col("answer_type") == "EX", "formula").otherwise("text")
    out = _problems(
        df, "ugphysics", problem_id=F.col("index"), question=F.col("problem"), answer=F.col("answers"), answer_category=kind,
        answer_unit=F.when(F.col("answer_type") == "NV", F.col("unit")), solution=F.col("solution"), domain=domain_map(UGPHYSICS)(F.col("folder")),
        language=normalise_language(F.coalesce("language", "file")), difficulty=F.lit("undergraduate"), additional_fields=_extra("topic", "answer_type"),
    )
    return out if per_domain is None else R.sample_balanced(out, per_domain, "domain", "problem_id", seed)


def _array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


PHYBENCH = {"MECHANICS": "mechanics", "ELECTRICITY": "electricity", "THERMODYNAMICS": "thermodynamics", "MODERN": "modern_physics", "OPTICS": "optics", "ADVANCED": "advanced_physics"}
PHYBENCH_FILES = {"full": "PHYBench-questions_v1.json", "fullques": "PHYBench-fullques_v1.json", "onlyques": "PHYBench-onlyques_v1.json"}


def phybench(spark: SparkSession, path: str, variant: str = "full") -> DataFrame:
    """One of three files in a folder, or a file; all answers are formulas."""
    path = path if path.endswith(".json") else f"{path}/{PHYBENCH_FILES[variant]}"
    df = _array(spark, path, "id string, tag string, content string, answer string, solution string")
    domain = F.when(F.coalesce("tag", F.lit("")) != "", domain_map(PHYBENCH)(F.col("tag"))).otherwise(F.col("tag"))
    return _problems(
        df, "phybench", problem_id=F.col("id"), question=F.col("content"), answer=F.col("answer"), answer_category=F.lit("formula"),
        solution=F.col("solution"), domain=domain, language=F.lit(None).cast("string"),
    )


PHYX = {
    "Mechanics": "mechanics", "mechanics": "mechanics", "Electromagnetism": "electricity", "electromagnetism": "electricity",
    "electricity": "electricity", "Thermodynamics": "thermodynamics", "thermodynamics": "thermodynamics", "Optics": "optics",
    "optics": "optics", "Modern Physics": "modern_physics", "modern_physics": "modern_physics",
}


def phyx(spark: SparkSession, path: str, split: str = "test_mini") -> DataFrame:
    """A JSON array; rows without an identifier are named by the split and their place."""
    path = path if path.endswith(".json") else f"{path}/PhyX-{split}.json"
    schema = "id string, question string, answer string, domain string, options array<string>, correct_answer int, image string, image_path string, image_paths array<string>"
    df = _array(spark, path, schema).withColumn("place", F.monotonically_increasing_id())
    listed = F.filter(F.concat(F.coalesce("image_paths", F.array().cast("array<string>")), _paths("image"), _paths("image_path")), lambda p: strip(p) != "")
    return _problems(
        df, "phyx", pos=F.col("place"), problem_id=F.coalesce("id", F.concat(F.lit(f"phyx_{split}_"), "place")), question=F.col("question"),
        answer=F.col("answer"), domain=domain_map(PHYX)(F.col("domain")), options=F.col("options"), correct_option=F.col("correct_answer"),
        image_paths=F.array_distinct(listed), problem_type=problem_type(F.col("options")),
    )


def _paths(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), image_paths(F.col(column))).otherwise(F.array().cast("array<string>"))


def stem_number(file: Column) -> Column:
    """The number that a file's name is, else null; sorts numbers first."""
    return F.regexp_extract(file, r"([^/]+)\.[^./]+$", 1).try_cast("long")


def seephys(spark: SparkSession, root: str, split: str = "train") -> DataFrame:
    """{split}/{n}.json, one object a file, in the order of the numbers; other names come last."""
    df = _array(spark, f"{root}/{split}", "index string, question string, answer string, subject string, image_paths string, language string")
    df = df.withColumn("file", F.input_file_name())
    place = F.coalesce(stem_number(F.col("file")), F.lit(1 << 40))
    return _problems(
        df.orderBy(place, "file"), "seephys", pos=place, problem_id=F.coalesce("index", F.regexp_extract("file", r"([^/]+)\.json$", 1)),
        question=F.col("question"), answer=F.col("answer"), domain=F.col("subject"), image_paths=_paths("image_paths"),
        language=F.when(F.col("language").isNotNull(), normalise_language(F.col("language"))),
    )


TPBENCH = {"QM": "quantum_mechanics", "HET": "high_energy_theory", "Stat Mech": "statistical_mechanics", "Classical Mechanics": "classical_mechanics", "Cosmology": "cosmology"}


def tpbench(spark: SparkSession, path: str, language: str = "en", per_domain: int | None = None, seed: int = 0) -> DataFrame:
    """Parquet or JSON, regrouped by domain in the order in which the domains first occur."""
    if language != "en":
        raise ValueError("tpbench is in English")
    schema = "problem_id string, problem string, answer string, solution string, domain string, difficulty_level int"
    df = spark.read.parquet(path) if path.endswith(".parquet") else _array(spark, path, schema)
    out = _problems(
        df, "tpbench", problem_id=F.col("problem_id").cast("string"), question=F.col("problem"), answer=F.col("answer"), answer_category=F.lit("formula"),
        solution=F.col("solution"), domain=domain_map(TPBENCH)(F.col("domain")), difficulty=F.col("difficulty_level").cast("string"),
    )
    out = out if per_domain is None else R.sample_balanced(out, per_domain, "domain", "problem_id", seed)
    return first_seen_order(out, "domain")


def first_seen_order(df: DataFrame, group: str, pos: str = "pos", keep: str | None = None) -> DataFrame:
    """Rows by group, groups in the order of their first row, whose place is kept under the name `keep`."""
    firsts = df.groupBy(F.col(group).alias("_group")).agg(F.min(pos).alias("_first"))
    ordered = df.join(firsts, F.col(group).eqNullSafe(F.col("_group"))).orderBy("_first", pos).drop("_group")
    return ordered.withColumnRenamed("_first", keep) if keep else ordered.drop("_first")


def physreason(spark: SparkSession, root: str, sample_size: int | None = None, seed: int = 42) -> DataFrame:
    """{id}/problem.json; each sub-question becomes a problem of its own, after the shared context. After a
    sub-question that has no answer, the rest of its problem is left out. Samples are of whole problems."""
    schema = "question_structure map<string,string>, answer array<string>, explanation_steps map<string,map<string,string>>, difficulty string"
    df = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "problem.json").json(root)
    df = df.withColumn("id", F.regexp_extract(F.input_file_name(), r"([^/]+)/problem\.json$", 1))
    if sample_size is not None:
        df = R.sample(df, sample_size, "id", seed)
    many = F.size("question_structure") - 1
    ordinals = F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>"))
    df = df.select("*", F.explode(ordinals).alias("nth")).where((F.col("nth") <= F.size("answer")))
    key = F.concat(F.lit("sub_question_"), F.col("nth"))
    df = df.withColumn("sub", F.try_element_at("question_structure", key)).where("sub IS NOT NULL")
    return _problems(
        df, "physreason", problem_id=F.concat_ws("_", "id", F.col("nth").cast("string")),
        question=F.concat_ws("\n\n", F.try_element_at("question_structure", F.lit("context")), "sub"),
        answer=F.element_at("answer", F.col("nth")), solution=F.to_json(F.try_element_at("explanation_steps", key)), difficulty=F.col("difficulty"),
    )


def jeebench(spark: SparkSession, path: str) -> DataFrame:
    """Physics only; both multiple-choice types keep their name, options are taken from the question. Rows of other
    types are left out."""
    df = _array(spark, path, "index string, subject string, type string, question string, gold string, description string").where("subject = 'phy'")
    table = {"MCQ": "MC", "MCQ(multiple)": "MultipleMC", "Integer": "OE", "Numeric": "OE"}
    df = df.where(F.col("type").isin(*table))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("type"))
    choice = F.contains(kind, F.lit("MC"))
    return _problems(
        df, "jeebench", problem_id=F.concat_ws("_", "subject", "index", "description"), question=F.col("question"), answer=F.col("gold"), problem_type=kind,
        answer_category=F.when(choice, "option").otherwise("text"), options=F.when(choice, extract_options(F.col("question"))), additional_fields=_extra("type"),
    )


def subject_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the raw JEEBench file by subject, and by subject and type."""
    df = _array(spark, path, "subject string, type string")
    return df.groupBy(F.coalesce("subject", F.lit("unknown")).alias("subject"), F.coalesce("type", F.lit("unknown")).alias("type")).count().orderBy("subject", "type")


LOADERS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (ugphysics, phybench, phyx, seephys, tpbench, physreason, jeebench)
}


def load(spark: SparkSession, name: str, path: str, **how) -> DataFrame:
    if name.lower() not in LOADERS:
        raise ValueError(f"no such dataset: {name}; there are {', '.join(sorted(LOADERS))}")
    return LOADERS[name.lower()](spark, path, **how)


def save(problems: DataFrame, path: str, kind: str = "json") -> None:
    """Sink: one file for each partition."""
    problems.write.mode("overwrite").format(kind).save(path)


def save_envelope(problems: DataFrame, path: str, info: Mapping[str, object] | None = None, split: str = "test") -> None:
    """Sink: the rows as JSON lines in {path}/problems, nulls left out, and info and split in {path}/meta."""
    problems.write.mode("overwrite").json(f"{path}/problems")
    meta = [(json.dumps(dict(info or {}), default=str), split)]
    problems.sparkSession.createDataFrame(meta, "info string, split string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_envelope(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, dict, str]:
    """What save_envelope wrote, or one JSON file {info, split, problems}: rows with `pos`, info and split. A single
    file must fit an executor; without a schema the rows are inferred."""
    if path.endswith(".json"):
        reader = spark.read.option("multiLine", "true")
        one = (reader.schema(f"info map<string,string>, split string, problems array<struct<{schema}>>") if schema else reader).json(path)
        rows = one.select(F.posexplode("problems").alias("pos", "row")).select(F.col("pos").cast("long").alias("pos"), "row.*")
        head = one.select(F.to_json("info") if "info" in one.columns else F.lit("{}"), "split").first()
        return rows, json.loads(head[0] or "{}"), head[1]
    head = spark.read.schema("info string, split string").json(f"{path}/meta").first()
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(f"{path}/problems"), json.loads(head[0]), head[1]


def export(problems: DataFrame, path: str, info: Mapping[str, object] | None = None) -> None:
    """Sink: {path}/samples as JSON lines, and {path}/info if there is any."""
    problems.write.mode("overwrite").json(f"{path}/samples")
    if info:
        problems.sparkSession.createDataFrame([(json.dumps(dict(info), default=str),)], "info string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def as_json(problems: DataFrame) -> Column:
    """Each row as JSON without nulls."""
    return F.to_json(F.struct(*problems.columns))


def renamed(raw: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Source fields under their standard names, the rest as it is; of fields that get the same name the later one that
    isn't null counts. Identifiers become strings, a language that is there is normalised."""
    groups: dict[str, list[str]] = {}
    for c in raw.columns:
        groups.setdefault(names.get(c, c), []).append(c)
    columns = {new: F.coalesce(*[F.col(c) for c in reversed(old)]) for new, old in groups.items()}
    if "problem_id" in columns:
        columns["problem_id"] = columns["problem_id"].cast("string")
    if "language" in columns:
        columns["language"] = normalise_language(columns["language"])
    return raw.select(*[c.alias(n) for n, c in columns.items()])

