"""The data set's own methods, validation, evaluation and typed answers on small tables."""

import pytest
from pyspark.sql import functions as F

from gradus.functions import typed as Y
from gradus.operators import dataset as P
from gradus.operators import evaluation as E
from gradus.plans import annotation as A
from gradus.sources import loaders as L


@pytest.fixture(scope="module")
def problems(spark):
    rows = [("a", "q a", "mechanics", "MC"), ("b", "q b", None, "OE"), ("a", "again", "optics", "OE"), (None, "nameless", "optics", None), ("c", "q c", "typo", "MultipleMC")]
    df = spark.createDataFrame([(k, *r, '{"tag": "t%d"}' % k) for k, r in enumerate(rows)], "pos long, problem_id string, question string, domain string, problem_type string, additional_fields string")
    return P.ProblemSet(df, {"name": "five"}, "train")


def questions(part):
    return [r.question for r in part]


def test_rows(problems):
    assert len(problems) == 5 and problems.name == "five" and problems[0].question == "q a" and problems[-1].question == "q c"
    with pytest.raises(IndexError):
        problems[5]
    assert questions(problems[1:4]) == ["q b", "again", "nameless"] and questions(problems[::-2]) == ["q c", "again", "q a"]
    assert questions(problems.select([4, 0, 4, 9, -1])) == ["q c", "q a", "q c"]
    assert questions(problems.head(2)) == ["q a", "q b"] and questions(problems.tail(2)) == ["nameless", "q c"] and questions(problems.take(0)) == []
    assert problems.get_by_id("a").question == "q a" and problems.get_by_id("problem_3").question == "nameless" and problems.get_by_id_safe("x") is None
    with pytest.raises(KeyError):
        problems.get_by_id("x")
    assert problems.get_all_ids() == ["a", "b", "problem_3", "c"]
    assert [r.pos for r in problems.filter(F.col("domain") == "optics")] == [0, 1]
    assert questions(problems.filter_by_domains(["Optics", "nonsense"])) == ["again", "nameless"] or len(problems.filter_by_domains(["nonsense"])) >= 1
    assert questions(problems.filter_by_domain("mechanics")) == ["q a"] and questions(problems.filter_by_keywords(["AGAIN"], ["question"])) == ["again"]
    assert [r.n for r in problems.map(n=F.length("question")).collect()] == [3, 3, 5, 8, 3]


def test_samples_and_folds(problems):
    assert sorted(questions(problems.sample(3, 1))) == sorted(questions(problems.sample(3, 1))) and len(problems.sample(99)) == 5
    balanced = problems.sample_balanced("domain", 1)
    assert [r.domain for r in balanced] == ["mechanics", None, "optics", "typo"] and balanced.get_info()["balanced_on"] == "domain"
    parts = problems.cross_validation(2, 1)
    assert sorted(len(v) for _, v in parts) == [2, 3] and all(len(t) + len(v) == 5 for t, v in parts)
    assert len(problems.extend(problems)) == 10 and [r.pos for r in problems.extend(problems)] == list(range(10))


def test_columns_of_problems(problems):
    rows = problems.df.orderBy("pos").select(P.is_multiple_choice().alias("mc"), P.is_open_ended().alias("oe"), P.domain_name().alias("d"), P.field(problems.df, "tag", "-").alias("tag"), P.field(problems.df, "none", "-").alias("no"), P.short(chars=2).alias("s")).collect()
    assert [r.mc for r in rows] == [True, False, False, False, False] and [r.oe for r in rows] == [False, True, True, False, False]
    assert rows[1].d == "Unknown" and rows[2].tag == "t2" and rows[2].no == "-" and rows[0].s == "a [mechanics] q ..."
    assert problems.domains() == ["Unknown", "mechanics", "optics", "typo"] and "5 problems" in str(problems) and "five" in repr(problems)
    stats = {(r.kind, r.value): r.n for r in problems.get_statistics().collect()}
    assert stats["domain", "optics"] == 2 and stats["domain", None] == 1 and stats["total", ""] == 5


def test_envelopes(problems, tmp_path, spark):
    problems.save(str(tmp_path / "out"))
    again = P.ProblemSet.load(spark, str(tmp_path / "out"), "pos long, problem_id string, question string")
    assert again.name == "five" and again.split == "train" and questions(again) == questions(problems)
    (tmp_path / "one.json").write_text('{"info": {"name": "n"}, "split": "s", "problems": [{"problem_id": "1"}, {"problem_id": "2"}]}')
    one = P.ProblemSet.load(spark, str(tmp_path / "one.json"))
    assert [(r.pos, r.problem_id) for r in one] == [(0, "1"), (1, "2")] and one.split == "s" and one.name == "n"
    L.export(problems.df, str(tmp_path / "e"), {"a": 1})
    assert spark.read.json(str(tmp_path / "e/samples")).count() == 5
    assert '"problem_id"' not in problems.to_json().collect()[3].json  # nulls are left out


def test_validation(spark, problems):
    row = P.validate(problems.df).first()
    assert (row.valid, row.rows, row.duplicates, row.drifted) == (True, 5, 1, 0) and row.warnings == ["1 identifiers occur again"]
    lacking = P.validate(problems.df.drop("question")).first()
    assert not lacking.valid and lacking.issues == ["missing fields: question"]
    empty = P.validate(problems.df.limit(0)).first()
    assert not empty.valid and empty.issues == ["the table is empty"] and empty.rows == 0
    assert [tuple(r) for r in L.missing_fields(problems.df).collect()] == [(None, ["problem_id"])]
    with pytest.raises(Exception, match="no problem type"):
        L.canonical(spark.createDataFrame([("XX", None)], "problem_type string, image_paths array<string>")).collect()


def test_evaluation(spark):
    rows = [("1", "42", "number"), ("2", "x", "text"), ("3", None, "text"), ("4", "9", "number"), ("5", "7", "number")]
    problems = spark.createDataFrame(rows, "problem_id string, v string, k string").select("problem_id", Y.answer(F.col("v"), F.col("k")).alias("answer"), F.lit(None).cast("string").alias("domain"), F.lit("OE").alias("problem_type"))
    preds = spark.createDataFrame([("1", "42.0"), ("2", "y"), ("3", "z"), ("5", None), ("9", "?")], "problem_id string, t string").select("problem_id", Y.raw(F.col("t")).alias("prediction"))
    out = E.Evaluator("category").evaluate_dataset(problems, preds)
    assert {r.problem_id: (r.status, r.score) for r in out.collect()} == {"1": ("success", 1.0), "2": ("success", 0.0), "3": ("no_ground_truth", 0.0), "4": ("missing_prediction", 0.0), "5": ("missing_prediction", 0.0)}
    assert {(r.kind, r.value): (r.accuracy, r.total, r.evaluated, r.failed) for r in E.summary(out).collect()} == {("overall", ""): (0.5, 5, 2, 3), ("domain", "Unknown"): (0.5, 5, 2, 3), ("problem_type", "OE"): (0.5, 5, 2, 3)}
    unsure = E.Evaluator(lambda p, g: F.when(p["value"] == "y", True)).evaluate_dataset(problems, preds)
    assert {r.problem_id: r.status for r in unsure.collect()}["1"] == "error"
    with pytest.raises(ValueError):
        E.Evaluator().evaluate_dataset(problems)
    with pytest.raises(ValueError):
        E.Evaluator().set_comparator(None)
    ruled = problems.select(Y.category(Y.raw(F.lit("x")), Y.raw(F.lit("y")), {"text": lambda p, g: True}).alias("same"), Y.can_compare(F.lit(1), F.lit(2)).alias("can")).first()
    assert ruled.same and ruled.can


def test_raw_answers(spark):
    rows = [("B", None, "MultipleMC", None), ("\\boxed{3}", "number", "OE", "m"), ("$4$", "number", "OE", None), ("x+1", "equation", "OE", None), ("some", None, "OE", None), ("2x", None, "OE", None), (None, "text", "OE", None)]
    df = spark.createDataFrame(rows, "v string, k string, t string, u string")
    got = df.select(Y.from_raw(F.col("v"), F.col("k"), F.col("t"), F.col("u")).alias("a")).collect()
    assert [r.a and (r.a.value, r.a.category, r.a.unit) for r in got] == [("B", "option", None), ("3", "physical_quantity", "m"), ("4", "number", None), ("x+1", "formula", None), ("some", "text", None), ("2x", "formula", None), None]
    first = df.limit(1).select(Y.to_json(Y.answer(F.lit("3"), "number", F.lit(""))).alias("j")).first()
    assert first.j == '{"value":"3","answer_category":"number"}'


def test_reviews(spark):
    two = A.parse_theorems(F.lit('{"theorems": [{"name": "one"}, {"name": "two"}]}'))
    said = F.from_json(F.lit('[{"is_relevant": false, "equations_correct": true, "conditions_valid": true, "relevance_feedback": "no"}]'), "array<struct<" + A.REVIEW.replace(" boolean", ":boolean").replace(" string", ":string") + ">>")
    more = A.parse_theorems(F.lit('{"theorems": [{"name": "three"}]}'))
    found = spark.range(1).select(A.review_theorems(two, said, more).alias("r"), A.review_theorems(F.lit(None).cast(spark.range(1).select(two).schema[0].dataType), said).alias("none")).first()
    assert [(t.name, t.is_relevant, t.equations_correct, t.theorem_index, t.added) for t in found.r] == [("one", False, False, 1, False), ("two", False, False, 2, False), ("three", True, True, 3, True)]
    assert found.r[0].relevance_feedback == "no" and found.none == []


def test_solutions(spark):
    problems = spark.createDataFrame([("1", None, "MC")], "problem_id string, domain string, problem_type string")
    answers = spark.createDataFrame([("1", "$x$"), ("2", "y")], "problem_id string, agent_answer string")
    steps = A.add_step(F.col("intermediate_steps"), F.lit("s"), F.lit("c"))
    row = A.solutions(problems, answers).withColumn("intermediate_steps", steps).withColumn("metadata", A.add_metadata(F.col("metadata"), "k", F.lit(1))).select("*", *[c.alias(f"_{n}") for n, c in A.solution_summary().items()], A.step(F.col("intermediate_steps"), "s").alias("one"), A.step(F.col("intermediate_steps"), "z").alias("no"), A.metadata(F.col("metadata"), "q", "d").alias("m")).first()
    assert (row._domain, row._problem_type, row._steps, row._latex, row._metadata_keys) == ("Unknown", "MC", 1, True, ["k"])
    assert row.one.step_content == "c" and row.no is None and row.m == "d"
    assert [r.problem_id for r in A.orphans(problems, answers).collect()] == ["2"]


def test_schemas():
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {"type": "string"}}}}}}
    made = A.response_format(schema, "r")
    assert made["name"] == "r" and made["schema"]["additionalProperties"] is False and made["schema"]["properties"]["a"]["items"]["required"] == ["b"]
    assert A.response_format(None) is None and A.response_format({"json_schema": {"name": "n", "schema": {"type": "string"}}})["name"] == "n"


def test_logger(tmp_path):
    from gradus.log import get_logger

    where = tmp_path / "logs/x.log"
    log = get_logger("gradus.test", {"GRADUS_LOG_FILE": str(where), "GRADUS_LOG_CONSOLE": "false", "GRADUS_LOG_LEVEL": "warning"})
    log.info("quiet")
    log.warning("loud")
    assert get_logger("gradus.test") is log and "loud" in where.read_text() and "quiet" not in where.read_text()
