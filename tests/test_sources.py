import json

import pytest
from pyspark.sql import functions as F

from gradus.functions import columns as C
from gradus.operators import rows as R
from gradus.sources.loaders import PROBLEM, load, save
from gradus.streaming.answers import stream_scores


def write(path, value, lines=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, value)) if lines else json.dumps(value))


def test_loaders(spark, tmp_path):
    write(tmp_path / "ug/Optics/en.jsonl", [{"index": "1", "problem": "q", "answers": "3", "unit": "m", "domain": "Optics"}], True)
    write(tmp_path / "ug/Optics/zh.jsonl", [{"index": "2", "problem": "q", "answers": "3"}], True)
    write(tmp_path / "phybench.json", [{"id": "a", "tag": "OPTICS", "content": "q", "answer": "$x$"}])
    write(tmp_path / "phyx.json", [{"id": "p", "question": "q", "answer": "B", "options": ["x", "y"], "correct_answer": 1}])
    write(tmp_path / "see/train/7.json", {"index": None, "question": "q", "answer": "1", "subject": "CM"})
    write(tmp_path / "tp.json", [{"problem_id": "t", "problem": "q", "answer": "1", "difficulty_level": 5}])
    write(tmp_path / "pr/x9/problem.json", {"question_structure": {"context": "c", "sub_question_1": "a?", "sub_question_2": "b?"}, "answer": ["1", "2"], "difficulty": "easy"})
    write(tmp_path / "jee.json", [{"index": "1", "subject": "phy", "type": "MCQ(multiple)", "question": "q", "gold": "AB"}, {"index": "2", "subject": "chem"}])
    at = {"ugphysics": "ug", "phybench": "phybench.json", "phyx": "phyx.json", "seephys": "see", "tpbench": "tp.json", "physreason": "pr", "jeebench": "jee.json"}
    found = {n: load(spark, n, str(tmp_path / p)) for n, p in at.items()}
    assert all(tuple(df.columns) == PROBLEM for df in found.values())
    rows = {n: sorted(df.collect(), key=lambda r: r.problem_id) for n, df in found.items()}
    assert {n: len(r) for n, r in rows.items()} == dict.fromkeys(at, 1) | {"physreason": 2}
    assert rows["physreason"][1].question == "c\n\nb?" and rows["seephys"][0].problem_id == "7"
    assert rows["phyx"][0].problem_type == "MC" and rows["jeebench"][0].problem_type == "MultipleMC"
    save(found["phyx"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError):
        load(spark, "nothing", "x")


def test_columns(spark):
    df = spark.createDataFrame([("Classical Mechanics", " \n", "<answer></answer>"), ("typo", "a  b\tc", "none")], "d string, t string, r string")
    got = df.select(C.normalise_domain(F.col("d")), C.word_count(F.col("t")), C.answer_tag(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("classical_mechanics", 0, ""), ("other", 3, None)]
    assert R.filter_by_domains(df, ["Classical-Mechanics"], "d").count() == 1 and R.filter_by_domains(df, [], "d").count() == 0
    assert R.filter_by_keywords(df, ["none"], ["t", "r"]).count() == 1


def test_positions_and_folds(spark):
    df = R.with_position(spark.range(0, 103, 1, 5).withColumnRenamed("id", "k"), "k")
    assert all(r.k == r.pos for r in df.collect())
    assert {r.fold: r["count"] for r in R.folds(df, 5, 103).groupBy("fold").count().collect()} == {0: 20, 1: 20, 2: 20, 3: 20, 4: 23}
    assert [r.k for r in R.slice_positions(df, slice(None, None, -50), 103).orderBy("k").collect()] == [2, 52, 102]


def test_half_way_numbers(spark, tmp_path):
    from gradus.plans.catalogue import compare_number_rounded

    rows = [(q, 1, float(q), 5) for q in range(1, 9)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.l_orderkey: r.same for r in compare_number_rounded(spark, str(tmp_path)).collect()} == {q: q % 2 == 0 for q in range(1, 9)}


def test_cross_validation(spark, tmp_path):
    import hashlib
    from collections import Counter

    ids = [*range(-5, 900, 7), 10**12]  # with gaps, and not from 0
    got = {r.k: r.fold for r in R.cross_validation(spark.createDataFrame([(i,) for i in ids], "k long"), 5, "k", 3).collect()}
    order = sorted(ids, key=lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest())
    assert got == {i: min(at // (len(ids) // 5), 4) for at, i in enumerate(order)}
    spark.range(50, 1053).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    from gradus.plans.catalogue import cv_splits

    assert Counter(r.fold for r in cv_splits(spark, str(tmp_path)).collect()) == {0: 200, 1: 200, 2: 200, 3: 200, 4: 203}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("1", "x = 5"), ("2", "6")], "problem_id string, prediction string").write.parquet(f"{tmp_path}/in")
    problems = spark.createDataFrame([("1", "5"), ("2", "7")], "problem_id string, answer string")
    stream = spark.readStream.schema("problem_id string, prediction string").parquet(f"{tmp_path}/in")
    q = stream_scores(stream, problems).writeStream.format("memory").queryName("scores").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.problem_id: r.score for r in spark.sql("SELECT * FROM scores").collect()} == {"1": 1.0, "2": 0.0}
