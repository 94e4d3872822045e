"""The hub and the offline halves of downloading."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gradus.sources import downloads as D
from gradus.sources import hub as H


def test_hub(spark, tmp_path):
    hub = H.Hub()
    assert "phyx" in hub.available() and hub.info("PhyX")["modalities"] == ("text", "image") and H.citation("PHYX")[1].startswith("https") and H.citation("x") is None
    (tmp_path / "PHYBench-questions_v1.json").write_text(json.dumps([{"id": str(i), "tag": "OPTICS", "content": f"q{i}", "answer": "x"} for i in range(9)]))
    df = hub.load(spark, "phybench", str(tmp_path), sample_size=4)
    assert df.count() == 4 and {(r.domain, r.answer_category) for r in df.collect()} == {("optics", "formula")}
    with pytest.raises(ValueError):
        hub.load(spark, "phybench", str(tmp_path), sample_size=10)
    with pytest.raises(ValueError):
        hub.load(spark, "phybench", str(tmp_path), variant="none")
    with pytest.raises(ValueError):
        hub.load(spark, "nothing")
    with pytest.raises(FileNotFoundError):
        hub.load(spark, "phybench", str(tmp_path / "absent"))

    def fetch(folder):
        (tmp_path / "later").mkdir()
        (tmp_path / "later/PhyX-test_mini.json").write_text(json.dumps([{"question": "q", "answer": "B", "options": ["x"], "image": "a.png", "domain": "Optics"}]))

    row = hub.register_downloader("phyx", fetch).load(spark, "phyx", str(tmp_path / "later"), auto_download=True).first()
    assert (row.problem_id, row.problem_type, row.domain, row.image_paths) == ("phyx_test_mini_0", "OE", "optics", ["a.png"])
    hub.register("mine", lambda spark, path: spark.range(3).select(F.col("id").cast("string").alias("problem_id")))
    assert hub.load(spark, "mine", str(tmp_path)).count() == 3 and len(hub.available()) == 8
    assert H.resolve_data_dir(None, "PhyX", {H.CACHE: "/c"}) == "/c/phyx" and H.resolve_data_dir("/d", "x") == "/d"


def test_download_once(tmp_path):
    calls = []

    def fetch(folder):
        calls.append(folder)
        open(f"{folder}/a.json", "w").write("[1]")

    get = D.Download("x", fetch, lambda folder: D.is_json_array(f"{folder}/a.json"))
    folder = str(tmp_path / "x")
    assert get(folder) == get(folder) == folder and len(calls) == 1 and get(folder, force=True) and len(calls) == 2 and get.size(folder) == 3
    with pytest.raises(RuntimeError):
        D.Download("y", lambda folder: None, lambda folder: False)(str(tmp_path / "y"))


def test_pages_and_parts(tmp_path):
    failed = []

    def page(offset, length):
        if offset == 2 and not failed:
            failed.append(1)
            raise OSError
        return {"rows": [{"row": {"k": k}} for k in range(offset, min(offset + length, 5))], "num_rows_total": 5}

    assert [r["k"] for r in D.paged(page, rows=2, wait=0)] == list(range(5))

    def fetch(domain, language):
        if language == "zh":
            raise OSError
        return [{"d": domain}]

    done = D.fetch_each(D.domain_languages(["A", "B"], ["en", "zh"]), fetch, str(tmp_path))
    assert done == [("A", "en"), ("B", "en")] and D.are_json_lines(str(tmp_path / "A/en.jsonl")) and not D.are_json_lines(str(tmp_path / "A/zh.jsonl"))


def test_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as packed:
        packed.writestr("d/1.json", "{}")
    assert D.is_zip(str(tmp_path / "a.zip")) and not D.is_zip(__file__)
    assert D.are_json_objects(D.unpacked(str(tmp_path / "a.zip"), str(tmp_path / "to")) + "/d") and not D.are_json_objects(str(tmp_path))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as packed:
        packed.writestr("../x", "")
    with pytest.raises(ValueError):
        D.unpacked(str(tmp_path / "b.zip"), str(tmp_path / "to"))


def test_json_safe(spark):
    df = spark.sql("SELECT X'FFD8' AS b, double('NaN') AS x, array(double('NaN'), 1D) AS y, map('k', X'00') AS m, named_struct('d', date'2024-01-02') AS s, CAST(NULL AS struct<z: double>) AS n")
    assert json.loads(D.json_safe(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]) == {"b": "/9g=", "x": None, "y": [None, 1.0], "m": {"k": "AA=="}, "s": {"d": "2024-01-02"}, "n": None}


def test_images(spark, tmp_path):
    png, jpg = bytearray(b"\x89PNG1"), bytearray(b"\xff\xd8\xff\xe0")
    df = spark.createDataFrame([("1", [png]), ("2", [jpg, None, png]), ("3", None)], "problem_id string, images array<binary>")
    rows, files = D.split_images(df, "problem_id", "images")
    assert {r.problem_id: r.image_paths for r in rows.collect()} == {"1": ["images/1.png"], "2": ["images/2_0.jpg", "images/2_1.png"], "3": []}
    D.write_files(files, str(tmp_path))
    back = {r.problem_id: r.images for r in D.read_images(spark, rows, str(tmp_path / "images")).collect()}
    assert back == {"1": [png], "2": [jpg, png], "3": []}
