import pytest
from pyspark.sql import functions as F

from gradus.plans import annotation as A


def test_models():
    assert [A.provider_of(m) for m in ("deepseek-chat", "qwen3-vl", "o3", "gpt-5-mini", "gemini-pro", "stub")] == ["deepseek", "ollama", "openai", "openai", "gemini", "stub"]
    with pytest.raises(ValueError):
        A.provider_of("gpt-3.5")


def test_workflow(spark):
    class Broken:
        def chat(self, prompt):
            raise RuntimeError("no " + prompt)

    df = spark.createDataFrame([("a",), ("b",)], "question string")
    broken = lambda d: A.ask(d, F.col("question"), Broken, "second")
    out = A.domain_workflow("stub").add("second", broken).run(df)
    rows = out.collect()
    assert all(r.domain_annotation.domains == [] and r.domain_annotation.confidence == 0 for r in rows)
    assert [[t.status for t in r.trace] for r in rows] == [["success", "failed"]] * 2
    assert {r.module_name: r.success_rate_percentage for r in A.metrics(out).collect()} == {"domain_reply": 100.0, "second": 0.0}
    with pytest.raises(ValueError):
        A.Workflow().run(df)


def test_parsing(spark):
    variables = '{"variables": [{"symbol": "v", "known": true, "value": "3"}, {"symbol": "v", "known": true, "value": "4"}, {"symbol": "t", "known": false, "description": "time"}]}'
    theorems = '{"theorems": [{"name": "Ohm", "equations": ["U=RI"]}]}'
    row = spark.range(1).select(A.parse_variables(F.lit(variables)).alias("v"), A.parse_theorems(F.lit(theorems)).alias("t"), A.parse_theorems(F.lit("broken")).alias("n")).first()
    assert row.v.known == {"v": "4"} and row.v.unknown == {"t": "time"}
    assert row.t[0].name == "Ohm" and row.n == []
