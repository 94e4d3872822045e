"""Annotation: model calls as stages of a plan, each storing its result, status and error beside the rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DOMAINS

DOMAIN_REPLY = "domains array<string>, subdomains array<string>, confidence double, reasoning string"
THEOREM_REPLY = "theorems array<struct<name string, description string, equations array<string>, domain string, conditions array<string>>>"
VARIABLE_REPLY = "variables array<struct<symbol string, description string, known boolean, value string, unit string, type string>>, problem_summary string"
Stage = Callable[[DataFrame], DataFrame]


class Client(Protocol):
    def chat(self, prompt: str) -> str: ...


PROVIDERS: dict[str, Callable[[str], Client]] = {}


def provider_of(model: str) -> str:
    """Which provider serves a model name; a name that none serves is an error."""
    name = model.lower()
    if name == "stub":
        return "stub"
    if "deepseek" in name:
        return "deepseek"
    if name.startswith("qwen"):
        return "ollama"
    if re.match(r"o\d", name) or re.match(r"gpt-(4\.1|5)", name):
        return "openai"
    if name.startswith("gemini"):
        return "gemini"
    raise ValueError(f"no provider for model {model}")


def create_client(model: str) -> Client:
    """A client of a registered provider; register one by PROVIDERS[name] = factory."""
    provider = provider_of(model)
    if provider not in PROVIDERS:
        raise RuntimeError(f"provider {provider} isn't registered")
    return PROVIDERS[provider](model)


class Stub:
    """Answers every prompt with the same text."""

    def __init__(self, reply: str = "{}"):
        self.reply = reply

    def chat(self, prompt: str) -> str:
        return self.reply


PROVIDERS["stub"] = lambda model: Stub()


def ask(df: DataFrame, prompt: Column, make: Callable[[], Client], name: str) -> DataFrame:
    """Adds `name` (the reply) and `name`_error; one client for each task, and a failed call is a row with an error. In
    a workflow rows that were stopped, and null prompts anywhere, aren't sent.

    Calls aren't deterministic, so the result should be stored before it is used twice.
    """

    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            out = []
            for text in batch:
                if text is None:
                    out.append((None, None))
                    continue
                try:
                    out.append((client.chat(text), None))
                except Exception as error:  # noqa: BLE001 - becomes the row's error
                    out.append((None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["reply", "error"])

    call.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(call, "reply string, error string").asNondeterministic()
    df = df.withColumn("_said", udf(F.when(may_run(), prompt) if "_alive" in df.columns else prompt))
    return df.select(*[c for c in df.columns if c != "_said"], F.col("_said.reply").alias(name), F.col("_said.error").alias(f"{name}_error"))


def parse_domains(reply: Column) -> Column:
    """struct<domains, subdomains, confidence, reasoning>; unknown domains are 'other', no reply has none."""
    found = F.from_json(reply, DOMAIN_REPLY)

    def known(name: Column) -> Column:
        clean = F.translate(F.lower(name), " -", "__")
        return F.when(clean.isin(*DOMAINS), clean).otherwise("other")

    return F.struct(
        F.transform(F.coalesce(found["domains"], F.array().cast("array<string>")), known).alias("domains"),
        found["subdomains"].alias("subdomains"),
        F.coalesce(found["confidence"], F.lit(0.0)).alias("confidence"),
        found["reasoning"].alias("reasoning"),
    )


def parse_theorems(reply: Column) -> Column:
    return F.coalesce(F.from_json(reply, THEOREM_REPLY)["theorems"], F.from_json(F.lit("[]"), THEOREM_REPLY[len("theorems ") :]))


def parse_variables(reply: Column) -> Column:
    """struct of two maps by symbol, known and unknown; of a repeated symbol the last counts."""
    found = F.coalesce(F.from_json(reply, VARIABLE_REPLY)["variables"], F.from_json(F.lit("[]"), "array<" + VARIABLE_REPLY.split("array<", 1)[1].rsplit(">, ", 1)[0] + ">"))

    def by_symbol(known: bool) -> Column:
        own = F.filter(found, lambda v: F.coalesce(v["known"], F.lit(False)) == known)
        last = F.filter(own, lambda v, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda w: w["symbol"] == v["symbol"]))
        return F.map_from_entries(F.transform(last, lambda v: F.struct(v["symbol"], F.coalesce(v["value"], v["description"]))))

    return F.struct(by_symbol(True).alias("known"), by_symbol(False).alias("unknown"))


class Workflow:
    """A linear chain of named stages.

    A row stops at the first stage that fails: later stages see null for its prompt columns, aren't counted as run, and
    its `annotated` is false. A stage with `keep_going` is recorded as failed but lets the row go on, as if it had
    given nothing.
    """

    def __init__(self) -> None:
        self.stages: list[tuple[str, Stage, bool]] = []

    def add(self, name: str, stage: Stage, keep_going: bool = False) -> Workflow:
        self.stages.append((name, stage, keep_going))
        return self

    def add_modules(self, stages: dict[str, Stage]) -> Workflow:
        for name, stage in stages.items():
            self.add(name, stage)
        return self

    def remove(self, name: str) -> Workflow:
        self.stages = [s for s in self.stages if s[0] != name]
        return self

    def clear(self) -> Workflow:
        self.stages = []
        return self

    def run(self, problems: DataFrame, key: str | None = None) -> DataFrame:
        """The rows with every stage's columns, `annotated` (no stage stopped it) and `trace`: of each stage that ran its
        name, place, status and error, and with a `key` column the row's key."""
        if not self.stages:
            raise ValueError("the workflow has no stages")
        traces, alive = [], F.lit(True)
        problems = problems.withColumn("_alive", alive)
        for k, (name, stage, keep_going) in enumerate(self.stages):
            before = problems.columns
            problems = stage(problems)
            made = [c for c in problems.columns if c not in before]
            error = F.col(f"{name}_error") if f"{name}_error" in problems.columns else F.lit(None).cast("string")
            ran = F.col(f"_ran_{k}")
            problems = problems.withColumn(f"_ran_{k}", F.col("_alive"))
            problems = problems.withColumns({c: F.when(F.col("_alive"), F.col(c)) for c in made})  # a stopped row gets nothing
            status = F.when(error.isNull(), "success").otherwise("failed")
            parts = [F.lit(name).alias("module_name"), F.lit(k).alias("module_index"), status.alias("status"), error.alias("error")]
            traces.append(F.when(ran, F.struct(*([F.col(key).alias("problem_id")] if key else []), *parts)))
            if not keep_going:
                problems = problems.withColumn("_alive", F.col("_alive") & error.isNull())
        listed = F.filter(F.array(*traces), lambda t: t.isNotNull())
        out = problems.withColumns({"trace": listed, "annotated": F.col("_alive")})
        return out.drop("_alive", *[f"_ran_{k}" for k in range(len(self.stages))])


def may_run() -> Column:
    """Whether a row is still going, for stages whose calls are dear: null prompts aren't sent."""
    return F.col("_alive")


def save_results(annotated: DataFrame, path: str, name: str = "workflow") -> None:
    """Sink: rows as JSON lines in {path}/results, counts by stage in {path}/{name}_status."""
    annotated.write.mode("overwrite").json(f"{path}/results")
    metrics(annotated).write.mode("overwrite").json(f"{path}/{name}_status")


def metrics(annotated: DataFrame) -> DataFrame:
    """Of each stage the runs, failures and share of successes in percent."""
    return (
        annotated.select(F.explode("trace").alias("t"))
        .groupBy("t.module_name")
        .agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("t.status") == "failed").alias("failed"))
        .withColumn("success_rate_percentage", F.coalesce(F.try_divide(100 * (F.col("runs") - F.col("failed")), F.col("runs")), F.lit(0.0)))
    )


def domain_workflow(model: str, question: str = "question") -> Workflow:
    prompt = F.concat(F.lit("Name the domains of this problem as JSON.\n"), F.col(question))
    label = lambda df: ask(df, prompt, lambda: create_client(model), "domain_reply").withColumn("domain_annotation", parse_domains(F.col("domain_reply")))
    return Workflow().add("domain_reply", label)


def theorem_workflow(model: str, question: str = "question") -> Workflow:
    prompt = F.concat(F.lit("Name the theorems that solve this problem as JSON.\n"), F.col(question))
    label = lambda df: ask(df, prompt, lambda: create_client(model), "theorem_reply").withColumn("theorems", parse_theorems(F.col("theorem_reply")))
    return Workflow().add("theorem_reply", label)


REVIEW = "is_relevant boolean, equations_correct boolean, conditions_valid boolean, relevance_feedback string, equations_feedback string, conditions_feedback string"


def review_theorems(theorems: Column, reviews: Column, missing: Column | None = None, at: Column | None = None) -> Column:
    """Theorems with their reviews (an array of REVIEW in the same order) and `theorem_index` from 1.

    What isn't relevant has neither right equations nor valid conditions; a review that is missing or null says no to
    all. `missing` are theorems that the reviewer adds: all true, numbered after the others. `at` is the time of the
    review. A null list counts as empty.
    """
    none = F.from_json(F.lit("[]"), THEOREM_REPLY[len("theorems ") :])
    said = lambda r, c: F.coalesce(r[c], F.lit(False))
    time = F.lit(None).cast("timestamp") if at is None else at

    def reviewed(t: Column, k: Column) -> Column:
        r = F.get(reviews, k)
        relevant = said(r, "is_relevant")
        return F.struct(
            t["name"].alias("name"), t["description"].alias("description"), t["equations"].alias("equations"), t["domain"].alias("domain"), t["conditions"].alias("conditions"),
            relevant.alias("is_relevant"), (relevant & said(r, "equations_correct")).alias("equations_correct"), (relevant & said(r, "conditions_valid")).alias("conditions_valid"),
            *[F.coalesce(r[c], F.lit("")).alias(c) for c in ("relevance_feedback", "equations_feedback", "conditions_feedback")],
            time.alias("review_timestamp"), (k + 1).cast("int").alias("theorem_index"), F.lit(False).alias("added"),
        )

    def added(t: Column, k: Column) -> Column:
        yes, empty = F.lit(True), F.lit("")
        return F.struct(
            t["name"].alias("name"), t["description"].alias("description"), t["equations"].alias("equations"), t["domain"].alias("domain"), t["conditions"].alias("conditions"),
            yes.alias("is_relevant"), yes.alias("equations_correct"), yes.alias("conditions_valid"),
            empty.alias("relevance_feedback"), empty.alias("equations_feedback"), empty.alias("conditions_feedback"),
            time.alias("review_timestamp"), (F.size(F.coalesce(theorems, none)) + k + 1).cast("int").alias("theorem_index"), yes.alias("added"),
        )

    own = F.transform(F.coalesce(theorems, none), reviewed)
    return own if missing is None else F.concat(own, F.transform(F.coalesce(missing, none), added))


def theorem_counters(df: DataFrame, theorems: str = "theorems", error: str | None = None) -> DataFrame:
    """One row: problems, failed, theorems, with and without any, average of a problem (0 without problems)."""
    n = F.greatest(F.size(F.coalesce(theorems, F.array())), F.lit(0)).cast("long")
    failed = F.col(error).isNotNull() if error else F.lit(False)
    return df.select(n.alias("n"), failed.alias("failed")).agg(
        F.count(F.lit(1)).alias("problems"), F.count_if("failed").alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("theorems"),
        F.count_if(F.col("n") > 0).alias("with_theorems"), F.count_if(F.col("n") == 0).alias("without_theorems"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("average"),
    )


def domain_counters(df: DataFrame, annotation: str = "domain_annotation") -> DataFrame:
    """One row: problems, domains given, problems with several, mean, least and greatest confidence."""
    n = F.greatest(F.size(F.col(annotation)["domains"]), F.lit(0)).cast("long")
    return df.select(n.alias("n"), F.col(annotation)["confidence"].alias("sure")).agg(
        F.count(F.lit(1)).alias("problems"), F.coalesce(F.sum("n"), F.lit(0)).alias("domains"), F.count_if(F.col("n") > 1).alias("several_domains"),
        F.avg("sure").alias("confidence"), F.min("sure").alias("least"), F.max("sure").alias("greatest"),
    )


def review_counters(df: DataFrame, reviewed: str = "reviewed") -> DataFrame:
    """One row: theorems reviewed, relevant, with right equations, with valid conditions, added by reviewers, and the
    average number reviewed of a problem."""
    own = lambda test: F.size(F.filter(F.coalesce(reviewed, F.array()), test)).cast("long")
    counts = {
        "reviewed_theorems": lambda t: ~t["added"], "relevant_theorems": lambda t: ~t["added"] & t["is_relevant"], "correct_equations": lambda t: ~t["added"] & t["equations_correct"],
        "valid_conditions": lambda t: ~t["added"] & t["conditions_valid"], "missing_theorems": lambda t: t["added"],
    }
    each = df.select(*[own(test).alias(name) for name, test in counts.items()])
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], F.coalesce(F.avg("reviewed_theorems"), F.lit(0.0)).alias("average"))


def performance(df: DataFrame, seconds: str, status: str) -> DataFrame:
    """One row of a trace table: problems a minute, mean seconds and percent of successes; 0 where nothing ran."""
    total, good = F.sum(seconds), F.count_if(F.col(status) == "success")
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return df.agg(
        rate(60.0 * F.count(F.lit(1)), total).alias("problems_per_minute"), F.coalesce(F.avg(seconds), F.lit(0.0)).alias("average_module_execution_time"),
        rate(100.0 * good, F.count(F.lit(1))).alias("success_rate_percentage"),
    )


# Solutions: problem_id, agent_answer, intermediate_steps (array of STEP) and metadata (map).
STEP = "struct<step_name:string,step_content:string,step_type:string,tool_usage:map<string,string>>"


def solutions(problems: DataFrame, answers: DataFrame, key: str = "problem_id") -> DataFrame:
    """Answers with their problem's columns in `problem`; steps and metadata are never null. Answers without a problem
    are left out (see orphans)."""
    own = problems.select(key, F.struct(*problems.columns).alias("problem"))
    none, empty = F.from_json(F.lit("[]"), f"array<{STEP}>"), F.create_map().cast("map<string,string>")
    filled = {"intermediate_steps": (none, f"array<{STEP}>"), "metadata": (empty, "map<string,string>")}
    for name, (default, kind) in filled.items():
        answers = answers.withColumn(name, F.coalesce(F.col(name).cast(kind), default) if name in answers.columns else default)
    return answers.join(own, key)


def orphans(problems: DataFrame, answers: DataFrame, key: str = "problem_id") -> DataFrame:
    """Answers whose problem isn't there."""
    return answers.join(problems.select(key), key, "left_anti")


def add_step(steps: Column, name: Column, content: Column, kind: Column | None = None) -> Column:
    tools = F.create_map().cast("map<string,string>")
    made = F.struct(name.alias("step_name"), content.alias("step_content"), (F.lit("reasoning") if kind is None else kind).alias("step_type"), tools.alias("tool_usage"))
    return F.array_append(steps, made.cast(STEP))


def step(steps: Column, name: str) -> Column:
    """The first step of the name; null if there is none."""
    return F.get(F.filter(steps, lambda s: s["step_name"] == name), F.lit(0))


def step_names(steps: Column) -> Column:
    return F.transform(steps, lambda s: s["step_name"])


def metadata(values: Column, key: str, default: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(key)), F.lit(default).cast("string"))


def add_metadata(values: Column, key: str, value: Column) -> Column:
    rest = F.map_filter(values, lambda k, v: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), value.cast("string")))


def is_latex_answer(answer: Column) -> Column:
    """Between dollars."""
    return F.trim(answer).rlike(r"(?s)^\$.*\$$")


def solution_summary() -> dict[str, Column]:
    """Columns about a row of solutions()."""
    problem = F.col("problem")
    named = lambda c, default: F.when(F.coalesce(problem[c], F.lit("")) == "", default).otherwise(problem[c])
    return {
        "domain": named("domain", "Unknown"), "problem_type": named("problem_type", "Unknown"), "steps": F.size("intermediate_steps"),
        "latex": is_latex_answer(F.col("agent_answer")), "metadata_keys": F.array_sort(F.map_keys("metadata")),
    }


def closed_schema(schema: dict) -> dict:
    """A JSON schema in which no object takes further properties and all its own are required, at every depth."""
    out = {k: closed_schema(v) if isinstance(v, dict) else [closed_schema(x) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v for k, v in schema.items()}
    if schema.get("type") == "object" or "properties" in schema:
        out["additionalProperties"] = False
        out["required"] = list(schema.get("properties", {}))
    return out


def response_format(schema: dict | None, name: str = "reply") -> dict | None:
    """What providers take as a structured reply: a bare schema is named and closed, a named one is closed."""
    if schema is None:
        return None
    inner = schema.get("json_schema", schema)
    return {"type": "json_schema", "name": inner.get("name", name), "strict": True, "schema": closed_schema(inner.get("schema", inner))}
