"""Column functions: native where Catalyst has the parts, Arrow-batched over distinct values elsewhere."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import answers

DOMAINS = (
    "solid_state_physics", "relativity", "quantum_mechanics", "classical_electromagnetism", "electrodynamics", "thermodynamics",
    "theoretical_mechanics", "atomic_physics", "statistical_mechanics", "geometrical_optics", "wave_optics", "semiconductor_physics",
    "classical_mechanics", "high_energy_theory", "cosmology", "fundamental_physics", "mechanics", "electricity", "optics",
    "modern_physics", "advanced_physics", "other",
)
_PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _by_value(make: Callable) -> Callable:
    """Work out each distinct value of a batch once."""

    def over(*columns: pd.Series) -> pd.Series:
        keys = list(zip(*columns, strict=True))
        found = {k: make(*[None if x is None or x != x else x for x in k]) for k in dict.fromkeys(keys)}
        return pd.Series([found[k] for k in keys])

    return over


def _frame_by_value(make: Callable) -> Callable:
    def over(column: pd.Series) -> pd.DataFrame:
        found = {k: make(k) for k in dict.fromkeys(column)}
        return pd.DataFrame([found[k] for k in column], columns=["category", "value"])

    return over


def _typed(f: Callable, **kinds: type) -> Callable:
    f.__annotations__ = kinds
    return f


def normalise_answer(text: Column) -> Column:
    """struct<category, value>."""
    over = _typed(_frame_by_value(answers.normalise_answer), column=pd.Series, **{"return": pd.DataFrame})
    return F.pandas_udf(over, "category string, value string")(text)


def _pair(make: Callable, pred: Column, truth: Column) -> Column:
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return _by_value(make)(a, b)

    over.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(over, "boolean")(pred, truth)


def compare_exact(pred: Column, truth: Column) -> Column:
    return strip(F.coalesce(pred, F.lit(""))) == strip(F.coalesce(truth, F.lit("")))


def compare_normalised(pred: Column, truth: Column) -> Column:
    return _pair(answers.compare_normalised, pred, truth)


def compare_category(pred: Column, truth: Column) -> Column:
    return _pair(answers.compare_category, pred, truth)


def compare_smart(pred: Column, truth: Column) -> Column:
    return _pair(answers.compare_smart, pred, truth)


def compare_formula(pred: Column, truth: Column) -> Column:
    return _pair(answers.same_formula, pred, truth)


def compare_number(pred: Column, truth: Column) -> Column:
    return _pair(answers.same_number, pred, truth)


def strip(text: Column) -> Column:
    """Remove white space, not only blanks, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_number(text: Column) -> Column:
    """Native: commas and blanks removed, at most one fraction; null if it isn't a number."""
    clean = F.translate(text, ", ", "")
    parts = F.split(clean, "/")
    one = lambda x: F.when(x.rlike(_PLAIN), x.cast("double"))
    fraction = F.try_divide(one(F.get(parts, F.lit(0))), one(F.get(parts, F.lit(1))))
    return F.when(F.size(parts) == 2, fraction).otherwise(one(clean))


def classify(text: Column) -> Column:
    """Native: equation, physical_quantity or formula."""
    quantity = text.rlike(r"^\s*-?\d+(\.\d+)?(\s*(\*\*|\^)\s*(\{[^}]*\}|\([^)]*\)|-?\d+))?\s*[A-Za-z/]")
    return (
        F.when(F.length(text) - F.length(F.replace(text, F.lit("="))) == 1, "equation")
        .when(quantity, "physical_quantity")
        .otherwise("formula")
    )


def normalise_domain(name: Column) -> Column:
    """Lower case, blanks and hyphens as underscores; what isn't known is 'other'."""
    clean = F.translate(F.lower(name), " -", "__")
    return F.when(clean.isin(*DOMAINS), clean).otherwise("other")


def word_count(text: Column) -> Column:
    clean = strip(F.coalesce(text, F.lit("")))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, r"\s+"))).cast("long")


def reason_answer(response: Column) -> Column:
    """struct<reason, answer, error> of a JSON reply; what it lacks is empty, an empty or broken reply is an error."""
    found = F.from_json(response, "reason string, answer string")
    kind = F.json_object_keys(response).isNotNull()
    error = F.when(strip(F.coalesce(response, F.lit(""))) == "", "empty response").when(~kind, "not a JSON object")
    part = lambda c: F.coalesce(found[c], F.lit("")).alias(c)
    return F.struct(part("reason"), part("answer"), error.alias("error"))


def answer_tag(response: Column) -> Column:
    """What the first answer tag holds, stripped; null without a tag."""
    pattern = r"(?is)<answer>\s*(.*?)\s*</answer>"
    return F.when(response.rlike(pattern), F.regexp_extract(response, pattern, 1))


def option_index(answer: Column) -> Column:
    letter = F.upper(strip(answer))
    return F.when(letter.rlike("^[A-E]$"), F.ascii(letter) - 65).cast("long")


def image_paths(value: Column) -> Column:
    """A list written as text, with single or double quotes, or one path; blanks are left out."""
    listed = F.from_json(F.translate(value, "'", '"'), "array<string>")
    paths = F.when(value.startswith("["), listed).otherwise(F.array(value))
    return F.filter(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.trim(p) != "")


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")
