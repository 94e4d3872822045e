"""Typed answers: a struct of value, category, unit and metadata, its predicates, and comparators that know the type.

A side of a comparison is either raw text or a typed answer: `category` is null for raw text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import answers
from .answers import EQUATION, FORMULA, NUMBER, OPTION, QUANTITY, TEXT
from .columns import strip, word_count
from .text import detect_category, unwrapped

CATEGORIES = (NUMBER, EQUATION, QUANTITY, FORMULA, TEXT, OPTION)
ANSWER = "struct<value:string,category:string,unit:string,metadata:map<string,string>>"


def answer(value: Column, category: Column | str | None = None, unit: Column | None = None, metadata: Column | None = None) -> Column:
    """A typed answer; without a category the loaders' rule decides, a null value gives a null answer. Unknown
    categories are text. Metadata is never null."""
    kind = detect_category(value) if category is None else F.lit(category) if isinstance(category, str) else category
    kind = F.when(kind.isin(*CATEGORIES), kind).otherwise(TEXT)
    none = F.create_map().cast("map<string,string>")
    made = F.struct(
        value.cast("string").alias("value"),
        kind.alias("category"),
        (F.lit(None) if unit is None else unit).cast("string").alias("unit"),
        (none if metadata is None else F.coalesce(metadata, none)).alias("metadata"),
    )
    return F.when(value.isNotNull(), made)


def raw(value: Column) -> Column:
    """Raw text as a side of a comparison."""
    return answer(value, TEXT).withField("category", F.lit(None).cast("string"))


def from_raw(value: Column, category: Column, problem_type: Column, unit: Column) -> Column:
    """The loaders' answer of a raw value: an option for multiple choice, else what the data set calls it, without
    boxes and dollars for numbers, and with a unit a quantity; what isn't called anything is detected."""
    number = F.when(F.coalesce(unit, F.lit("")) != "", QUANTITY).otherwise(NUMBER)
    kind = (
        F.when(F.contains(problem_type, F.lit("MC")), OPTION)
        .when(category.isin(NUMBER, QUANTITY), number)
        .when(category.isin(FORMULA, EQUATION), FORMULA)
        .when(category.isin(TEXT, OPTION), category)
        .otherwise(detect_category(value))
    )
    plain = F.when(kind.isin(NUMBER, QUANTITY), unwrapped(value)).otherwise(value)
    return answer(plain, kind, F.when(kind == QUANTITY, unit))


def is_valid(a: Column) -> Column:
    """A number has a number, every other category a text that isn't blank."""
    text = strip(F.coalesce(a["value"], F.lit(""))) != ""
    return F.when(a["category"] == NUMBER, number(a).isNotNull()).otherwise(text & a["category"].isin(*CATEGORIES))


def number(a: Column) -> Column:
    """The numeric value of a number or quantity; null where the value isn't one."""
    return F.when(is_numerical(a), a["value"].try_cast("double"))


def is_category(a: Column, category: str) -> Column:
    return a["category"] == category


def is_numerical(a: Column) -> Column:
    return a["category"].isin(NUMBER, QUANTITY)


def is_symbolic(a: Column) -> Column:
    """Quantities are both numerical and symbolic."""
    return a["category"].isin(EQUATION, FORMULA, QUANTITY)


def unit(a: Column) -> Column:
    return F.when(is_numerical(a), a["unit"])


def has_unit(a: Column) -> Column:
    return (a["category"] == QUANTITY) | ((a["category"] == NUMBER) & a["unit"].isNotNull())


def is_integer(a: Column) -> Column:
    return F.coalesce(number(a) == F.floor(number(a)), F.lit(False))


def is_positive(a: Column) -> Column:
    """False for what isn't numerical, null where a numerical value isn't a number."""
    return F.when(is_numerical(a), number(a) > 0).otherwise(False)


def is_negative(a: Column) -> Column:
    return F.when(is_numerical(a), number(a) < 0).otherwise(False)


def is_latex(a: Column) -> Column:
    return is_symbolic(a) & a["value"].rlike(r"[$\\]")


def clean_expression(a: Column) -> Column:
    """Without one pair of dollars, single or double, around a symbolic value."""
    text = strip(a["value"])
    double = F.regexp_extract(text, r"(?s)^\$\$(.*)\$\$$", 1)
    single = F.regexp_extract(text, r"(?s)^\$(.*)\$$", 1)
    inner = F.when(text.rlike(r"(?s)^\$\$.*\$\$$"), strip(double)).when(text.rlike(r"(?s)^\$.*\$$"), strip(single))
    return F.when(is_symbolic(a), F.coalesce(inner, text)).otherwise(a["value"])


def words(a: Column) -> Column:
    """0 for what isn't text, which makes that short."""
    return F.when(a["category"] == TEXT, word_count(a["value"])).otherwise(F.lit(0).cast("long"))


def chars(a: Column) -> Column:
    return F.when(a["category"] == TEXT, F.length(a["value"])).otherwise(0).cast("long")


def is_short(a: Column) -> Column:
    return words(a) < 10


def is_long(a: Column) -> Column:
    return words(a) > 50


def contains_keywords(a: Column, keywords: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in keywords:
        found = found | F.contains(F.lower(a["value"]), F.lit(word.lower()))
    return (a["category"] == TEXT) & found


def _option(a: Column, *values: str) -> Column:
    return (a["category"] == OPTION) & F.upper(a["value"]).isin(*values)


def is_letter_option(a: Column) -> Column:
    return _option(a, *"ABCDE")


def is_yes_no(a: Column) -> Column:
    return _option(a, "YES", "NO")


def is_true_false(a: Column) -> Column:
    return _option(a, "TRUE", "FALSE")


def is_numeric_option(a: Column) -> Column:
    return _option(a, *"12345")


def option_index(a: Column) -> Column:
    """From 0; null for other options and categories."""
    letter = F.ascii(F.upper(a["value"])) - F.when(is_letter_option(a), 65).otherwise(49)
    return F.when(is_letter_option(a) | is_numeric_option(a), letter).cast("long")


def text_of(a: Column) -> Column:
    """'value unit' for numbers and quantities with a unit, else the value."""
    with_unit = is_numerical(a) & (F.coalesce(a["unit"], F.lit("")) != "")
    return F.when(with_unit, F.concat_ws(" ", a["value"], a["unit"])).otherwise(a["value"])


def to_json(a: Column) -> Column:
    """Empty units and metadata are left out."""
    kept = a.withField("unit", F.when(a["unit"] != "", a["unit"])).withField("metadata", F.when(F.size(a["metadata"]) > 0, a["metadata"]))
    return F.to_json(kept.withField("answer_category", a["category"]).dropFields("category"))


def _compared(make: Callable, pred: Column, truth: Column) -> Column:
    def over(p: pd.Series, g: pd.Series, p_kind: pd.Series, g_kind: pd.Series) -> pd.Series:
        rows = list(zip(p, g, p_kind, g_kind, strict=True))
        found = {r: make(*r) for r in dict.fromkeys(rows)}  # each distinct pair once
        return pd.Series([found[r] for r in rows], dtype=bool)

    over.__annotations__ = dict.fromkeys(("p", "g", "p_kind", "g_kind", "return"), pd.Series)
    return F.pandas_udf(over, "boolean")(pred["value"], truth["value"], pred["category"], truth["category"])


def exact(pred: Column, truth: Column) -> Column:
    return strip(F.coalesce(pred["value"], F.lit(""))) == strip(F.coalesce(truth["value"], F.lit("")))


def normalised(pred: Column, truth: Column) -> Column:
    return _compared(answers.compare_normalised, pred, truth)


def category(pred: Column, truth: Column, rules: answers.Rules | None = None) -> Column:
    """`rules` replace or add the rule of a category."""
    return _compared(lambda p, g, a, b: answers.compare_category(p, g, a, b, rules), pred, truth)


def smart(pred: Column, truth: Column, strict: bool = False) -> Column:
    return _compared(lambda p, g, a, b: answers.compare_smart(p, g, a, b, strict), pred, truth)


Comparator = Callable[[Column, Column], Column]
COMPARATORS: dict[str, Comparator] = {"exact": exact, "normalised": normalised, "category": category, "smart": smart}


def can_compare(pred: Column, truth: Column) -> Column:
    """Every pair can be compared; comparators of one's own may say otherwise."""
    return F.lit(True)


def evaluated(pred: Column, truth: Column, comparator: str | Comparator = "exact") -> Column:
    """struct<accuracy_score, comparison_result, details> of one pair."""
    compare = COMPARATORS[comparator] if isinstance(comparator, str) else comparator
    name = comparator if isinstance(comparator, str) else getattr(comparator, "__name__", "custom")
    same = compare(pred, truth)
    kind = lambda a: F.coalesce(a["category"], F.lit("string"))
    details = F.struct(
        pred["value"].alias("predicted_value"), truth["value"].alias("ground_truth_value"), kind(pred).alias("predicted_type"),
        kind(truth).alias("ground_truth_type"), F.lit(name).alias("comparator_type"),
    )
    return F.struct(same.cast("double").alias("accuracy_score"), same.alias("comparison_result"), details.alias("details"))
