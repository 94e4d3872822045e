"""Queries over small tables of examples: what an operator gives for each is written out beside it, in the query's SQL
too, so that a wrong list or rule shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..functions import typed as Y

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]" + "::VARCHAR[]" * (not value)
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def golden(name: str, given: str, result: str, rows: list[tuple], make: Callable[..., Column]) -> None:
    """`given` and `result`: schemas of the inputs and of the one result; `rows`: inputs, then what is expected."""
    names = [x.split()[0] for x in given.split(", ")]
    out = result.split()[0]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(k, *r[:-1]) for k, r in enumerate(rows)], f"nth int, {given}")
        return df.select("nth", make(*map(F.col, names)).alias(out))

    values = ", ".join(f"({k}, {_literal(r[-1])})" for k, r in enumerate(rows))
    QUERIES[name] = query
    ORACLE_SQL[name] = f"SELECT CAST(nth AS INT) AS nth, {out} FROM (VALUES {values}) v(nth, {out})"


_PAIR, _SAME = "p string, g string", "same boolean"
golden("golden_smart", _PAIR, _SAME, [
    ("9.86", "9.9", True), ("9.8", "10", True), ("10", "9.8", False), ("0.0", "0.001", False), ("9.8", "9.8 m/s^2", False),
    ("9.8 m/s^2", "9.8", True), ("The answer is 42", "42", True), ("42", "The answer is 42", False), ("x = 5", "5", True), ("v = 3 m", "3 m", True),
    ("inf", "inf", False), ("$x*y$", "$y*x$", True), ("$x*y$", "$x+y$", False), ("5 m", "5.0 m", True), ("3 kg", "3 m", False),
    ("4 apples", "42", False), ("42", "4 apples", False), (" a b ", "a b", True), (None, "1", False), ("B", "b", False), ("", "", True),
], lambda p, g: Y.smart(Y.raw(p), Y.raw(g)))
golden("golden_category", _PAIR, _SAME, [
    ("9.86", "9.9", True), ("500/11", "45.4545454545", True), ("9.8 m/s^2", "9.8", False), ("-10^4 A/s", "-10000 A/s", True),
    ("10**2 m", "100 m", True), ("The answer is 42", "42", False), ("$\\frac{a}{b}$", "$a/b$", True), ("x = 5", "5", False), ("text", " text", True), ("1/0", "1/0", True),
], lambda p, g: Y.category(Y.raw(p), Y.raw(g)))
golden("golden_normalized", _PAIR, _SAME, [
    ("1,000.5", "1000.5", True), ("9.86", "9.9", False), ("inf", "inf", False), ("-10^4 A/s", "-10000 A/s", True), ("\\frac{ 2 }{ 3 }", "2/3", False),
    ("$\\frac{2}{3}$", "2/3", True), ("from $B$ to $A$", "from B to A", True), ("5 m s", "5 ms", True), ("yes", "Yes", False), ("$42$", "42.0", True),
], lambda p, g: Y.normalised(Y.raw(p), Y.raw(g)))
_TYPED = "p string, a string, g string, b string"


def _typed(compare: Callable) -> Callable:
    side = lambda value, kind: Y.raw(value).withField("category", kind)
    return lambda p, a, g, b: compare(side(p, a), side(g, b))


golden("golden_typed_category", _TYPED, _SAME, [
    ("42.0", "number", "42", "number", True), ("42.0", "number", "42", None, True), ("b", "option", "B", "option", False), ("B", "option", "B", "option", True),
    ("42", "physical_quantity", "42 m", None, False), ("42", "physical_quantity", "42", "physical_quantity", True), ("x*y", "formula", "y*x", "formula", True),
    ("a = b", "equation", "b = a", "equation", False), (" t", "text", "t", None, True), ("42", "text", "42", "number", True), ("42", "text", "42.0", "number", False),
], _typed(Y.category))
golden("golden_typed_normalized", _TYPED, _SAME, [
    ("b", "option", " B", "option", True), ("b", "option", "B", None, False), ("42.0", "text", "42", "number", True), ("42", "option", "42.0", "number", True),
], _typed(Y.normalised))
golden("golden_typed_smart", _TYPED, _SAME, [
    ("42.0", "number", "42", "number", True), ("42", None, "42.0", "number", True), ("42 m", None, "42.0", "number", True), ("B", "option", "B", "option", True),
    ("B", None, "B", "option", False), ("42", "number", "x", "formula", False), ("42.0", "number", "42 m", None, False),
], _typed(Y.smart))
golden("golden_typed_smart_strict", _TYPED, _SAME, [
    ("42.0", "number", "42", "number", False), ("42", None, "42.0", "number", False), ("42", "number", "42", "number", True),
], _typed(lambda p, g: Y.smart(p, g, strict=True)))
golden("golden_latex", "latex string", "clean string", [
    ("\\hbar\\omega", "\\mathrm{hbar}\\omega"), ("\\mu_0 I", "\\mathrm{mu0} I"), ("\\epsilon_0", "\\mathrm{eps0}"), ("a\\,b\\;c\\quad d", "a b c d"),
    ("\\vec{v} + \\hat{u}", "v + u"), ("\\int x \\mathrm{d}x", "\\int x d x"), ("\\text{d}t", "d t"), ("\\ell  \\square", "\\mathrm{ell} \\mathrm{dalembert}"),
    ("5\\degree", "5\\mathrm{deg}"), ("\\alpha", "\\alpha"), ("", ""), (None, ""), ("x\\qquad y", "x y"), ("\\vec{\\hat{a}}", "\\hat{a}"),
], X.preprocess_latex)
golden("golden_domains", "name string", "domain string", [
    *[(d, d) for d in (
        "advanced_physics", "atomic_physics", "classical_electromagnetism", "classical_mechanics", "cosmology", "electricity", "electrodynamics", "fundamental_physics",
        "geometrical_optics", "high_energy_theory", "mechanics", "modern_physics", "optics", "other", "quantum_mechanics", "relativity", "semiconductor_physics",
        "solid_state_physics", "statistical_mechanics", "theoretical_mechanics", "thermodynamics", "wave_optics",
    )],
    ("Quantum Mechanics", "quantum_mechanics"), ("Solid-State Physics", "solid_state_physics"), ("OPTICS", "optics"), ("optic", "other"), ("", "other"), (None, "other"),
], C.normalise_domain)
golden("golden_languages", "name string", "language string", [
    ("English", "en"), (" German ", "de"), ("zh-Hans", "zh"), ("mandarin", "zh"), ("simplified chinese", "zh"), ("bengali", "bn"), ("vietnamese", "es"), ("pt-BR", "pt"),
    ("polish", "en"), ("turkish", "en"), ("klingon", "en"), ("jpn", "ja"), ("hin", "hi"), ("Nederlands (nl-nl)", "de"), ("dutch", "nl"), ("", "en"), (None, "en"),
], X.normalise_language)
golden("golden_detect_category", "value string", "category string", [
    ("42", "number"), ("$1{,}000$", "text"), ("1,000", "number"), ("\\boxed{3/4}", "number"), ("1e5", "number"), ("three", "text"), ("2x", "formula"), ("x", "formula"),
    ("9.8 m/s^2", "formula"), ("a-b", "formula"), ("well known", "text"), ("$F = ma$", "formula"), ("x_i", "formula"), ("1/0", "number"), ("π", "formula"), ("", "text"),
], X.detect_category)
golden("golden_options", "question string", "options array<string>", [
    ("Which? (A) one (B) two", ["A: one", "B: two"]), ("(1) first\nline (2) second", ["1: first\nline", "2: second"]), ("no options", []),
    ("read\n(A) (x)\n (B) (y)\nend", ["(A) (x)", "(B) (y)"]),
], X.extract_options)
golden("golden_answers", "value string", "kind string", [
    ("42", "number 42"), ("500/11", "number 45.45454545454545"), ("1,000.5", "number 1000.5"), ("1/0", "physical_quantity 1/0"), ("1/0 m", "physical_quantity 1/0 m"), ("2**(1+1) m", "physical_quantity 4 m"), ("-10^4 A/s", "physical_quantity -10000 A/s"),
    ("10**2 m", "physical_quantity 100 m"), ("from $B$ to $A$", "text from B to A"), ("F = ma", "text F = ma"), ("$a=0, b=1$", "formula a=0, b=1"), ("$F = ma$", "equation F = ma"),
    ("3 apples", "physical_quantity 3 apples"), ("$2x$", "physical_quantity 2 x"), ("5 %", "text 5 %"), ("+5 m", "text +5 m"), ("\\boxed{7}", "number 7"), (None, "text "),
], lambda v: F.concat_ws(" ", C.normalise_answer(v)["category"], C.normalise_answer(v)["value"]))
