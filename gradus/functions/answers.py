"""Meaning of free-form answers: what kind an answer is, its canonical form, and when two answers agree.

Plain Python over single strings, used through Arrow-batched UDFs (see columns.py); the frequent cases, plain numbers
and quantities, also have native Column forms there.
"""

from __future__ import annotations

import ast
import math
import random
import re
from collections.abc import Callable

NUMBER, EQUATION, QUANTITY, FORMULA, TEXT, OPTION = "number", "equation", "physical_quantity", "formula", "text", "option"
_DELIMITERS = [re.compile(p, re.S) for p in (r"\$\$(.*?)\$\$", r"\$(.*?)\$", r"\\\[(.*?)\\\]", r"\\\((.*?)\\\)")]
_WRAPPERS = ("\\boxed{", "\\text{", "\\mathrm{")
_LATEX_START = re.compile(r"\s*(?:\$|\\\[|\\\(|\\boxed\{|\\frac\{|\\text\{|\\mathrm\{)")
_FRACTION = re.compile(r"\\frac\{(-?[\d.]+)\}\{(-?[\d.]+)\}")
_NUMBER_THEN_UNIT = re.compile(r"\s*-?\d+(?:\.\d+)?(?:\s*(?:\*\*|\^)\s*(?:\{[^}]*\}|\([^)]*\)|-?\d+))?\s*[A-Za-z/]")
_QUANTITY = re.compile(r"(?P<base>-?\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?)(?:\*\*(?P<power>[-+*()\d]+)|\^(?P<raised>-?\d+))?(?P<unit>.*)", re.S)


def _float(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def parse_number(text: str) -> float | None:
    """A number with commas or blanks inside, or one fraction; None if it is neither."""
    text = text.replace(" ", "").replace(",", "")
    if text.count("/") == 1:
        top, bottom = map(_float, text.split("/"))
        if top is not None and bottom is not None:
            return top / bottom if bottom else None
    return _float(text)


def format_number(value: float) -> str:
    return str(int(value)) if math.isfinite(value) and value == int(value) else str(value)


def closing(text: str, at: int) -> int:
    """Where the brace that opens at `at` is closed, or -1."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return i
    return -1


def extract_math(text: str) -> tuple[str, bool]:
    """The text without math delimiters and wrappers, and whether it had any."""
    found = False
    for _ in range(20):
        before = text
        for pattern in _DELIMITERS:
            text = pattern.sub(lambda m: m[1].strip(), text)
            if text != before:
                break
        if text == before:
            at, name = max((text.rfind(w), w) for w in _WRAPPERS)
            end = closing(text, at + len(name) - 1) if at >= 0 else -1
            if end >= 0:
                text = text[:at] + text[at + len(name) : end] + text[end + 1 :]
        if text == before:
            break
        found = True
    return re.sub(r"\\[;,:!]", "", text).strip(), found


def normalise_number(text: str) -> float:
    """NaN if the text isn't a number."""
    clean, _ = extract_math(text)
    if m := _FRACTION.fullmatch(clean):
        clean = f"{m[1]}/{m[2]}"
    value = parse_number(clean)
    return math.nan if value is None else value


def _exponent(text: str) -> int | None:
    """A small integer or a sum or product of such; nothing is evaluated as code."""
    text = text.strip("{}() ")
    try:
        tree = ast.parse(text, mode="eval").body
    except (SyntaxError, ValueError):
        return None

    def value(node: ast.expr) -> int:
        if isinstance(node, ast.Constant) and isinstance(node.value, int):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -value(node.operand) if isinstance(node.op, ast.USub) else value(node.operand)
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult)):
            a, b = value(node.left), value(node.right)
            return a + b if isinstance(node.op, ast.Add) else a - b if isinstance(node.op, ast.Sub) else a * b
        raise ValueError

    try:
        found = value(tree)
    except ValueError:
        return None
    return found if abs(found) <= 400 else None


def normalise_quantity(text: str) -> str:
    """'number unit' with the number worked out and the unit without blanks; what can't be worked out is given back
    with its blanks collapsed."""
    text = re.sub(r"\\(?:mathrm|text)\{([^{}]*)\}", r"\1", text).replace("~", " ").replace("\\cdot", " ")
    text = re.sub(r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", lambda m: f"{m[1].strip()}/{m[2].strip()}", text)
    text = re.sub(r"\^\{([^{}]+)\}", r"^\1", text)
    as_it_is = re.sub(r"\s+", " ", text).strip()
    m = _QUANTITY.fullmatch(re.sub(r"\s+", "", text))
    base = parse_number(m["base"]) if m else None
    if base is None:
        return as_it_is
    power = _exponent(m["power"] or m["raised"] or "")
    try:
        value = base if power is None else math.copysign(abs(base) ** power, base)
    except (OverflowError, ZeroDivisionError):
        return as_it_is
    return f"{format_number(value)} {m['unit']}".strip()


def classify(text: str) -> str:
    """equation with exactly one '=', a number with a letter or '/' behind it is a quantity, all else a formula."""
    if text.count("=") == 1:
        return EQUATION
    return QUANTITY if _NUMBER_THEN_UNIT.match(text) else FORMULA


def normalise_answer(text: str | None) -> tuple[str, str]:
    """(category, canonical text) of a raw answer; a null counts as empty."""
    text = text or ""
    number = normalise_number(text)
    if not math.isnan(number):
        return NUMBER, format_number(number)
    clean, had = extract_math(text)
    if not _LATEX_START.match(text):
        return (QUANTITY, normalise_quantity(clean)) if classify(clean) == QUANTITY else (TEXT, clean.strip())
    kind = classify(clean)
    if kind == QUANTITY:
        return QUANTITY, normalise_quantity(clean)
    return kind, re.sub(r"\s+", " ", preprocess_latex(clean) if had else clean).strip()


#: Commands that a LaTeX reader would stumble over, and the names that stand for them; the order counts.
PROTECTED = (
    ("\\hbar", "hbar"), ("\\mu_0", "mu0"), ("\\epsilon_0", "eps0"), ("\\ell", "ell"), ("\\square", "dalembert"),
    ("\\angstrom", "angstrom"), ("\\degree", "deg"),
)
SPACINGS = ("\\,", "\\:", "\\;", "\\!", "\\quad", "\\qquad")
DIFFERENTIALS = ("\\mathrm{d}", "\\text{d}")


def preprocess_latex(text: str | None) -> str:
    """Spacing commands become blanks, protected symbols upright names, accents go, upright d's stand alone, and blanks
    are collapsed. A null gives an empty text."""
    text = text or ""
    for command in SPACINGS:
        text = text.replace(command, " ")
    for command, name in PROTECTED:
        text = text.replace(command, f"\\mathrm{{{name}}}")
    text = re.sub(r"\\(?:vec|hat)\{([^}]*)\}", r"\1", text)
    for command in DIFFERENTIALS:
        text = text.replace(command, " d ")
    return re.sub(r"\s+", " ", text).strip()


def decimal_places(x: float) -> int:
    """Decimals in 15 significant digits; none for 0, infinities and NaN."""
    if not math.isfinite(x) or x == 0:
        return 0
    text = f"{x:.15g}"
    if "e" in text:
        text = f"{x:.15f}"
    return len(text.rstrip("0").partition(".")[2]) if "." in text else 0


def same_number(p: float | None, g: float | None, eps: float = 1e-10) -> bool:
    """The ground truth's precision wins: a finer prediction is rounded to it."""
    if p is None or g is None or math.isnan(p) or math.isnan(g):
        return False
    n = decimal_places(g)
    if decimal_places(p) > n:
        p = round(p, n)
    return abs(p - g) < eps


def parse_quantity(text: str) -> tuple[float | None, str]:
    head, _, rest = text.strip().partition(" ")
    value = parse_number(head) if head else None
    return (value, rest.strip()) if value is not None else (None, text)


def same_quantity(p: str, g: str) -> bool:
    (a, u), (b, v) = parse_quantity(p), parse_quantity(g)
    if a is not None and b is not None and u == v:
        return same_number(a, b)
    return p == g


_FUNCTIONS = {n: getattr(math, n) for n in ("sin", "cos", "tan", "exp", "sqrt", "log", "sinh", "cosh", "tanh")} | {"ln": math.log}


def _python(formula: str) -> str:
    text = formula.replace("\\left", "").replace("\\right", "").replace("\\cdot", "*").replace("\\times", "*")
    while (new := re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", text)) != text:
        text = new
    text = re.sub(r"\\sqrt\{([^{}]*)\}", r"sqrt(\1)", text).replace("{", "(").replace("}", ")").replace("\\", " ")
    text = text.replace("^", "**")
    return re.sub(r"(?<=[0-9)])\s*(?=[A-Za-z(])|(?<=[A-Za-z0-9)])\s+(?=[A-Za-z0-9(])", "*", text)


def _value(node: ast.expr, at: dict[str, float]) -> float:
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return float(node.value)
    if isinstance(node, ast.Name):
        return math.pi if node.id == "pi" else at[node.id]
    if isinstance(node, ast.UnaryOp):
        x = _value(node.operand, at)
        return -x if isinstance(node.op, ast.USub) else x
    if isinstance(node, ast.BinOp):
        a, b = _value(node.left, at), _value(node.right, at)
        kind = type(node.op)
        if kind in (ast.Add, ast.Sub, ast.Mult, ast.Div):
            return {ast.Add: a + b, ast.Sub: a - b, ast.Mult: a * b, ast.Div: a / b if b else math.nan}[kind]
        if kind is ast.Pow and abs(b) <= 64:
            return a**b
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and len(node.args) == 1:
        return _FUNCTIONS[node.func.id](_value(node.args[0], at))
    raise ValueError("not a formula")


def same_formula(p: str, g: str) -> bool:
    """Equal at twelve random points, if both can be read as formulas; else equal as strings."""
    if p == g:
        return True
    try:
        trees = [ast.parse(_python(x).strip(), mode="eval").body for x in (p, g)]
        names = sorted({n.id for t in trees for n in ast.walk(t) if isinstance(n, ast.Name)} - set(_FUNCTIONS) - {"pi"})
        rng, seen = random.Random(p + "=" + g), 0
        for _ in range(12):
            at = {n: rng.uniform(0.3, 2.1) for n in names}
            a, b = (_value(t, at) for t in trees)
            if isinstance(a, complex) or isinstance(b, complex) or math.isnan(a) or math.isnan(b):
                continue
            seen += 1
            if abs(a - b) > 1e-9 * max(1.0, abs(a), abs(b)):
                return False
        return seen > 0
    except (SyntaxError, ValueError, KeyError, TypeError, ArithmeticError, RecursionError, MemoryError):
        return False


def compare_exact(p: str | None, g: str | None) -> bool:
    return (p or "").strip() == (g or "").strip()


def compare_normalised(p: str | None, g: str | None, p_kind: str | None = None, g_kind: str | None = None) -> bool:
    """Same category and canonical form; numbers within 1e-10, without rounding. Options, if both are typed so, in any
    case; the category of other typed answers doesn't count."""
    if p_kind == g_kind == OPTION:
        return (p or "").strip().upper() == (g or "").strip().upper()
    (a, x), (b, y) = normalise_answer(p), normalise_answer(g)
    if a != b:
        return compare_exact(p, g)
    if a == NUMBER:
        return abs(float(x) - float(y)) < 1e-10  # never of infinities, whose difference is NaN
    return x == y


Rules = dict[str, Callable[[str, str], bool]]


def _same(kind: str, p: str, g: str, rules: Rules | None = None) -> bool:
    if rules and kind in rules:
        return rules[kind](p, g)
    if kind == NUMBER:
        return same_number(parse_number(p), parse_number(g))
    if kind == QUANTITY:
        return same_quantity(p, g)
    if kind == FORMULA:
        return same_formula(p, g)
    return p.strip() == g.strip() if kind == TEXT else p == g


def _side(text: str | None, category: str | None) -> tuple[str, str]:
    """Category and text of one side: a typed answer keeps its own, raw text is read."""
    return normalise_answer(text) if category is None else (category, text or "")


def compare_category(p: str | None, g: str | None, p_kind: str | None = None, g_kind: str | None = None, rules: Rules | None = None) -> bool:
    """By the rule of the category both share; of different categories as raw text. `p_kind` and `g_kind` are given
    for typed answers. `rules` replace or add rules by category; one that isn't known compares as plain text."""
    (a, x), (b, y) = _side(p, p_kind), _side(g, g_kind)
    return _same(a, x, y, rules) if a == b else compare_exact(p, g)


def compare_smart(p: str | None, g: str | None, p_kind: str | None = None, g_kind: str | None = None, strict: bool = False) -> bool:
    """As compare_category, with the right-hand sides of equations and rules across categories.

    A number given as a typed answer is read as a number; `strict` compares it as its text instead.
    """
    (a, x), (b, y) = _side(p, p_kind), _side(g, g_kind)
    if a != b:
        if a == EQUATION or x.count("=") == 1:
            a, x = normalise_answer(x.partition("=")[2].strip() if "=" in x else x)
        if b == EQUATION:
            b, y = normalise_answer(y.partition("=")[2].strip() if "=" in y else y)
    if a == b:
        if strict and a == NUMBER and NUMBER in (p_kind, g_kind):
            return x == y
        return x == y if a in (TEXT, EQUATION) else _same(a, x, y)
    if b == NUMBER:
        value = _float(y)
        if a == QUANTITY:
            return not (strict and g_kind) and same_number(parse_quantity(x)[0], value)
        if a == TEXT and value is not None:
            whole = math.isfinite(value) and value == int(value)
            return (y if g_kind else str(value)) in x or (whole and str(int(value)) in x)
        return False
    if b == TEXT and a == QUANTITY:
        value, unit = parse_quantity(x)
        return value is not None and str(value) in y and unit in y
    return b == TEXT and a == FORMULA and x in y
