"""Native text functions: languages, options, categories at load time, LaTeX spacing, data addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import answers
from .columns import strip

#: The order counts: the first name that is part of an unknown one, or has it as a part, is taken.
LANGUAGES = {
    "english": "en", "en": "en", "eng": "en", "en-us": "en", "en-gb": "en", "chinese": "zh", "zh": "zh", "zh-cn": "zh",
    "zh-tw": "zh", "zh-hans": "zh", "zh-hant": "zh", "mandarin": "zh", "cantonese": "zh", "spanish": "es", "es": "es",
    "esp": "es", "es-es": "es", "es-mx": "es", "french": "fr", "fr": "fr", "fra": "fr", "fr-fr": "fr", "german": "de",
    "de": "de", "deu": "de", "de-de": "de", "japanese": "ja", "ja": "ja", "jpn": "ja", "ja-jp": "ja", "korean": "ko",
    "ko": "ko", "kor": "ko", "ko-kr": "ko", "russian": "ru", "ru": "ru", "rus": "ru", "ru-ru": "ru", "arabic": "ar",
    "ar": "ar", "ara": "ar", "ar-sa": "ar", "portuguese": "pt", "pt": "pt", "por": "pt", "pt-pt": "pt", "pt-br": "pt",
    "italian": "it", "it": "it", "ita": "it", "it-it": "it", "dutch": "nl", "nl": "nl", "nld": "nl", "nl-nl": "nl",
    "hindi": "hi", "hi": "hi", "hin": "hi", "hi-in": "hi", "bengali": "bn", "bn": "bn", "ben": "bn", "bn-bd": "bn",
    "bn-in": "bn",
}


def normalise_language(name: Column) -> Column:
    """A code or name to a two-letter code: known names, then the first known name that holds this one or is held by
    it, then a known code as the first two letters, else en."""
    clean = F.lower(strip(F.coalesce(name, F.lit(""))))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    known = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("code")) for k, v in LANGUAGES.items()])
    partial = F.get(F.filter(known, lambda x: F.contains(clean, x["name"]) | F.contains(x["name"], clean)), F.lit(0))["code"]
    prefix = F.substring(clean, 1, 2)
    return F.coalesce(F.element_at(table, clean), partial, F.when(prefix.isin(*set(LANGUAGES.values())), prefix), F.lit("en"))


def extract_options(question: Column) -> Column:
    """'A: text' of each '(A) text' in a question, A to D or 1 to 4; if there is none, the lines that begin so."""
    pattern = r"(?s)\(([A-D1-4])\)\s*([^()]+?)(?=\([A-D1-4]\)|$)"
    letters = F.regexp_extract_all(question, F.lit(pattern), 1)
    texts = F.transform(F.regexp_extract_all(question, F.lit(pattern), 2), strip)
    found = F.filter(F.zip_with(letters, texts, lambda a, b: F.when(b != "", F.concat(a, F.lit(": "), b))), lambda x: x.isNotNull())
    lines = F.filter(F.transform(F.split(question, "\n"), strip), lambda x: x.rlike(r"^\([A-D1-4]\)"))
    return F.when(F.size(found) > 0, found).otherwise(lines)


_FLOAT = r"[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|(?i:inf(inity)?|nan))"


def is_pure_number(text: Column) -> Column:
    """A number with commas or blanks inside, or one fraction of two such; with an e or E, which exponents and `one`
    have, only a number by itself."""
    clean = F.translate(text, ", ", "")
    return clean.rlike(f"^{_FLOAT}$") | (~clean.rlike("[eE]") & clean.rlike(f"^{_FLOAT}/{_FLOAT}$"))


_MATHEMATICAL = r"[-+*/=^$\\√π∞±≤≥≠≈]|sqrt|[0-9]\s*[a-zA-Z]|[a-zA-Z]\s*[0-9]|[a-zA-Z]_[a-zA-Z0-9]|(?i)\b(sin|cos|tan|log|ln|exp)\s*\("


def is_mathematical(text: Column) -> Column:
    """A letter by itself, or any operator, mathematical sign, digit beside a letter, subscript, function call or LaTeX;
    a number alone isn't."""
    clean = strip(text)
    return clean.rlike(r"^\p{L}$") | (clean.rlike(_MATHEMATICAL) & ~is_pure_number(clean))


def unwrapped(text: Column) -> Column:
    """Without boxes and dollars around a part."""
    plain = F.regexp_replace(strip(text), r"\\boxed\{([^}]+)\}", "$1")
    return F.regexp_replace(F.regexp_replace(plain, r"\$\$(.*?)\$\$", "$1"), r"\$([^$]+)\$", "$1")


def detect_category(text: Column) -> Column:
    """The loaders' rule: number, formula or text; coarser than the evaluation's."""
    clean = unwrapped(text)
    return F.when(is_pure_number(clean), "number").when(is_mathematical(clean), "formula").otherwise("text")


def preprocess_latex(text: Column) -> Column:
    """As answers.preprocess_latex, native."""
    for command in answers.SPACINGS:
        text = F.replace(text, F.lit(command), F.lit(" "))
    for command, name in answers.PROTECTED:
        text = F.replace(text, F.lit(command), F.lit(f"\\mathrm{{{name}}}"))
    text = F.regexp_replace(text, r"\\(vec|hat)\{([^}]*)\}", "$2")
    for command in answers.DIFFERENTIALS:
        text = F.replace(text, F.lit(command), F.lit(" d "))
    return F.coalesce(strip(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def data_address(path: Column, content: Column) -> Column:
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    mime = F.when(kind.isin("png", "gif", "webp"), F.concat(F.lit("image/"), kind)).otherwise("image/jpeg")
    return F.when(path.rlike("^https?://"), path).otherwise(F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content)))
