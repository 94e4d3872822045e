"""Every domain and language name of the reference."""

from pyspark.sql import functions as F

from gradus.functions import columns as C
from gradus.functions import text as X
from gradus.operators import rows as R
from gradus.plans import annotation as A

DOMAINS = """solid_state_physics relativity quantum_mechanics classical_electromagnetism electrodynamics thermodynamics
 theoretical_mechanics atomic_physics statistical_mechanics geometrical_optics wave_optics semiconductor_physics
 classical_mechanics high_energy_theory cosmology fundamental_physics mechanics electricity optics modern_physics
 advanced_physics other""".split()
LANGUAGES = {
    "en": "english en eng en-us en-gb", "zh": "chinese zh zh-cn zh-tw zh-hans zh-hant mandarin cantonese", "es": "spanish es esp es-es es-mx",
    "fr": "french fr fra fr-fr", "de": "german de deu de-de", "ja": "japanese ja jpn ja-jp", "ko": "korean ko kor ko-kr",
    "ru": "russian ru rus ru-ru", "ar": "arabic ar ara ar-sa", "pt": "portuguese pt por pt-pt pt-br", "it": "italian it ita it-it",
    "nl": "dutch nl nld nl-nl", "hi": "hindi hi hin hi-in", "bn": "bengali bn ben bn-bd bn-in",
}


def test_domains(spark):
    rows = [(d, d) for d in DOMAINS] + [(d.upper().replace("_", " "), d) for d in DOMAINS] + [("acoustics", "other"), ("electromagnetism", "other"), ("Wave-Optics", "wave_optics")]
    df = spark.createDataFrame(rows, "domain string, want string")
    assert len(DOMAINS) == 22 and df.where(C.normalise_domain(F.col("domain")) != F.col("want")).count() == 0
    assert R.filter_by_domains(df, ["mechanics"]).count() == 2
    reply = F.lit('{"domains": ["Mechanics", "Cosmology", "cooking"]}')
    assert spark.range(1).select(A.parse_domains(reply)["domains"].alias("d")).first().d == ["mechanics", "cosmology", "other"]


def test_languages(spark):
    pairs = [(name, code) for code, names in LANGUAGES.items() for name in names.split()]
    partial = [("chinese_simplified", "zh"), ("simplified mandarin", "zh"), ("portug", "pt"), ("dutch (nl)", "nl"), ("klingon", "en"), ("", "en"), (None, "en"), ("\tBengali\n", "bn"), ("swahili", "hi"), ("nederlands", "de")]
    rows = pairs + [(f" {n.upper()}", c) for n, c in pairs] + partial
    df = spark.createDataFrame(rows, "name string, want string")
    found = [(r.name, r.got, r.want) for r in df.select("name", "want", X.normalise_language(F.col("name")).alias("got")).collect()]
    assert len(pairs) == 64 and [x for x in found if x[1] != x[2]] == []
