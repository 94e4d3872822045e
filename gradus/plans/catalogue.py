"""The reference operators as queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..functions import typed as Y
from ..operators import dataset as P
from ..operators import evaluation as E
from ..operators import rows as R
from ..sources import downloads as D
from ..sources import hub as H
from ..sources import loaders as L
from . import annotation as A
from . import golden

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_ANSWERS = """lines AS (SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_quantity AS BIGINT) AS q,
 CAST(l_partkey % 7 AS BIGINT) AS r FROM lineitem)"""


@query("""SELECT coalesce(lang, 'Unknown') AS lang, avg(CASE WHEN quality IS NOT NULL THEN CAST(quality AS DOUBLE) END) AS accuracy,
 count(*) AS total, count(quality) AS evaluated FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def accuracy_by_domain(spark, d):
    return R.accuracy(_evaluated(spark, d), "lang")


def _evaluated(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "source")
    labels = _t(spark, d, "labels").select("doc_id", F.col("quality").alias("prediction"))
    return R.evaluate(docs, labels, F.col("prediction") == 1, key="doc_id")


@query("""SELECT coalesce(source, 'unknown') AS source, avg(CASE WHEN quality IS NOT NULL THEN CAST(quality AS DOUBLE) END) AS accuracy,
 count(*) AS total, count(quality) AS evaluated FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def accuracy_by_type(spark, d):
    return R.accuracy(_evaluated(spark, d), "source", "unknown")


@query("""SELECT coalesce(avg(CAST(quality AS DOUBLE)), 0) AS accuracy, count(*) AS total, count(quality) AS evaluated
 FROM documents LEFT JOIN labels USING (doc_id)""")
def evaluate_overall(spark, d):
    return R.accuracy(_evaluated(spark, d))


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'missing_prediction' ELSE 'success' END AS status,
 CAST(quality AS DOUBLE) AS score FROM documents LEFT JOIN labels USING (doc_id)""")
def evaluate_status(spark, d):
    return _evaluated(spark, d).select("doc_id", "status", "score")


@query("SELECT doc_id, lang FROM documents WHERE lower(lang) IN ('en', 'fr')")
def filter_by_domain(spark, d):
    return R.filter_by_values(_t(spark, d, "documents"), "lang", ["EN", "fr"]).select("doc_id", "lang")


@query("""SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, 'None')), 'license')
 OR contains(lower(coalesce(source, 'None')), 'license') OR contains(lower(coalesce(text, 'None')), 'the with')
 OR contains(lower(coalesce(source, 'None')), 'the with')""")
def filter_by_keywords(spark, d):
    docs = _t(spark, d, "documents")
    return R.filter_by_keywords(docs, ["License", "the with"], ["text", "source", "absent"]).select("doc_id")


@query("""SELECT doc_id, CAST(nth AS BIGINT) AS nth FROM (VALUES (0, 5), (1, 3), (2, 5), (3, 99999999), (4, -1)) v(nth, pos)
 JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) USING (pos)""")
def select_by_index(spark, d):
    docs = R.with_position(_t(spark, d, "documents").select("doc_id"), "doc_id")
    return R.select_positions(docs, [5, 3, 5, 99999999, -1]).select("doc_id", "nth")


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
 WHERE pos >= 10 AND pos < n - 5 AND (pos - 10) % 7 = 0""")
def slice_step(spark, d):
    docs = P.ProblemSet(_t(spark, d, "documents").select("doc_id"), order="doc_id")
    return docs[10:-5:7].df.select("doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents")
def row_positions(spark, d):
    return R.with_position(_t(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("""SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1""")
def lookup_first_duplicate(spark, d):
    return R.first_by_key(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", ["l_linenumber"])


@query("SELECT doc_id FROM documents ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def sample_exact_n(spark, d):
    return R.sample(_t(spark, d, "documents"), 50, "doc_id", 7).select("doc_id")


@query("""SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang
 ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) <= 20""")
def sample_balanced(spark, d):
    return R.sample_balanced(_t(spark, d, "documents"), 20, "lang", "doc_id", 7).select("doc_id", "lang")


@query("""SELECT doc_id, CAST(least((row_number() OVER (ORDER BY md5('0|' || CAST(doc_id AS VARCHAR)), doc_id) - 1)
 // greatest(1, count(*) OVER () // 5), 4) AS BIGINT) AS fold FROM documents""")
def cv_splits(spark, d):
    return R.cross_validation(_t(spark, d, "documents").select("doc_id"), 5, "doc_id")


@query("""SELECT 'total' AS kind, '' AS value, count(*) AS n FROM documents UNION ALL
 SELECT 'lang', lang, count(*) FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source""")
def dataset_statistics(spark, d):
    return R.statistics(_t(spark, d, "documents"), ["lang", "source"])


@query("""SELECT 'total' AS kind, '' AS value, count(*) AS n FROM labels UNION ALL SELECT 'field', f, (SELECT count(*) FROM labels)
 FROM (VALUES ('doc_id'), ('difficulty'), ('has_images')) v(f) UNION ALL SELECT 'difficulty_distribution', coalesce(CAST(quality AS VARCHAR), 'unknown'), count(*) FROM labels GROUP BY 2
 UNION ALL SELECT 'images', CASE WHEN toxic = 1 THEN 'with' ELSE 'without' END, count(*) FROM labels GROUP BY 2""")
def field_distribution(spark, d):
    labels = _t(spark, d, "labels").select("doc_id", F.col("quality").alias("difficulty"), (F.col("toxic") == 1).alias("has_images"))
    return P.field_statistics(labels, images="has_images")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return R.duplicates(_t(spark, d, "lineitem"), "l_orderkey")


@query("""SELECT id, dataset, pos FROM (SELECT doc_id AS id, 'documents' AS dataset, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents UNION ALL
 SELECT item_id, 'benchmark', row_number() OVER (ORDER BY item_id) - 1 + (SELECT count(*) FROM documents) FROM benchmark)""")
def union_datasets(spark, d):
    part = lambda name, key: P.ProblemSet(_t(spark, d, name).select(F.col(key).alias("id"), F.lit(name).alias("dataset")), order="id")
    return part("documents", "doc_id").extend(part("benchmark", "item_id")).df.select("id", "dataset", F.col("pos").cast("long").alias("pos"))


def _lines(spark, d):
    lines = _t(spark, d, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), (F.col("l_partkey") % 7).alias("r"))


@query(f"""WITH {_ANSWERS} SELECT l_orderkey, l_linenumber, CASE r WHEN 0 THEN NULL WHEN 1 THEN NULL
 WHEN 2 THEN 1000 + q ELSE CAST(q AS DOUBLE) / r END AS value FROM lines""")
def normalize_number(spark, d):
    text = F.expr("CASE r WHEN 0 THEN q || '/0' WHEN 1 THEN q || ' kg' WHEN 2 THEN '1,' || lpad(string(q), 3, '0') ELSE q || ' / ' || r END")
    return _lines(spark, d).select("l_orderkey", "l_linenumber", C.parse_number(text).alias("value"))


@query(f"""WITH {_ANSWERS} SELECT l_orderkey, l_linenumber, CASE WHEN r % 3 = 0 THEN 'physical_quantity' WHEN r % 3 = 1 THEN 'equation'
 ELSE 'formula' END AS category FROM lines""")
def classify_expression(spark, d):
    text = F.expr("CASE r % 3 WHEN 0 THEN q || ' kg' WHEN 1 THEN 'x = ' || q ELSE '(' || q || ')' END")
    return _lines(spark, d).select("l_orderkey", "l_linenumber", C.classify(text).alias("category"))


@query(f"""WITH {_ANSWERS} SELECT l_orderkey, l_linenumber,
 CASE r % 4 WHEN 0 THEN 'physical_quantity' WHEN 1 THEN 'physical_quantity' WHEN 2 THEN 'number' ELSE 'text' END AS category,
 CASE r % 4 WHEN 0 THEN q || ' m/s^2' WHEN 1 THEN '-' || CAST(q * q AS VARCHAR) || ' A/s' WHEN 2 THEN CAST(q AS VARCHAR)
  ELSE 'about ' || q END AS value FROM lines""")
def normalize_quantity(spark, d):
    text = F.expr("CASE r % 4 WHEN 0 THEN q || ' m / s^2' WHEN 1 THEN '-' || q || '^2 A/s' WHEN 2 THEN '$' || q || '.0$' ELSE ' about ' || q || ' ' END")
    found = _lines(spark, d).withColumn("found", C.normalise_answer(text))
    return found.select("l_orderkey", "l_linenumber", "found.category", "found.value")


def _compared(spark, d, compare):
    pairs = _lines(spark, d).selectExpr(
        "l_orderkey", "l_linenumber",
        "CASE r WHEN 0 THEN q || ' kg' WHEN 1 THEN ' text ' WHEN 2 THEN 'x = ' || q ELSE string(q) END AS p",
        "CASE r WHEN 0 THEN q || '.0 kg' WHEN 1 THEN 'text' WHEN 2 THEN string(q) WHEN 3 THEN q || '.0' WHEN 4 THEN q || ' m' WHEN 5 THEN 'It is ' || q ELSE string(q + 1) END AS g",
    )
    return pairs.select("l_orderkey", "l_linenumber", compare(F.col("p"), F.col("g")).alias("same"))


def _truth(*same: int) -> str:
    return f"WITH {_ANSWERS} SELECT l_orderkey, l_linenumber, r IN ({', '.join(map(str, same))}) AS same FROM lines"


@query(_truth(1))
def compare_exact(spark, d):
    return _compared(spark, d, C.compare_exact)


@query(_truth(0, 1, 3))
def compare_normalized(spark, d):
    return _compared(spark, d, C.compare_normalised)


@query(_truth(0, 1, 3))
def compare_category(spark, d):
    return _compared(spark, d, C.compare_category)


@query(_truth(0, 1, 2, 3))
def compare_smart(spark, d):
    return _compared(spark, d, C.compare_smart)


@query(f"WITH {_ANSWERS} SELECT l_orderkey, l_linenumber, r <> 0 AS same FROM lines")
def compare_formula(spark, d):
    pairs = _lines(spark, d)
    p, g = F.expr("'(x + ' || q || ')^2'"), F.expr("'x^2 + ' || (2 * q) || '*x + ' || (q * q + IF(r = 0, 1, 0))")
    return pairs.select("l_orderkey", "l_linenumber", C.compare_formula(p, g).alias("same"))


@query(f"WITH {_ANSWERS} SELECT l_orderkey, l_linenumber, r < 5 OR (r = 5 AND q % 2 = 0) AS same FROM lines")
def compare_number_rounded(spark, d):
    p, g = F.expr("q + r / 10.0D"), F.expr("CAST(q AS double)")
    return _lines(spark, d).select("l_orderkey", "l_linenumber", C.compare_number(p, g).alias("same"))


@query("""SELECT doc_id, CAST(CASE WHEN regexp_matches(coalesce(text, ''), '[^ \\t\\n\\r\\x0b\\x0c]') THEN len(list_filter(
 string_split_regex(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '')) ELSE 0 END AS BIGINT) AS words,
 length(coalesce(text, '')) AS chars FROM documents""")
def word_and_char_count(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", C.word_count(F.col("text")).alias("words"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS answer FROM conversations")
def parse_answer_tag(spark, d):
    wrapped = F.expr("CASE WHEN role = 'assistant' THEN 'So <Answer> ' || text || ' </answer> it is' ELSE text END")
    return _t(spark, d, "conversations").select("conv_id", "turn", C.answer_tag(wrapped).alias("answer"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS reason, CASE WHEN event_id % 5 < 2 THEN '' ELSE CAST(event_id AS VARCHAR) END AS answer,
 CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 'empty response' ELSE 'not a JSON object' END END AS error FROM events""")
def parse_json_fields(spark, d):
    full = F.to_json(F.struct(F.col("event_type").alias("reason"), F.when(F.col("event_id") % 5 > 1, F.col("event_id").cast("string")).alias("answer")))
    reply = F.when(F.col("event_id") % 5 > 0, full).when(F.col("event_id") % 2 == 0, " ").otherwise("[1")
    return _t(spark, d, "events").select("event_id", C.reason_answer(reply).alias("x")).select("event_id", "x.*")


@query("SELECT p_partkey, CASE WHEN p_size % 6 < 5 THEN CAST(p_size % 6 AS BIGINT) END AS option FROM part")
def option_index(spark, d):
    return _t(spark, d, "part").select("p_partkey", C.option_index(F.expr("substr('ABCDEF', p_size % 6 + 1, 1)")).alias("option"))


@query("SELECT page_id, [url, 'b.png'] AS paths, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM pages")
def image_path_parse(spark, d):
    listed = F.concat(F.lit("['"), "url", F.lit("', ' ', 'b.png']"))
    return _t(spark, d, "pages").select("page_id", C.image_paths(listed).alias("paths"), C.safe_file_name(F.col("url")).alias("name"))


@query("""SELECT doc_id, pos - 1 AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""")
def explode_subquestions(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return docs.withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT round(60.0 * count(*) / sum(value), 9) AS problems_per_minute, round(avg(value), 9) AS average_module_execution_time,
 CAST(100.0 * count(*) FILTER (WHERE value <= 50) AS DOUBLE) / count(*) AS success_rate_percentage FROM events""")
def workflow_trace_metrics(spark, d):
    traces = _t(spark, d, "events").select("value", F.when(F.col("value") > 50, "failed").otherwise("success").alias("status"))
    found = A.performance(traces, "value", "status")  # sums of doubles depend on their order in the last digits
    return found.withColumns({c: F.round(c, 9) for c in ("problems_per_minute", "average_module_execution_time")})


@query("""SELECT conv_id AS problem_id, CAST(count(*) + 1 AS INT) AS steps, 'Unknown' AS domain, arg_min(text, turn) AS first_step, 'end' AS last_name
 FROM conversations GROUP BY 1""")
def solution_steps(spark, d):
    turns = _t(spark, d, "conversations").groupBy(F.col("conv_id").alias("problem_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    tools = F.create_map().cast("map<string,string>")
    listed = F.transform("turns", lambda t: F.struct(t["turn"].cast("string").alias("step_name"), t["text"].alias("step_content"), F.lit("turn").alias("step_type"), tools.alias("tool_usage")))
    answers = turns.select("problem_id", F.lit("$x$").alias("agent_answer"), A.add_step(listed, F.lit("end"), F.lit("done")).alias("intermediate_steps"))
    problems = turns.select("problem_id", F.lit(None).cast("string").alias("domain"), F.lit("OE").alias("problem_type"))
    found, about = A.solutions(problems, answers), A.solution_summary()
    first, names = F.col("intermediate_steps")[0]["step_content"], A.step_names(F.col("intermediate_steps"))
    return found.select("problem_id", about["steps"].alias("steps"), about["domain"].alias("domain"), first.alias("first_step"), F.element_at(names, -1).alias("last_name"))


@query("""SELECT doc_id, part, pos FROM (SELECT doc_id, 'head' AS part, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos < 5 UNION ALL
 SELECT doc_id, part, pos FROM (SELECT doc_id, 'tail' AS part, 4 - (row_number() OVER (ORDER BY doc_id DESC) - 1) AS pos FROM documents) WHERE pos >= 0""")
def take_head_tail(spark, d):
    docs = P.ProblemSet(_t(spark, d, "documents").select("doc_id"), order="doc_id")
    part = lambda x, name: x.df.select("doc_id", F.lit(name).alias("part"), F.col("pos").cast("long").alias("pos"))
    return part(docs.head(), "head").unionByName(part(docs.tail(), "tail"))


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang
 ORDER BY md5('3|' || CAST(doc_id AS VARCHAR)), doc_id) <= 15) ORDER BY md5('4|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 40""")
def per_domain_then_total(spark, d):
    capped = R.sample_balanced(_t(spark, d, "documents"), 15, "lang", "doc_id", 3)
    return R.sample(capped, 40, "doc_id", 4).select("doc_id", "lang")


@query("""SELECT true AS valid, count(*) AS rows, []::VARCHAR[] AS issues, [count(*) FILTER (WHERE m > 0) || ' rows have other fields than the first',
 count(DISTINCT l_orderkey) FILTER (WHERE n > 1) || ' identifiers occur again'] AS warnings, count(*) FILTER (WHERE m > 0) AS drifted,
 count(DISTINCT l_orderkey) FILTER (WHERE n > 1) AS duplicates FROM (SELECT l_orderkey, (l_orderkey - min(l_orderkey) OVER ()) % 10 AS m,
 count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)""")
def validate_format(spark, d):
    lines = _t(spark, d, "lineitem").select("l_orderkey")
    first = lines.agg(F.min("l_orderkey").alias("least"))  # one row
    other = (F.col("l_orderkey") - F.col("least")) % 10 > 0
    fields = F.when(other, F.create_map(F.lit("problem_id"), F.lit("x"))).otherwise(F.create_map(F.lit("problem_id"), F.lit("x"), F.lit("question"), F.lit("y")))
    table = lines.crossJoin(F.broadcast(first)).select("l_orderkey", fields.alias("fields"))
    return P.validate(table, key="l_orderkey", record="fields", pos="l_orderkey")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN 'de' WHEN 2 THEN 'en' ELSE 'zh' END AS language FROM documents""")
def normalize_language(spark, d):
    name = F.expr("CASE doc_id % 4 WHEN 0 THEN upper(lang) WHEN 1 THEN ' German' WHEN 2 THEN 'klingon' ELSE 'zh-CN' END")
    return _t(spark, d, "documents").select("doc_id", X.normalise_language(name).alias("language"))


@query("SELECT p_partkey, ['A: ' || p_brand, 'B: ' || p_type] AS options FROM part")
def extract_options(spark, d):
    text = F.expr("'Which? (A) ' || p_brand || ' (B) ' || p_type")
    return _t(spark, d, "part").select("p_partkey", X.extract_options(text).alias("options"))


@query(f"""WITH {_ANSWERS} SELECT l_orderkey, l_linenumber, CASE r % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'formula' ELSE 'text' END AS category
 FROM lines""")
def detect_category(spark, d):
    text = F.expr("CASE r % 3 WHEN 0 THEN '$' || q || '$' WHEN 1 THEN q || ' m/s' ELSE 'some words' END")
    return _lines(spark, d).select("l_orderkey", "l_linenumber", X.detect_category(text).alias("category"))


@query(f"WITH {_ANSWERS} SELECT l_orderkey, l_linenumber, q || ' v + u \\mathrm{{hbar}} d x' AS latex FROM lines")
def latex_normalize(spark, d):
    text = F.expr(r"q || '\\,\\vec{v} \\quad+  \\hat{u} \\hbar\\mathrm{d}x'")
    return _lines(spark, d).select("l_orderkey", "l_linenumber", X.preprocess_latex(text).alias("latex"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL ELSE page_id END AS number FROM pages")
def file_number_sort(spark, d):
    name = F.expr("CASE WHEN page_id % 5 = 0 THEN 'train/cover.json' ELSE 'train/' || page_id || '.json' END")
    return _t(spark, d, "pages").select("page_id", L.stem_number(name).alias("number")).orderBy(F.asc_nulls_last("number"))


@query("""SELECT doc_id, lang, row_number() OVER (ORDER BY first_id, doc_id) - 1 AS place FROM (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY lang) AS first_id FROM documents)""")
def first_seen_regroup(spark, d):
    docs = _t(spark, d, "documents").select("lang", F.col("doc_id").alias("pos"))
    placed = R.with_position(L.first_seen_order(docs, "lang", keep="first"), ["first", "pos"], "place")
    return placed.select(F.col("pos").alias("doc_id"), "lang", F.col("place").cast("long").alias("place"))


@query("""SELECT count(*) AS problems, count(*) FILTER (WHERE failed) AS failed, CAST(sum(n) AS BIGINT) AS theorems, count(*) FILTER (WHERE n > 0) AS with_theorems,
 count(*) FILTER (WHERE n = 0) AS without_theorems, avg(n) AS average FROM (SELECT event_id % 7 = 0 AS failed,
 CASE WHEN event_id % 7 = 0 THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) % 4 END AS n FROM events)""")
def theorem_counters(spark, d):
    one = F.lit('{"name": "Ohm", "equations": ["U=RI"], "domain": "electricity"}')
    n = (F.from_json("props", "k long")["k"] % 4).cast("int")
    reply = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit('{"theorems": ['), F.array_join(F.array_repeat(one, n), ", "), F.lit("]}")))
    events = _t(spark, d, "events").select(A.parse_theorems(reply).alias("theorems"), F.when(reply.isNull(), "failed").alias("error"))
    return A.theorem_counters(events, error="error")


@query("""WITH t AS (SELECT doc_id, coalesce(toxic, 0) = 0 AS relevant, coalesce(quality, 0) = 1 AS right_, doc_id % 3 = 0 AS more FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) AS reviewed_theorems, count(*) FILTER (WHERE relevant) AS relevant_theorems, count(*) FILTER (WHERE relevant AND right_) AS correct_equations,
 count(*) FILTER (WHERE relevant) AS valid_conditions, count(*) FILTER (WHERE more) AS missing_theorems, CAST(1 AS DOUBLE) AS average FROM t""")
def review_join(spark, d):
    docs = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left")
    said = F.struct(
        (F.coalesce("toxic", F.lit(0)) == 0).alias("is_relevant"), (F.coalesce("quality", F.lit(0)) == 1).alias("equations_correct"), F.lit(True).alias("conditions_valid"),
        *[F.lit("").alias(c) for c in ("relevance_feedback", "equations_feedback", "conditions_feedback")],
    )
    found, none = A.parse_theorems(F.lit('{"theorems": [{"name": "Ohm"}]}')), A.parse_theorems(F.lit("{}"))
    reviewed = A.review_theorems(found, F.array(said), F.when(F.col("doc_id") % 3 == 0, found).otherwise(none))
    return A.review_counters(docs.select(reviewed.alias("reviewed")))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'optics' WHEN c_nationkey % 3 = 1 THEN 'quantum_mechanics' ELSE 'other' END AS domain
 FROM customer""")
def normalize_domain(spark, d):
    name = F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'OPTICS' WHEN 1 THEN 'Quantum-Mechanics' ELSE 'cooking' END")
    return _t(spark, d, "customer").select("c_custkey", C.normalise_domain(name).alias("domain"))


@query("""SELECT conv_id, turn, ['other', 'optics'] AS domains, 'success' AS status FROM conversations""")
def annotate_domains(spark, d):
    reply = '{"domains": ["Cooking", "Optics"], "confidence": 0.5}'
    label = lambda df: A.ask(df, F.col("text"), lambda: A.Stub(reply), "label").withColumn("found", A.parse_domains(F.col("label")))
    done = A.Workflow().add("label", label).run(_t(spark, d, "conversations").select("conv_id", "turn", "text"))
    return done.select("conv_id", "turn", F.col("found.domains").alias("domains"), F.col("trace")[0]["status"].alias("status"))


def _typed_answers(spark, d):
    value = F.expr("CASE r WHEN 0 THEN string(q - 20) WHEN 1 THEN q || '.5' WHEN 2 THEN '$x + ' || q || '$' WHEN 3 THEN 'about ' || q || ' words' WHEN 4 THEN 'b' WHEN 5 THEN 'yes' ELSE 'x = ' || q END")
    kind = F.expr("element_at(array('number', 'physical_quantity', 'formula', 'text', 'option', 'option', 'equation'), cast(r + 1 AS int))")
    unit = F.expr("CASE r WHEN 0 THEN '' WHEN 1 THEN 'm' END")
    return _lines(spark, d).select("l_orderkey", "l_linenumber", Y.answer(value, kind, unit).alias("a"))


@query(f"""WITH {_ANSWERS} SELECT l_orderkey, l_linenumber, r < 2 AS numerical, r IN (1, 2, 6) AS symbolic, r < 2 AS with_unit, r = 0 AS whole,
 r = 1 OR (r = 0 AND q > 20) AS positive, r = 0 AND q < 20 AS negative, r = 2 AS latex, true AS valid FROM lines""")
def answer_predicates(spark, d):
    a = F.col("a")
    return _typed_answers(spark, d).select(
        "l_orderkey", "l_linenumber", Y.is_numerical(a).alias("numerical"), Y.is_symbolic(a).alias("symbolic"), Y.has_unit(a).alias("with_unit"), Y.is_integer(a).alias("whole"),
        Y.is_positive(a).alias("positive"), Y.is_negative(a).alias("negative"), Y.is_latex(a).alias("latex"), Y.is_valid(a).alias("valid"),
    )


@query(f"""WITH {_ANSWERS} SELECT l_orderkey, l_linenumber, CASE r WHEN 0 THEN (q - 20) || '' WHEN 1 THEN q || '.5 m' WHEN 2 THEN '$x + ' || q || '$' WHEN 3 THEN 'about ' || q || ' words'
 WHEN 4 THEN 'b' WHEN 5 THEN 'yes' ELSE 'x = ' || q END AS text, CASE r WHEN 2 THEN 'x + ' || q WHEN 0 THEN (q - 20) || '' WHEN 1 THEN q || '.5' WHEN 3 THEN 'about ' || q || ' words'
 WHEN 4 THEN 'b' WHEN 5 THEN 'yes' ELSE 'x = ' || q END AS clean, CASE WHEN r = 1 THEN 'm' WHEN r = 0 THEN '' END AS unit, CAST(CASE WHEN r = 3 THEN 3 ELSE 0 END AS BIGINT) AS words,
 CAST(CASE WHEN r = 3 THEN 12 + length(q || '') ELSE 0 END AS BIGINT) AS chars, r = 3 AS about, CASE WHEN r = 4 THEN CAST(1 AS BIGINT) END AS option, r = 4 AS letter, r = 5 AS yes_no FROM lines""")
def answer_accessors(spark, d):
    a = F.col("a")
    return _typed_answers(spark, d).select(
        "l_orderkey", "l_linenumber", Y.text_of(a).alias("text"), Y.clean_expression(a).alias("clean"), Y.unit(a).alias("unit"), Y.words(a).alias("words"), Y.chars(a).alias("chars"),
        Y.contains_keywords(a, ["ABOUT"]).alias("about"), Y.option_index(a).alias("option"), Y.is_letter_option(a).alias("letter"), Y.is_yes_no(a).alias("yes_no"),
    )


def _problem_set(spark, d):
    """Documents as problems: the answer is a label, a seventh of the predictions is missing."""
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    truth = Y.answer(F.col("quality").cast("string"), "number")
    problems = docs.select(F.col("doc_id").alias("problem_id"), F.col("lang").alias("domain"), F.col("source").alias("problem_type"), truth.alias("answer"))
    guesses = _t(spark, d, "documents").where("doc_id % 7 > 0").select(F.col("doc_id").alias("problem_id"), Y.raw(F.lit("1.0")).alias("prediction"))
    return problems, guesses


_STATUS = """s AS (SELECT doc_id, coalesce(lang, 'Unknown') AS domain, coalesce(source, 'unknown') AS problem_type,
 CASE WHEN quality IS NULL THEN 'no_ground_truth' WHEN doc_id % 7 = 0 THEN 'missing_prediction' ELSE 'success' END AS status,
 CASE WHEN quality = 1 AND doc_id % 7 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents LEFT JOIN labels USING (doc_id))"""


@query(f"WITH {_STATUS} SELECT doc_id AS problem_id, status, score FROM s")
def evaluate_statuses(spark, d):
    return E.Evaluator("category").evaluate_dataset(*_problem_set(spark, d)).select("problem_id", "status", "score")


@query(f"""WITH {_STATUS} SELECT kind, value, coalesce(avg(score) FILTER (WHERE status = 'success'), 0) AS accuracy, count(*) AS total,
 count(*) FILTER (WHERE status = 'success') AS evaluated, count(*) FILTER (WHERE status <> 'success') AS failed FROM (SELECT *, unnest(['overall', 'domain', 'problem_type']) AS kind,
 unnest(['', domain, problem_type]) AS value FROM s) GROUP BY 1, 2""")
def evaluate_summary(spark, d):
    return E.summary(E.Evaluator("category").evaluate_dataset(*_problem_set(spark, d)))


@query("""SELECT doc_id AS problem_id, CASE WHEN lang IS NULL THEN 'extraction_failed' ELSE 'success' END AS status, lang = 'en' AS same, 'text' AS kind
 FROM documents""")
def evaluate_extracted(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("problem_id"), "lang", Y.answer(F.lit("en"), "text").alias("answer"))
    out = E.Evaluator().set_comparator(Y.exact).evaluate_dataset(docs, extract=lambda df: Y.answer(df["lang"], "text"))
    return out.select("problem_id", "status", F.col("result.comparison_result").alias("same"), F.coalesce("result.details.predicted_type", F.lit("text")).alias("kind"))


@query("""SELECT count(*) AS problems, CAST(sum(CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS domains, count(*) FILTER (WHERE turn % 2 = 0) AS several_domains,
 avg(CASE WHEN turn % 2 = 0 THEN 0.5 ELSE 0 END) AS confidence, min(CASE WHEN turn % 2 = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END) AS least, max(CASE WHEN turn % 2 = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END) AS greatest FROM conversations""")
def domain_counters(spark, d):
    reply = F.when(F.col("turn") % 2 == 0, '{"domains": ["Optics", "typo"], "confidence": 0.5}')
    return A.domain_counters(_t(spark, d, "conversations").select(A.parse_domains(reply).alias("domain_annotation")))


@query("""SELECT conv_id, turn, turn % 3 > 0 AS annotated, CASE WHEN turn % 3 > 0 THEN ['first success', 'second success'] ELSE ['first failed'] END AS trace,
 CASE WHEN turn % 3 > 0 THEN text END AS second FROM conversations""")
def workflow_stops(spark, d):
    def first(df):
        return df.withColumns({"first": F.lit("x"), "first_error": F.when(F.col("turn") % 3 == 0, "broken")})

    done = A.Workflow().add("first", first).add("second", lambda df: df.withColumn("second", F.col("text"))).run(_t(spark, d, "conversations"))
    said = F.transform("trace", lambda t: F.concat_ws(" ", t["module_name"], t["status"]))
    return done.select("conv_id", "turn", "annotated", said.alias("trace"), "second")


@query("""SELECT doc_id, CAST(fold AS INT) AS fold, train FROM (SELECT doc_id, CAST(least((row_number() OVER (ORDER BY md5('0|' || CAST(pos AS VARCHAR)), pos) - 1) // greatest(1, n // 5), 4) AS BIGINT) AS f
 FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)), (VALUES (0), (1), (2), (3), (4)) v(fold), (VALUES (true), (false)) w(train)
 WHERE (f <> fold) = train""")
def train_validation(spark, d):
    docs, out = P.ProblemSet(_t(spark, d, "documents").select("doc_id"), order="doc_id"), None
    for fold, parts in enumerate(docs.cross_validation(5)):
        for train, part in zip((True, False), parts, strict=True):
            own = part.df.select("doc_id", F.lit(fold).alias("fold"), F.lit(train).alias("train"))
            out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS problem_id, min(pos) AS pos FROM (SELECT l_orderkey,
 row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS pos FROM lineitem) GROUP BY 1""")
def ids_in_order(spark, d):
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("problem_id"), "l_orderkey", "l_linenumber")
    return P.ProblemSet(lines, order=["l_orderkey", "l_linenumber"]).ids().select("problem_id", F.col("pos").cast("long").alias("pos"))


@query("""SELECT vec_id, 'images/' || vec_id || '.png' AS path, CAST(1 AS BIGINT) AS images FROM embeddings""")
def split_images(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", F.array(F.unhex(F.lit("89504E470D0A"))).alias("images"))
    table, files = D.split_images(rows, "vec_id", "images")
    counted = files.groupBy("path").agg(F.count(F.lit(1)).alias("images"))
    return table.select("vec_id", F.col("image_paths")[0].alias("path")).join(counted, "path")


@query("""SELECT name, CAST(len(variants) AS BIGINT) AS variants, splits[1] AS split FROM (VALUES ('phybench', [1, 2, 3], ['train']), ('phyx', [1], ['test_mini']), ('seephys', [1], ['train']),
 ('ugphysics', [1, 2], ['test']), ('jeebench', [1], ['test']), ('tpbench', [1], ['public']), ('physreason', [1, 2], ['test'])) v(name, variants, splits)""")
def dataset_catalogue(spark, d):
    return H.Hub().catalogue(spark).select("name", F.size("variants").cast("long").alias("variants"), F.col("splits")[0].alias("split"))


QUERIES |= golden.QUERIES
ORACLE_SQL |= golden.ORACLE_SQL
