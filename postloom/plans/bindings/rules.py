"""C-family."""

import re

from pyspark.sql import functions as F

from postloom.functions.access import row_count
from postloom import vocab
from postloom.functions import classify as C
from postloom.functions.taxonomy import Taxonomy, bucket_contains
from postloom.functions.text import contains_any, count_keywords
from postloom.operators import counts, joins
from postloom.plans.bindings.common import (
    DOC_TAXONOMY, SKILL_ROWS_SQL, any_sql, first_match_sql, flag_sql, lit_sql, query, skill_rows, table)


# Job titles made from the part columns: seniority from the first word, role from the type, suffix from the second word.
ROLES = {"ECONOMY": "Software Engineer", "LARGE": "AI Engineer", "MEDIUM": "Machine Learning Engineer",
         "PROMO": "Data Engineer", "SMALL": "Sales Engineer", "STANDARD": "Full Stack AI Engineer"}
FRONT = {"red": "Senior ", "blue": "Staff ", "hot": "Lead ", "cold": "AI ", "old": "", "new": "Junior ", "large": "Sr. ", "small": "Maintenance "}
BACK = {"widget": ", AI Platform", "gear": " II", "ring": " - ML", "rod": "", "bolt": " (Software)", "plate": " / Inference Engineer",
        "anvil": " for AI", "gizmo": ", Data & AI"}


def _mapped(column, values):
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column)


def titles(spark, sf):
    word = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", F.concat(
        _mapped(word[0], FRONT), _mapped(F.col("p_type"), ROLES), _mapped(word[1], BACK)).alias("title"))


def _case(expr, values):
    return f"CASE {expr} " + " ".join(f"WHEN {lit_sql(k)} THEN {lit_sql(v)}" for k, v in values.items()) + " END"


TITLES_SQL = f"""titles AS (SELECT p_partkey, {_case("string_split(p_name, ' ')[1]", FRONT)} || {_case('p_type', ROLES)}
  || {_case("string_split(p_name, ' ')[2]", BACK)} AS title FROM part)"""


def _rx(column, pattern):
    return f"regexp_matches({column}, {lit_sql('(?i)' + pattern)})"


def _pattern_sql(column, patterns):
    """RE2 has no lookahead: `A(?!B)` at the end of a pattern becomes `A and not AB`."""
    parts = []
    for p in patterns:
        m = re.fullmatch(r"(.*)\(\?!(.*)\)", p)
        parts.append(f"({_rx(column, m[1])} AND NOT {_rx(column, m[1] + m[2])})" if m else _rx(column, p))
    return "(" + " OR ".join(parts) + ")"


GUARD_SQL = f"""({any_sql('lower(title)', vocab.SUPPORT_PHRASES)} AND len(list_filter(range(2, len(ws) + 1), lambda i:
  contains(ws[i], 'ai') AND {any_sql("array_to_string(ws[greatest(1, i - 3):i - 1], ' ')", vocab.GUARD_TERMS)})) > 0)"""

CLASS_SQL = f"""CASE
  WHEN {_pattern_sql('title', vocab.AI_FIRST_PATTERNS)} AND NOT {GUARD_SQL} THEN 'ai_first'
  WHEN {_pattern_sql('title', vocab.AI_SUPPORT_PATTERNS)} THEN 'ai_support'
  WHEN {any_sql('lower(title)', vocab.AI_FIRST_KEYWORDS)} AND NOT {any_sql('lower(title)', vocab.SOFTWARE_PHRASES)} THEN 'ai_first'
  WHEN {any_sql('lower(title)', vocab.SUPPORT_PHRASES)} AND contains(lower(title), 'ai') THEN 'ai_support'
  ELSE 'other' END"""

SPLIT_TITLES_SQL = f"WITH {TITLES_SQL}, x AS (SELECT *, string_split_regex(trim(lower(title)), '\\s+') AS ws FROM titles)"


@query("c01_classify_title", f"{SPLIT_TITLES_SQL} SELECT p_partkey, title, {CLASS_SQL} AS classification FROM x")
def classify_title(spark, sf):
    return titles(spark, sf).withColumn("classification", C.classify_title("title"))


@query("c01g_prefix_role_guard", f"{SPLIT_TITLES_SQL} SELECT p_partkey, {GUARD_SQL} AS guard FROM x")
def prefix_role_guard(spark, sf):
    return titles(spark, sf).select("p_partkey", C.prefix_role_guard("title").alias("guard"))


@query("c02_first_match", f"SELECT doc_id, {first_match_sql(DOC_TAXONOMY, 'lower(text)', lit_sql('uncategorized'))} AS category FROM documents")
def first_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Taxonomy(DOC_TAXONOMY).first_match("text", "uncategorized").alias("category"))


@query("c02_responsibility_categories", f"""
SELECT category, count(*) AS n FROM (SELECT {first_match_sql(vocab.RESPONSIBILITY_TAXONOMY, 'lower(line)')} AS category
  FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1""")
def responsibility_categories(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(Taxonomy(vocab.RESPONSIBILITY_TAXONOMY).first_match("line").alias("category")).groupBy("category").agg(row_count().alias("n"))


@query("c02_use_case_categories", f"""
SELECT category, count(*) AS n FROM (SELECT {first_match_sql(vocab.USE_CASE_TAXONOMY, 'lower(text)')} AS category FROM conversations) GROUP BY 1""")
def use_case_categories(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.select(Taxonomy(vocab.USE_CASE_TAXONOMY).first_match("text").alias("category")).groupBy("category").agg(row_count().alias("n"))


GATED = DOC_TAXONOMY[:5]


@query("c03_first_match_gated", f"""
SELECT * FROM (SELECT doc_id, coalesce({first_match_sql(GATED, 'lower(text)')},
  CASE WHEN {any_sql('lower(text)', ['que', 'the'])} THEN 'other mention' END) AS category FROM documents) WHERE category IS NOT NULL""")
def first_match_gated(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", Taxonomy(GATED).gated("text", ["que", "the"], "other mention").alias("category"))
    return rows.filter(F.col("category").isNotNull())


def _two_field_sql(entries):
    return "CASE " + " ".join(
        f"WHEN {any_sql('lower(source)', kws)} OR {any_sql('text', kws)} THEN {lit_sql(name)}" for name, kws in entries) + " ELSE 'Other' END"


SOURCES = [("First sources", ["src1", "license"]), ("Second sources", ["src2", "rag"]), ("Accents", ["è", "ü"])]


@query("c04_two_fields", f"SELECT doc_id, {_two_field_sql(SOURCES)} AS category FROM documents")
def two_fields(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", Taxonomy(SOURCES).first_match_in([F.lower("source"), F.col("text")], "Other").alias("category"))


@query("c05_multi_label", " UNION ALL ".join(
    f"SELECT {lit_sql(name)} AS tag, count(*) AS n FROM documents WHERE {any_sql('lower(text)', kws)} HAVING count(*) > 0" for name, kws in DOC_TAXONOMY))
def multi_label(spark, sf):
    tags = Taxonomy(DOC_TAXONOMY).all_matches("text")
    return counts.value_counts(table(spark, sf, "documents").select(F.explode(tags).alias("tag")), "tag")


FOR, AGAINST, TITLE = ["rag", "the", "ation", "src7", "ring"], ["que", "data", "ung"], ["src11", "src12"]
_A = " + ".join(f"(CASE WHEN contains(lower(source), {lit_sql(k)}) OR contains(text, {lit_sql(k)}) THEN 1 ELSE 0 END)" for k in FOR)
_B = " + ".join(flag_sql("text", k) for k in AGAINST)


@query("c06_score_compare", f"""
SELECT doc_id, reason <> 'none' AS hit, reason FROM (SELECT doc_id,
  CASE WHEN {any_sql('lower(source)', TITLE)} THEN 'title' WHEN ({_A}) > ({_B}) AND ({_A}) >= 2 THEN 'content' ELSE 'none' END AS reason FROM documents)""")
def score_compare(spark, sf):
    scored = C.score_compare(F.lower("source"), [F.col("text")], for_words=FOR, against_words=AGAINST, title_words=TITLE)
    return table(spark, sf, "documents").select("doc_id", scored.alias("s")).select("doc_id", "s.hit", "s.reason")


@query("c07_depth_level", f"""
SELECT doc_id, CASE WHEN m AND (contains(lower(source), 'src1') OR occ >= 2 OR {any_sql('lower(text)', ['license'])}) THEN 'primary'
  WHEN m THEN 'secondary' ELSE 'none' END AS depth FROM (SELECT *,
  {any_sql("lower(source || ' ' || text)", ['rag', 'data', 'license'])} AS m,
  len(regexp_extract_all(text, 'rag')) + len(regexp_extract_all(text, 'data')) AS occ FROM documents)""")
def depth_level(spark, sf):
    mention = F.lower(F.concat_ws(" ", "source", "text"))
    level = C.depth_level(mention, F.col("source"), F.col("text"), indicators=["rag", "data", "license"],
                          title_words=["src1"], repeated=["rag", "data"], techniques=["license"])
    return table(spark, sf, "documents").select("doc_id", level.alias("depth"))


PRIORITIES = [("Early", ["LOW", "NOT"]), ("Growth", ["MEDIUM", "SPEC"]), ("Late", ["HIGH"])]


@query("c08_bucket_contains", f"""
SELECT bucket, count(*) AS n FROM (SELECT {first_match_sql(PRIORITIES, 'o_orderpriority')} AS bucket FROM orders) WHERE bucket IS NOT NULL GROUP BY 1""")
def buckets(spark, sf):
    rows = table(spark, sf, "orders").select(bucket_contains("o_orderpriority", PRIORITIES).alias("bucket"))
    return counts.value_counts(rows, "bucket")


@query("c09_months_to_level", """
SELECT p_partkey, CASE WHEN m IS NULL OR m = 0 THEN '' WHEN m / 12 < 2 THEN 'Entry level' WHEN m / 12 < 4 THEN 'Mid level'
  WHEN m / 12 < 7 THEN 'Senior level' ELSE 'Expert/Leader' END AS level FROM (SELECT p_partkey, (p_size - 1) * 2 AS m FROM part)""")
def months_to_level(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.months_to_level((F.col("p_size") - 1) * 2).alias("level"))


@query("c10_cluster_label", """
SELECT p_name, n, n_first, n_second, CASE WHEN 100.0 * n_first / n >= 75 THEN 'SMALL' WHEN 100.0 * n_second / n >= 75 THEN 'LARGE' ELSE 'mixed' END AS label
FROM (SELECT p_brand || p_name AS p_name, count(*) AS n, count(*) FILTER (p_type = 'SMALL') AS n_first, count(*) FILTER (p_type = 'LARGE') AS n_second
  FROM part GROUP BY 1) WHERE n >= 3""")
def cluster_label(spark, sf):
    rows = table(spark, sf, "part").select(F.concat("p_brand", "p_name").alias("p_name"), "p_type")
    return counts.cluster_label(rows, "p_name", "p_type", "SMALL", "LARGE")


@query("c11_capability_flags", f"""
WITH {SKILL_ROWS_SQL}, k AS (SELECT l_orderkey, bool_or({any_sql('lower(skill)', ['widget', 'ring'])}) AS a, bool_or({any_sql('lower(skill)', ['gear', 'rod'])}) AS b
  FROM s GROUP BY 1)
SELECT count(*) AS n_total, count(*) FILTER (a) AS n_frontend, count(*) FILTER (b) AS n_backend, count(*) FILTER (a AND b) AS n_both FROM k""")
def capability_flags(spark, sf):
    rows = skill_rows(spark, sf)
    per_key = rows.groupBy("l_orderkey").agg(F.bool_or(contains_any("skill", ["widget", "ring"])).alias("a"),
                                             F.bool_or(contains_any("skill", ["gear", "rod"])).alias("b"))
    return counts.flag_counts(per_key, {"n_frontend": F.col("a"), "n_backend": F.col("b"), "n_both": F.col("a") & F.col("b")})


@query("c11_capability_arrays", """
WITH k AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: length(x) > 0) AS s FROM documents)
SELECT doc_id, len(list_filter(s, lambda x: contains(lower(x), 'rag') OR contains(lower(x), 'rest'))) > 0 AS capable FROM k""")
def capability_arrays(spark, sf):
    words = F.transform(F.split("text", r"\s+"), F.lower)
    return table(spark, sf, "documents").select("doc_id", C.capability(words, ["rag", "rest"]).alias("capable"))


@query("c12_mixture_flags", f"""
WITH {SKILL_ROWS_SQL}, k AS (SELECT l_orderkey, bool_or(category = 'PROMO') AS p, bool_or(category = 'SMALL') AS sm, bool_or(category = 'LARGE') AS la,
  bool_or(category <> 'PROMO') AS o FROM s GROUP BY 1)
SELECT count(*) AS n_total, count(*) FILTER (p AND NOT o) AS n_only, count(*) FILTER (p AND o) AS n_any_other,
  count(*) FILTER (p AND sm) AS n_with_small, count(*) FILTER (p AND la) AS n_with_large FROM k""")
def mixture_flags(spark, sf):
    is_ = lambda c: F.bool_or(F.col("category") == c)
    k = skill_rows(spark, sf).groupBy("l_orderkey").agg(is_("PROMO").alias("p"), is_("SMALL").alias("sm"), is_("LARGE").alias("la"),
                                                       F.bool_or(F.col("category") != "PROMO").alias("o"))
    p = F.col("p")
    return counts.flag_counts(k, {"n_only": p & ~F.col("o"), "n_any_other": p & F.col("o"),
                                  "n_with_small": p & F.col("sm"), "n_with_large": p & F.col("la")})


FAMILIES = [("Warm", ["red", "hot"]), ("Cool", ["blue", "cold"]), ("Round", ["ring", "gear", "rod"]), ("Flat", ["plate"])]


@query("c13_title_families", " UNION ALL ".join(
    f"""SELECT {lit_sql(name)} AS family, count(*) AS n, count(*) FILTER (p_type = 'PROMO') AS n_first,
  100.0 * count(*) FILTER (p_type = 'PROMO') / count(*)::DOUBLE AS pct_first FROM part WHERE {any_sql('lower(p_name)', kws)}""" for name, kws in FAMILIES))
def title_families(spark, sf):
    return counts.title_families(table(spark, sf, "part"), Taxonomy(FAMILIES).all_matches("p_name"), "p_type", "PROMO")


@query("c14_entry_level", f"{SPLIT_TITLES_SQL} SELECT p_partkey, {any_sql('lower(title)', vocab.ENTRY_LEVEL_WORDS)} AS entry FROM x")
def entry_level(spark, sf):
    return titles(spark, sf).select("p_partkey", C.entry_level("title").alias("entry"))


def _normalize_sql(expr):
    for word in vocab.SENIORITY_WORDS:
        expr = f"trim(replace({expr}, {lit_sql(word)}, ''))"
    return expr


@query("c15_normalize_title", f"WITH {TITLES_SQL} SELECT p_partkey, {_normalize_sql('lower(title)')} AS base FROM titles")
def normalize_title(spark, sf):
    return titles(spark, sf).select("p_partkey", C.normalize_title("title").alias("base"))


@query("c16_score_rule", f"""
SELECT doc_id, CASE WHEN a > b AND a >= 2 THEN 'ai-first' WHEN b > a AND b >= 2 THEN 'ai-support' WHEN a > 0 THEN 'ai-first'
  WHEN b > 0 THEN 'ai-support' ELSE 'unknown' END AS ai_type FROM (
  SELECT doc_id, {' + '.join(flag_sql('lower(text)', k) for k in ['the ', ' of', 'and '])} AS a,
    {' + '.join(flag_sql('lower(text)', k) for k in [' la ', 'que', ' und', ' und '])} AS b FROM documents)""")
def score_rule(spark, sf):
    low = F.lower("text")
    scored = table(spark, sf, "documents").select(
        "doc_id", count_keywords([low], ["the ", " of", "and "]).alias("a"), count_keywords([low], [" la ", "que", " und", " und "]).alias("b"))
    return scored.select("doc_id", C.score_rule(F.col("a"), F.col("b")).alias("ai_type"))


@query("c17_normalize_skill", r"""
SELECT p_partkey, coalesce(CASE WHEN base = 'brand#1' THEN 'First Brand' WHEN base = 'brand#2' THEN 'Second Brand' END, raw) AS skill FROM (
  SELECT p_partkey, regexp_replace(p_brand || ' v' || p_size || '.0', '\s+v?\d+(\.\d+)*$', '') AS raw,
    lower(regexp_replace(p_brand || ' v' || p_size || '.0', '\s+v?\d+(\.\d+)*$', '')) AS base FROM part)""")
def normalize_skill(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws("", "p_brand", F.lit(" v"), "p_size", F.lit(".0")).alias("skill"))
    aliases = spark.createDataFrame([("brand#1", "First Brand"), ("brand#2", "Second Brand")], "alias string, canonical string")
    return joins.normalize_skills(rows, "skill", aliases)


