"""Registry, table access, and the derived views the bindings share.

A derived view adds columns to whole tables inside Spark; the matching SQL text does the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import vocab
from postloom.functions.text import WS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lit_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_sql(column: str, keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit_sql(k)})" for k in keywords) + ")"


def first_match_sql(entries, column: str, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(column, kws)} THEN {lit_sql(name)}" for name, kws in entries) + f" ELSE {default} END"


def flag_sql(column: str, keyword: str) -> str:
    return f"(CASE WHEN contains({column}, {lit_sql(keyword)}) THEN 1 ELSE 0 END)"


PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
STATUSES = ["F", "O", "P"]

# A taxonomy whose keywords occur in the given documents.
DOC_TAXONOMY = [
    ("License", ["license", "copyright", "rights reserved"]),
    ("Contact", ["@", "phone"]),
    ("Retrieval", ["rag", "vector"]),
    ("Data", ["data"]),
    ("German", ["ß", "ü", "sch "]),
    ("Spanish", ["ñ", "ó"]),
    ("French", ["ç", "è"]),
    ("English", ["the "]),
]


def skill_rows(spark: SparkSession, sf: str) -> DataFrame:
    """An order is a posting, its parts are the skills, the part type is the category: long rows."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("category"), F.col("p_name").alias("skill"))
    return li.join(part, li.l_partkey == part.p_partkey).select("l_orderkey", "l_linenumber", "category", "skill")


SKILL_ROWS_SQL = """s AS (SELECT l_orderkey, l_linenumber, p_type AS category, p_name AS skill
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def typed_skill_rows(spark: SparkSession, sf: str) -> DataFrame:
    """`skill_rows` with the posting's class (order status) and stage (order priority)."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("kind"),
                                               F.col("o_orderpriority").alias("stage"))
    rows = skill_rows(spark, sf)
    return rows.join(orders, rows.l_orderkey == orders.o_orderkey).drop("o_orderkey")


TYPED_SKILL_ROWS_SQL = SKILL_ROWS_SQL + """,
  t AS (SELECT s.*, o_orderstatus AS kind, o_orderpriority AS stage FROM s JOIN orders ON l_orderkey = o_orderkey)"""

# The long words of a document stand for its skills; the word length picks the category.
LENGTHS = dict(zip(vocab.SKILL_CATEGORIES, range(11, 21)))


def word_category(word: Column) -> Column:
    out = None
    for category, length in LENGTHS.items():
        hit = F.length(word) >= length if category == "other" else F.length(word) == length
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out


WORD_CATEGORY_SQL = "CASE " + " ".join(
    f"WHEN length(w) {'>=' if c == 'other' else '='} {n} THEN '{c}'" for c, n in LENGTHS.items()) + " END"


def extractions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as flat extractions; everything is derived inside the row from the whole text."""
    skills = F.transform(F.filter(F.split("text", WS), lambda w: F.length(w) >= 11),
                         lambda w: F.struct(w.alias("name"), word_category(w).alias("category")))
    kind = (F.when(F.col("lang") == "en", "ai-first").when(F.col("lang") == "fr", "ai-support")
            .when(F.col("lang") == "de", "ml-first").otherwise("unknown"))
    stage = (F.when(F.col("lang") == "en", "Series A").when(F.col("lang") == "fr", "Seed/Series A")
             .when(F.col("lang") == "de", "Public"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    sentences = F.filter(F.split("text", r"\. "), lambda x: F.length(F.trim(x)) > 0)
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("job_id"), "doc_id",
        F.array_join(F.slice(F.filter(F.split("text", WS, 5), lambda w: F.length(w) > 0), 1, 3), " ").alias("title"), F.col("source").alias("company"),
        kind.alias("ai_type"), F.lit("by language").alias("ai_type_reasoning"),
        stage.alias("company_stage"), F.col("lang").alias("company_focus"),
        lines.alias("responsibilities"), sentences.alias("use_cases"), skills.alias("skills"),
        F.contains("text", F.lit("@")).alias("is_customer_facing"), (F.col("n_chars") > 2000).alias("is_management"))


# `d`: one row per document; `w`: its long words with their position and category.
POSTING_SQL = f"""d AS (
  SELECT doc_id, text, lang, source AS company,
    CASE lang WHEN 'en' THEN 'ai-first' WHEN 'fr' THEN 'ai-support' WHEN 'de' THEN 'ml-first' ELSE 'unknown' END AS kind,
    CASE lang WHEN 'en' THEN 'Series A' WHEN 'fr' THEN 'Seed/Series A' WHEN 'de' THEN 'Public' END AS stage,
    array_to_string(list_slice(list_filter(string_split_regex(text, '\\s+'), lambda x: length(x) > 0), 1, 3), ' ') AS title,
    contains(text, '@') AS customer_facing, n_chars > 2000 AS management
  FROM documents),
  tokens AS (SELECT doc_id, unnest(toks) AS w, unnest(range(1, len(toks) + 1)) AS pos
    FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: length(x) > 0) AS toks FROM documents)),
  w AS (SELECT doc_id, pos, w AS skill, {WORD_CATEGORY_SQL} AS category FROM tokens WHERE length(w) >= 11)"""


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as nested postings of the live schema, with `doc_id` as the ordering key."""
    from postloom.operators.nesting import flat_to_nested

    return flat_to_nested(extractions(spark, sf), extracted_at=F.lit("2026-01-01T00:00:00"))
