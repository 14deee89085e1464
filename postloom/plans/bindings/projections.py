"""P-family."""

from pyspark.sql import functions as F

from postloom import vocab
from postloom.functions import access, text
from postloom.operators import nesting
from postloom.plans.bindings.common import (
    PART_TYPES, POSTING_SQL, SKILL_ROWS_SQL, extractions, postings, query, skill_rows, table)

CATS = vocab.SKILL_CATEGORIES


@query("p01_get_path", """
SELECT o_orderkey, coalesce(o_orderstatus, 'unknown') AS ai_type,
  coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, 'N/A') AS stage FROM orders""")
def get_path(spark, sf):
    nested = table(spark, sf, "orders").select(
        "o_orderkey", F.struct(F.struct(F.col("o_orderstatus").alias("type")).alias("ai_type")).alias("position"),
        F.struct(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("stage")).alias("company"))
    return nested.select("o_orderkey", access.get_path("position.ai_type.type", "unknown").alias("ai_type"),
                         access.get_path("company.stage", "N/A").alias("stage"))


@query("p02_url_tail_id", r"""
SELECT page_id, coalesce(nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$'), ''), 'unknown') AS job_id,
  regexp_extract(url, '[^/]*$') AS link_id FROM pages""")
def url_tail_id(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", text.url_tail_id("url").alias("job_id"), text.link_tail_id("url").alias("link_id"))


def _joined(column, alias):
    return F.array_join(column, "|").alias(alias)


_BY_CATEGORY = ", ".join(
    f"coalesce(string_agg(skill, '|' ORDER BY pos) FILTER (category = '{c}'), '') AS {c}" for c in CATS)


@query("p03_flat_to_nested", f"""
WITH {POSTING_SQL}
SELECT d.doc_id::VARCHAR AS job_id, title, kind AS ai_type, company, stage, customer_facing, management, {_BY_CATEGORY}
FROM d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY ALL""")
def flat_to_nested(spark, sf):
    nested = postings(spark, sf)
    return nested.select(
        "meta.job_id", "position.title", F.col("position.ai_type.type").alias("ai_type"),
        F.col("company.name").alias("company"), "company.stage",
        F.col("position.is_customer_facing").alias("customer_facing"),
        F.col("position.is_management").alias("management"),
        *[_joined(F.col(f"position.skills.{c}"), c) for c in CATS])


_PARTS = ", ".join(
    f"coalesce(string_agg(skill, '|' ORDER BY l_linenumber, skill) FILTER (category = '{c}'), '') AS {c}" for c in PART_TYPES)


@query("p03_nest_rows", f"WITH {SKILL_ROWS_SQL} SELECT l_orderkey, 0 AS part, {_PARTS} FROM s GROUP BY l_orderkey")
def nest_rows(spark, sf):
    nested = nesting.nest_rows(skill_rows(spark, sf), "l_orderkey", "category", "skill", ["l_linenumber"], PART_TYPES)
    return nested.select("l_orderkey", "part", *[_joined(F.col(c), c) for c in PART_TYPES])


@query("p03_nest_rows_parts", f"""
WITH {SKILL_ROWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, category, skill) AS nth FROM s)
SELECT l_orderkey, ((nth - 1) // 3)::INTEGER AS part, {_PARTS} FROM r GROUP BY 1, 2""")
def nest_rows_parts(spark, sf):
    nested = nesting.nest_rows(skill_rows(spark, sf), "l_orderkey", "category", "skill", ["l_linenumber"], PART_TYPES, part_size=3)
    return nested.select("l_orderkey", "part", *[_joined(F.col(c), c) for c in PART_TYPES])


@query("p04_flat_to_nested_summary", f"""
WITH {POSTING_SQL}
SELECT d.doc_id, count(skill) AS count, coalesce(string_agg(skill, '|' ORDER BY pos), '') AS all_skills,
  {_BY_CATEGORY} FROM d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY d.doc_id""")
def flat_to_nested_summary(spark, sf):
    rows = extractions(spark, sf).select("doc_id", nesting.skills_summary("skills").alias("s"))
    return rows.select("doc_id", F.col("s.count").cast("long").alias("count"), _joined(F.col("s.all"), "all_skills"),
                       *[_joined(F.col(f"s.by_category.{c}"), c) for c in CATS])


_CAT_ORDER = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATS)) + " END"


@query("p05_flatten_skills", f"""
WITH {POSTING_SQL}
SELECT d.doc_id::VARCHAR AS job_id, coalesce(string_agg(lower(skill), '|' ORDER BY {_CAT_ORDER}, pos), '') AS skills
FROM d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY d.doc_id""")
def flatten_skills(spark, sf):
    return postings(spark, sf).select("meta.job_id", _joined(access.flatten_skills("position.skills", CATS), "skills"))


@query("p06_select_reorder", """
SELECT l_linestatus AS status, CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
  l_returnflag, '' AS compensation FROM (SELECT *, l_linestatus FROM lineitem)""")
def select_reorder(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_linestatus", "status")
    return access.select_reorder(rows, ["status", "l_orderkey", "l_linenumber", "l_returnflag", "compensation"])


@query("p07_truncate_preview", """
SELECT doc_id, substr(text, 1, 80) || '...' AS preview, substr(text, 1, 30) AS head FROM documents""")
def truncate_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate_preview("text", 80).alias("preview"),
                                                text.truncate_preview("text", 30, "").alias("head"))


@query("p08_array_head", f"""
WITH {POSTING_SQL}
SELECT d.doc_id, coalesce(string_agg(skill, '|' ORDER BY pos) FILTER (rn <= 5), '') AS first_5
FROM d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM w) w ON d.doc_id = w.doc_id
GROUP BY d.doc_id""")
def array_head(spark, sf):
    return extractions(spark, sf).select(
        "doc_id", _joined(access.array_head(F.transform("skills", lambda s: s.getField("name")), 5), "first_5"))


@query("p09_text_bundle", """
SELECT doc_id, length(b) AS n, md5(b) AS digest FROM (
  SELECT doc_id, lower(concat_ws(' ', source, array_to_string(string_split(text, chr(10)), ' '), lang)) AS b FROM documents)""")
def text_bundle(spark, sf):
    bundle = text.text_bundle("source", F.split("text", "\n"), "lang")
    return table(spark, sf, "documents").select("doc_id", bundle.alias("b")).select(
        "doc_id", F.length("b").cast("long").alias("n"), F.md5("b").alias("digest"))


@query("p10_compose_location", """
SELECT n_nationkey, concat_ws(', ', CASE WHEN n_name <> 'NATION_3' THEN n_name END, CASE WHEN r_name <> 'ASIA' THEN r_name END) AS location
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def compose_location(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    both = nation.join(region, nation.n_regionkey == region.r_regionkey)
    city = F.when(F.col("n_name") == "NATION_3", "").otherwise(F.col("n_name"))
    country = F.when(F.col("r_name") == "ASIA", "").otherwise(F.col("r_name"))
    return both.select("n_nationkey", text.compose_location(city, country).alias("location"))


@query("p11_stamp_source", """
SELECT event_id, event_type, 'board' AS source, 'main' AS site, '2026-01-15 08:00:00' AS scraped_at FROM events""")
def stamp_source(spark, sf):
    stamped = access.stamp_source(table(spark, sf, "events").select("event_id", "event_type"),
                                  at=F.lit("2026-01-15 08:00:00").cast("timestamp"), source="board", site="main")
    return stamped.withColumn("scraped_at", F.col("scraped_at").cast("string"))


@query("p12_with_defaults", """
SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic,
  coalesce(CASE WHEN quality = 1 THEN 'good' END, 'Unknown') AS grade
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def with_defaults(spark, sf):
    labels = table(spark, sf, "labels").withColumn("grade", F.when(F.col("quality") == 1, "good"))
    joined = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return access.with_defaults(joined, {"quality": -1, "toxic": 0, "grade": "Unknown"})


@query("p13_drop_empty_fields", """
SELECT c_custkey, '{"c_name":"' || c_name || '"' || CASE WHEN c_mktsegment <> 'BUILDING' THEN ',"segment":"' || c_mktsegment || '"' ELSE '' END
  || ',"note":""}' AS record FROM customer""")
def drop_empty_fields(spark, sf):
    rows = table(spark, sf, "customer").withColumns({
        "segment": F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")), "note": F.lit("")})
    return rows.select("c_custkey", access.drop_empty_fields("c_name", "segment", "note", keep=("note",)).alias("record"))


@query("p14_explode_with_source", """
SELECT doc_id, source AS company, lang AS ai_type, pos - 1 AS pos, item FROM (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS item,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)""")
def explode_with_source(spark, sf):
    rows = nesting.explode_with_source(table(spark, sf, "documents"), F.split("text", "\n"), [
        "doc_id", F.col("source").alias("company"), F.col("lang").alias("ai_type")])
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query("p15_normalize_postings", """
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderpriority AS title, o_orderstatus AS ai_type,
  'use ' || o_orderkey AS use_cases, o_orderpriority || '|x' AS genai, false AS management FROM orders""")
def normalize_postings(spark, sf):
    """Orders of status O arrive in the older layout, all others in the live one."""
    from postloom import schemas
    from pyspark.sql import types as T

    def nested(schema: T.StructType, values: dict, prefix=""):
        fields = []
        for f in schema:
            path = prefix + f.name
            if isinstance(f.dataType, T.StructType):
                inner = nested(f.dataType, values, path + ".")
                part_of_old = prefix == "" and f.name in ("skills", "ai_type")
                part_of_new = prefix == "" and f.name in ("position", "meta")
                if part_of_old:
                    inner = F.when(old, inner)
                elif part_of_new:
                    inner = F.when(~old, inner)
                fields.append(inner.alias(f.name))
            else:
                fields.append(values.get(path, F.lit(None)).cast(f.dataType).alias(f.name))
        return F.struct(*fields)

    orders = table(spark, sf, "orders")
    old = F.col("o_orderstatus") == "O"
    key, title = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    use = F.concat(F.lit("use "), key)
    skills = F.array(title, F.lit("x"))
    values = {
        "company.use_cases": F.when(old, use), "position.title": title, "position.ai_type.type": F.col("o_orderstatus"),
        "position.use_cases": F.array(use), "position.skills.genai": skills, "meta.job_id": key,
        "job_id": F.when(old, key), "title": F.when(old, title), "ai_type.type": F.col("o_orderstatus"),
        "skills.by_category.genai": skills}
    both = orders.select(nested(schemas.EITHER_GENERATION, values).alias("r")).select("r.*")
    live = nesting.normalize_postings(both)
    return live.select("meta.job_id", "position.title", F.col("position.ai_type.type").alias("ai_type"),
                       _joined(F.col("position.use_cases"), "use_cases"), _joined(F.col("position.skills.genai"), "genai"),
                       F.col("position.is_management").alias("management"))
