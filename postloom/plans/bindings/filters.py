"""F-family."""

from pyspark.sql import functions as F

from postloom.functions import predicates as P
from postloom.functions.text import contains_all, contains_any, words
from postloom.operators.counts import value_counts
from postloom.plans.bindings.common import POSTING_SQL, SKILL_ROWS_SQL, any_sql, extractions, query, skill_rows, table


@query("f01_differs", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'")
def differs(spark, sf):
    return table(spark, sf, "customer").filter(P.differs("c_mktsegment", "BUILDING")).select("c_custkey", "c_mktsegment")


@query("f02_regex_contains", r"SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'o.*d\s+r')")
def regex_contains(spark, sf):
    return table(spark, sf, "part").filter(P.matches("p_name", r"o.*d\s+r")).select("p_partkey", "p_name")


@query("f03_substring_and", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'old') AND contains(lower(p_name), 'ring')")
def substring_and(spark, sf):
    return table(spark, sf, "part").filter(contains_all("p_name", ["old", "ring"])).select("p_partkey", "p_name")


@query("f04_substring_or", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget') OR contains(lower(p_name), 'hot')")
def substring_or(spark, sf):
    return table(spark, sf, "part").filter(contains_any("p_name", ["widget", "hot"])).select("p_partkey", "p_name")


@query("f05_any_keyword", f"SELECT doc_id FROM documents WHERE {any_sql('lower(text)', ['rag', 'license', 'data', '@'])}")
def any_keyword(spark, sf):
    return table(spark, sf, "documents").filter(contains_any("text", ["rag", "license", "data", "@"])).select("doc_id")


@query("f06_array_size", f"""
WITH {POSTING_SQL}, c AS (SELECT d.doc_id, count(skill) AS n FROM d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY 1)
SELECT doc_id::VARCHAR AS job_id, n AS n_skills, n <= 1 AS few, n >= 2 AS pairable, n > 0 AS some FROM c""")
def array_size(spark, sf):
    rows = extractions(spark, sf)
    return rows.select("job_id", F.size("skills").cast("long").alias("n_skills"), P.size_is("skills", "<=", 1).alias("few"),
                       P.size_is("skills", ">=", 2).alias("pairable"), P.size_is("skills", ">", 0).alias("some"))


@query("f07_flag", """SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(quality = 1, false)""")
def flag(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.filter(P.truthy("quality")).select("doc_id")


@query("f08_required_fields", "SELECT doc_id FROM documents WHERE length(coalesce(trim(text), '')) > 0 AND length(coalesce(source, '')) > 0")
def required_fields(spark, sf):
    return table(spark, sf, "documents").filter(P.has_text(F.trim("text"), "source")).select("doc_id")


@query("f09_split_by_presence", f"""
WITH {SKILL_ROWS_SQL}, k AS (SELECT l_orderkey, bool_or(category = 'PROMO') AS has_promo FROM s GROUP BY 1)
SELECT has_promo, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM k)::DOUBLE AS pct FROM k GROUP BY 1""")
def split_by_presence(spark, sf):
    from postloom.operators.counts import share_of_total

    per_key = skill_rows(spark, sf).groupBy("l_orderkey").agg(F.bool_or(F.col("category") == "PROMO").alias("has_promo"))
    return share_of_total(per_key.groupBy("has_promo").agg(F.count(F.lit(1)).alias("n")))


@query("f10_clean_token", r"""
SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS w FROM documents)
WHERE length(w) > 1 AND length(w) < 40 AND NOT contains(lower(w), 'the') AND NOT contains(lower(w), 'tion') GROUP BY doc_id""")
def clean_token(spark, sf):
    tokens = table(spark, sf, "documents").select("doc_id", F.explode(words("text")).alias("w"))
    kept = tokens.filter(P.clean_token("w", longer_than=1, shorter_than=40, deny=["the", "tion"]))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("f11_group_threshold", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 15")
def group_threshold(spark, sf):
    return value_counts(table(spark, sf, "part"), ["p_brand", "p_type"], min_count=15)


@query("f12_first_rows", "SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 25")
def first_rows(spark, sf):
    return P.first_rows(table(spark, sf, "pages"), 25, "url", "page_id").select("page_id", "url")


@query("f13_date_window", """
WITH a AS (SELECT max(ts)::DATE AS anchor FROM events)
SELECT event_type, count(*) AS n FROM events, a WHERE ts::DATE > anchor - 28 AND ts::DATE <= anchor GROUP BY 1""")
def date_window(spark, sf):
    events = table(spark, sf, "events")
    anchor = events.agg(F.max("ts").cast("date")).scalar()
    return events.filter(P.in_window("ts", anchor, 28)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("f13_quarter_range", """
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-04-01' GROUP BY 1""")
def quarter_range(spark, sf):
    rows = table(spark, sf, "orders").filter(P.between_months("o_orderdate", "1997-10-01", "1998-03-31"))
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("f14_relevant", f"""SELECT doc_id FROM documents
WHERE {any_sql('lower(text)', ['rag', 'data', 'the'])} AND NOT {any_sql('lower(text)', ['license', '@'])}""")
def relevant(spark, sf):
    return table(spark, sf, "documents").filter(P.relevant("text", ["rag", "data", "the"], ["license", "@"])).select("doc_id")


@query("f15_keep_listed", """
SELECT doc_id, count(*) AS n, string_agg(w, '|' ORDER BY pos) AS kept FROM (
  SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w, unnest(range(1, len(string_split_regex(text, '\\s+')) + 1)) AS pos
  FROM documents) WHERE w IN ('the', 'la', 'und', 'que', 'of') GROUP BY doc_id""")
def keep_listed(spark, sf):
    kept = table(spark, sf, "documents").select("doc_id", P.keep_listed(F.split("text", r"\s+"), ["the", "la", "und", "que", "of"]).alias("k"))
    return kept.filter(F.size("k") > 0).select("doc_id", F.size("k").cast("long").alias("n"), F.array_join("k", "|").alias("kept"))
