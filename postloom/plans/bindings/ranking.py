"""W, T and U families."""

from pyspark.sql import functions as F

from postloom.functions.access import row_count
from postloom.functions.predicates import first_rows
from postloom.functions.text import contains_any, words
from postloom.operators import counts, html, ranking, setops
from postloom.plans.bindings.common import (
    POSTING_SQL, SKILL_ROWS_SQL, TYPED_SKILL_ROWS_SQL, any_sql, extractions, query, skill_rows, table, typed_skill_rows)


@query("w01_top_k_per_group", f"""
WITH {SKILL_ROWS_SQL}, c AS (SELECT category, skill, count(*) AS n FROM s GROUP BY ALL)
SELECT category, skill, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, skill) AS rank FROM c) WHERE rank <= 10""")
def top_k_per_group(spark, sf):
    n = counts.category_item_counts(skill_rows(spark, sf))
    return ranking.top_k_per_group(n, ["category"], 10, [F.col("n").desc(), F.col("skill").asc()], rank="rank")


@query("w02_enumerate_rows", "SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations")
def enumerate_rows(spark, sf):
    return ranking.number_rows(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])


@query("w02_enumerate_within_group", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events")
def enumerate_within_group(spark, sf):
    return ranking.number_rows(table(spark, sf, "events").select("event_type", "event_id"), ["event_id"], group=["event_type"])


@query("w03_first_per_group", "SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1")
def first_per_group(spark, sf):
    return ranking.first_per_group(table(spark, sf, "conversations"), ["conv_id"], "turn", "text")


@query("w04_first_n_matching", f"SELECT doc_id, source FROM documents WHERE {any_sql('lower(text)', ['license', 'rag'])} ORDER BY doc_id LIMIT 5")
def first_n_matching(spark, sf):
    hits = table(spark, sf, "documents").filter(contains_any("text", ["license", "rag"])).select("doc_id", "source")
    return first_rows(hits, 5, "doc_id")


@query("t01_top_k", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 15")
def top_k(spark, sf):
    return counts.value_counts(table(spark, sf, "part"), "p_name", top=15)


@query("t02_sort_by_group_size", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand")
def sort_by_group_size(spark, sf):
    return ranking.order_by_size(counts.value_counts(table(spark, sf, "part"), "p_brand"), "n", "p_brand")


@query("t03_sort_by_share", """
SELECT o_orderpriority, count(*) AS n, 100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE AS pct FROM orders GROUP BY 1 ORDER BY pct, 1""")
def sort_by_share(spark, sf):
    rows = counts.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F"])
    return ranking.order_by_share(rows.select("o_orderpriority", "n", (F.lit(100.0) * F.col("n_f") / F.col("n")).alias("pct")), "pct", "o_orderpriority")


@query("t04_sort_by_nested_sum", f"""
WITH {TYPED_SKILL_ROWS_SQL} SELECT skill, count(*) FILTER (kind = 'F') AS n_f, count(*) FILTER (kind = 'O') AS n_o, count(*) FILTER (kind = 'P') AS n_p,
  count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, skill""")
def sort_by_nested_sum(spark, sf):
    return ranking.order_by_size(counts.crosstab(typed_skill_rows(spark, sf), "skill", "kind", ["F", "O", "P"]), "n", "skill")


_SIZES = f"WITH {POSTING_SQL}, k AS (SELECT d.doc_id, count(skill)::INTEGER AS list_size FROM d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY 1)"


@query("t05_largest_lists", f"{_SIZES} SELECT doc_id, list_size FROM k ORDER BY list_size DESC, doc_id LIMIT 3")
def largest_lists(spark, sf):
    return ranking.largest_lists(extractions(spark, sf), F.size("skills"), "doc_id").select("doc_id", "list_size")


@query("t05_short_lists", f"{_SIZES} SELECT doc_id, list_size FROM k WHERE list_size <= 2 ORDER BY doc_id LIMIT 3")
def short_lists(spark, sf):
    return ranking.largest_lists(extractions(spark, sf), F.size("skills"), "doc_id", at_most=2).select("doc_id", "list_size")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("u01_union_sites", "SELECT c_custkey, c_mktsegment AS site, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS note FROM customer "
       "WHERE c_mktsegment IN (" + ", ".join(f"'{s}'" for s in SEGMENTS) + ")")
def union_sites(spark, sf):
    customer = table(spark, sf, "customer")
    parts = []
    for s in SEGMENTS:
        part = customer.filter(F.col("c_mktsegment") == s).select("c_custkey", F.lit(s).alias("site"))
        if s == "BUILDING":
            part = customer.filter(F.col("c_mktsegment") == s).select("c_custkey", F.lit(s).alias("site"), F.col("c_name").alias("note"))
        parts.append(part)
    return setops.union_sites(parts)


@query("u02_distinct_links", """SELECT DISTINCT link FROM (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages)""")
def distinct_links(spark, sf):
    return setops.distinct_links(table(spark, sf, "pages").select(F.explode(html.links("html")).alias("link")), "link")


@query("u03_distinct_ordered_items", """
WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: length(x) > 0) AS toks FROM documents),
  p AS (SELECT doc_id, unnest(toks) AS w, unnest(range(1, len(toks) + 1)) AS pos FROM t),
  f AS (SELECT doc_id, w, min(pos) AS pos FROM p GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM f)
SELECT doc_id, string_agg(w, '|' ORDER BY pos) AS items FROM r WHERE rn <= 10 GROUP BY doc_id""")
def distinct_ordered_items(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(setops.distinct_ordered_items(words("text"), 10), "|").alias("items"))


@query("u04_difference", """
WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM conversations) WHERE length(word) > 3 GROUP BY 1)
SELECT * FROM c WHERE word NOT IN (SELECT unnest(string_split_regex(lower(text), '\\s+')) FROM benchmark)""")
def difference(spark, sf):
    words_of = lambda name: table(spark, sf, name).select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    n = counts.value_counts(words_of("conversations").filter(F.length("word") > 3), "word")
    return setops.difference(n, words_of("benchmark").distinct(), "word")


@query("u05_partition_in_two", f"SELECT in_first, count(*) AS n FROM (SELECT {any_sql('lower(text)', ['rag', 'data'])} AS in_first FROM documents) GROUP BY 1")
def partition_in_two(spark, sf):
    rows = setops.partition_in_two(table(spark, sf, "documents"), contains_any("text", ["rag", "data"]))
    return rows.groupBy("in_first").agg(row_count().alias("n"))


@query("u06_merge_skills", f"""
WITH {POSTING_SQL}, b AS (SELECT doc_id, skill, min(pos) AS pos FROM w GROUP BY ALL),
  e AS (SELECT doc_id, company AS skill, 1000000 AS pos FROM d)
SELECT doc_id, count(*) AS skills_count, string_agg(skill, '|' ORDER BY pos) AS skills FROM (SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY 1""")
def merge_skills(spark, sf):
    names = F.transform("skills", lambda s: s.getField("name"))
    rows = extractions(spark, sf).select("doc_id", setops.merge_skills(names, F.array("company")).alias("m"))
    return rows.select("doc_id", F.col("m.skills_count").cast("long").alias("skills_count"), F.array_join("m.skills", "|").alias("skills"))
