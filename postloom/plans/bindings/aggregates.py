"""A-family."""

from pyspark.sql import functions as F

from postloom.functions import tables
from postloom.functions.access import row_count
from postloom import vocab
from postloom.functions.predicates import matches
from postloom.functions.taxonomy import bucket_contains
from postloom.functions.text import contains_all
from postloom.operators import cooccur, counts, ranking
from postloom.operators.setops import dedup_keep_first
from postloom.plans.bindings.common import (
    PART_TYPES, POSTING_SQL, SKILL_ROWS_SQL, STATUSES, TYPED_SKILL_ROWS_SQL, extractions, first_match_sql, lit_sql, query,
    skill_rows, table, typed_skill_rows)
from postloom.plans.bindings.rules import PRIORITIES
from postloom.session import scratch_path


@query("a01_value_counts", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def value_counts(spark, sf):
    return counts.value_counts(table(spark, sf, "customer"), "c_mktsegment")


@query("a02_match_rate", r"""SELECT avg((contains(lower(p_name), 'old') AND contains(lower(p_name), 'ring'))::INT)::DOUBLE AS both,
  avg(regexp_matches(lower(p_name), 'o.*ring')::INT)::DOUBLE AS loose, avg(regexp_matches(lower(p_name), 'old\s+ring')::INT)::DOUBLE AS strict FROM part""")
def match_rate(spark, sf):
    return counts.match_rate(table(spark, sf, "part"), both=contains_all("p_name", ["old", "ring"]),
                             loose=matches("p_name", "o.*ring"), strict=matches("p_name", r"old\s+ring"))


@query("a03_distinct_count", "SELECT count(DISTINCT o_custkey) AS n_o_custkey, count(DISTINCT o_orderpriority) AS n_o_orderpriority FROM orders")
def distinct_count(spark, sf):
    return counts.distinct_count(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query("a03_distinct_sketches", """
SELECT year(o_orderdate)::INT AS year, count(DISTINCT o_custkey) AS n_exact, true AS within FROM orders GROUP BY 1""")
def distinct_sketches(spark, sf):
    # Sketches per month are stored in two runs, as months come; years are merged from them and held against the exact counts at 6 %.
    months = table(spark, sf, "orders").withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})
    path = scratch_path(spark, "sketches")
    for part in (F.col("month") <= 6, F.col("month") > 6):
        counts.distinct_sketches(months.filter(part), ["year", "month"], "o_custkey").write.mode("append").parquet(path)
    about = counts.merged_distinct(spark.read.parquet(path), ["year"])
    exact = months.groupBy("year").agg(F.countDistinct("o_custkey").alias("n_exact"))
    off = F.abs(F.col("n_about") - F.col("n_exact"))
    return exact.join(about, "year").select("year", "n_exact", (off <= 0.06 * F.col("n_exact")).alias("within"))


@query("a04_composite_counts", "SELECT p_name || ' ' || p_brand AS value, count(*) AS n FROM part GROUP BY 1")
def composite_counts(spark, sf):
    return counts.composite_counts(table(spark, sf, "part"), "p_name", "p_brand")


@query("a05_dedup_keep_first", """
SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM (
  SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup(spark, sf):
    kept = dedup_keep_first(table(spark, sf, "documents"), ["text", "lang"], "doc_id")
    return kept.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))


@query("a06_category_item_counts", f"WITH {SKILL_ROWS_SQL} SELECT category, skill, count(*) AS n FROM s GROUP BY ALL")
def category_item_counts(spark, sf):
    return counts.category_item_counts(skill_rows(spark, sf))


@query("a07_category_item_counts_excluding", f"""
WITH {TYPED_SKILL_ROWS_SQL} SELECT category, skill, count(*) AS n FROM t WHERE kind = 'F' AND category <> 'PROMO' GROUP BY ALL""")
def category_item_counts_excluding(spark, sf):
    rows = typed_skill_rows(spark, sf).filter(F.col("kind") == "F")
    return counts.category_item_counts(rows, without=["PROMO"])


@query("a08_crosstab", "SELECT o_orderpriority, count(*) AS n, " + ", ".join(
    f"count(*) FILTER (o_orderstatus = '{k}') AS n_{k.lower()}" for k in STATUSES) + " FROM orders GROUP BY 1")
def crosstab(spark, sf):
    return counts.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", STATUSES)


@query("a09_flag_counts", """
SELECT count(*) AS n_total, count(*) FILTER (quality = 1) AS n_quality, count(*) FILTER (toxic = 1) AS n_toxic,
  count(*) FILTER (quality = 1 AND toxic = 1) AS n_both FROM labels""")
def flag_counts(spark, sf):
    q, x = F.col("quality") == 1, F.col("toxic") == 1
    return counts.flag_counts(table(spark, sf, "labels"), {"n_quality": q, "n_toxic": x, "n_both": q & x})


TERMS = ["widget", "ring", "OLD", "plate"]


@query("a10_postings_with_item", f"""
WITH {TYPED_SKILL_ROWS_SQL}, k AS (SELECT kind, l_orderkey, {', '.join(f"bool_or(contains(lower(skill), '{t.lower()}')) AS f{i}" for i, t in enumerate(TERMS))} FROM t GROUP BY ALL)
""" + " UNION ALL ".join(
    [f"SELECT kind, '{t}' AS term, count(*) FILTER (f{i}) AS n, count(*) AS n_total FROM k GROUP BY kind" for i, t in enumerate(TERMS)]
    + [f"SELECT kind, 'any' AS term, count(*) FILTER ({' OR '.join(f'f{i}' for i in range(len(TERMS)))}) AS n, count(*) AS n_total FROM k GROUP BY kind"]))
def postings_with_item(spark, sf):
    return counts.keys_with_term(typed_skill_rows(spark, sf), ["l_orderkey"], "skill", TERMS, by=["kind"])


@query("a10_postings_with_item_arrays", f"""
WITH {POSTING_SQL}, k AS (SELECT d.doc_id, d.kind, {', '.join(f"coalesce(bool_or(contains(lower(skill), '{t}')), false) AS f{i}" for i, t in enumerate(['tion', 'rag', 'ment']))}
  FROM d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY ALL)
""" + " UNION ALL ".join(
    [f"SELECT kind AS ai_type, '{t}' AS term, count(*) FILTER (f{i}) AS n, count(*) AS n_total FROM k GROUP BY kind" for i, t in enumerate(["tion", "rag", "ment"])]
    + ["SELECT kind AS ai_type, 'any' AS term, count(*) FILTER (f0 OR f1 OR f2) AS n, count(*) AS n_total FROM k GROUP BY kind"]))
def postings_with_item_arrays(spark, sf):
    lowered = F.transform("skills", lambda s: F.lower(s.getField("name")))
    return counts.postings_with_term(extractions(spark, sf), lowered, ["tion", "rag", "ment"], by=["ai_type"])


@query("a11_pair_counts", f"""
WITH {POSTING_SQL}, u AS (SELECT DISTINCT doc_id, skill FROM w)
SELECT x.skill AS a, y.skill AS b, count(*) AS n FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.skill < y.skill GROUP BY ALL HAVING count(*) >= 2""")
def pair_counts(spark, sf):
    return cooccur.pair_counts(extractions(spark, sf), F.transform("skills", lambda s: s.getField("name")), min_count=2)


@query("a11_pair_counts_rows", f"""
WITH {SKILL_ROWS_SQL}, u AS (SELECT DISTINCT l_orderkey, skill FROM s)
SELECT x.skill AS a, y.skill AS b, count(*) AS n FROM u x JOIN u y ON x.l_orderkey = y.l_orderkey AND x.skill < y.skill GROUP BY ALL HAVING count(*) >= 50""")
def pair_counts_rows(spark, sf):
    return cooccur.pair_counts_rows(skill_rows(spark, sf), "l_orderkey", "skill", min_count=50)


_ORD = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(PART_TYPES)) + " END"


@query("a12_category_pair_crosstab", f"""
WITH {TYPED_SKILL_ROWS_SQL}, u AS (SELECT DISTINCT l_orderkey, kind, category, {_ORD} AS o FROM t)
SELECT x.category AS first, y.category AS second, x.kind, count(*) AS n FROM u x JOIN u y ON x.l_orderkey = y.l_orderkey AND x.o < y.o GROUP BY ALL""")
def category_pair_crosstab(spark, sf):
    per_key = typed_skill_rows(spark, sf).groupBy("l_orderkey", "kind").agg(*[F.bool_or(F.col("category") == c).alias(c) for c in PART_TYPES])
    present = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in PART_TYPES]))
    return cooccur.category_pairs(per_key, present, "kind")


LISTED = ["old ring", "hot gear", "red widget", "blue bolt", "small rod", "new plate"]
_LISTED = ", ".join(lit_sql(x) for x in LISTED)


@query("a13_listed_totals", f"WITH {SKILL_ROWS_SQL} SELECT skill, count(*) AS n FROM s WHERE skill IN ({_LISTED}) GROUP BY 1")
def listed_totals(spark, sf):
    return cooccur.listed_totals(skill_rows(spark, sf), "skill", LISTED)


@query("a13_listed_pairs", f"""
WITH {SKILL_ROWS_SQL}, u AS (SELECT DISTINCT l_orderkey, skill FROM s WHERE skill IN ({_LISTED}))
SELECT x.skill AS a, y.skill AS b, count(*) AS n FROM u x JOIN u y ON x.l_orderkey = y.l_orderkey AND x.skill < y.skill GROUP BY ALL""")
def listed_pairs(spark, sf):
    listed = skill_rows(spark, sf).filter(F.col("skill").isin(*LISTED))
    return cooccur.pair_counts_rows(listed, "l_orderkey", "skill")


_STOP = ", ".join(lit_sql(w) for w in vocab.USE_CASE_STOP_WORDS)


@query("a14_word_frequency", f"""
SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents)
WHERE length(word) > 3 AND word NOT IN ({_STOP}) GROUP BY 1 ORDER BY n DESC, word LIMIT 30""")
def word_frequency(spark, sf):
    return counts.word_frequency(table(spark, sf, "documents"), "text", stop_words=vocab.USE_CASE_STOP_WORDS)


@query("a14_word_table", """
SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents) WHERE length(word) > 3 GROUP BY ALL""")
def word_table(spark, sf):
    return tables.words_by(table(spark, sf, "documents"), "text", "lang")


@query("a14_word_table_sql", f"""
SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents)
WHERE length(word) > 3 AND word NOT IN ({_STOP}) GROUP BY 1 ORDER BY n DESC, word LIMIT 30""")
def word_table_sql(spark, sf):
    tables.register(spark)
    return spark.sql(f"""
SELECT word, sum(n) AS n FROM tokenize(TABLE(SELECT pmod(xxhash64(doc_id), 64) AS part, text FROM {{docs}}) PARTITION BY part, text => 'text',
  keep => 'part', longer_than => 3) WHERE word NOT IN ({_STOP}) GROUP BY word ORDER BY n DESC, word LIMIT 30""", docs=table(spark, sf, "documents"))


@query("a15_group_items", """
WITH p AS (SELECT p_brand, p_name, count(*) AS c FROM part GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS rn FROM p)
SELECT p_brand, sum(c)::BIGINT AS n, count(*) AS n_distinct, string_agg(p_name, '|' ORDER BY p_name) FILTER (rn <= 5) AS samples FROM r GROUP BY 1""")
def group_items(spark, sf):
    return counts.group_items(table(spark, sf, "part"), "p_brand", "p_name", 5).withColumn("samples", F.array_join("samples", "|"))


@query("a16_bucketed_item_counts", f"""
WITH {TYPED_SKILL_ROWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, category ORDER BY l_linenumber, skill) AS rn,
  {first_match_sql(PRIORITIES, 'stage')} AS bucket FROM t)
SELECT bucket, skill, count(*) AS n FROM r WHERE rn <= 10 AND bucket IS NOT NULL GROUP BY ALL""")
def bucketed_item_counts(spark, sf):
    rows = typed_skill_rows(spark, sf).withColumn("bucket", bucket_contains("stage", PRIORITIES)).filter(F.col("bucket").isNotNull())
    head = ranking.top_k_per_group(rows, ["l_orderkey", "category"], 10, [F.col("l_linenumber"), F.col("skill")])
    return head.groupBy("bucket", "skill").agg(row_count().alias("n"))


@query("a16_bucketed_item_counts_arrays", f"""
WITH {POSTING_SQL}, r AS (SELECT w.*, stage, row_number() OVER (PARTITION BY w.doc_id, category ORDER BY pos) AS rn FROM w JOIN d ON d.doc_id = w.doc_id),
  b AS (SELECT *, {first_match_sql(vocab.STAGE_BUCKETS, 'stage')} AS bucket FROM r)
SELECT bucket, skill, count(*) AS n FROM b WHERE rn <= 10 AND bucket IS NOT NULL GROUP BY ALL""")
def bucketed_item_counts_arrays(spark, sf):
    from postloom.plans.bindings.common import postings

    return counts.bucketed_item_counts(postings(spark, sf), bucket_contains("company.stage", vocab.STAGE_BUCKETS),
                                       "position.skills", vocab.SKILL_CATEGORIES)


@query("a17_share_of_total", """
SELECT o_orderstatus, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM orders)::DOUBLE AS pct FROM orders GROUP BY 1""")
def share_of_total(spark, sf):
    return counts.share_of_total(counts.value_counts(table(spark, sf, "orders"), "o_orderstatus"))


@query("a18_title_term_rates", " UNION ALL ".join(
    f"""SELECT p_type, '{t}' AS term, count(*) AS n_total, count(*) FILTER (contains(lower(p_name), '{t}')) AS n,
  100.0 * count(*) FILTER (contains(lower(p_name), '{t}')) / count(*)::DOUBLE AS pct FROM part GROUP BY 1""" for t in ["old", "ring", "red", "ai", "widget"]))
def title_term_rates(spark, sf):
    return counts.term_rates(table(spark, sf, "part"), "p_name", ["old", "ring", "red", "ai", "widget"], ["p_type"])


@query("a19_grand_and_by_type_totals", """
SELECT CASE WHEN grouping(lang) = 1 THEN '(all)' ELSE lang END AS lang, sum(len(string_split(text, chr(10))))::BIGINT AS n FROM documents GROUP BY GROUPING SETS ((lang), ())""")
def totals_by_type(spark, sf):
    return counts.totals_by_type(table(spark, sf, "documents"), "lang", F.size(F.split("text", "\n")))


@query("a20_run_tally", """
SELECT CASE WHEN n_chars < 100 THEN 'failed' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped' ELSE lang END AS status, count(*) AS n FROM documents GROUP BY 1""")
def run_tally(spark, sf):
    done = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("done"))
    rows = table(spark, sf, "documents").join(done, "doc_id", "left")
    status = F.when(F.col("n_chars") < 100, "failed").when(F.col("done"), "skipped").otherwise(F.col("lang"))
    return counts.run_tally(rows.withColumn("status", status), "status")["status"]


@query("a20_first_errors", """
SELECT error FROM (SELECT 'order ' || o_orderkey || ': ' || o_orderstatus AS error FROM orders WHERE o_orderstatus = 'P') ORDER BY error LIMIT 5""")
def first_errors(spark, sf):
    error = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(": "), F.col("o_orderstatus")))
    return counts.run_tally(table(spark, sf, "orders").withColumn("error", error), "o_orderstatus", errors="error")["errors"]


@query("a21_profile_summary", """
WITH l AS (SELECT 'location' AS section, CAST(c_nationkey AS VARCHAR) AS key, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 10),
  c AS (SELECT 'company' AS section, c_mktsegment AS key, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 10)
SELECT 'summary' AS section, 'total' AS key, count(*) AS n FROM customer UNION ALL SELECT 'summary', 'companies', count(DISTINCT c_mktsegment) FROM customer
UNION ALL SELECT 'summary', 'locations', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT * FROM l UNION ALL SELECT * FROM c""")
def profile_summary(spark, sf):
    return counts.profile_summary(table(spark, sf, "customer"), "c_mktsegment", "c_nationkey")


@query("a22_exclusive_items", """
SELECT p_type, p_name, rank::INTEGER AS rank FROM (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_name) AS rank
  FROM (SELECT DISTINCT p_type, p_name FROM part)) WHERE rank <= 30""")
def exclusive_items(spark, sf):
    return counts.exclusive_items(table(spark, sf, "part"), "p_type", "p_name", 30)


@query("a23_quality_checks", f"""
WITH {POSTING_SQL}, k AS (SELECT d.doc_id, d.kind, d.lang, count(skill) AS c FROM d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY ALL)
SELECT 'skills_10_to_50' AS rule, count(*) FILTER (NOT (c BETWEEN 10 AND 50)) AS n_failed, count(*) AS n_total FROM k
UNION ALL SELECT 'class_agrees', count(*) FILTER (NOT ((lang = 'en') = (kind = 'ai-first'))), count(*) FROM k""")
def quality_checks(spark, sf):
    size = F.size("skills")
    return counts.quality_checks(extractions(spark, sf), {
        "skills_10_to_50": (size >= 10) & (size <= 50),
        "class_agrees": (F.col("company_focus") == "en") == (F.col("ai_type") == "ai-first")})


@query("a23_sample_per_batch", """
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) AS n
  FROM documents) WHERE n <= 7""")
def sample_per_batch(spark, sf):
    return counts.sample_per_batch(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 7)
