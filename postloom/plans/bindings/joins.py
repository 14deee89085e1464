"""J-family."""

from pyspark.sql import functions as F

from postloom import vocab
from postloom.functions.text import contains_any, url_tail_id
from postloom.operators import cooccur, counts, joins, keywords
from postloom.plans.bindings.common import DOC_TAXONOMY, SKILL_ROWS_SQL, any_sql, lit_sql, query, skill_rows, table
from postloom.session import scratch_path
from postloom.sources.staging import KeyIndex


@query("j01_pending_urls", r"""
WITH u AS (SELECT page_id, url, coalesce(nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$'), ''), 'unknown') AS job_id FROM pages)
SELECT page_id, url, job_id FROM u WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE CAST(d.doc_id AS VARCHAR) = u.job_id)""")
def pending_urls(spark, sf):
    queue = table(spark, sf, "pages").select("page_id", "url", url_tail_id("url").alias("job_id"))
    done = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("job_id"))
    return joins.pending(queue, done, "job_id")


@query("j01_pending_by_index", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IS NULL OR l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25 OR p_brand LIKE '%3')""")
def pending_by_index(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_brand")
    index = KeyIndex(spark, scratch_path(spark, "done"), "l_partkey", dict(part.dtypes)["l_partkey"], buckets=8)
    index.add(part.filter(F.col("p_size") <= 25))
    index.add(part.filter(F.col("p_brand").endswith("3")))  # a later run: some of its keys are held already
    return index.pending(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"))


@query("j02_pending_outputs", """
SELECT doc_id || '.yaml' AS file_name, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def pending_outputs(spark, sf):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".yaml")).alias("file_name")
    return joins.pending_outputs(table(spark, sf, "documents").select(name, "source"), table(spark, sf, "labels").select(name))


@query("j03_attach_raw", "SELECT l.doc_id, quality, toxic, source, n_chars FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def attach_raw(spark, sf):
    return joins.attach_raw(table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id")


@query("j04_keyword_join", " UNION ALL ".join(
    f"SELECT doc_id, {lit_sql(name)} AS category FROM documents WHERE {any_sql('lower(text)', kws)}" for name, kws in DOC_TAXONOMY))
def keyword_join(spark, sf):
    return joins.keyword_join(table(spark, sf, "documents"), "text", DOC_TAXONOMY, ["doc_id"])


# An order's text lists its parts by name, brand and number; the keywords are all numbers (one inside the other: `id 1`, `id 12`), names, brands and types.
_ORDER_TEXT_SQL = """t AS (SELECT l_orderkey, string_agg(p_name || ' ' || p_brand || ' id ' || p_partkey, ', ' ORDER BY l_linenumber, p_partkey) AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
k AS (SELECT DISTINCT lower(k) AS k FROM (SELECT 'ID ' || p_partkey AS k FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT p_brand FROM part
  UNION ALL SELECT p_type FROM part))"""


def _order_texts(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand", F.lit(" id "), F.col("p_partkey").cast("string")).alias("item"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", "p_partkey", "item")))  # a few lines an order
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(items, lambda i: i["item"]), ", ").alias("text"))


def _part_words(spark, sf):
    part = table(spark, sf, "part")
    numbers = F.concat(F.lit("ID "), F.col("p_partkey").cast("string"))
    return part.select(F.explode(F.array(numbers, "p_name", "p_brand", "p_type", F.lit(""), F.lit(None))).alias("k"))


@query("j04_keyword_table", f"""
WITH {_ORDER_TEXT_SQL}, l AS (SELECT l_orderkey, lower(text) AS text FROM t)
SELECT l_orderkey, k AS keyword, ((length(text) - length(replace(text, k, ''))) // length(k))::BIGINT AS n FROM l JOIN k ON contains(text, k)""")
def keyword_table(spark, sf):
    return keywords.keyword_table_join(_order_texts(spark, sf), "text", _part_words(spark, sf), "k", ["l_orderkey"])


@query("j04_keyword_table_whole_words", f"""
WITH {_ORDER_TEXT_SQL}, w AS (SELECT l_orderkey, unnest(string_split(lower(text), ', ')) AS item FROM t),
w2 AS (SELECT l_orderkey, string_split(item, ' id ') AS x FROM w),
f AS (SELECT l_orderkey, 'id ' || x[2] AS keyword FROM w2 UNION ALL SELECT l_orderkey, regexp_extract(x[1], '^(.*) ', 1) FROM w2
  UNION ALL SELECT l_orderkey, regexp_extract(x[1], '[^ ]*$') FROM w2 UNION ALL SELECT l_orderkey, unnest(string_split(regexp_extract(x[1], '^(.*) ', 1), ' ')) FROM w2)
SELECT l_orderkey, keyword, count(*) AS n FROM f JOIN k ON keyword = k GROUP BY ALL""")
def keyword_table_whole_words(spark, sf):
    return keywords.keyword_table_join(_order_texts(spark, sf), "text", _part_words(spark, sf), "k", ["l_orderkey"], whole_words=True, block_bytes=1 << 14)


@query("j05_cooccurrence_self", f"""
WITH {SKILL_ROWS_SQL}, u AS (SELECT DISTINCT l_orderkey, skill FROM s)
SELECT x.skill AS a, y.skill AS b, count(*) AS n FROM u x JOIN u y ON x.l_orderkey = y.l_orderkey AND x.skill < y.skill GROUP BY ALL""")
def cooccurrence_self(spark, sf):
    return cooccur.pair_counts_rows(skill_rows(spark, sf), "l_orderkey", "skill")


STOP = vocab.RESPONSIBILITY_STOP_WORDS


@query("j06_drop_stop_words", f"""
SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents)
WHERE length(word) > 3 AND word NOT IN ({', '.join(lit_sql(w) for w in STOP)}) GROUP BY 1 HAVING count(*) >= 5""")
def drop_stop_words(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).filter(F.length("word") > 3)
    return counts.value_counts(joins.drop_listed(words, "word", STOP), "word", min_count=5)


@query("j07_keep_listed", f"""
WITH {SKILL_ROWS_SQL} SELECT skill, count(*) AS n FROM s WHERE skill IN (SELECT p_name FROM part WHERE p_size = 1) GROUP BY 1""")
def keep_listed(spark, sf):
    listed = table(spark, sf, "part").filter("p_size = 1").select(F.col("p_name").alias("skill"))
    return counts.value_counts(joins.keep_found(skill_rows(spark, sf), listed, "skill"), "skill")


@query("j08_site_lookup", """
SELECT c_custkey, c_nationkey, n_name, n_nationkey IS NOT NULL AS known FROM customer LEFT JOIN
  (SELECT * FROM nation WHERE n_regionkey <> 3) ON c_nationkey = n_nationkey""")
def site_lookup(spark, sf):
    sites = table(spark, sf, "nation").filter("n_regionkey <> 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.site_lookup(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), sites, "c_nationkey")


METRICS = ["rag", "license", "data", "the", "que"]


@query("j09_compare_groups", "WITH g AS (SELECT quality, lower(text) AS t FROM labels JOIN documents USING (doc_id)) " + " UNION ALL ".join(
    f"""SELECT {lit_sql(m)} AS metric, count(*) FILTER (quality = 1 AND contains(t, {lit_sql(m)})) AS n_good,
  count(*) FILTER (quality = 0 AND contains(t, {lit_sql(m)})) AS n_bad,
  100.0 * count(*) FILTER (quality = 1 AND contains(t, {lit_sql(m)})) / (count(*) FILTER (quality = 1))::DOUBLE AS pct_good,
  100.0 * count(*) FILTER (quality = 0 AND contains(t, {lit_sql(m)})) / (count(*) FILTER (quality = 0))::DOUBLE AS pct_bad FROM g""" for m in METRICS))
def compare_groups(spark, sf):
    both = joins.attach_raw(table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "text"), "doc_id", how="inner")
    return joins.compare_groups(both, F.col("quality"), {"good": 1, "bad": 0}, {m: contains_any("text", [m]) for m in METRICS})
