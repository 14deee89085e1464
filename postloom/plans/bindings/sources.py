"""S-family: round trips through the formats, over whole tables, in the shared scratch folder."""

from pyspark.sql import functions as F

from postloom import schemas
from postloom.plans.bindings.common import query, table
from postloom.session import scratch_path, stored
from postloom.sources import readers, staging, writers, yaml_source


@query("s01_read_structured", """
SELECT CAST(c_custkey AS VARCHAR) AS job_id, c_name AS company, c_mktsegment AS title, 'ai-first' AS ai_type, 'B: two|' || c_nationkey AS genai,
  false AS management FROM customer""")
def read_structured(spark, sf):
    record = F.concat_ws("\n", F.lit("company:"), F.concat(F.lit("  name: "), F.col("c_name")), F.lit("position:"),
                         F.concat(F.lit("  title: "), F.col("c_mktsegment")), F.lit("  ai_type:\n    type: ai-first\n  skills:"),
                         F.concat(F.lit("    genai: ['B: two', '"), F.col("c_nationkey").cast("string"), F.lit("']")),
                         F.lit("  is_management: false\nmeta:"), F.concat(F.lit("  job_id: '"), F.col("c_custkey").cast("string"), F.lit("'")))
    files = table(spark, sf, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".yaml")).alias("file_name"), record.alias("value"))
    live = readers.structured_records(files)[0]
    return live.select("meta.job_id", F.col("company.name").alias("company"), "position.title", F.col("position.ai_type.type").alias("ai_type"),
                       F.array_join("position.skills.genai", "|").alias("genai"), F.col("position.is_management").alias("management"))


@query("s02_read_extracted", """
SELECT s_suppkey || '.yaml' AS file_name, CAST(s_suppkey AS VARCHAR) AS job_id, s_name AS title, '' AS location, 'x|y' AS skills, NULL AS error
FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT s_suppkey || '.yaml', '', '', '', '', 'bad' FROM supplier WHERE s_nationkey = 3""")
def read_extracted(spark, sf):
    # Records of nation 3 are malformed and must end up in the quarantine.
    title = F.when(F.col("s_nationkey") == 3, F.concat(F.lit("a: b: "), F.col("s_name"))).otherwise(F.col("s_name"))
    record = F.concat(F.lit("job_id: "), F.col("s_suppkey").cast("string"), F.lit("\ntitle: "), title, F.lit("\nskills:\n  - x\n  - y\n"))
    files = table(spark, sf, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".yaml")).alias("file_name"), record.alias("value"))
    ok, bad = readers.extracted_records(files)
    good = ok.select("file_name", "job_id", "title", "location", F.array_join("skills", "|").alias("skills"), F.lit(None).cast("string").alias("error"))
    empty = [F.lit("").alias(c) for c in ("job_id", "title", "location", "skills")]
    return good.unionByName(bad.select("file_name", *empty, F.lit("bad").alias("error")))


@query("s02_yaml_source", """
SELECT CAST(s_suppkey AS VARCHAR) AS job_id, s_name AS title, 'x|y' AS skills, false AS bad FROM supplier WHERE s_nationkey <> 3
UNION ALL SELECT '', '', '', true FROM supplier WHERE s_nationkey = 3""")
def yaml_records(spark, sf):
    # One small file per supplier, written by the tasks; those of nation 3 are malformed.
    title = F.when(F.col("s_nationkey") == 3, F.concat(F.lit("a: b: "), F.col("s_name"))).otherwise(F.col("s_name"))
    record = F.concat(F.lit("job_id: '"), F.col("s_suppkey").cast("string"), F.lit("'\ntitle: "), title, F.lit("\nskills:\n  - x\n  - y\n"))
    path = scratch_path(spark, "yaml-files")
    rows = table(spark, sf, "supplier").select(record.alias("value"), (F.col("s_suppkey") % 64).alias("part"))
    # Files are what takes the time: they are made by 64 tasks, which also put them in place, and read once for both tables.
    rows.repartition(64, "part").write.partitionBy("part").option("maxRecordsPerFile", 1).option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    parsed = stored(yaml_source.load(spark, path, schemas.EXTRACTED, pattern="part-*", taskFiles=50), "yaml-read")
    ok, bad = yaml_source.records(parsed, schemas.EXTRACTED)
    good = ok.select("job_id", "title", F.array_join("skills", "|").alias("skills"), F.lit(False).alias("bad"))
    return good.unionByName(bad.select(*[F.lit("").alias(c) for c in ("job_id", "title", "skills")], F.lit(True).alias("bad")))


def _cards(spark, sf):
    rows = table(spark, sf, "customer")
    link = F.when(F.col("c_nationkey") == 7, "").otherwise(F.concat(F.lit("https://board.example.com/job/"), F.col("c_custkey").cast("string")))
    return rows.select(F.concat(F.col("c_name"), F.lit(' "x", y\nz')).alias("title"), F.col("c_mktsegment").alias("company"),
                       F.col("c_nationkey").cast("string").alias("location"), link.alias("link"))


_CARDS_SQL = """SELECT c_name || ' "x", y' || chr(10) || 'z' AS title, c_mktsegment AS company, CAST(c_nationkey AS VARCHAR) AS location,
  'https://board.example.com/job/' || c_custkey AS link FROM customer"""


@query("s03_read_cards_csv", _CARDS_SQL + " WHERE c_nationkey <> 7")
def read_cards_csv(spark, sf):
    path = scratch_path(spark, "cards")
    writers.write_csv_projection(_cards(spark, sf), path)
    return readers.read_cards_csv(spark, path).select("title", "company", "location", "link")


@query("s04_read_cards_json", "SELECT event_type AS site, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def read_cards_json(spark, sf):
    path = scratch_path(spark, "sites")
    events = table(spark, sf, "events").select("event_id", F.col("event_type").alias("site"), "props")
    writers.write_json_by_site(events, path, run_ts="20260204_145248")
    listed = [f"{path}/site={site}" for site in ("click", "missing", "view")]
    schema = "event_id long, props string"
    parts = [readers.read_cards_json(spark, [p], schema, multi_line=False).withColumn("site", F.lit(p.rsplit("=", 1)[1])) for p in listed]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("s05_read_pages", "SELECT page_id, url, length(html) AS n_chars, contains(html, '<h1>') AS has_h1 FROM pages")
def read_pages(spark, sf):
    return readers.read_pages(spark, f"{sf}/pages.parquet").select(
        "page_id", "url", F.length("html").cast("long").alias("n_chars"), F.contains("html", F.lit("<h1>")).alias("has_h1"))


@query("s06_read_queue", "SELECT url, CASE WHEN contains(url, '?') THEN 'HTTP 500|retry' END AS error FROM pages")
def read_queue(spark, sf):
    line = F.when(F.contains("url", F.lit("?")), F.concat(F.col("url"), F.lit("|HTTP 500|retry"))).otherwise(F.col("url"))
    return readers.parse_queue(table(spark, sf, "pages").select(line.alias("value")))


@query("s07_read_markdown_listing", """
SELECT (c_custkey + 1)::INTEGER AS n, c_name AS title, c_mktsegment AS company, 'Nation ' || c_nationkey AS location, CAST(NULL AS VARCHAR) AS source,
  'https://board.example.com/' || c_custkey AS link FROM customer""")
def read_markdown_listing(spark, sf):
    key = F.col("c_custkey")
    block = F.concat(F.lit("\n### "), (key + 1).cast("string"), F.lit(". "), F.col("c_name"), F.lit("\n\n**Company:** "), F.col("c_mktsegment"),
                     F.lit("\n\n**Location:** Nation "), F.col("c_nationkey").cast("string"), F.lit("\n\n**Source:** \n\n**Link:** https://board.example.com/"),
                     key.cast("string"), F.lit("\n"))
    path = scratch_path(spark, "listing")
    table(spark, sf, "customer").select(block.alias("value")).write.option("lineSep", "\n---\n").text(path)
    return readers.read_markdown_listing(spark, path).select("n", "title", "company", "location", "source", "link")


@query("s08_write_csv_projection", f"SELECT title, company, location, '' AS work_type, '' AS level, '' AS compensation, CASE WHEN location = '7' THEN '' ELSE link END AS link FROM ({_CARDS_SQL})")
def write_csv_projection(spark, sf):
    path = scratch_path(spark, "projection")
    writers.write_csv_projection(_cards(spark, sf), path)
    return spark.read.schema(schemas.CARD).csv(path, header=True, multiLine=True, escape='"').fillna("")


@query("s09_write_json_by_site", "SELECT event_id, event_type AS site, '20260204_145248' AS run_ts, props FROM events")
def write_json_by_site(spark, sf):
    path = scratch_path(spark, "by-site")
    writers.write_json_by_site(table(spark, sf, "events").select("event_id", F.col("event_type").alias("site"), "props"), path, run_ts="20260204_145248")
    return spark.read.schema("event_id long, props string, site string, run_ts string").json(path)


@query("s10_write_structured", """
SELECT o_orderkey, o_orderstatus AS kind, strftime(o_orderdate, '%Y-%m') AS posted_month FROM orders""")
def write_structured(spark, sf):
    path = scratch_path(spark, "structured")
    nested = table(spark, sf, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("kind")).alias("position"), "o_orderdate")
    writers.write_structured(nested, path, posted="o_orderdate")
    back = spark.read.schema("o_orderkey long, position struct<kind:string>, posted_month string").parquet(path)
    return back.select("o_orderkey", "position.kind", "posted_month")


@query("s10_write_structured_json", """
SELECT '{"c_custkey":' || c_custkey || ',"name":"' || c_name || '"' || CASE WHEN c_mktsegment <> 'BUILDING' THEN ',"segment":"' || c_mktsegment || '"' ELSE '' END || '}' AS line FROM customer""")
def write_structured_json(spark, sf):
    path = scratch_path(spark, "structured-json")
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    writers.write_structured(rows, path, fmt="json")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("s11_site_index", """
SELECT p_brand, n, n || '. [' || replace(replace(p_name || ' [' || p_type || ']', '[', '\\['), ']', '\\]') || '](https://board.example.com/' || p_partkey || ') - ' || p_type AS line
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)""".replace("\\\\", "\\"))
def site_index(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_brand", "p_partkey", F.concat_ws("", "p_name", F.lit(" ["), "p_type", F.lit("]")).alias("title"), "p_type",
        F.concat(F.lit("https://board.example.com/"), F.col("p_partkey").cast("string")).alias("url"))
    return writers.site_index(rows, "p_brand", "title", "url", "p_type", ["p_partkey"])


@query("s11_card_text", """
SELECT p_partkey, '## ' || p_partkey || '. ' || p_name || chr(10) || chr(10) || '**Company:** ' || p_brand || chr(10) || chr(10) || '**Level:** ' ||
  CASE WHEN p_size > 10 THEN p_type ELSE 'N/A' END || chr(10) || chr(10) || '---' AS card FROM part""")
def card_text(spark, sf):
    level = F.when(F.col("p_size") > 10, F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", writers.card_markdown(F.col("p_name"), {"Company": F.col("p_brand"), "Level": level}, F.col("p_partkey")).alias("card"))


@query("s12_numbered_lines", """
SELECT n, n || '. ' || item AS line FROM (SELECT item, row_number() OVER (ORDER BY conv_id, turn, pos) AS n FROM (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS item, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM conversations))""")
def numbered_lines(spark, sf):
    items = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "item"))
    return writers.numbered_lines(items, "item", ["conv_id", "turn", "pos"])


@query("s12_listing_header", "SELECT 'Total job titles: ' || count(DISTINCT p_name || p_brand) AS line FROM part")
def listing_header(spark, sf):
    return writers.listing_header(table(spark, sf, "part").select("p_name", "p_brand").distinct(), "job titles")


@query("s14_write_missing_only", """
SELECT d.doc_id, source, CASE WHEN l.doc_id IS NULL THEN 'second' ELSE 'first' END AS run FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
UNION ALL SELECT -1, 'skipped', CAST(count(*) AS VARCHAR) FROM labels UNION ALL SELECT -1, 'written', CAST((SELECT count(*) FROM documents) - count(*) AS VARCHAR) FROM labels""")
def write_missing_only(spark, sf):
    path = scratch_path(spark, "outputs")
    documents = table(spark, sf, "documents").select("doc_id", "source")
    writers.write_missing_only(documents.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("run", F.lit("first")), path, "doc_id")
    tally = writers.write_missing_only(documents.withColumn("run", F.lit("second")), path, "doc_id")
    return spark.read.parquet(path).unionByName(tally.select(F.lit(-1).cast("long").alias("doc_id"), F.col("status").alias("source"), F.col("n").cast("string").alias("run")))


@query("s10_staged_quarter", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS posted_month, o_orderstatus, quarter(o_orderdate)::INTEGER AS quarter,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority || ' of ' || o_custkey END AS description
FROM orders WHERE quarter(o_orderdate) = 4""")
def staged_quarter(spark, sf):
    described = F.when(F.col("o_orderstatus") != "P", F.concat("o_orderpriority", F.lit(" of "), F.col("o_custkey").cast("string")))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", described.alias("description"))
    staged = staging.write_staged(orders, scratch_path(spark, "staged"), key="o_orderkey", posted="o_orderdate", long="description")
    calendar = staged.rows().select("posted_month").distinct().withColumn("quarter", F.ceil(F.substring("posted_month", 6, 2).cast("int") / 3).cast("int"))
    rows = staged.of_periods(calendar.filter(F.col("quarter") == 4))
    return staged.with_texts(rows).select("o_orderkey", "posted_month", "o_orderstatus", "quarter", "description")
