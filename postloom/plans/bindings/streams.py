"""ST-family: each query starts a stream over a whole table, lets it drain and returns what it wrote."""

from pyspark.sql import functions as F

from postloom.functions.taxonomy import Taxonomy
from postloom.plans.bindings.common import DOC_TAXONOMY, first_match_sql, lit_sql, query, table
from postloom.session import scratch_path
from postloom.streaming import incremental as I


def _stream(spark, sf, name):
    # A pattern, since a stream's path may not name a single file: it finds the table as one file and as a folder of files.
    return I.stream_files(spark, f"{sf}/{{{name}}}.parquet", table(spark, sf, name).schema)


def _drain(spark, started, path):
    started.awaitTermination()
    return spark.read.parquet(path)


@query("st01_incremental_structure", f"SELECT doc_id, source, {first_match_sql(DOC_TAXONOMY, 'lower(text)', lit_sql('Other'))} AS category FROM documents")
def incremental_structure(spark, sf):
    out, state = scratch_path(spark, "structured"), scratch_path(spark, "state")
    label = lambda df: df.select("doc_id", "source", Taxonomy(DOC_TAXONOMY).first_match("text", "Other").alias("category"))
    for _ in range(2):  # the second run finds nothing new
        I.incremental(_stream(spark, sf, "documents"), label, out, state).awaitTermination()
    return spark.read.parquet(out)


@query("st02_stream_dedup_links", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_links(spark, sf):
    out = scratch_path(spark, "links")
    unique = lambda df: I.dedup_links(df.select("user_id", "event_type"), ["user_id", "event_type"])
    return _drain(spark, I.incremental(_stream(spark, sf, "events"), unique, out, scratch_path(spark, "state")), out)


@query("st02_stream_dedup_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_watermark(spark, sf):
    # All events lie within the horizon, so the bounded form finds the same keys.
    out = scratch_path(spark, "links")
    timed = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    unique = lambda df: I.dedup_links(timed(df), ["user_id", "event_type"], event_time="ts", horizon="30 days").select("user_id", "event_type")
    return _drain(spark, I.incremental(_stream(spark, sf, "events"), unique, out, scratch_path(spark, "state")), out)


@query("st03_dead_letter", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN event_type = 'error' THEN event_id || '|bad payload of user ' || user_id END AS retry_line FROM events""")
def dead_letter(spark, sf):
    out = scratch_path(spark, "outcome")
    cut = F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    parsed = _stream(spark, sf, "events").select("event_id", "user_id", F.try_parse_json(cut).isNotNull().alias("good"))
    error = F.when(~F.col("good"), F.concat(F.lit("bad payload of user "), F.col("user_id").cast("string")))
    started = I.dead_letter(parsed, F.col("event_id"), error, out, scratch_path(spark, "state"))
    return _drain(spark, started, out).select("event_id", "status", "retry_line")


@query("st03_two_tables", """
SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN event_id || '|bad payload of user ' || user_id END AS retry_line FROM events""")
def two_tables(spark, sf):
    ok, failed, ledger, state = (scratch_path(spark, name) for name in ("ok", "failed", "ledger", "state"))
    cut = F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    parsed = _stream(spark, sf, "events").select("event_id", "user_id", F.try_parse_json(cut).isNotNull().alias("good"))
    error = F.when(~F.col("good"), F.concat(F.lit("bad payload of user "), F.col("user_id").cast("string")))
    I.TwoSinks(F.col("event_id"), error, ok, failed, ledger).start(parsed, state).awaitTermination()
    good = spark.read.parquet(ok).select("event_id", "user_id", F.lit(None).cast("string").alias("retry_line"))
    return good.unionByName(spark.read.parquet(failed).select("event_id", "user_id", "retry_line"))


@query("st04_page_growth", """
WITH f AS (SELECT user_id, min(ts::DATE) AS page FROM events GROUP BY 1), n AS (SELECT page, count(*) AS n_new FROM f GROUP BY 1)
SELECT e.page, n_found, coalesce(n_new, 0) AS n_new, (sum(coalesce(n_new, 0)) OVER (ORDER BY e.page))::BIGINT AS n_unique
FROM (SELECT ts::DATE AS page, count(*) AS n_found FROM events GROUP BY 1) e LEFT JOIN n ON e.page = n.page""")
def page_growth(spark, sf):
    return I.running_new(I.page_growth(table(spark, sf, "events"), F.col("ts").cast("date"), "user_id"))


@query("st04_page_growth_stream", """
WITH f AS (SELECT user_id, min(ts::DATE) AS page FROM events GROUP BY 1), n AS (SELECT page, count(*) AS n_new FROM f GROUP BY 1)
SELECT e.page, n_found, coalesce(n_new, 0)::BIGINT AS n_new
FROM (SELECT ts::DATE AS page, count(*) AS n_found FROM events GROUP BY 1) e LEFT JOIN n ON e.page = n.page""")
def page_growth_stream(spark, sf):
    out = scratch_path(spark, "growth")
    grow = lambda df: I.page_growth_stream(df, F.col("ts").cast("date"), "user_id", "ts", horizon_days=60)
    return I.summed_growth(_drain(spark, I.incremental(_stream(spark, sf, "events"), grow, out, scratch_path(spark, "state")), out))
