"""Sinks. All of them write in parallel, one file set per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom import vocab
from postloom.functions.access import select_reorder
from postloom.operators.ranking import number_rows


def write_csv_projection(df: DataFrame, path: str, columns: list[str] = vocab.CARD_COLUMNS, *, mode: str = "error") -> None:
    """Ordered projection with header; missing values are empty."""
    select_reorder(df, columns).write.mode(mode).csv(path, header=True, emptyValue="", escape='"', quote='"')


def write_json_by_site(df: DataFrame, path: str, *, site: str = "site", run_ts: str | Column | None = None, mode: str = "append") -> None:
    """JSON lines under `site=…/run_ts=…`. Rows are gathered by site; AQE splits a large site over several tasks and files."""
    stamp = run_ts if isinstance(run_ts, Column) else (
        F.lit(run_ts) if run_ts else F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))
    df.withColumn("run_ts", stamp).hint("rebalance", site).write.mode(mode).partitionBy(site, "run_ts").json(path)


def write_structured(df: DataFrame, path: str, *, posted: str | None = None, fmt: str = "parquet", mode: str = "append") -> None:
    """Nested postings as parquet, or as JSON lines without empty fields; partitioned by month when dated."""
    out, parts = df, []
    if posted:
        out, parts = out.withColumn("posted_month", F.date_format(F.to_date(posted), "yyyy-MM")), ["posted_month"]
        out = out.hint("rebalance", "posted_month")
    writer = out.write.mode(mode).partitionBy(*parts)
    if fmt == "json":
        writer.option("ignoreNullFields", "true").json(path)
    else:
        writer.parquet(path)


def compact(df: DataFrame, path: str) -> DataFrame:
    """Write once as parquet and read back: the staging table that all reports share.

    The rebalance lets AQE merge small inputs and split large ones into files of even size.
    """
    df.hint("rebalance").write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def site_index(df: DataFrame, site: str, title: str, url: str, company: str, order: list[str]) -> DataFrame:
    """Numbered index lines per site: `n. [title](url) - company`, brackets of the title escaped."""
    numbered = number_rows(df, order, group=[site])
    safe = F.replace(F.replace(F.col(title), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    return numbered.select(site, "n", F.concat(
        F.col("n").cast("string"), F.lit(". ["), safe, F.lit("]("), F.col(url), F.lit(") - "), F.col(company)).alias("line"))


def card_markdown(title: Column, fields: dict[str, Column], n: Column) -> Column:
    """Text of one card: heading, `**Key:** value` lines and the closing rule; absent values show N/A."""
    parts = [F.concat(F.lit("## "), n.cast("string"), F.lit(". "), title)]
    parts += [F.concat(F.lit(f"**{k}:** "), F.coalesce(v, F.lit("N/A"))) for k, v in fields.items()]
    return F.concat_ws("\n\n", *parts, F.lit("---"))


def numbered_lines(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """`{i}. {text}` over all rows in a total order, numbered without a single-task sort."""
    return number_rows(df, order).select(
        "n", F.concat(F.col("n").cast("string"), F.lit(". "), F.col(text)).alias("line"))


def listing_header(df: DataFrame, label: str) -> DataFrame:
    """The header line with the total of a numbered file."""
    return df.agg(F.concat(F.lit(f"Total {label}: "), F.count(F.lit(1)).cast("string")).alias("line"))


def write_missing_only(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the target does not hold yet; returns the tally per status.

    What is decided and stored first are the keys and their numbers of rows (shared scratch table), so a retried or repeated run
    neither writes a row twice nor changes its report, and the rows themselves are computed once. A null key is never held.
    """
    from postloom.session import checkpointed

    spark = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if exists:
        done = spark.read.schema(T.StructType([df.schema[key]])).parquet(path).withColumn("_done", F.lit(True)).distinct()
        keys = keys.join(done, key, "left").select(key, "n", F.when(F.col("_done"), "skipped").otherwise("written").alias("status"))
    else:
        keys = keys.withColumn("status", F.lit("written"))
    keys = checkpointed(keys)
    rows = df.join(keys.filter(F.col("status") == "skipped").select(key), key, "left_anti") if exists else df
    rows.write.mode("append").parquet(path)
    return keys.groupBy("status").agg(F.sum("n").alias("n"))
