"""Incremental and streaming forms. State lives in checkpoints, so a lost executor or a restart repeats nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postloom.session import checkpointed


def stream_files(spark: SparkSession, path: str, schema: T.StructType, *, fmt: str = "parquet",
                 pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream; `pattern` picks them by name."""
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def incremental(source: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *,
                partition_by: list[str] = (), fmt: str = "parquet") -> StreamingQuery:
    """Process what is new since the last run and stop. The file source remembers its inputs and the
    file sink commits each batch once, so re-runs are safe."""
    return (transform(source).writeStream.format(fmt).partitionBy(*partition_by).outputMode("append")
            .option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start())


def dedup_links(source: DataFrame, keys: list[str], *, event_time: str | None = None, horizon: str | None = None) -> DataFrame:
    """Drop keys seen earlier in the stream.

    With `horizon`, state for a key is dropped once the watermark passes it: bounded state, and the
    form to use at scale. Without it keys are remembered for ever, as the batch run does.
    """
    if event_time and horizon:
        return source.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)
    return source.dropDuplicates(keys)


def with_outcome(df: DataFrame, key: Column, error: Column) -> DataFrame:
    """Split rows into `ok` and `failed`; failed rows carry a `url|error` retry line."""
    return df.withColumns({
        "status": F.when(error.isNull(), "ok").otherwise("failed"),
        "retry_line": F.when(error.isNotNull(), F.concat(key.cast("string"), F.lit("|"), error))})


def dead_letter(source: DataFrame, key: Column, error: Column, out: str, checkpoint: str) -> StreamingQuery:
    """One pass, one exactly-once sink: `status=ok` and `status=failed` are its partitions."""
    return incremental(source, lambda df: with_outcome(df, key, error), out, checkpoint, partition_by=["status"])


class TwoSinks:
    """Batches of a stream dealt into two tables, each batch exactly once in each, even where a batch comes again.

    A batch owns the folder `batch=<id>` of either table and overwrites it; a ledger file per batch and table is written behind it. A batch
    that comes again finds its ledger files and writes nothing; one that was cut short finds some missing and writes those tables' folders
    anew. Rows are `ok` where `error` is null, else `failed` with a retry line.
    """

    def __init__(self, key: Column, error: Column, ok: str, failed: str, ledger: str):
        self.key, self.error, self.paths, self.ledger = key, error, {"ok": ok, "failed": failed}, ledger.rstrip("/")

    def _file(self, spark: SparkSession, batch: int, sink: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.ledger}/{batch}.{sink}")
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def __call__(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        open_ = [sink for sink in self.paths if not (lambda p, fs: fs.exists(p))(*self._file(spark, batch, sink))]
        if not open_:
            return
        judged = with_outcome(df, self.key, self.error).persist()
        try:
            for sink in open_:
                rows = judged.filter(F.col("status") == sink).drop("status")
                (rows.drop("retry_line") if sink == "ok" else rows).write.mode("overwrite").parquet(f"{self.paths[sink]}/batch={batch}")
                path, fs = self._file(spark, batch, sink)
                fs.create(path).close()
        finally:
            judged.unpersist()

    def start(self, source: DataFrame, checkpoint: str) -> StreamingQuery:
        return source.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_growth(df: DataFrame, page: Column, link: str) -> DataFrame:
    """Per page: links found and links not seen on an earlier page.

    The first page of a link is a map-side minimum, so a link found on very many pages stays small.
    """
    rows = df.select(page.alias("page"), F.col(link).alias("_link"))
    per_link = rows.groupBy("_link").agg(F.min("page").alias("page"))
    new = per_link.groupBy("page").agg(F.count(F.lit(1)).alias("n_new"))
    found = rows.groupBy("page").agg(F.count(F.lit(1)).alias("n_found"))
    return found.join(new, "page", "left").select("page", "n_found", F.coalesce("n_new", F.lit(0)).alias("n_new"))


def page_growth_stream(source: DataFrame, page: Column, link: str, event_time: str, *, horizon_days: int) -> DataFrame:
    """`page_growth` of a stream whose pages come in order: parts (page, n_found, n_new), to be added up per page (`summed_growth`).

    A link is new on the first page that names it; of several in one batch, on the smallest. Links not met for `horizon_days` of event
    time are forgotten, so the state is bounded; rows later than that play no part. Null links or pages count nowhere. Rows are added up per
    Arrow batch before the shuffle, so a link found very often stays small.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = source.select(page.alias("page"), F.col(link).alias("link"), F.col(event_time).cast("timestamp").alias("at")).dropna()
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page", "link")}
    wait = horizon_days * 86_400_000

    def partial(batches):
        for b in batches:
            yield b.groupby(["page", "link"], as_index=False).agg(at=("at", "max"), n=("at", "size"))

    def grow(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        found, last = {}, state.getCurrentWatermarkMs()
        for b in batches:
            for at, n, ms in zip(b["page"], b["n"], b["ms"]):
                found[at], last = found.get(at, 0) + int(n), max(last, int(ms))
        first = None if state.exists else min(found)
        state.update((True,))
        state.setTimeoutTimestamp(last + wait)
        yield pd.DataFrame({"page": list(found), "n_found": list(found.values()), "n_new": [int(at == first) for at in found]})

    parts = rows.mapInPandas(partial, f"page {kinds['page']}, link {kinds['link']}, at timestamp, n long")
    timed = parts.withWatermark("at", f"{horizon_days} days").withColumn("ms", F.unix_millis("at"))
    return timed.groupBy("link").applyInPandasWithState(
        grow, f"page {kinds['page']}, n_found long, n_new long", "seen boolean", "append", GroupStateTimeout.EventTimeTimeout)


def summed_growth(parts: DataFrame) -> DataFrame:
    """What `page_growth_stream` wrote, added up per page."""
    return parts.groupBy("page").agg(F.sum("n_found").alias("n_found"), F.sum("n_new").alias("n_new"))


def running_new(growth: DataFrame) -> DataFrame:
    """Unique links so far after each page: sums within range partitions, then the totals of the partitions before."""
    ordered = growth.repartitionByRange("page").withColumn("_part", F.spark_partition_id())
    ordered = checkpointed(ordered)
    totals = ordered.groupBy("_part").agg(F.sum("n_new").alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    summed = ordered.withColumn("n_unique", F.sum("n_new").over(inside))
    joined = summed.join(F.broadcast(offsets), "_part")  # one row per shuffle partition
    return joined.withColumn("n_unique", F.col("n_unique") + F.col("_before")).select(*growth.columns, "n_unique")
