"""The staging layout: rows by period, their long texts in a table of their own, and an index of the keys already done.

Reports read narrow rows of the periods they ask for; a text is read only for rows that are left, and only in their periods. A filter
on a joined table of periods prunes both scans while the job runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.operators.joins import join_known
from postloom.session import checkpointed

MONTH = "yyyy-MM"
UNDATED = "undated"


@dataclass
class Staged:
    """A staged table under `path`: `rows` without the long column, `texts` with key, period and long column."""

    spark: SparkSession
    path: str
    key: str
    period: str
    row_schema: T.StructType
    text_schema: T.StructType

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.row_schema).parquet(f"{self.path}/rows")

    def texts(self) -> DataFrame:
        return self.spark.read.schema(self.text_schema).parquet(f"{self.path}/texts")

    def _pruned(self, rows: DataFrame, periods: DataFrame, any_period: Column, how: str) -> DataFrame:
        """Join with a table of periods that is counted and, being small, broadcast. `any_period` holds for every period: the
        optimizer prunes a scan at run time only by a side that has a filter, and a stored table has lost its own. The two uses
        need conditions of their own, for a condition that already holds is removed."""
        known = checkpointed(periods)
        return join_known(rows, known.filter(any_period), known.count(), self.period, how)

    def of_periods(self, periods: DataFrame) -> DataFrame:
        """Rows whose period is in the table `periods` (one row per period; its other columns are attached); other folders aren't read."""
        return self._pruned(self.rows(), periods, F.col(self.period) >= "", "inner")

    def with_texts(self, rows: DataFrame) -> DataFrame:
        """`rows` with their long column; null where there is none. Only the folders of the periods that `rows` holds are read."""
        texts = self._pruned(self.texts(), rows.select(self.period).distinct(), F.length(self.period) >= 0, "left_semi")
        return rows.join(texts, [self.period, self.key], "left")


def write_staged(df: DataFrame, path: str, *, key: str, posted: str | Column, long: str, period: str = "posted_month", pattern: str = MONTH,
                 mode: str = "error") -> Staged:
    """Write `df` in the staging layout. `key` tells rows apart; rows without a date are of the period `undated`, rows with a null
    text have no row in `texts`. AQE splits a period of many rows over several files."""
    when = F.col(posted) if isinstance(posted, str) else posted
    dated = df.withColumn(period, F.coalesce(F.date_format(when, pattern), F.lit(UNDATED)))
    rows, texts = dated.drop(long), dated.filter(F.col(long).isNotNull()).select(key, period, long)
    for name, part in (("rows", rows), ("texts", texts)):
        part.hint("rebalance", period).write.mode(mode).partitionBy(period).option("compression", "zstd").parquet(f"{path}/{name}")
    return Staged(df.sparkSession, path, key, period, rows.schema, texts.schema)


class KeyIndex:
    """The keys of finished outputs as a table in buckets under `path`, for anti joins that don't shuffle it.

    The files carry the buckets, so a later session attaches the same folder with the same number. Null keys are never done.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str, *, buckets: int = 64, name: str | None = None) -> None:
        self.spark, self.key = spark, key
        self.name = name or "keys_" + path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
        where = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{self.name}` (`{key}` {kind}) USING parquet "
                  f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{where}'")
        spark.catalog.refreshTable(self.name)

    def keys(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, done: DataFrame) -> None:
        """Add the keys of `done` that the index doesn't hold; adding twice changes nothing."""
        new = done.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        held = self.keys().hint("merge")
        new.join(held, self.key, "left_anti").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def known(self, df: DataFrame) -> DataFrame:
        """The keys of `df` that are done, once each. They are made distinct before the shuffle, so a hot key is one row a task;
        the index is read bucket by bucket, without an exchange."""
        asked = df.select(self.key).distinct()
        return asked.join(self.keys().hint("merge"), self.key, "left_semi")

    def pending(self, df: DataFrame, *, unique: bool = False) -> DataFrame:
        """Rows of `df` whose key is not done. With `unique`, the keys of `df` don't repeat and one join decides; else repeated keys
        are looked up once, and AQE may split the rows of a hot one."""
        if unique:
            return df.join(self.keys().hint("merge"), self.key, "left_anti")
        # dealt anew: else the rows of `df` would come in as many partitions as the index has buckets
        return df.join(self.known(df).repartition(self.key), self.key, "left_anti")
