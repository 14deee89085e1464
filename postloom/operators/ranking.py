"""Top-k, per-group ranks and global numbering that never goes through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import checkpointed


def top_k(df: DataFrame, k: int, n: str, ties: list[str]) -> DataFrame:
    """The `k` largest by `n`, ties by key: TakeOrderedAndProject, no full sort."""
    return df.orderBy(F.col(n).desc(), *[F.col(t).asc() for t in ties]).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], k: int, order: list[Column], rank: str | None = None) -> DataFrame:
    """The first `k` rows of every group. The rank filter becomes a WindowGroupLimit, so each map
    task ships at most `k` rows per group and a hot group stays small."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(
        F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def first_per_group(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """The value of the first row of every group, combined map-side."""
    return df.groupBy(*group).agg(F.min_by(value, order).alias(value))


def number_rows(df: DataFrame, order: list[str], *, group: list[str] = (), name: str = "n") -> DataFrame:
    """1-based numbering in a total order, over everything or within groups, without a one-task window.

    Rows are range-partitioned and sorted once and written to the checkpoint folder; each
    partition numbers its own run locally, and the offsets are prefix sums over one small row per
    (group, partition). `order` must be a total order.
    """
    keys = [*group, *order]
    tagged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_id", F.monotonically_increasing_id()))
    tagged = checkpointed(tagged).withColumns({
        "_part": F.shiftright("_id", 33), "_pos": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    runs = tagged.groupBy(*group, "_part").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if not group:
        runs = F.broadcast(runs)  # one row per shuffle partition
    same = tagged.alias("t").join(
        runs.alias("r"),
        [F.col("t._part") == F.col("r._part")] + [F.col(f"t.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group])
    return same.select(*[F.col(f"t.{c}") for c in df.columns],
                       (F.col("r._offset") + F.col("t._pos") - F.col("r._first") + 1).alias(name))


def order_by_share(df: DataFrame, share: str, key: str) -> DataFrame:
    return df.orderBy(F.col(share).asc(), F.col(key).asc())


def order_by_size(df: DataFrame, size: str, key: str) -> DataFrame:
    return df.orderBy(F.col(size).desc(), F.col(key).asc())


def largest_lists(df: DataFrame, size: Column, key: str, k: int = 3, *, at_most: int | None = None) -> DataFrame:
    """The `k` records with the longest list; with `at_most`, the first `k` records with a list no longer than that."""
    sized = df.withColumn("list_size", size)
    if at_most is not None:
        return sized.filter(F.col("list_size") <= at_most).orderBy(F.col(key).asc()).limit(k)
    return sized.orderBy(F.col("list_size").desc(), F.col(key).asc()).limit(k)
