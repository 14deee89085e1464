"""Joins. A side is broadcast only after its size is known: by AQE from shuffle statistics, or by `join_checked`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.classify import strip_version
from postloom.functions.taxonomy import Taxonomy
from postloom.functions.text import as_col
from postloom.session import checkpointed


MAX_BROADCAST_ROWS = 200_000


def join_known(df: DataFrame, small: DataFrame, rows: int, key: str, how: str = "left") -> DataFrame:
    """Join with a side of `rows` counted rows. Up to MAX_BROADCAST_ROWS it is broadcast, so the large
    side is not shuffled and a hot key stays spread; beyond that the join is an ordinary one, where
    AQE splits skewed partitions."""
    return df.join(F.broadcast(small) if rows <= MAX_BROADCAST_ROWS else small, key, how)


def join_checked(df: DataFrame, small: DataFrame, key: str, *, how: str = "left") -> DataFrame:
    """`join_known` for a side that is normally tiny (hot keys, a vocabulary): it is computed once,
    kept in the checkpoint folder and counted."""
    kept = checkpointed(small)
    return join_known(df, kept, kept.count(), key, how)


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return df.join(done.select(key), key, "left_anti")


def pending_outputs(inputs: DataFrame, outputs: DataFrame, name: str = "file_name") -> DataFrame:
    """Inputs without an output file of the same name."""
    return inputs.join(outputs.select(name), name, "left_anti")


def attach_raw(structured: DataFrame, raw: DataFrame, key: str, *, how: str = "left") -> DataFrame:
    return structured.join(raw, key, how)


def keyword_join(df: DataFrame, text: Column | str, entries: list[tuple[str, list[str]]], keep: list[str], *,
                 name: str = "category", lower: bool = True) -> DataFrame:
    """One row per (row, matching category). The keyword list is configuration, so the theta join
    collapses to an in-row generator: no shuffle and no nested loop over rows."""
    return df.select(*keep, F.explode(Taxonomy(entries).all_matches(as_col(text), lower=lower)).alias(name))


def drop_listed(df: DataFrame, column: str, listed: list[str]) -> DataFrame:
    return df.filter(~F.col(column).isin(*listed))


def drop_found(df: DataFrame, stop: DataFrame, column: str) -> DataFrame:
    """`drop_listed` for a stop list that is itself a table."""
    return df.join(stop.select(column), column, "left_anti")


def keep_found(df: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Rows whose value is in the list table; duplicates stay."""
    return df.join(listed.select(column), column, "left_semi")


def site_lookup(df: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """Attach the site's columns; `known` tells the unknown ids apart."""
    return df.join(sites.withColumn("_hit", F.lit(True)), key, "left").withColumn(
        "known", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def compare_groups(df: DataFrame, group: Column, groups: dict[str, object], metrics: dict[str, Column]) -> DataFrame:
    """Each metric's count and share in every group side by side, from one scan.

    `groups` maps a short name to the group's value; output: metric, n_<name>, pct_<name>.
    """
    rows = df.select(group.alias("_g"), *[F.coalesce(m, F.lit(False)).alias(f"m{i}") for i, m in enumerate(metrics.values())])
    aggs = []
    for name, value in groups.items():
        here = F.col("_g") == F.lit(value)
        aggs.append(F.count_if(here).alias(f"size_{name}"))
        aggs += [F.count_if(here & F.col(f"m{i}")).alias(f"{name}_{i}") for i in range(len(metrics))]
    wide = rows.agg(*aggs)
    entry = F.array(*[
        F.struct(F.lit(metric).alias("metric"), *[F.col(f"{name}_{i}").alias(f"n_{name}") for name in groups])
        for i, metric in enumerate(metrics)])
    long = wide.select(*[f"size_{name}" for name in groups], F.inline(entry))
    return long.select("metric", *[f"n_{name}" for name in groups], *[
        F.try_divide(F.lit(100.0) * F.col(f"n_{name}"), F.col(f"size_{name}").cast("double")).alias(f"pct_{name}")
        for name in groups])


def normalize_skills(df: DataFrame, skill: str, aliases: DataFrame, *, noise: list[str] = ()) -> DataFrame:
    """Canonical skill names: version suffix off, case variants and spellings merged by an alias table
    (`alias` lower-cased, `canonical`), noise words dropped."""
    base = df.withColumn(skill, strip_version(skill)).withColumn("_alias", F.lower(F.trim(F.col(skill))))
    if noise:
        base = base.filter(~F.col("_alias").isin(*noise))
    # a repeated alias counts once, for its first canonical name
    known = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.min("canonical").alias("canonical"))
    return (base.join(known, "_alias", "left").withColumn(skill, F.coalesce("canonical", F.trim(F.col(skill))))
            .drop("_alias", "canonical"))
