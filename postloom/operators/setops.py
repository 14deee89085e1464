"""Unions, distinct, difference and first-wins deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import as_col


def union_sites(parts: list[DataFrame]) -> DataFrame:
    """Concatenate per-site tables by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_links(df: DataFrame, link: str) -> DataFrame:
    return df.select(link).dropna().distinct()


def distinct_ordered_items(items: Column | str, n: int | None = None) -> Column:
    """Unique items in first-seen order, at most `n`."""
    unique = F.array_distinct(as_col(items))
    return F.slice(unique, 1, n) if n else unique


def difference(df: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the other table."""
    return df.join(removed.select(key), key, "left_anti")


def partition_in_two(df: DataFrame, predicate: Column, name: str = "in_first") -> DataFrame:
    """Complementary subsets as one boolean column; null goes to the second."""
    return df.withColumn(name, F.coalesce(predicate, F.lit(False)))


def merge_skills(base: Column | str, extra: Column | str) -> Column:
    """struct(skills, skills_count): base skills, then the new ones, without duplicates."""
    merged = F.array_union(F.coalesce(as_col(base), F.array().cast("array<string>")),
                           F.coalesce(as_col(extra), F.array().cast("array<string>")))
    return F.struct(merged.alias("skills"), F.size(merged).alias("skills_count"))


def dedup_keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row (by `order`) of every key combination; null keys are equal to each other.

    An aggregate with map-side combine, not a window: a key that holds a third of all rows
    shrinks to one row per map task before the shuffle. Text keys are grouped by their SHA-256,
    so that the aggregate sorts digests, not texts.
    """
    kinds = dict(df.dtypes)
    digests = [F.sha2(F.col(k), 256) if kinds[k] == "string" else F.col(k) for k in keys]
    first = df.groupBy(*[d.alias(f"_k{i}") for i, d in enumerate(digests)]).agg(
        F.min_by(F.struct(*df.columns), F.col(order)).alias("_first"))
    return first.select("_first.*")
