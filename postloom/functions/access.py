"""Nested access, defaults and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import as_col


def get_path(path: str, default: str | None = None) -> Column:
    """`a.b.c` of a nested record; absent and null both fall back to `default`."""
    value = F.col(path)
    return value if default is None else F.coalesce(value, F.lit(default))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill nulls per column; a list default becomes an empty array."""
    filled = {}
    for name, value in defaults.items():
        if isinstance(value, list):
            filled[name] = F.coalesce(F.col(name), F.array().cast("array<string>"))
        else:
            filled[name] = F.coalesce(F.col(name), F.lit(value))
    return df.withColumns(filled)


def select_reorder(df: DataFrame, columns: list[str], default: str = "") -> DataFrame:
    """Exactly these columns in this order; missing columns and nulls become `default`."""
    have = set(df.columns)
    return df.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c) if c in have else F.lit(default).alias(c)
        for c in columns
    ])


def flatten_skills(skills: Column | str, categories: list[str], *, lower: bool = True) -> Column:
    """All category lists of the record as one array, in category order."""
    base = as_col(skills)
    every = F.flatten(F.array(*[items(base.getField(c)) for c in categories]))
    return F.transform(every, F.lower) if lower else every


def items(c: Column | str) -> Column:
    """The array itself, or an empty one for null."""
    return F.coalesce(as_col(c), F.array().cast("array<string>"))


def array_head(c: Column | str, n: int) -> Column:
    return F.slice(as_col(c), 1, n)


def stamp_source(df: DataFrame, *, at: Column | None = None, **constants: str) -> DataFrame:
    """Constant columns plus `scraped_at`: `at`, or one current timestamp for the whole query."""
    stamped = {name: F.lit(value) for name, value in constants.items()}
    stamped["scraped_at"] = F.current_timestamp() if at is None else at
    return df.withColumns(stamped)


def drop_empty_fields(*columns: str, arrays: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> Column:
    """JSON text of the columns without those that are null or empty; the columns in `keep` always stay."""
    fields = []
    for name in columns:
        value = F.col(name)
        if name in arrays:
            value = F.when(F.size(value) > 0, value)
        elif name not in keep:
            value = F.nullif(value.cast("string"), F.lit(""))
        fields.append(value.alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def row_count() -> Column:
    return F.count(F.lit(1))
