"""Row predicates. Each returns a Column, so Catalyst can push it into the scan where the source allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import as_col, contains_any


def differs(c: Column | str, value: object) -> Column:
    """Null-safe `!=`: rows with null stay."""
    return ~as_col(c).eqNullSafe(F.lit(value))


def matches(c: Column | str, pattern: str, *, lower: bool = True) -> Column:
    text = F.lower(as_col(c)) if lower else as_col(c)
    return F.coalesce(text.rlike(pattern), F.lit(False))


def size_is(c: Column | str, op: str, n: int) -> Column:
    """Compare an array's size; null counts as empty."""
    size = F.coalesce(F.size(as_col(c)), F.lit(0))
    return {"<=": size <= n, ">=": size >= n, ">": size > n, "<": size < n, "==": size == n}[op]


def truthy(c: Column | str) -> Column:
    """A flag column with null read as false."""
    return F.coalesce(as_col(c).cast("boolean"), F.lit(False))


def has_text(*columns: Column | str) -> Column:
    """All columns are present and not empty."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.length(F.coalesce(as_col(c), F.lit(""))) > 0)
    return out


def clean_token(c: Column | str, *, longer_than: int, shorter_than: int | None, deny: list[str] = ()) -> Column:
    """Length strictly within the bounds and none of the denied substrings."""
    text = as_col(c)
    ok = F.length(text) > longer_than
    if shorter_than is not None:
        ok = ok & (F.length(text) < shorter_than)
    return ok & ~contains_any(text, list(deny)) if deny else ok


def in_window(c: Column | str, anchor: Column, days: int) -> Column:
    """Dates of the last `days` days up to and including `anchor`, as a half-open range on the raw column, so that the
    scan can prune on it. `anchor` is a date (a literal, or a scalar computed first)."""
    first, behind = F.date_sub(anchor, days - 1), F.date_add(anchor, 1)
    return (as_col(c) >= first.cast("timestamp")) & (as_col(c) < behind.cast("timestamp"))


def between_months(c: Column | str, first_day: str, last_day: str) -> Column:
    """Half-open range on the raw column, so that the scan can prune on it."""
    return (as_col(c) >= F.lit(first_day).cast("timestamp")) & (
        as_col(c) < F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp"))


def relevant(c: Column | str, include: list[str], exclude: list[str]) -> Column:
    """Some include keyword and no exclude keyword."""
    return contains_any(c, include) & ~contains_any(c, exclude)


def keep_listed(items: Column | str, listed: list[str]) -> Column:
    """Array items that are on the list, duplicates kept."""
    return F.filter(as_col(items), lambda s: s.isin(*listed))


def first_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first `n` rows in a total order (a top-n, never a full sort)."""
    return df.orderBy(*order).limit(n)
