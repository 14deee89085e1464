"""Ordered keyword taxonomies compiled to expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import any_of, as_col, contains_any, let


def _cased(c: Column | str, lower: bool) -> Column:
    return F.lower(as_col(c)) if lower else as_col(c)


class Taxonomy:
    """An ordered list of (category, keywords). A keyword may appear in several categories; order decides."""

    def __init__(self, entries: list[tuple[str, list[str]]]):
        self.entries = [(name, list(keywords)) for name, keywords in entries]

    @property
    def categories(self) -> list[str]:
        return [name for name, _ in self.entries]

    def first_match(self, c: Column | str, default: str | None = None, *, lower: bool = True,
                    word_boundary: bool = False) -> Column:
        """The first category with any keyword in the text."""
        return let([_cased(c, lower)], lambda t: self._chain(
            [contains_any(t, kws, lower=False, word_boundary=word_boundary) for _, kws in self.entries], default))

    def first_match_in(self, columns: list[Column], default: str | None = None) -> Column:
        """As `first_match` over several texts, each already in the wanted case."""
        return let(columns, lambda *texts: self._chain(
            [any_of([contains_any(t, kws, lower=False) for t in texts]) for _, kws in self.entries], default))

    def gated(self, c: Column | str, gate: list[str], residual: str, *, lower: bool = True) -> Column:
        """`first_match`; unmatched text gets `residual` if it hits a gate keyword, else null."""
        return Taxonomy([*self.entries, (residual, gate)]).first_match(c, lower=lower)

    def all_matches(self, c: Column | str, *, lower: bool = True) -> Column:
        """Every matching category, in taxonomy order."""
        return let([_cased(c, lower)], lambda t: F.array_compact(F.array(*[
            F.when(contains_any(t, kws, lower=False), F.lit(name)) for name, kws in self.entries])))

    def flags(self, c: Column | str, *, lower: bool = True) -> dict[str, Column]:
        """One boolean per category."""
        return {name: contains_any(c, kws, lower=lower) for name, kws in self.entries}

    def _chain(self, conditions: list[Column], default: str | None) -> Column:
        out = None
        for (name, _), condition in zip(self.entries, conditions):
            out = F.when(condition, F.lit(name)) if out is None else out.when(condition, F.lit(name))
        return out.otherwise(F.lit(default).cast("string"))


def bucket_contains(c: Column | str, buckets: list[tuple[str, list[str]]]) -> Column:
    """Ordered, case-sensitive buckets of free text; null where nothing matches."""
    return Taxonomy(buckets).first_match(as_col(c), lower=False)
