"""Repair of record text before it is parsed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import as_col, strip

# A literal block (its key line and every line below it that is empty or starts with a blank, tab or dash)
# is one segment; every other line is a segment of its own.
# `(?<![^\n])` is a line start that also holds for empty text and after a final line feed.
_SEGMENT = r"(?Ud)(?<![^\n])(?:\w+:[^\S\n]*\|.*(?:\n(?:[ \t\-].*|(?=\n)))*+|.*)"
_BLOCK = r"(?Ud)\A\w+:[^\S\n]*\|"
_PAIR = r"(?Ud)^(\w+):\s*(.+)$"
_LIST = r"(?Ud)^(\s*-\s*)(.+)$"
_SAFE = r"""(?U)^["'|>\-]|^\d+$|^https?://|^[\d,]+K?\s*-\s*\d+K?$"""


def _quoted(value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _risky(value: Column) -> Column:
    return F.contains(value, F.lit(":")) & ~F.endswith(value, F.lit(":"))


def repair_line(line: Column | str) -> Column:
    """Quote the value of a `key: value` or `- value` line when it holds a colon that would break parsing."""
    text = as_col(line)
    key, value = F.regexp_extract(text, _PAIR, 1), strip(F.regexp_extract(text, _PAIR, 2))
    dash, item = F.regexp_extract(text, _LIST, 1), strip(F.regexp_extract(text, _LIST, 2))
    pair = text.rlike(_PAIR)
    return (F.when(pair & _risky(value) & ~value.rlike(_SAFE), F.concat(key, F.lit(": "), _quoted(value)))
            .when(~pair & text.rlike(_LIST) & _risky(item) & ~item.rlike("^[\"']"), F.concat(dash, _quoted(item)))
            .otherwise(text))


def clean_separators(c: Column | str) -> Column:
    """Line and paragraph separators become line feeds; zero-width spaces go."""
    return F.replace(F.replace(F.replace(as_col(c), F.lit("\u2028"), F.lit("\n")), F.lit("\u2029"), F.lit("\n")),
                     F.lit("\u200b"), F.lit(""))


def segments(c: Column | str) -> Column:
    return F.regexp_extract_all(clean_separators(c), F.lit(_SEGMENT), F.lit(0))


def repair_yaml_text(c: Column | str) -> Column:
    """The whole text repaired, literal blocks untouched. One row in, one row out: no shuffle."""
    fixed = F.transform(segments(c), lambda s: F.when(s.rlike(_BLOCK), s).otherwise(repair_line(s)))
    return F.array_join(fixed, "\n")
