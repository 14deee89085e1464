"""Rule classifiers as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import vocab
from postloom.functions.text import ICASE, any_of, as_col, contains_any, count_keywords, let, quote


def _alternation(patterns: list[str]) -> str:
    return ICASE + "(?:" + "|".join(patterns) + ")"


def role_before_ai(title: Column | str, terms: list[str] = vocab.GUARD_TERMS) -> Column:
    """Some later word holds `ai` and one of its three preceding words holds a role term.

    A term of m words leaves room for 3 - m whole words between it and the word with `ai`.
    """
    forms = []
    for term in terms:
        parts = term.split(" ")
        forms.append(r"\s+".join(quote(p) for p in parts) + r"\S*(?:\s+\S+){0,%d}\s+\S*ai" % (3 - len(parts)))
    return F.lower(as_col(title)).rlike("(?U)(?:" + "|".join(forms) + ")")


def prefix_role_guard(title: Column | str) -> Column:
    """An engineering role named in front of `ai`: the field is applied to it, not practised by it."""
    return contains_any(title, vocab.SUPPORT_PHRASES) & role_before_ai(title)


def classify_title(title: Column | str, *, first: list[str] = vocab.AI_FIRST_PATTERNS,
                   support: list[str] = vocab.AI_SUPPORT_PATTERNS) -> Column:
    """ai_first, ai_support or other. One ordered `when` chain; the guard is evaluated once."""
    def rules(t: Column, low: Column) -> Column:
        has = lambda words: contains_any(low, words, lower=False)
        guard = has(vocab.SUPPORT_PHRASES) & role_before_ai(low)
        return (
            F.when(t.rlike(_alternation(first)) & ~guard, "ai_first")
            .when(t.rlike(_alternation(support)), "ai_support")
            .when(has(vocab.AI_FIRST_KEYWORDS) & ~has(vocab.SOFTWARE_PHRASES), "ai_first")
            .when(has(vocab.SUPPORT_PHRASES) & has(["ai"]), "ai_support")
            .otherwise("other")
        )

    return F.coalesce(let([as_col(title), F.lower(as_col(title))], rules), F.lit("other"))


def is_outside_field(title: Column | str) -> Column:
    """Optional filter for roles outside the field."""
    return as_col(title).rlike(_alternation(vocab.NON_AI_PATTERNS))


def score_compare(title: Column, bodies: list[Column], *, for_words: list[str], against_words: list[str],
                  title_words: list[str], at_least: int = 2) -> Column:
    """struct(hit, reason): a title word decides; else more `for` than `against` keywords, and enough of them.

    `title` must be lower-cased by the caller and counts for the `for` side only; `bodies` are taken as they are.
    """
    def rules(t: Column, *texts: Column) -> Column:
        a, b = count_keywords([t, *texts], for_words), count_keywords(list(texts), against_words)
        reason = (F.when(contains_any(t, title_words, lower=False), "title")
                  .when((a > b) & (a >= at_least), "content").otherwise("none"))
        return F.struct((reason != "none").alias("hit"), reason.alias("reason"))

    return let([title, *bodies], rules)


def depth_level(mention_text: Column, title: Column, body: Column, *, indicators: list[str],
                title_words: list[str], repeated: list[str], techniques: list[str]) -> Column:
    """primary, secondary or none.

    Primary needs a mention and one of: a title word, two or more occurrences in the body
    (case-sensitive), or a named technique. `mention_text` must be lower-cased.
    """
    def rules(mention: Column, low_title: Column, text: Column) -> Column:
        has = lambda words: contains_any(mention, words, lower=False)
        occurrences = reduce(lambda x, y: x + y, [F.regexp_count(text, F.lit(quote(r))) for r in repeated])
        deep = contains_any(low_title, title_words, lower=False) | (occurrences >= 2) | has(techniques)
        return F.when(has(indicators), F.when(deep, "primary").otherwise("secondary")).otherwise("none")

    return let([mention_text, F.lower(title), body], rules)


def months_to_level(months: Column | str, bands: list[tuple[int, str]] = vocab.LEVEL_BANDS,
                    top: str = vocab.TOP_LEVEL) -> Column:
    """Experience in months as a level name; null and zero give the empty string."""
    m = as_col(months)
    out = F.when(m.isNull() | (m == 0), "")
    for years, label in bands:
        out = out.when(m / 12 < years, label)
    return out.otherwise(top)


def capability(skills: Column | str, terms: list[str]) -> Column:
    """Some skill of the (lower-cased) array holds some term."""
    return F.exists(as_col(skills), lambda s: any_of([F.contains(s, F.lit(t)) for t in terms]))


def entry_level(title: Column | str) -> Column:
    return contains_any(title, vocab.ENTRY_LEVEL_WORDS)


def normalize_title(title: Column | str, removed: list[str] = vocab.SENIORITY_WORDS, *, mode: str = "compat") -> Column:
    """Base title for grouping.

    `compat` removes the strings wherever they occur (so `i` disappears from every word) and
    strips after each removal; `token` removes whole words only.
    """
    t = F.lower(as_col(title))
    if mode == "token":
        pattern = r"(?U)(?<![\w.])(?:" + "|".join(quote(w) for w in sorted(set(removed), key=len, reverse=True)) + r")(?![\w.])"
        return F.btrim(F.regexp_replace(F.regexp_replace(t, pattern, ""), r"(?U)\s+", " "))
    return reduce(lambda acc, word: F.btrim(F.replace(acc, F.lit(word), F.lit("")), F.lit(" \t\n\r\f\v\u00a0")), removed, t)


def score_rule(a: Column, b: Column, *, first: str = "ai-first", second: str = "ai-support",
               neither: str = "unknown", at_least: int = 2) -> Column:
    """Two scores: the larger wins once it reaches the threshold; below it, any hit of the first, then of the second."""
    return (F.when((a > b) & (a >= at_least), first).when((b > a) & (b >= at_least), second)
            .when(a > 0, first).when(b > 0, second).otherwise(neither))


def strip_version(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), r"\s+v?\d+(\.\d+)*$", "")
