"""String expressions. All of them stay inside the JVM and inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regex flags that give Java the matching rules of the source data: ignore case, Unicode classes, `\n` ends a line.
ICASE = "(?iUd)"
WS = r"(?U)\s+"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote(literal: str) -> str:
    """`literal` as a regex that matches itself in both Java and RE2."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|/" else ch for ch in literal)


def let(values: list[Column], body) -> Column:
    """`body(*values)` with every value computed once per row.

    Projections share repeated subexpressions, but filters and generators do not, and the
    optimizer is free to move an expression into one of them. A lambda variable is shared anywhere.
    """
    if len(values) == 1:
        return F.get(F.transform(F.array(values[0]), body), F.lit(0))
    bound = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(bound, lambda s: body(*[s.getField(f"v{i}") for i in range(len(values))])), F.lit(0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c: Column | str, keywords: list[str], *, lower: bool = True, word_boundary: bool = False) -> Column:
    """True when the text holds any keyword as a substring (or as whole words).

    A chain of `contains` short-circuits and runs several times faster on long text than one
    regex alternation, so the alternation is used only when word boundaries are asked for.
    """
    text = F.lower(as_col(c)) if lower else as_col(c)
    if word_boundary:
        return text.rlike(r"(?U)\b(?:" + "|".join(quote(k) for k in keywords) + r")\b")
    if lower and len(keywords) > 2:
        return let([text], lambda t: any_of([F.contains(t, F.lit(k)) for k in keywords]))
    return any_of([F.contains(text, F.lit(k)) for k in keywords])


def contains_all(c: Column | str, keywords: list[str], *, lower: bool = True) -> Column:
    text = F.lower(as_col(c)) if lower else as_col(c)
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(k)) for k in keywords])


def count_keywords(texts: list[Column], keywords: list[str]) -> Column:
    """Number of distinct keywords found in at least one of the texts."""
    return reduce(lambda a, b: a + b,
                  [any_of([F.contains(t, F.lit(k)) for t in texts]).cast("int") for k in keywords])


def strip(c: Column | str) -> Column:
    """Strip all Unicode white space from both ends (`trim` strips spaces only)."""
    return F.regexp_replace(as_col(c), r"(?U)^\s+|\s+\z", "")


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), WS, " ")


def words(c: Column | str) -> Column:
    """White-space tokens in order; punctuation stays attached."""
    return F.filter(F.split(as_col(c), WS), lambda w: F.length(w) > 0)


def truncate_preview(c: Column | str, n: int, suffix: str = "...") -> Column:
    """The first `n` characters, always followed by `suffix`."""
    return F.concat(F.substring(as_col(c), 1, n), F.lit(suffix))


def text_bundle(*parts: Column | str) -> Column:
    """One lower-cased search text; array parts are joined by spaces, null parts count as empty."""
    return F.lower(F.concat_ws(" ", *[as_col(p) for p in parts]))


def compose_location(city: Column | str, country: Column | str) -> Column:
    """`City, Country`, the one that is present, or the empty string."""
    return F.concat_ws(", ", F.nullif(as_col(city), F.lit("")), F.nullif(as_col(country), F.lit("")))


def url_tail_id(url: Column | str, default: str = "unknown") -> Column:
    """Last segment of the URL path; `default` when it is empty."""
    path = F.try_parse_url(as_col(url), F.lit("PATH"))
    return F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), F.lit(default))


def link_tail_id(link: Column | str) -> Column:
    """Everything after the last `/` of the raw link, query string included."""
    return F.substring_index(as_col(link), "/", -1)


def sanitize_filename(c: Column | str) -> Column:
    """Keep word characters and dashes, turn white space into `_`, strip `_` from the ends."""
    kept = F.regexp_replace(as_col(c), r"(?U)[^\w\s-]", "")
    return F.btrim(F.regexp_replace(kept, WS, "_"), F.lit("_"))


def record_file_name(job_id: Column | str, company: Column | str, title: Column | str, ext: str = "yaml") -> Column:
    """`{id}_{company}_{title, first 50 characters}.{ext}`; an empty company is called Unknown."""
    who = F.when(F.length(as_col(company)) > 0, sanitize_filename(company)).otherwise("Unknown")
    return F.concat(F.concat_ws("_", as_col(job_id), who, sanitize_filename(F.substring(as_col(title), 1, 50))),
                    F.lit("." + ext))


def page_file_name(title: Column | str, job_id: Column | str) -> Column:
    """`{title, first 30 characters}_{id}.html`; without a title, `job_{id}` stands in for it."""
    head = F.substring(strip(title), 1, 30)
    head = F.regexp_replace(head, r"[^\p{L}\p{N} _-]", "_")
    head = F.btrim(F.btrim(head, F.lit("_")), F.lit("-"))
    head = F.coalesce(F.regexp_replace(head, " ", "_"), F.concat(F.lit("job_"), as_col(job_id)))
    return F.concat(head, F.lit("_"), as_col(job_id), F.lit(".html"))


def company_size(c: Column | str) -> Column:
    """`1,200 Employees` from free text, or the empty string."""
    number = F.regexp_extract(as_col(c), r"(?U)(\d+[,\d]*)\s+Employees", 1)
    return F.when(F.length(number) > 0, F.concat(number, F.lit(" Employees"))).otherwise("")


def size_number(c: Column | str) -> Column:
    """The integer in front of `Employees`, or null."""
    return F.regexp_replace(F.regexp_extract(as_col(c), r"(\d+[,\d]*)", 1), ",", "").try_cast("int")


def salary_range(c: Column | str) -> Column:
    """`$160,000 - $180,000/year` as struct(lo, hi, unit); null fields where absent."""
    text = as_col(c)

    def amount(group: int) -> Column:
        found = F.regexp_extract(text, r"\$?([\d,]+)(K?)\s*-\s*\$?([\d,]+)(K?)", group)
        kilo = F.regexp_extract(text, r"\$?([\d,]+)(K?)\s*-\s*\$?([\d,]+)(K?)", group + 1)
        value = F.regexp_replace(found, ",", "").try_cast("decimal(12,2)")
        return F.when(kilo == "K", value * 1000).otherwise(value).cast("decimal(12,2)")

    unit = F.nullif(F.regexp_extract(text, r"/\s*(\w+)", 1), F.lit(""))
    return F.struct(amount(1).alias("lo"), amount(3).alias("hi"), unit.alias("unit"))


def strip_bullet(c: Column | str) -> Column:
    """Remove one leading list marker (`-`, `*`, `•`) and the blanks around it."""
    return F.regexp_replace(as_col(c), r"^\s*[-*•]\s*", "")


def has_bullet(c: Column | str) -> Column:
    return as_col(c).rlike(r"^\s*[-*•]")


def absolute_link(href: Column | str, base: str, hosts: list[str] | None = None) -> Column:
    """Relative links get `base` in front; with `hosts`, only links that name one of them do."""
    link = as_col(href)
    relative = ~F.startswith(link, F.lit("http")) & (F.length(link) > 0)
    if hosts:
        relative = relative & contains_any(link, hosts, lower=False)
    joined = F.concat(F.lit(base.rstrip("/")), F.when(F.startswith(link, F.lit("/")), link).otherwise(
        F.concat(F.lit("/"), link)))
    return F.when(relative, joined).otherwise(link)


def page_url(url: Column | str, page: Column | str) -> Column:
    """Page 1 is the URL itself; later pages add `page=n` with the right separator."""
    u, n = as_col(url), as_col(page)
    sep = F.when(F.contains(u, F.lit("?")), "&").otherwise("?")
    return F.when(n > 1, F.concat(u, sep, F.lit("page="), n.cast("string"))).otherwise(u)
