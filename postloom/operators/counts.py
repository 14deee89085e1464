"""Frequencies, rates, cross-tabs and tallies: hash aggregates with map-side combine throughout.

A hot key never becomes a hot task here, because every group is reduced to one partial row per
map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.access import row_count
from postloom.functions.classify import capability
from postloom.functions.text import WS, as_col
from postloom.operators.ranking import top_k, top_k_per_group


def value_counts(df: DataFrame, by: list[str] | str, *, top: int | None = None, min_count: int = 0) -> DataFrame:
    """Rows per value, nulls left out; with `top`, the most frequent ones in order, ties by key."""
    keys = [by] if isinstance(by, str) else list(by)
    counts = df.dropna(subset=keys).groupBy(*keys).agg(row_count().alias("n"))
    if min_count:
        counts = counts.filter(F.col("n") >= min_count)
    return top_k(counts, top, "n", keys) if top else counts


def share_of_total(counts: DataFrame, n: str = "n") -> DataFrame:
    """Add `pct` of the sum of `n`. The total is a scalar subquery, not a one-partition window."""
    total = counts.agg(F.sum(n).alias("total")).scalar()
    return counts.withColumn("pct", F.try_divide(F.lit(100.0) * F.col(n), total.cast("double")))


def share_of(counts: DataFrame, base: DataFrame, n: str = "n") -> DataFrame:
    """Add `pct` of the number of rows of `base` (postings, for example, rather than mentions)."""
    total = base.agg(row_count().alias("total")).scalar()
    return counts.withColumn("pct", F.try_divide(F.lit(100.0) * F.col(n), total.cast("double")))


def match_rate(df: DataFrame, **predicates: Column) -> DataFrame:
    """Mean of each predicate; null counts as false."""
    return df.agg(*[F.avg(F.coalesce(p, F.lit(False)).cast("double")).alias(name) for name, p in predicates.items()])


def distinct_count(df: DataFrame, *columns: str, approximate: bool = False) -> DataFrame:
    """Number of distinct values per column; the approximate form needs constant memory."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[count(c).alias(f"n_{c}") for c in columns])


def distinct_sketches(df: DataFrame, by: list[str], column: str, *, lg: int = 12) -> DataFrame:
    """`by`, sketch: a HyperLogLog sketch of 2^lg cells per group, to be stored. A new period is a new row: nothing is read again."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(column, lg).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: list[str] = (), n: str = "n_about") -> DataFrame:
    """Distinct values of all sketches of a group; with 2^12 cells the standard error is under 2 %."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(n))


def composite_counts(df: DataFrame, left: str, right: str, *, top: int | None = None) -> DataFrame:
    """Frequency of `left + ' ' + right`; a null on either side leaves the row out."""
    return value_counts(df.select(F.concat(F.col(left), F.lit(" "), F.col(right)).alias("value")), "value", top=top)


def category_item_counts(long: DataFrame, *, category: str = "category", item: str = "skill",
                         without: list[str] = ()) -> DataFrame:
    """List entries per (category, item), optionally without some categories."""
    rows = long.filter(~F.col(category).isin(*without)) if without else long
    return rows.filter(F.col(item).isNotNull()).groupBy(category, item).agg(row_count().alias("n"))


def crosstab(df: DataFrame, group: str, kind: str, kinds: list[str]) -> DataFrame:
    """Group by fixed kinds, one column each: a single conditional aggregate (no pivot job)."""
    return df.groupBy(group).agg(row_count().alias("n"), *[F.count_if(F.col(kind) == k).alias(_name(k)) for k in kinds])


def _name(kind: str) -> str:
    return "n_" + "".join(ch if ch.isalnum() else "_" for ch in kind.lower())


def flag_counts(df: DataFrame, flags: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """Several conditional counts in one pass."""
    return df.groupBy(*by).agg(row_count().alias("n_total"), *[
        F.count_if(F.coalesce(f, F.lit(False))).alias(name) for name, f in flags.items()])


def unpivot(df: DataFrame, keep: list[str], columns: dict[str, str], label: str, value: str) -> DataFrame:
    """Wide to long; `columns` maps the label to show to the column that holds its value."""
    entry = F.array(*[F.struct(F.lit(show).alias(label), F.col(col).alias(value)) for show, col in columns.items()])
    return df.select(*keep, F.inline(entry))


def postings_with_term(df: DataFrame, skills: Column | str, terms: list[str], by: list[str] = ()) -> DataFrame:
    """Per term: postings whose (lower-cased) skill array holds it as a substring. One scan for all terms.

    Long form: `<by>, term, n, n_total`; the extra term `any` counts postings with at least one.
    """
    array = as_col(skills)
    found = [f"t{i}" for i in range(len(terms))]
    flagged = df.select(*by, *[F.coalesce(capability(array, [t.lower()]), F.lit(False)).alias(n) for n, t in zip(found, terms)])
    anything = F.lit(False)
    for name in found:
        anything = anything | F.col(name)
    wide = flagged.groupBy(*by).agg(row_count().alias("n_total"), F.count_if(anything).alias("any"),
                                    *[F.count_if(F.col(name)).alias(name) for name in found])
    labels = {t: f"t{i}" for i, t in enumerate(terms)} | {"any": "any"}
    return unpivot(wide, [*by, "n_total"], labels, "term", "n")


def keys_with_term(rows: DataFrame, key: list[str], item: str, terms: list[str], by: list[str] = ()) -> DataFrame:
    """`postings_with_term` when the skills arrive as rows: one flag per term and key, then one count.

    The per-key step keeps only booleans, so a key with very many rows stays one small group.
    """
    text = F.lower(F.col(item))
    flags = [F.bool_or(F.contains(text, F.lit(t.lower()))).alias(f"t{i}") for i, t in enumerate(terms)]
    per_key = rows.groupBy(*key, *by).agg(*flags)
    anything = F.lit(False)
    for i in range(len(terms)):
        anything = anything | F.col(f"t{i}")
    wide = per_key.groupBy(*by).agg(row_count().alias("n_total"), F.count_if(anything).alias("any"),
                                    *[F.count_if(F.col(f"t{i}")).alias(f"t{i}") for i in range(len(terms))])
    labels = {t: f"t{i}" for i, t in enumerate(terms)} | {"any": "any"}
    return unpivot(wide, [*by, "n_total"], labels, "term", "n")


def word_frequency(df: DataFrame, text: str, *, stop_words: list[str] = (), longer_than: int = 3,
                   top: int | None = 30, strip_punct: bool = False) -> DataFrame:
    """Lower-cased white-space tokens longer than `longer_than`, without the stop words."""
    source = F.lower(F.col(text))
    if strip_punct:
        source = F.regexp_replace(source, r"(?U)[^\w\s-]", "")
    tokens = df.select(F.explode(F.split(source, WS)).alias("word")).filter(F.length("word") > longer_than)
    if stop_words:
        tokens = tokens.filter(~F.col("word").isin(*stop_words))
    return value_counts(tokens, "word", top=top)


def group_items(df: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """Per group: number of rows and its first `n` distinct items in sorted order.

    The sample is a per-group top-n over distinct pairs, so no group is ever collected whole.
    """
    pairs = df.dropna(subset=[group, item]).groupBy(group, item).agg(row_count().alias("_n"))
    totals = pairs.groupBy(group).agg(F.sum("_n").alias("n"), row_count().alias("n_distinct"))
    first = top_k_per_group(pairs, [group], n, [F.col(item).asc()])
    samples = first.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("samples"))
    return totals.join(samples, group)


def term_rates(df: DataFrame, text: str, terms: list[str], by: list[str]) -> DataFrame:
    """Per group and term: texts containing the term and their share. One scan for all terms."""
    lowered = df.select(*by, F.lower(F.col(text)).alias("_t"))
    wide = lowered.groupBy(*by).agg(row_count().alias("n_total"), *[
        F.count_if(F.contains(F.col("_t"), F.lit(t))).alias(f"t{i}") for i, t in enumerate(terms)])
    long = unpivot(wide, [*by, "n_total"], {t: f"t{i}" for i, t in enumerate(terms)}, "term", "n")
    return long.withColumn("pct", F.try_divide(F.lit(100.0) * F.col("n"), F.col("n_total").cast("double")))


def totals_by_type(df: DataFrame, kind: str, value: Column | None = None) -> DataFrame:
    """Totals per kind plus the grand total in the row `(all)`."""
    measure = F.sum(value) if value is not None else row_count()
    return (df.rollup(kind).agg(measure.alias("n"), F.grouping(kind).alias("_g"))
            .select(F.when(F.col("_g") == 1, "(all)").otherwise(F.col(kind)).alias(kind), "n"))


def run_tally(df: DataFrame, status: str, *, errors: str | None = None, first: int = 5) -> dict[str, DataFrame]:
    """Counts per status, and the first few error messages."""
    out = {"status": df.groupBy(status).agg(row_count().alias("n"))}
    if errors:
        out["errors"] = df.filter(F.col(errors).isNotNull()).orderBy(errors).limit(first).select(errors)
    return out


def profile_summary(df: DataFrame, company: str, location: str, *, top: int = 10) -> DataFrame:
    """Header of a listing in long form: totals, top locations and top companies as (section, key, n)."""
    heads = unpivot(
        df.agg(row_count().alias("total"), F.countDistinct(company).alias("companies"),
               F.countDistinct(location).alias("locations")),
        [], {"total": "total", "companies": "companies", "locations": "locations"}, "key", "n",
    ).select(F.lit("summary").alias("section"), "key", "n")
    out = heads
    for section, column in (("location", location), ("company", company)):
        part = value_counts(df, column, top=top).select(
            F.lit(section).alias("section"), F.col(column).cast("string").alias("key"), "n")
        out = out.unionByName(part)
    return out


def exclusive_items(df: DataFrame, kind: str, item: str, n: int) -> DataFrame:
    """The first `n` distinct items of every kind, in sorted order, numbered."""
    distinct = df.select(kind, item).dropna().distinct()
    return top_k_per_group(distinct, [kind], n, [F.col(item).asc()], rank="rank")


def quality_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule: (rule, n_failed, n_total)."""
    wide = df.agg(row_count().alias("n_total"), *[
        F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values())])
    return unpivot(wide, ["n_total"], {name: f"r{i}" for i, name in enumerate(rules)}, "rule", "n_failed")


def sample_per_batch(df: DataFrame, batch: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of `n` rows per batch, chosen by hash of the key."""
    return top_k_per_group(df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))), [batch], n,
                           [F.col("_h").asc(), F.col(key).asc()]).drop("_h")


def cluster_label(df: DataFrame, group: str, kind: str, first: str, second: str, *, share: float = 75.0,
                  min_total: int = 3) -> DataFrame:
    """Groups of at least `min_total` rows labelled by the kind that holds at least `share` percent, else mixed."""
    counts = df.groupBy(group).agg(row_count().alias("n"), F.count_if(F.col(kind) == first).alias("n_first"),
                                   F.count_if(F.col(kind) == second).alias("n_second"))
    pct = {name: F.lit(100.0) * F.col(name) / F.col("n") for name in ("n_first", "n_second")}
    return (counts.filter(F.col("n") >= min_total)
            .withColumn("label", F.when(pct["n_first"] >= share, first)
                        .when(pct["n_second"] >= share, second).otherwise("mixed")))


def title_families(df: DataFrame, families: Column, kind: str, first: str) -> DataFrame:
    """Multi-label families: rows, rows of the first kind and its share per family."""
    return (df.select(F.explode(families).alias("family"), kind).groupBy("family")
            .agg(row_count().alias("n"), F.count_if(F.col(kind) == first).alias("n_first"))
            .withColumn("pct_first", F.lit(100.0) * F.col("n_first") / F.col("n")))


def bucketed_item_counts(df: DataFrame, bucket: Column, skills: str, categories: list[str], *, per_category: int = 10) -> DataFrame:
    """Skills per bucket, at most the first `per_category` of every category list of a record."""
    heads = F.flatten(F.array(*[F.slice(F.coalesce(F.col(f"{skills}.{c}"), F.array().cast("array<string>")), 1, per_category)
                                for c in categories]))
    rows = df.filter(bucket.isNotNull()).select(bucket.alias("bucket"), F.explode(heads).alias("skill"))
    return rows.groupBy("bucket", "skill").agg(row_count().alias("n"))


def shown_percent(df: DataFrame, pct: str = "pct") -> DataFrame:
    """Add the percentage as a report shows it, with one decimal; the exact one stays."""
    return df.withColumn(f"{pct}_shown", F.round(pct, 1))
