"""Between flat extractions, nested records and long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import vocab
from postloom.functions.access import items
from postloom.functions.text import as_col
from postloom.operators.joins import join_known
from postloom.operators.ranking import number_rows
from postloom.session import checkpointed


def skills_by_category(skills: Column | str, categories: list[str] = vocab.SKILL_CATEGORIES) -> Column:
    """array<struct<name, category>> as a struct with one name array per category; absent category gives []."""
    source = as_col(skills)

    def of(category: str) -> Column:
        own = F.filter(source, lambda s: s.getField("category") == category)
        return items(F.transform(own, lambda s: s.getField("name"))).alias(category)

    return F.struct(*[of(c) for c in categories])


def flat_to_nested(df: DataFrame, *, job_id: str = "job_id", title: str = "title", company: str = "company",
                   extracted_at: Column | None = None,
                   categories: list[str] = vocab.SKILL_CATEGORIES) -> DataFrame:
    """A flat extraction per posting as the nested record. Narrow: no shuffle."""
    at = extracted_at if extracted_at is not None else F.date_format(
        F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.select(
        F.struct(F.col(company).alias("name"), F.col("company_stage").alias("stage"),
                 F.col("company_focus").alias("focus")).alias("company"),
        F.struct(
            F.coalesce(F.col(title), F.lit("")).alias("title"),
            F.struct(F.col("ai_type").alias("type"), F.col("ai_type_reasoning").alias("reasoning")).alias("ai_type"),
            items("responsibilities").alias("responsibilities"),
            items("use_cases").alias("use_cases"),
            skills_by_category("skills", categories).alias("skills"),
            F.coalesce(F.col("is_customer_facing"), F.lit(False)).alias("is_customer_facing"),
            F.coalesce(F.col("is_management"), F.lit(False)).alias("is_management"),
        ).alias("position"),
        F.struct(F.col(job_id).cast("string").alias("job_id"), at.alias("extracted_at")).alias("meta"),
    )


def skills_summary(skills: Column | str, categories: list[str] = vocab.SKILL_CATEGORIES) -> Column:
    """struct(all, by_category, count): every name in source order, the category arrays and their total."""
    names = F.transform(as_col(skills), lambda s: s.getField("name"))
    return F.struct(F.coalesce(names, F.array().cast("array<string>")).alias("all"),
                    skills_by_category(skills, categories).alias("by_category"),
                    F.coalesce(F.size(as_col(skills)), F.lit(0)).alias("count"))


HELD_ROWS = 4096  # so many rows of a key are put in order inside one row, however small its parts are
KEY_BUCKETS = 1 << 18


def _keys_above(keys: DataFrame, key: str, most: int) -> tuple[DataFrame | None, int]:
    """Keys with more than `most` rows as `key, _n`, and how many there are. Hash buckets are counted first, a bounded number of
    them; keys are counted only in buckets that are above `most` themselves."""
    dealt = keys.filter(F.col(key).isNotNull()).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)))
    buckets = checkpointed(dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("_bucket"))
    n_buckets = buckets.count()
    if not n_buckets:
        return None, 0
    counted = join_known(dealt, buckets, n_buckets, "_bucket", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = checkpointed(counted.filter(F.col("_n") > most))
    return hot, hot.count()


def nest_rows(rows: DataFrame, key: str, category: str, item: str, order: list[str], categories: list[str],
              *, part_size: int = 50_000, held_rows: int = HELD_ROWS) -> DataFrame:
    """Long (key, category, item) rows as nested records: `key, part, <one array per category>`.

    Rows of a key have a total order: `order`, then category, then item. Part p holds the rows at positions
    p * part_size + 1 to (p + 1) * part_size, so reading a key's parts one after the other gives its lists in `order`, and
    no task holds more than `part_size` or `held_rows` rows of a key, whichever is more. Keys within that are gathered once,
    sorted and cut into parts inside their row. Only larger keys are numbered. Equal rows of such a key are counted before
    they are laid out again with a running number that breaks their tie.
    """
    rows = rows.select(key, category, *order, item)
    held = max(part_size, held_rows)
    hot, n_hot = _keys_above(rows.select(key), key, held)
    entry = F.struct(*[F.col(o) for o in order], F.col(category).alias("_category"), F.col(item).alias("_item"))

    def nested(parts: DataFrame) -> DataFrame:
        def of(c: str) -> Column:
            own = F.filter("_rows", lambda e: e.getField("_category") == c)
            return F.transform(own, lambda e: e.getField("_item")).alias(c)

        return parts.select(key, "part", *[of(c) for c in categories])

    def gathered(some: DataFrame, *by: str) -> DataFrame:
        return some.groupBy(key, *by).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))

    def cut(some: DataFrame) -> DataFrame:
        parts = F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / part_size).cast("int"))
        return gathered(some).select(key, F.posexplode(F.transform(parts, lambda p: F.slice("_rows", p * part_size + 1, part_size))).alias("part", "_rows"))

    if not n_hot:
        return nested(cut(rows))
    marked = join_known(rows, hot, n_hot, key)
    equal = marked.filter(F.col("_n").isNotNull()).groupBy(key, category, *order, item).agg(F.count(F.lit(1)).alias("_m"))
    runs = equal.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / part_size))).alias("_run"))
    laid = runs.select(key, category, *order, item, "_run", F.explode(F.sequence(
        F.lit(1), F.least(F.col("_m") - F.col("_run") * part_size, F.lit(part_size)))).alias("_copy"))
    numbered = number_rows(laid, [*order, category, item, "_run", "_copy"], group=[key], name="_at")
    split = numbered.withColumn("part", F.floor((F.col("_at") - 1) / part_size).cast("int"))
    cold = cut(marked.filter(F.col("_n").isNull()))
    return nested(cold.unionByName(gathered(split, "part")))


def unnest_skills(df: DataFrame, skills: str, keep: list[Column | str],
                  categories: list[str] = vocab.SKILL_CATEGORIES) -> DataFrame:
    """One row per list entry: the kept columns plus `category, pos, skill`. Narrow."""

    def entries(category: str) -> Column:
        return F.transform(items(f"{skills}.{category}"), lambda s, i: F.struct(
            F.lit(category).alias("category"), i.alias("pos"), s.alias("skill")))

    return df.select(*[as_col(k) for k in keep], F.inline(F.flatten(F.array(*[entries(c) for c in categories]))))


def explode_with_source(df: DataFrame, items_col: Column | str, keep: list[Column | str], name: str = "item") -> DataFrame:
    """One row per list item with its source columns and its position; null or missing lists give no rows."""
    # The outer form is not duplicated as a filter below the generator; its empty rows are dropped here.
    return df.select(*[as_col(k) for k in keep], F.posexplode_outer(as_col(items_col)).alias("pos", name)).filter(
        F.col("pos").isNotNull())


def normalize_postings(df: DataFrame) -> DataFrame:
    """Fold both generations of the structured record (schema EITHER_GENERATION) into the live one."""
    empty = F.array().cast("array<string>")

    def as_list(c: str) -> Column:
        return F.when(F.length(F.col(c)) > 0, F.array(F.col(c)))

    return df.select(
        F.struct("company.name", "company.stage", "company.focus").alias("company"),
        F.struct(
            F.coalesce(F.col("position.title"), F.col("title"), F.lit("")).alias("title"),
            F.coalesce(F.col("position.ai_type"), F.col("ai_type")).alias("ai_type"),
            F.coalesce(F.col("position.responsibilities"), as_list("responsibilities"), empty).alias("responsibilities"),
            F.coalesce(F.col("position.use_cases"), as_list("company.use_cases"), empty).alias("use_cases"),
            F.struct(*[F.coalesce(F.col(f"position.skills.{c}"), F.col(f"skills.by_category.{c}"), empty).alias(c)
                       for c in vocab.SKILL_CATEGORIES]).alias("skills"),
            F.coalesce(F.col("position.is_customer_facing"), F.col("is_customer_facing"), F.lit(False))
            .alias("is_customer_facing"),
            F.coalesce(F.col("position.is_management"), F.col("is_management"), F.lit(False)).alias("is_management"),
        ).alias("position"),
        F.struct(F.coalesce(F.col("meta.job_id"), F.col("job_id")).alias("job_id"),
                 F.coalesce(F.col("meta.extracted_at"), F.col("extracted_at")).alias("extracted_at")).alias("meta"),
    )
