"""Items that occur together in a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.access import row_count
from postloom.functions.text import as_col
from postloom.operators.joins import join_checked, join_known
from postloom.operators.ranking import number_rows
from postloom.session import checkpointed

FEW_ITEMS = 1448     # whose pairs, about a million, fit the partial aggregate of any task
TASK_PAIRS = 1 << 21  # so many pairs, or a little more, are counted by one task


def pair_counts(df: DataFrame, items: Column | str, *, min_count: int = 1, keep: list[str] = ()) -> DataFrame:
    """Unordered pairs of distinct items inside each record's array: `a < b, n`.

    With a minimum count the items go on as rows (`pair_counts_rows`), so that rare items leave before any pair is formed and a wide
    record is many tasks. Without one, two nested generators stream the pairs of a record into the partial aggregate; no pair array
    is ever built, and nothing but partial counts is shuffled. (The outer form keeps the optimizer from evaluating the array a
    second time in a filter below the generator.)
    """
    if min_count > 1:
        records = df.select(*keep, F.array_distinct(F.array_compact(as_col(items))).alias("_s")).withColumn("_k", F.monotonically_increasing_id())
        rows = records.select("_k", *keep, F.explode_outer("_s").alias("_i")).filter(F.col("_i").isNotNull())
        # `keep` is the same for all items of a record, so it goes along inside the item
        pairs = pair_counts_rows(rows.select("_k", F.struct(*keep, "_i").alias("_v")), "_k", "_v", min_count=min_count)
        return pairs.select(*[F.col(f"a.{c}").alias(c) for c in keep], F.col("a._i").alias("a"), F.col("b._i").alias("b"), "n")
    sets = df.select(*keep, F.array_sort(F.array_distinct(F.array_compact(as_col(items)))).alias("_s"))
    left = sets.select(*keep, "_s", F.posexplode_outer("_s").alias("_i", "a"))
    pairs = left.select(*keep, "a", F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("b"))
    return pairs.groupBy(*keep, "a", "b").agg(row_count().alias("n")).filter(F.col("n") >= min_count)


def pair_counts_rows(rows: DataFrame, key: str, item: str, *, min_count: int = 1, block: int = 1024, few_items: int = FEW_ITEMS) -> DataFrame:
    """`pair_counts` when the items arrive as (key, item) rows.

    * Both items of a pair that is frequent enough must be frequent enough themselves, so rarer
      items leave before any pair is formed. This is exact.
    * A key with more than `block` distinct items is cut into item blocks, and each pair of blocks
      is its own join key: a hot key spreads over many tasks, each of at most block x block pairs.
    * The distinct (key, item) rows are written once (shared scratch table); support, block counts and both sides read them.
    * With a minimum count and many items left, partial counts would be about as many as pairs, each with two items in it. Such
      pairs are shuffled as number lists instead (`_listed_pairs`).
    """
    sets = checkpointed(rows.select(F.col(key).alias("_k"), F.col(item).alias("_v")).dropna().distinct())
    if min_count > 1:
        support = checkpointed(sets.groupBy("_v").agg(row_count().alias("_n")).filter(F.col("_n") >= min_count))
        n_items = support.count()
        if n_items > few_items:
            return _listed_pairs(sets, support, n_items, min_count, block)
        sets = join_known(sets, support.select("_v"), n_items, "_v", "left_semi")
    wide = _wide(sets, block)
    tagged = _tagged(join_checked(sets, wide, "_k"), "_v")
    left = tagged.select("_k", F.col("_v").alias("_x"), F.col("_b").alias("_b1"),
                         F.explode(F.sequence(F.col("_b"), F.col("_blocks") - 1)).alias("_b2"))
    right = tagged.select("_k", F.col("_v").alias("_y"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_b1"),
                          F.col("_b").alias("_b2"))
    pairs = left.join(right, ["_k", "_b1", "_b2"]).filter(
        (F.col("_b1") < F.col("_b2")) | (F.col("_x") < F.col("_y")))
    return (pairs.groupBy(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))
            .agg(row_count().alias("n")).filter(F.col("n") >= min_count))


def _wide(sets: DataFrame, block: int) -> DataFrame:
    """Keys with more than `block` items and the number of their blocks."""
    return (sets.groupBy("_k").agg(row_count().alias("_n")).filter(F.col("_n") > block)
            .select("_k", F.ceil(F.col("_n") / block).cast("int").alias("_blocks")))


def _tagged(sets: DataFrame, item: str) -> DataFrame:
    blocks = F.coalesce("_blocks", F.lit(1))
    return sets.select("_k", item, blocks.alias("_blocks"), F.pmod(F.xxhash64(item), blocks).cast("int").alias("_b"))


def _listed_pairs(sets: DataFrame, support: DataFrame, n_items: int, min_count: int, block: int) -> DataFrame:
    """Pairs of the items of `support` in (_k, _v) rows, for many items.

    Items are numbered by support, rarest first. An item meets the items of higher number in its record (or block of a wide
    record) as one list of numbers, and lists are dealt by that item: a few bytes a pair, all counts of a pair in one task, and
    frequent items, which stand in many records, have short lists. Counted pairs get their items back by joins.
    """
    spark = sets.sparkSession
    kind = "int" if n_items < 1 << 31 else "long"
    items = checkpointed(number_rows(support, ["_n", "_v"], name="_at").select(F.col("_at").cast(kind).alias("_i"), "_v"))
    numbers = checkpointed(join_known(sets, items, n_items, "_v", "inner").select("_k", "_i"))
    wide = checkpointed(_wide(numbers, block))
    n_wide = wide.count()
    tagged = _tagged(join_known(numbers, wide, n_wide, "_k"), "_i")
    lists = checkpointed(tagged.groupBy("_k", "_blocks", "_b").agg(F.sort_array(F.collect_list("_i")).alias("_s")))
    n_pairs = lists.agg(F.sum(F.size("_s") * F.lit(1.0) * F.when(F.col("_blocks") > 1, F.col("_blocks") * block).otherwise(F.size("_s")) / 2)).first()[0] or 0
    own = lists.select("_s", F.posexplode("_s").alias("_p", "_x")).select("_x", F.slice("_s", F.col("_p") + 2, F.size("_s")).alias("_ys"))
    if n_wide:
        many = lists.filter(F.col("_blocks") > 1)
        left = many.select("_k", F.col("_s").alias("_l"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_to"), F.col("_b").alias("_from"))
        right = many.select("_k", F.col("_s").alias("_r"), F.col("_b").alias("_to"))
        met = left.filter(F.col("_from") != F.col("_to")).join(right, ["_k", "_to"]).select("_r", F.explode("_l").alias("_x"))
        own = own.unionByName(met.select("_x", F.filter("_r", lambda y: y > F.col("_x")).alias("_ys")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_pairs // TASK_PAIRS) + 1)
    dealt = own.filter(F.size("_ys") > 0).repartition(tasks, "_x")
    counted = dealt.select("_x", F.explode("_ys").alias("_y")).groupBy("_x", "_y").agg(row_count().alias("n")).filter(F.col("n") >= min_count)
    named = counted
    for number, name in (("_x", "_a"), ("_y", "_b")):
        own_items = items.select(F.col("_i").alias(number), F.col("_v").alias(name)).hint("shuffle_hash")
        named = join_known(named, own_items, n_items, number, "inner")
    return named.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "n")


def present_categories(skills: str, categories: list[str]) -> Column:
    """Names of the non-empty category lists, in record order."""
    return F.array_compact(F.array(*[F.when(F.size(F.col(f"{skills}.{c}")) > 0, F.lit(c)) for c in categories]))


def category_pairs(df: DataFrame, present: Column | str, kind: str) -> DataFrame:
    """Pairs of categories a record fills, by kind: `first, second, kind, n`. Pairs keep record order."""
    sets = df.select(kind, as_col(present).alias("_s"))
    left = sets.select(kind, "_s", F.posexplode_outer("_s").alias("_i", "first"))
    pairs = left.select(kind, "first", F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("second"))
    return pairs.groupBy("first", "second", kind).agg(row_count().alias("n"))


def listed_totals(long: DataFrame, item: str, listed: list[str]) -> DataFrame:
    """Entries per listed item, duplicates counted."""
    return long.filter(F.col(item).isin(*listed)).groupBy(item).agg(row_count().alias("n"))


def listed_pairs(df: DataFrame, items: Column | str, listed: list[str]) -> DataFrame:
    """Pairs among the listed items only."""
    return pair_counts(df, F.filter(as_col(items), lambda s: s.isin(*listed)))
