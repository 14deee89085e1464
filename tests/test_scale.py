"""Hot keys, many partitions and wide records give the same results as a plain model."""

import itertools
import random
from collections import Counter, defaultdict

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from postloom import vocab
from postloom.operators import cooccur, counts, joins, nesting, ranking, setops


def hot_rows(n=3000, keys=40, items=60, seed=1):
    """A third of all rows belong to one key."""
    rnd = random.Random(seed)
    return [(0 if rnd.random() < 0.34 else rnd.randrange(1, keys), i, rnd.choice(["a", "b", "c"]), f"s{rnd.randrange(items):02d}") for i in range(n)]


def rows_df(spark, rows):
    return spark.createDataFrame(rows, "k int, pos int, cat string, item string").repartition(7)


def test_nest_rows_splits_hot_keys_and_loses_nothing(spark):
    rows = hot_rows()
    out = nesting.nest_rows(rows_df(spark, rows), "k", "cat", "item", ["pos"], ["a", "b", "c"], part_size=200).collect()
    sizes = Counter(k for k, *_ in rows)
    assert {r.k for r in out if r.part > 0} == {k for k, n in sizes.items() if n > 200} == {0}
    assert max(len(r.a) + len(r.b) + len(r.c) for r in out) < 300
    got, want = defaultdict(Counter), defaultdict(Counter)
    for r in out:
        for c in "abc":
            got[r.k, c].update(r[c])
    for k, _, c, item in rows:
        want[k, c][item] += 1
    assert {x: y for x, y in got.items() if y} == want
    one = next(r for r in out if r.k == 1)
    assert one.a == [item for k, _, c, item in sorted(rows, key=lambda r: r[1]) if k == 1 and c == "a"]


def test_nest_rows_parts_joined_are_the_whole_list(spark):
    rows = [(0, 1, "a", "same")] * 2000 + [(0, 2, "b", "x")] * 3 + [(0, 0, "a", f"s{i:03}") for i in range(90)] + [(1, 1, "a", "y")] * 5
    for limit in (0, 200_000):  # with and without the broadcast
        joins.MAX_BROADCAST_ROWS = limit
        out = nesting.nest_rows(rows_df(spark, rows), "k", "cat", "item", ["pos"], ["a", "b"], part_size=200).collect()
        hot = sorted((r for r in out if r.k == 0), key=lambda r: r.part)
        assert [r.part for r in hot] == list(range(11)) and [len(r.a) + len(r.b) for r in hot] == [200] * 10 + [93]
        whole = sorted(r for r in rows if r[0] == 0)
        assert [x for r in hot for x in r.a] == [i for _, _, c, i in whole if c == "a"]
        assert [x for r in hot for x in r.b] == ["x"] * 3
        assert [(r.part, r.a, r.b) for r in out if r.k == 1] == [(0, ["y"] * 5, [])]


def brute_pairs(records, min_count=1):
    n = Counter()
    for s in records:
        n.update(itertools.combinations(sorted(set(s)), 2))
    return {p: c for p, c in n.items() if c >= min_count}


def as_dict(df):
    return {(r.a, r.b): r.n for r in df.collect()}


def test_pairs_from_rows_with_blocks(spark):
    rows = hot_rows()
    records = defaultdict(list)
    for k, _, _, item in rows:
        records[k].append(item)
    df = rows_df(spark, rows)
    for block, least in ((4, 1), (7, 25), (1024, 1), (1024, 30)):
        got = as_dict(cooccur.pair_counts_rows(df, "k", "item", min_count=least, block=block))
        assert got == brute_pairs(records.values(), least)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=6), min_size=1, max_size=6))
def test_pairs_from_arrays(spark, records):
    df = spark.createDataFrame([(r,) for r in records], "s array<string>")
    assert as_dict(cooccur.pair_counts(df, "s")) == brute_pairs(records)


def test_numbering_over_many_partitions(spark):
    rows = hot_rows(2000)
    df = rows_df(spark, rows).repartition(13)
    got = {r.pos: r.n for r in ranking.number_rows(df, ["item", "pos"]).collect()}
    assert got == {r[1]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[3], r[1])), 1)}
    got = {r.pos: r.n for r in ranking.number_rows(df, ["pos"], group=["k"]).collect()}
    want, seen = {}, Counter()
    for k, pos, _, _ in sorted(rows, key=lambda r: r[1]):
        seen[k] += 1
        want[pos] = seen[k]
    assert got == want


def test_first_wins_dedup_is_idempotent_and_null_safe(spark):
    rows = [(3, "t", "c", "x"), (1, "t", "c", "y"), (2, "t", None, "z"), (5, "t", None, "w"), (4, "u", "c", "v")]
    df = spark.createDataFrame(rows, "pos int, title string, company string, link string")
    once = setops.dedup_keep_first(df, ["title", "company"], "pos")
    want = {(1, "t", "c", "y"), (2, "t", None, "z"), (4, "u", "c", "v")}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in setops.dedup_keep_first(once, ["title", "company"], "pos").collect()} == want


def test_group_items_and_ties(spark):
    df = spark.createDataFrame([("g", x) for x in "cabbad"] + [("h", None), ("h", "z")], "g string, x string")
    got = {r.g: (r.n, r.n_distinct, r.samples) for r in counts.group_items(df, "g", "x", 3).collect()}
    assert got == {"g": (6, 4, ["a", "b", "c"]), "h": (1, 1, ["z"])}
    assert [tuple(r) for r in counts.value_counts(df, "x", top=3).collect()] == [("a", 2), ("b", 2), ("c", 1)]


def test_duplicates_count_as_mentions_but_not_as_postings(spark):
    rec = spark.createDataFrame([(1, (["RAG", "RAG", "rag eval"],)), (2, ([],)), (3, (None,))], "id int, skills struct<genai:array<string>>")
    long = nesting.unnest_skills(rec, "skills", ["id"], ["genai"])
    assert {(r.skill, r.n) for r in counts.category_item_counts(long).collect()} == {("RAG", 2), ("rag eval", 1)}
    lowered = F.transform("skills.genai", F.lower)
    got = {r.term: (r.n, r.n_total) for r in counts.postings_with_term(rec, lowered, ["RAG", "x"]).collect()}
    assert got == {"RAG": (1, 3), "x": (0, 3), "any": (1, 3)}


def test_shares_of_nothing_are_null(spark):
    empty = spark.createDataFrame([], "k string")
    assert counts.share_of_total(counts.value_counts(empty, "k")).collect() == []
    one = spark.createDataFrame([("a",)], "k string")
    assert counts.share_of(counts.value_counts(one, "k"), empty).first().pct is None


def test_cluster_threshold(spark):
    rows = [("x", "f")] * 3 + [("x", "s")] + [("y", "s")] * 3 + [("z", "f"), ("z", "s"), ("z", "s")] + [("w", "f")] * 2
    df = spark.createDataFrame(rows, "g string, kind string")
    assert {r.g: r.label for r in counts.cluster_label(df, "g", "kind", "f", "s").collect()} == {"x": "f", "y": "s", "z": "mixed"}


def test_merge_skills(spark):
    df = spark.createDataFrame([(["b", "a", "b"], ["c", "a"]), (None, ["x"])], "a array<string>, b array<string>")
    assert [tuple(r.m) for r in df.select(setops.merge_skills("a", "b").alias("m")).collect()] == [(["b", "a", "c"], 3), (["x"], 1)]


def test_categories_partition_the_items(spark):
    items = ["build a rag", "deploy", "nothing here", "Lead the team", "api"]
    from postloom.functions.taxonomy import Taxonomy

    df = spark.createDataFrame([(x,) for x in items], "t string")
    rows = df.select(Taxonomy(vocab.RESPONSIBILITY_TAXONOMY).first_match("t", "rest").alias("c")).groupBy("c").count().collect()
    assert sum(r["count"] for r in rows) == len(items)


def test_running_total_needs_no_single_partition(spark):
    from postloom.streaming import incremental

    growth = spark.createDataFrame([(i, 1, i % 3) for i in range(500)], "page int, n_found long, n_new long")
    out = incremental.running_new(growth)
    assert [r.n_unique for r in out.orderBy("page").collect()] == list(itertools.accumulate(i % 3 for i in range(500)))


def test_first_rows_are_grouped_by_digest_not_by_text(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 1), (None, 1, 3), (None, 1, 4), ("b", None, 5)], "t string, k int, o int")
    out = setops.dedup_keep_first(df, ["t", "k"], "o")
    assert sorted(out.collect(), key=str) == sorted([("a", 1, 1), (None, 1, 3), ("b", None, 5)], key=str)
    assert "hashpartitioning(t" not in out._jdf.queryExecution().executedPlan().toString()
