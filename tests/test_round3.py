"""Findings of the third review round."""

import importlib.util
import os

import __spark_entry__ as entry
from postloom.operators import validate

spec = importlib.util.spec_from_file_location("oracle", os.path.join(os.path.dirname(__file__), "oracle.py"))
oracle = importlib.util.module_from_spec(spec)
spec.loader.exec_module(oracle)

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_streams_read_a_table_that_is_a_folder(spark, tmp_path):
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("st01_incremental_structure", "st02_stream_dedup_links", "st03_dead_letter"):
        want, got = (sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=repr) for sf in (SF, str(tmp_path)))
        assert got == want and want


def pages_against_sql(spark, name, html):
    """The query and its SQL over one page per text."""
    import duckdb
    import tempfile

    folder = tempfile.mkdtemp(prefix="pages-")
    rows = [(i, f"https://a.example.com/{i}", h) for i, h in enumerate(html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    message, good = oracle.compare(spark, con, name, QUERIES[name], SQL[name], folder)
    assert good, message


def test_markdown_digest_of_cut_references(spark):
    pages_against_sql(spark, "x02_html_to_markdown", [
        "<html><title>a &amp;&amp</title><body><h1>&lt;b&gt; &quot;&copy;&quot; &#x27;</h1><ul><li><a href=\"/x\">one</a></li></ul><p>&amp;amp; &eacute</p></body></html>"])


def test_bare_title_shows_references_as_its_sql(spark):
    pages_against_sql(spark, "x05_posting_from_bare_page", ["<h1> token = &quot;1&quot; &amp; &amp;lt; &#x27; </h1>", "<h1>a &amp</h1>"])


def test_rule_extraction_keeps_digits_at_the_ends_of_lines(spark):
    text = "\n".join([" 0 zero 0", "1 one 11 ", "2 two 2", "   "] + [f"{i} x {i}" for i in range(4, 12)])
    rows = spark.createDataFrame([("t", text)], "title string, text string").select(validate.rule_extraction("title", "text").alias("payload"))
    got = validate.coerce_and_validate(rows, "payload").first().responsibilities
    assert got == [line.strip(" ") for line in text.split("\n") if line.strip(" ")]


def test_keyword_table_of_many_keywords_stays_a_table(spark):
    """One scan of the texts, whatever the size of the table, and the same rows as counted one by one."""
    import random
    import re

    from postloom.operators import keywords

    rnd = random.Random(7)
    letters = "ab_é😀 İ"
    words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 5, 9, 70]))) for _ in range(300)})
    texts = ["".join(rnd.choice(letters) if rnd.random() < 0.9 else rnd.choice(words) for _ in range(rnd.choice([0, 1, 40, 300]))) for _ in range(60)] + [None]
    left = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)], "i int, g int, t string")
    right = spark.createDataFrame([(w,) for w in words + words[:20]] + [("",), (None,)], "k string")
    for whole in (False, True):
        joined = keywords.keyword_table_join(left, "t", right, "k", ["i", "g"], lower=False, whole_words=whole, block_bytes=64)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Union" not in plan
        edge = lambda w: (r"(?<!\w)" + re.escape(w) + r"(?!\w)") if whole else re.escape(w)
        want = {(i, w): n for i, t in enumerate(texts) if t for w in words if w for n in [len(re.findall(f"(?={edge(w)})", t))] if n}
        got = joined.collect()
        assert {(r.i, r.keyword): r.n for r in got} == want and len(got) == len(want) and all(r.g == r.i % 3 for r in got)


def test_pages_leave_no_trees_behind():
    import gc

    from postloom.functions import markup, selectors

    page = "<div id='job-card-1'><h2><a href='/job/1'>T</a></h2><a href='/company/1'>C</a></div><ul><li>x<ul><li>y</li></ul></li></ul>"
    gc.collect()
    gc.disable()
    try:
        assert len(selectors.cards_of(page, None)) == 1 and "- x" in markup.to_markdown(page)
        markup.pills_after(page, "T", "h2", ("div", "ul"), ("li",), None)
        assert not [o for o in gc.get_objects() if isinstance(o, markup.Node)]
    finally:
        gc.enable()


def test_rows_meet_the_key_index_in_more_partitions_than_its_buckets(spark):
    from postloom.session import scratch_path
    from postloom.sources.staging import KeyIndex

    index = KeyIndex(spark, scratch_path(spark, "done"), "k", "bigint", buckets=2)
    index.add(spark.range(0, 100, 2).withColumnRenamed("id", "k"))
    rows = spark.range(400).selectExpr("id % 101 AS k", "id").unionAll(spark.sql("SELECT CAST(NULL AS BIGINT), 400L"))
    left = index.pending(rows)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan
    assert sorted(r.id for r in left.collect()) == sorted(i for i in range(400) if (i % 101) % 2 or i % 101 == 100) + [400]


def test_yaml_rows_of_one_partition_are_parsed_by_many_tasks(spark):
    from postloom.sources import readers

    files = spark.createDataFrame([(f"{i}.yaml", f"job_id: '{i}'") for i in range(50)], "file_name string, value string").coalesce(1)
    ok, bad = readers.extracted_records(files)
    assert ok.rdd.getNumPartitions() > 1 and ok.count() == 50 and bad.count() == 0


def test_report_sections_do_not_search_the_texts_again(spark):
    from postloom.plans import reports as R
    from postloom.plans.bindings.common import postings

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    staged = postings(spark, SF)
    roles, items = R.support_roles(staged), R.responsibilities(staged)
    for section in ("categories", "research_split", "research_reasons", "research_by_type"):
        assert "ontains(" not in plan(roles[section])
    for section in ("categories", "uncategorized", "by_type", "words"):
        assert "ontains(" not in plan(items[section])


def test_small_keys_are_cut_into_parts_without_numbering(spark):
    """Small parts of small keys need one shuffle of the rows; both ways give the same parts, ties and nulls included."""
    import random

    from postloom.operators import nesting

    rnd = random.Random(5)
    rows = [(rnd.choice([None, 0, *range(1, 30)]), rnd.randrange(4), rnd.choice(["a", "b", "c", None]), rnd.choice(["x", "y", None])) for _ in range(600)]
    rows += [(0, 1, "a", "x")] * 20
    df = spark.createDataFrame(rows, "k int, pos int, cat string, item string").repartition(5)
    want, first = {}, lambda v: (v is not None, v)
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: [first(v) for v in r[1:]])
        want |= {(k, p): tuple([r[3] for r in own[3 * p:3 * p + 3] if r[2] == c] for c in "ab") for p in range((len(own) + 2) // 3)}
    nested = {held: nesting.nest_rows(df, "k", "cat", "item", ["pos"], ["a", "b"], part_size=3, held_rows=held) for held in (4096, 25)}
    plans = {held: out._jdf.queryExecution().optimizedPlan().toString() for held, out in nested.items()}
    assert "Join" not in plans[4096] and "Join" in plans[25]
    for out in nested.values():
        got = out.collect()
        assert len(got) == len(want) and {(r.k, r.part): (r.a, r.b) for r in got} == want


def test_pairs_of_many_items_are_shuffled_as_number_lists(spark):
    import random
    from collections import Counter
    from itertools import combinations

    from postloom.operators import cooccur

    rnd = random.Random(11)
    records = [{f"w{int(rnd.paretovariate(0.6)) % 300:03d}" for _ in range(rnd.choice([0, 1, 2, 9, 60]))} for _ in range(80)]
    rows = spark.createDataFrame([(k, w) for k, s in enumerate(records) for w in s] + [(0, None), (None, "w001")], "k int, w string").repartition(5)
    for block in (7, 1024):
        for least in (2, 5):
            want = {p: n for p, n in Counter(p for s in records for p in combinations(sorted(s), 2)).items() if n >= least}
            pairs = cooccur.pair_counts_rows(rows, "k", "w", min_count=least, block=block, few_items=0)
            got = pairs.collect()
            assert "Repartition" in pairs._jdf.queryExecution().optimizedPlan().toString()
            assert len(got) == len(want) and {(r.a, r.b): r.n for r in got} == want and dict(pairs.dtypes)["n"] == "bigint"


def test_substrings_are_copied_whole_not_sliced_one_by_one():
    import numpy as np

    from postloom.operators import keywords

    text = "aß€😀 x\u0130b" * 3
    at = [(a, n) for a in range(len(text)) for n in range(len(text) - a + 1)]
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    got = keywords._substrings(text, codes, *(np.array(c, np.int64) for c in zip(*at)))
    assert got.to_pylist() == [text[a:a + n] for a, n in at]
    none = np.zeros(0, np.int64)
    assert keywords._substrings("", codes[:0], none, none).to_pylist() == []
