"""The staging layout, the key index and table functions: results and plans."""

import os
import random
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from postloom.functions import tables
from postloom.sources import staging, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def postings(spark):
    rows = [(i, f"2024-{i % 12 + 1:02d}-05" if i % 7 else None, "x" * (i % 3), f"text {i}" if i % 5 else None) for i in range(200)]
    return rows, spark.createDataFrame(rows, "id long, day string, title string, body string")


def test_staged_rows_and_texts(spark, postings, tmp_path):
    rows, df = postings
    staged = staging.write_staged(df, str(tmp_path / "s"), key="id", posted=F.to_date("day"), long="body")
    assert "body" not in staged.rows().columns and set(staged.texts().columns) == {"id", "body", "posted_month"}
    back = staged.with_texts(staged.rows()).select("id", "day", "title", "body").collect()
    assert sorted(map(tuple, back), key=str) == sorted(rows, key=str)
    assert staged.rows().filter("posted_month = 'undated'").count() == sum(d is None for _, d, _, _ in rows)


def test_staged_periods_prune_both_scans(spark, postings, tmp_path):
    rows, df = postings
    staged = staging.write_staged(df, str(tmp_path / "s"), key="id", posted=F.to_date("day"), long="body")
    periods = spark.createDataFrame([(f"2024-{m:02d}", (m + 2) // 3) for m in range(1, 13)], "posted_month string, quarter int").filter("quarter = 2")
    out = staged.with_texts(staged.of_periods(periods))
    assert plan(out).count("dynamicpruningexpression(posted_month") >= 2
    for name in ("rows", "texts"):  # files of the other periods are never opened: they hold no parquet any more
        for folder, _, files in os.walk(tmp_path / "s" / name):
            if "posted_month=" in folder and folder[-2:] not in ("04", "05", "06"):
                for f in files:
                    if f.endswith(".parquet"):
                        os.remove(os.path.join(folder, f))
                        open(os.path.join(folder, f), "w").write("spoiled")
                    elif f.endswith(".crc"):
                        os.remove(os.path.join(folder, f))
    spark.catalog.clearCache()
    got = sorted((r.id, r.body, r.quarter) for r in out.collect())
    assert got == sorted((i, b, 2) for i, d, _, b in rows if d and d[5:7] in ("04", "05", "06"))
    with pytest.raises(Exception):
        staged.rows().collect()


def test_staged_years_stay_text(spark, postings, tmp_path):
    staged = staging.write_staged(postings[1], str(tmp_path / "s"), key="id", posted=F.to_date("day"), long="body", period="year", pattern="yyyy")
    assert {r.year for r in staged.rows().filter("day is not null").collect()} == {"2024"}


def test_empty_staging(spark, postings, tmp_path):
    staged = staging.write_staged(postings[1].limit(0), str(tmp_path / "s"), key="id", posted=F.to_date("day"), long="body")
    assert staged.with_texts(staged.rows()).count() == 0 and set(staged.texts().columns) == {"id", "body", "posted_month"}


def test_key_index_is_not_shuffled(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(0 if rnd.random() < 0.4 else rnd.randrange(1000), i) for i in range(5000)] + [(None, -1), (None, -2)]
    df = spark.createDataFrame(rows, "k long, i long")
    index = staging.KeyIndex(spark, str(tmp_path / "done-a"), "k", "bigint", buckets=4)
    assert index.pending(df).count() == len(rows)
    index.add(df.filter("k % 3 = 0"))
    index.add(df.filter("k % 3 = 0 or k % 5 = 0"))
    index.add(df.filter("k is null"))
    assert index.keys().count() == len({k for k, _ in rows if k is not None and (k % 3 == 0 or k % 5 == 0)})
    want = sorted((r for r in rows if r[0] is None or (r[0] % 3 and r[0] % 5)), key=str)
    for unique in (False, True):
        assert sorted(map(tuple, index.pending(df, unique=unique).collect()), key=str) == want
    known = plan(index.known(df))
    side = known[known.index("SortMergeJoin"):]
    assert side.count("Exchange") == 1 and "Bucketed: true" in side  # of the keys asked for; none over the index
    again = staging.KeyIndex(spark, str(tmp_path / "done-a"), "k", "bigint", buckets=4, name="attached_again")
    assert sorted(map(tuple, again.pending(df).collect()), key=str) == want


def test_write_missing_only_with_repeats_and_nulls(spark, tmp_path):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert {tuple(r) for r in writers.write_missing_only(first, path, "k").collect()} == {("written", 3)}
    more = spark.createDataFrame([("a", 9), ("c", 4), ("c", 5), (None, 6)], "k string, v int")
    assert {tuple(r) for r in writers.write_missing_only(more, path, "k").collect()} == {("skipped", 1), ("written", 3)}
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == sorted([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("c", 5), (None, 6)], key=str)


def test_tokenize(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice("ab"), " ".join(rnd.choice(["Alpha", "beta", "Über", "no", "gamma\tdelta"]) for _ in range(9))) for _ in range(300)]
    rows += [("a", None), ("b", ""), (None, "alpha beta"), ("a", " \n ")]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = Counter((g, w) for g, t in rows for w in (t or "").lower().split() if len(w) > 3)
    assert {(r.lang, r.word): r.n for r in tables.words_by(df, "text", "lang", parts=5).collect()} == want
    assert tables.words_by(df.limit(0), "text", "lang").count() == 0
    function = tables.Tokenize.func()
    monkeypatch.setattr(tables, "HELD", 10)  # counts that go out in parts add up
    parts = [x for i in range(100) for x in function.eval({"t": f"word{i} same", "k": 1}, "t", "k", 3)] + list(function.terminate())
    assert len(parts) > 101 and sum(n for _, w, n in parts if w == "same") == 100
    tables.register(spark)
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM tokenize(TABLE(SELECT 1 AS a) PARTITION BY a, text => 'b', keep => 'a', longer_than => 3)").collect()
