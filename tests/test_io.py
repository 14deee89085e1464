"""Readers, writers and streams on small folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from postloom import schemas
from postloom.functions.access import drop_empty_fields
from postloom.operators import cooccur
from postloom.sources import readers, writers, yaml_source
from postloom.streaming import incremental as I

LIVE = """company:
  name: Acme
  stage: Series B+
position:
  title: AI Engineer
  ai_type:
    type: ai-first
    reasoning: |-
      builds
      agents
  responsibilities:
  - Build agents
  use_cases:
  - Search
  skills:
    genai: [RAG]
    ml: []
  is_management: true
meta:
  job_id: '7'
  extracted_at: '2026-02-05T09:25:23.885737'
"""
OLDER = """job_id: '8'
title: ML Engineer
ai_type: {type: ml-first, reasoning: r}
company: {name: Beta, stage: null, use_cases: forecasting}
responsibilities: train models
skills:
  all: [PyTorch]
  by_category: {ml: [PyTorch]}
  count: 1
is_customer_facing: true
is_management: false
extracted_at: '2026-01-01T00:00:00'
"""


def test_structured_yaml_of_both_generations(spark, tmp_path):
    for name, text in (("a.yaml", LIVE), ("b.yaml", OLDER), ("c.yaml", "a: b: c"), ("d.yaml", "- just\n- a list")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    ok, bad = readers.read_structured(spark, f"{tmp_path}/*.yaml")
    rows = {r.meta.job_id: r for r in ok.collect()}
    assert set(rows) == {"7", "8"}
    a, b = rows["7"], rows["8"]
    assert a.position.ai_type.reasoning == "builds\nagents" and a.position.skills.genai == ["RAG"] and a.position.skills.cloud == []
    assert a.position.is_management and not a.position.is_customer_facing and a.company.focus is None
    assert b.position.use_cases == ["forecasting"] and b.position.responsibilities == ["train models"] and b.position.skills.ml == ["PyTorch"]
    assert b.company.stage is None and b.position.title == "ML Engineer" and b.meta.extracted_at.startswith("2026")
    assert {r.file_name for r in bad.collect()} == {"c.yaml", "d.yaml"}


def test_extracted_yaml(spark, tmp_path):
    (tmp_path / "x.yaml").write_text("job_id: 12\ntitle: T\nlocation:\nposted_date: 2026-01-02\nskills:\n  - A\ndescription: |\n  one\n\n  two: x\n", encoding="utf-8")
    row = readers.read_extracted(spark, str(tmp_path))[0].first()
    assert (row.job_id, row.title, row.location, row.posted_date, row.skills, row.industries) == ("12", "T", "", "2026-01-02", ["A"], [])
    assert row.description == "one\n\ntwo: x\n" and row.file_name == "x.yaml"


def test_json_arrays_skip_missing_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "é", "link": "l1", "extra": 1}, {"title": "b"}]), encoding="utf-8")
    got = readers.read_cards_json(spark, [f"{tmp_path}/a.json", f"{tmp_path}/none.json"])
    assert {(r.title, r.link, r.company) for r in got.collect()} == {("é", "l1", None), ("b", None, None)}
    writers.write_csv_projection(got, f"{tmp_path}/csv")
    assert {(r.title, r.link) for r in readers.read_cards_csv(spark, f"{tmp_path}/csv").collect()} == {("é", "l1")}


def test_pages_and_queue(spark, tmp_path):
    (tmp_path / "p.html").write_text("<h1>a</h1>\n<p>b</p>", encoding="utf-8")
    row = readers.read_pages(spark, f"{tmp_path}/*.html").first()
    assert (row.file_name, row.html) == ("p.html", "<h1>a</h1>\n<p>b</p>")
    (tmp_path / "q.txt").write_text("http://a\nhttp://b|HTTP 500|again\n\n", encoding="utf-8")
    assert {tuple(r) for r in readers.read_queue(spark, f"{tmp_path}/q.txt").collect()} == {("http://a", None), ("http://b", "HTTP 500|again")}


def test_markdown_listing(spark, tmp_path):
    text = "# Head\n\n---\n\n### 1. AI Agent\n\n**Company:** Acme\n\n**Location:** Remote\n\n**Date Posted:** Feb 2026\n\n**Link:** http://x\n\n---\n\n### 2. B\n\n**Company:** Beta\n"
    (tmp_path / "l.md").write_text(text, encoding="utf-8")
    got = readers.read_markdown_listing(spark, f"{tmp_path}/l.md").orderBy("n").collect()
    assert [(r.n, r.title, r.company, r.location, r.date_posted, r.link) for r in got] == [
        (1, "AI Agent", "Acme", "Remote", "Feb 2026", "http://x"), (2, "B", "Beta", None, None, None)]


def test_missing_only_is_repeatable(spark, tmp_path):
    path = f"{tmp_path}/out"
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    more = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert {tuple(r) for r in writers.write_missing_only(one, path, "id").collect()} == {("written", 2)}
    assert {tuple(r) for r in writers.write_missing_only(more, path, "id").collect()} == {("written", 1), ("skipped", 1)}
    assert {tuple(r) for r in writers.write_missing_only(more, path, "id").collect()} == {("skipped", 2)}
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_empty_fields_are_left_out(spark):
    df = spark.createDataFrame([("x", "", None, []), ("y", "z", "w", ["q"])], "a string, b string, c string, d array<string>")
    got = [r.j for r in df.select(drop_empty_fields("a", "b", "c", "d", arrays=("d",)).alias("j")).collect()]
    assert got == ['{"a":"x"}', '{"a":"y","b":"z","c":"w","d":["q"]}']


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_incremental_stream_equals_batch(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "id int, v string"

    def run():
        stream = I.stream_files(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)
        I.incremental(stream, lambda df: df.withColumn("up", F.upper("v")), out, state).awaitTermination()
        return {tuple(r) for r in spark.read.parquet(out).select("id", "v", "up").collect()}

    rows = [(i, f"v{i}") for i in range(9)]
    for part in (rows[:3], rows[3:6]):
        _write(spark, source, part, schema)
    assert len(run()) == 6
    assert len(run()) == 6  # nothing new
    _write(spark, source, rows[6:], schema)
    assert run() == {(i, v, v.upper()) for i, v in rows}
    assert spark.read.parquet(out).count() == 9


def test_stream_dedup_across_batches_and_restart(spark, tmp_path):
    source, schema = f"{tmp_path}/in", "link string, ts timestamp"

    def feed(*links):
        import datetime as dt

        _write(spark, source, [(x, dt.datetime(2026, 1, 1, 0, m)) for x, m in links], schema)

    def run(name, **bound):
        stream = I.stream_files(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)
        out = f"{tmp_path}/{name}"
        I.incremental(stream, lambda df: I.dedup_links(df, ["link"], **bound), out, f"{tmp_path}/{name}-state").awaitTermination()
        return sorted(r.link for r in spark.read.parquet(out).collect())

    feed(("a", 1), ("b", 1), ("a", 2))
    feed(("b", 3), ("c", 3))
    assert run("ever") == ["a", "b", "c"] == run("bounded", event_time="ts", horizon="10 minutes")
    feed(("d", 40), ("a", 40))
    assert run("ever") == ["a", "b", "c", "d"]
    feed(("a", 41), ("e", 41))
    assert run("ever") == ["a", "b", "c", "d", "e"]


def test_dead_letters(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    _write(spark, source, [("u1", '{"k":1}'), ("u2", "{bad")], "url string, body string")
    stream = I.stream_files(spark, source, spark.read.parquet(source).schema)
    error = F.when(F.try_parse_json("body").isNull(), F.lit("bad json"))
    I.dead_letter(stream, F.col("url"), error, out, f"{tmp_path}/state").awaitTermination()
    got = {(r.url, r.status, r.retry_line) for r in spark.read.parquet(out).collect()}
    assert got == {("u1", "ok", None), ("u2", "failed", "u2|bad json")}


def test_page_growth(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "a")], "page int, link string")
    got = [tuple(r) for r in I.running_new(I.page_growth(df, F.col("page"), "link")).orderBy("page").collect()]
    assert got == [(1, 2, 2, 2), (2, 2, 1, 3), (3, 1, 0, 3)]


def test_page_growth_of_a_stream_equals_the_batch(spark, tmp_path):
    """Three drops in the order of their pages, a restart for each; a link in a third of all rows, null links and pages."""
    drops = [[(day, "hot" if i % 3 == 0 else f"l{(i * 7 + day) % (20 * day)}", f"2024-01-{day:02} 0{i % 9}:00:00") for i in range(200)
              for day in (2 * d + 1, 2 * d + 2)] + [(None, "x", "2024-01-01 00:00:00"), (1, None, "2024-01-01 00:00:00")] for d in range(3)]
    schema, source = "page int, link string, ts string", str(tmp_path / "in")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for rows in drops:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        I.incremental(stream, lambda df: I.page_growth_stream(df, F.col("page"), "link", "ts", horizon_days=30), out, state).awaitTermination()
    everything = spark.createDataFrame(sum(drops, []), schema).dropna()
    want = {tuple(r) for r in I.page_growth(everything, F.col("page"), "link").collect()}
    assert {tuple(r) for r in I.summed_growth(spark.read.parquet(out)).collect()} == want and len(want) == 6


def test_sketches_of_months_merge_to_those_of_all(spark):
    from postloom.operators import counts

    df = spark.range(60_000).selectExpr("id % 12 as month", "if(id % 3 = 0, 7, id % 9000) as user")
    stored = counts.distinct_sketches(df, ["month"], "user")
    whole = counts.merged_distinct(counts.distinct_sketches(df, [], "user")).first()["n_about"]
    merged, exact = counts.merged_distinct(stored).first()["n_about"], df.selectExpr("count(distinct user)").first()[0]
    assert abs(merged - exact) <= 0.06 * exact and abs(whole - exact) <= 0.06 * exact and stored.count() == 12


def test_shared_folder_comes_from_the_session(spark):
    from postloom.session import scratch_path

    named = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(named)


if __name__ == "__main__":
    pytest.main([__file__])


def test_odd_files_are_reported_and_end_nothing(spark):
    from postloom.sources import readers

    good = "title: T\nposted_date: 2025-08-01\nskills: [a, b]\n"
    odd = {"good": good, "date": "posted_date: 2026-02-31\n", "key": "2025-01-01: x\n", "cycle": "a: &a [*a]\n", "number": "a: 0x_\n",
           "list": "a: 1\nskills: one long text\n", "deep": "a: " + "[" * 3000 + "]" * 3000, "empty": "", "scalar": "x"}
    files = spark.createDataFrame(list(odd.items()), "file_name string, value string")
    ok, bad = readers.extracted_records(files)
    assert {r["file_name"] for r in ok.collect()} == {"good", "deep"}
    reasons = {r["file_name"]: r["error"] for r in bad.collect()}
    assert set(reasons) == set(odd) - {"good", "deep"} and reasons["list"] == "type:skills" and all(reasons.values())
    _, bad = readers.structured_records(spark.createDataFrame([("a", "position: {skills: [RAG, LLM]}\n")], "file_name string, value string"))
    assert bad.first()["error"] == "type:position.skills"


def test_two_sinks_write_a_batch_once(spark, tmp_path):
    ok, failed, ledger = (str(tmp_path / name) for name in ("ok", "failed", "ledger"))
    rows = spark.createDataFrame([(1, None), (2, "HTTP 500"), (3, None)], "id int, why string")
    sinks = I.TwoSinks(F.col("id"), F.col("why"), ok, failed, ledger)
    read = lambda: (sorted(r.id for r in spark.read.parquet(ok).collect()), sorted((r.id, r.retry_line) for r in spark.read.parquet(failed).collect()))
    want = ([1, 3], [(2, "2|HTTP 500")])
    sinks(rows, 0)
    assert read() == want
    sinks(rows.unionAll(rows), 0)  # the batch comes again, with whatever it holds
    assert read() == want
    os.remove(f"{ledger}/0.failed")  # cut short behind the first table
    sinks(rows, 0)
    assert read() == want and sorted(os.listdir(ledger))[-1] == "0.ok"
    sinks(rows, 1)
    assert read() == ([1, 1, 3, 3], want[1] * 2)


def test_two_sinks_replay_of_a_stream(spark, tmp_path):
    source, state = str(tmp_path / "in"), tmp_path / "state"
    spark.range(4).selectExpr("id", "if(id = 2, 'bad', null) AS why").coalesce(1).write.parquet(source)
    sinks = I.TwoSinks(F.col("id"), F.col("why"), *(str(tmp_path / name) for name in ("ok", "failed", "ledger")))
    stream = lambda: I.stream_files(spark, source, spark.read.parquet(source).schema)
    sinks.start(stream(), str(state)).awaitTermination()
    for commit in (state / "commits").iterdir():  # as if the driver was lost before the batch was committed
        commit.unlink()
    sinks.start(stream(), str(state)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 3 and spark.read.parquet(str(tmp_path / "failed")).count() == 1


YAML_FILES = {"a.yaml": "job_id: 1\ntitle: A", "b.yml": "job_id: '2'\nskills: [x, y]", "c.yaml": "a: b: c", "d.yaml": "- 1", "e.yaml": "", "_skip.yaml": "x: 1", "f.txt": "job_id: 9"}


def test_yaml_source_equals_the_reader(spark, tmp_path):
    for name, text in YAML_FILES.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "g.yaml").write_bytes(b"job_id: \xff")
    ok, bad = yaml_source.records(yaml_source.load(spark, str(tmp_path), schemas.EXTRACTED, taskFiles=2), schemas.EXTRACTED)
    files = readers.yaml_files(spark, str(tmp_path / "[a-e].*"))
    plain, wrong = readers.parse_yaml(files, schemas.EXTRACTED)
    assert sorted(map(str, ok.collect())) == sorted(map(str, plain.collect()))
    assert sorted(r.file_name for r in bad.collect()) == sorted({*(r.file_name for r in wrong.collect()), "e.yaml", "g.yaml"})  # the text reader passes an empty file over
    tasks = yaml_source.dealt([(0, str(i), size) for i, size in enumerate([5, 5, 50, 1, 1, 1])], 10, 2)
    assert [t.paths for t in tasks] == [["0", "1"], ["2"], ["3", "4"], ["5"]] and yaml_source.dealt([], 1, 1) == []
    assert yaml_source.load(spark, str(tmp_path / "none"), schemas.EXTRACTED).count() == 0


def test_yaml_stream_takes_each_file_once(spark, tmp_path):
    drop, out, state = tmp_path / "drop", str(tmp_path / "out"), str(tmp_path / "state")
    drop.mkdir()
    for turn in range(3):
        for i in range(3):
            (drop / f"{turn}-{i}.yaml").write_text(f"job_id: {turn}{i}" if i else "a: b: c")
        source = yaml_source.load(spark, str(drop), schemas.EXTRACTED, stream=True, settle=0, maxFilesPerTrigger=2)
        query = source.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).start()
        query.processAllAvailable()
        query.stop()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.file_name for r in rows) == sorted(f"{t}-{i}.yaml" for t in range(3) for i in range(3))
    assert sorted(r.file_name for r in rows if r.error) == ["0-0.yaml", "1-0.yaml", "2-0.yaml"]


def test_pairs_of_wide_records(spark):
    wide = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("s"), F.lit(None).cast("string").alias("g"))
    few = spark.createDataFrame([(["w1", "w2", "w2", None], None), (["w2", "w1", "z"], "h"), ([], None), (None, None)], "s array<string>, g string")
    rows = wide.unionByName(few)
    assert [tuple(r) for r in cooccur.pair_counts(rows, "s", min_count=3).collect()] == [("w1", "w2", 3)]
    assert [tuple(r) for r in cooccur.pair_counts(rows, "s", min_count=2, keep=["g"]).collect()] == [(None, "w1", "w2", 2)]
