"""Text, HTML, JSON and repair on literal rows."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from postloom.functions import markup, selectors, text
from postloom.operators import counts, html, keywords, repair, validate


def test_python_like_strip_and_words(col):
    assert col(["  a b \n"], text.strip("t")) == ["a b"]
    assert col(["a bb  ccc\n"], text.words("t")) == [["a", "bb", "ccc"]]


def test_file_names(col):
    assert col(["Café – AI/ML  (x)_"], text.sanitize_filename("t")) == ["Café_AIML_x"]
    assert col(["AI/ML Engineer – Lead, Rome & beyond", None], text.page_file_name("t", F.lit("7"))) == ["AI_ML_Engineer___Lead__Rome____7.html", "job_7_7.html"]
    assert col([""], text.record_file_name(F.lit("1"), "t", F.lit("A b"))) == ["1_Unknown_A_b.yaml"]


def test_urls(col):
    urls = ["https://a.b/job/x/123?q=1", "https://a.b/", "https://a.b", None]
    assert col(urls, text.url_tail_id("t")) == ["123", "unknown", "unknown", "unknown"]
    assert col(["u?a=1", "u"], text.page_url("t", F.lit(2))) == ["u?a=1&page=2", "u?page=2"]
    assert col(["u"], text.page_url("t", F.lit(1))) == ["u"]
    assert col(["/job/1", "http://x/1", ""], text.absolute_link("t", "https://b.example/")) == ["https://b.example/job/1", "http://x/1", ""]


def test_sizes_and_salaries(col):
    assert col(["has 1,200  Employees now", "none"], text.company_size("t")) == ["1,200 Employees", ""]
    assert col(["1,200 Employees", ""], text.size_number("t")) == [1200, None]
    lo, hi, unit = col(["$160,000 - $180,000/year"], text.salary_range("t"))[0]
    assert (int(lo), int(hi), unit) == (160000, 180000, "year")
    assert [int(x) for x in col(["120K - 150K"], text.salary_range("t"))[0][:2]] == [120000, 150000]


def test_unescape_is_single_pass(col):
    assert col(["a &amp;lt; &#x2B; &#233; &unknown; & b &#8211;", "plain", None], html.unescape("t")) == ["a &lt; + é &unknown; & b –", "plain", None]


def ld(*blocks):
    return "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)


def test_json_ld(col):
    pages = [ld("{broken", '{"@graph":[{"@type":"Org"},{"@type":"JobPosting","title":"A &amp; B"}]}'), ld('[{"@type":"JobPosting","title":"L"}]'),
             ld('{"@type":"Org"}'), "<p>none</p>", "<script type='application/ld&#x2B;json'>\n{\"@type\":\"JobPosting\",\"title\":\"Q\"}\n</script>"]
    assert col(pages, F.try_variant_get(html.json_ld("t"), "$.title", "string")) == ["A & B", "L", None, None, "Q"]


def test_posting_falls_back_to_the_page(spark):
    page = ('<html><head><link rel="canonical" href="https://b.example/job/ai/77"></head><body><h1> Big <b>Role</b> </h1><a href="/company/acme"> Acme </a>'
            '<h2>Top Skills</h2><div><span class="tag">Python</span><span class="Rounded">SQL</span><span class="tag">Python</span>'
            '<a class="tag">View all</a><span>no</span><span class="tag">x</span></div><p>96 Employees</p></body></html>')
    row = html.posting_from_page(spark.createDataFrame([(page,)], "html string"), source="board").first()
    assert (row.title, row.company, row.url, row.job_id) == ("Big Role", "Acme", "https://b.example/job/ai/77", "77")
    assert row.skills == ["Python", "SQL"] and row.company_size == "96 Employees" and row.level == "" and row.description == ""


def test_posting_from_json_ld(spark):
    page = ld('{"@type":"JobPosting","title":"T","description":"<p>Do <b>it</b></p><ul><li>one</li></ul>","jobLocation":{"address":{"addressCountry":"DEU"}},'
              '"baseSalary":{"value":{"value":"100"}},"experienceRequirements":{"monthsOfExperience":30},"industry":["A"],"url":"https://b.example/job/9"}')
    row = html.posting_from_page(spark.createDataFrame([(page,)], "html string"), source="board").first()
    assert (row.location, row.compensation, row.level, row.industries, row.job_id) == ("DEU", "100", "Mid level", ["A"], "9")
    assert row.description == "Do it\n\n- one"


@pytest.mark.parametrize("source,expected", [
    ("<ul><li>a<ul><li>b</li><li>c <b>d</b></li></ul></li><li>e :f</li></ul>", "- a\n  - b\n  - c d\n- e:f"),
    ("<p>x  y<br>z</p><div>w</div>", "x y\nz\n\nw"),
    ("a&nbsp;b​ c", "a b c"),
    ("<p>one<p>two</div>", "one\n\ntwo"),
    ("<b>bold <i>it</i></b> <script>no()</script><!-- no -->", "bold it"),
    ("", ""), (None, ""),
])
def test_markdown(source, expected):
    assert markup.to_markdown(source) == expected


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.sampled_from(["w1", "w2 w3", "é"]), lambda inner: st.builds(
    lambda tag, xs: f"<{tag}>" + " ".join(xs) + f"</{tag}>", st.sampled_from(["p", "div", "b", "em", "span"]), st.lists(inner, min_size=1, max_size=3)), max_leaves=8))
def test_markdown_keeps_every_visible_word(source):
    assert markup.to_markdown(source).split() == re.sub("<[^>]*>", " ", source).split()


CARD = """<div id="job-card-1"><a href="/company/acme"><img data-id="company-img" alt="Acme Logo"></a><h2><a href="/job/1">AI &amp; Co</a></h2>
<div><i class="fa fa-location-dot"></i><span>Berlin,  DE</span></div></div><div id="job-card-2"><h2><a href="/job/2">No company</a></h2></div>"""


def test_cards(spark):
    got = html.cards(spark.createDataFrame([(CARD,)], "html string")).collect()
    assert [(r.title, r.link, r.company, r.location, r.level) for r in got] == [("AI & Co", "/job/1", "Acme", "Berlin, DE", "")]


SECOND = """<base href="https://jobs.org/list/"><div class=list><div class="job-bounded-responsive"><div><h2><a href="../job/7">Second</a></h2></div>
<a href=/company/b><span>Beta</span></a><p><span><i class="fa fa-trophy"></i></span> Senior</p><p>%s<i class="fa-sack-dollar"></i></p></div>
<div id="job-card-9"><h2><a href="/job/9">No company of its own</a></h2></div></div><footer><div><i class="fa-location-dot"></i>Awards</div></footer>""" % ("x" * 100)


def test_cards_of_the_second_form(spark):
    pages = [(1, CARD, "https://a.org/x/y"), (2, SECOND, None), (3, None, None), (4, "<footer><i class=fa-trophy></i>Awards</footer>", "x")]
    got = html.cards(spark.createDataFrame(pages, "id int, html string, url string"), keep=["id"], url="url").collect()
    assert [(r.id, r.card_no, r.title, r.link, r.company, r.location, r.level, r.compensation) for r in got] == [
        (1, 0, "AI & Co", "https://a.org/job/1", "Acme", "Berlin, DE", "", ""), (2, 0, "Second", "https://jobs.org/job/7", "Beta", "", "Senior", "")]


def test_selectors():
    root = markup.read('<div id=a class="x y"><ul><li data-k="one two"><a href="/p/1">1</a></li><li><b><a href="/p/2" title="a,b]">2</a></b></li></ul></div><p class=y><a>3</a></p>')
    found = lambda text: [n.text() for n in selectors.select(root, text)]
    assert found("a") == ["1", "2", "3"] and found("a[href]") == ["1", "2"] and found("li > a") == ["1"] and found("#a .y, p.y a") == ["3"]
    assert found('a[href$="2"]') == found("div b>a") == found('[title="a,b]"]') == ["2"] and found("[data-k~=two] a") == ["1"] and found("[data-k~=tw] a") == []
    assert found("div.x.y a[href^='/p']") == ["1", "2"] and found("[href*='']") == [] and found("*") and found("ul > a") == [] and found("div > ul a") == ["1", "2"]
    deep = markup.read("<i><div><s><div><p><div><u><a>x</a>" + "<b>" * 3000 + "<a>y</a>")
    assert [n.text() for n in selectors.select(deep, "i > div > s a")] == ["x", "y"] and not list(selectors.select(deep, "i > s a"))
    for bad in ("", "a >", "> a", "a b >", "a + b", "a:first-child", "[a", "a,,b"):
        with pytest.raises(ValueError):
            selectors.Selector(bad)


def test_keyword_table(spark):
    texts = spark.createDataFrame([(1, "Ab abab x_ab"), (1, None), (2, ""), (2, "no hit"), (None, "ÄB ab.")], "id int, keyword string")
    words = spark.createDataFrame([("ab",), ("AB",), ("äb",), ("",), (None,), ("ab x",)], "w string")
    run = lambda **kw: sorted((r.id or 0, r.keyword, r.n) for r in keywords.keyword_table_join(texts.withColumnRenamed("keyword", "t"), "t", words, "w", ["id"], **kw).collect())
    assert run() == [(0, "ab", 1), (0, "äb", 1), (1, "ab", 4), (1, "ab x", 1)]
    assert run(whole_words=True) == [(0, "ab", 1), (0, "äb", 1), (1, "ab", 1)]
    assert run(lower=False) == [(0, "ab", 1), (1, "ab", 3), (1, "ab x", 1)]
    assert run(block_bytes=4) == run() and keywords.keyword_table_join(texts, "keyword", words.limit(0), "w", ["id"]).count() == 0
    plan = keywords.keyword_table_join(texts, "keyword", words, "w", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Exchange" not in plan


def test_card_text(col):
    texts = ["Acme — Rome\nx", "Acme - Rome\nRemote ok", "London office\nAcme - Rome", "nothing", "a-Berlin-c"]
    got = [tuple(r) for r in col(texts, html.card_text("t"))]
    assert got == [("Acme", "Rome"), ("Acme", "Remote ok"), ("Acme", "Rome"), ("", ""), ("a", "a-Berlin-c")]


RECORD = """job_id: 5
title: AI Engineer: Platform
url: https://a.b/c
quoted: "a: b"
pay: 120K - 150K
skills:
  - C: the language
  - 'x: y'
  - ends with:
description: |
  note: keep

- also: kept
company: A "b": c\\d
tail: x:"""

REPAIRED = RECORD.replace("title: AI Engineer: Platform", 'title: "AI Engineer: Platform"').replace(
    "- C: the language", '- "C: the language"').replace('company: A "b": c\\d', 'company: "A \\"b\\": c\\\\d"')


def test_repair(col):
    assert col([RECORD, "", "a\n", "k: a: b m: c​: d\n\n", "x: |\n  y: z: w\n"], repair.repair_yaml_text("t")) == [
        REPAIRED, "", "a\n", 'k: "a: b"\nm: "c: d"\n\n', "x: |\n  y: z: w\n"]
    assert col([REPAIRED], repair.repair_yaml_text("t")) == [REPAIRED]


def test_repair_of_a_very_long_block(col):
    block = "d: |\n" + "\n".join("  a: b: c" for _ in range(200_000)) + "\nk: a: b"
    assert col([block], repair.repair_yaml_text("t"))[0].endswith('\nk: "a: b"')


def test_word_frequency_is_unicode_aware(spark):
    rows = spark.createDataFrame([("Über Über ab, word, word, WORD with",)], "t string")
    got = {r.word: r.n for r in counts.word_frequency(rows, "t", stop_words=["with"]).collect()}
    assert got == {"über": 2, "word,": 2, "word": 1}
    got = {r.word: r.n for r in counts.word_frequency(rows, "t", stop_words=["with"], strip_punct=True).collect()}
    assert got == {"über": 2, "word": 3}


GOOD = '{"ai_type":"ai-first","ai_type_reasoning":"r","responsibilities":["a"],"skills":"[{\\"name\\":\\"x\\",\\"category\\":\\"ml\\"}]","is_management":"true"}'


def test_validation(spark):
    cases = [GOOD, "{oops", '{"ai_type":"ai-first"}', '{"ai_type":"boss","ai_type_reasoning":"r"}', '{"ai_type":"unknown","ai_type_reasoning":"r","responsibilities":"one"}',
             '{"ai_type":"unknown","ai_type_reasoning":"r","skills":[{"name":"x","category":"nope"}]}', '{"ai_type":"unknown","ai_type_reasoning":"r","use_cases":[1]}', "[1]"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, payload string")
    got = validate.coerce_and_validate(rows, "payload").orderBy("i").collect()
    assert [r.errors for r in got] == [[], ["json:payload"], ["missing:ai_type_reasoning"], ["value:ai_type"], ["type:responsibilities"], ["value:skills"], ["type:use_cases"],
                                       ["json:payload", "missing:ai_type", "missing:ai_type_reasoning"]]
    assert got[0].skills[0].name == "x" and got[0].is_management is True
    ok, bad = validate.split_by_status(validate.coerce_and_validate(rows, "payload"))
    assert (ok.count(), bad.count()) == (1, 7)


def test_plugged_in_extractor(spark):
    rows = spark.createDataFrame([("t", "c", "d")], "title string, company string, description string")
    out = validate.extract_with(rows, lambda batch: batch["title"].map(lambda t: f'{{"ai_type":"unknown","ai_type_reasoning":"{t}"}}'))
    row = validate.coerce_and_validate(out, "payload").first()
    assert (row.status, row.ai_type_reasoning) == ("ok", "t")


def test_odd_character_references(col):
    from postloom.operators.html import unescape

    got = col(["&#9999999;", "&#xFFFFFF;", "&#xD800;", "&#0;", "&#146;", "&#65;&#x42;", "&amp;lt;", "&nosuch;"], unescape("t"))
    assert got == ["�"] * 4 + ["’", "AB", "&lt;", "&nosuch;"]


def test_markup_survives_deep_and_odd_pages():
    assert markup.to_markdown("<div>" * 5000 + "x") == "x"
    assert markup.to_markdown("<b>" * 5000 + "y") == "y"
    assert markup.to_markdown("<![foo[bar]]>z") == "z"
    assert markup.to_markdown("<ul><li>" * 300 + "q").endswith("- q")
    assert markup.to_markdown("a<p>b</p><ul><li>c :<ol><li>d</li></ol></li></ul>") == "a\n\nb\n\n- c:\n  - d"


def test_compensation_goes_by_shape(spark):
    cases = [('{"value":{"value":7}}', "7"), ('{"value":{"minValue":1,"maxValue":2}}', ""), ('{"currency":"EUR"}', ""),
             ('{"value":"5k"}', "5k"), ('"6k"', "6k"), ("null", "")]
    pages = spark.createDataFrame([(i, '<script type="application/ld+json">{"@type":"JobPosting","baseSalary":%s}</script>' % salary)
                                   for i, (salary, _) in enumerate(cases)], "i int, html string")
    got = html.posting_from_page(pages, source="s", markdown=False).orderBy("i").select("compensation").collect()
    assert [r[0] for r in got] == [want for _, want in cases]


def test_skill_names_must_be_text_and_lists_not_null(spark):
    base = '{"ai_type":"unknown","ai_type_reasoning":"r"%s}'
    cases = [('', []), (',"skills":[{"name":1,"category":"ml"}]', ["type:skills"]), (',"skills":null', ["type:skills"]),
             (',"use_cases":null', ["type:use_cases"]), (',"company_stage":null', [])]
    rows = spark.createDataFrame([(i, base % more) for i, (more, _) in enumerate(cases)], "i int, payload string")
    got = validate.coerce_and_validate(rows, "payload").orderBy("i").select("errors").collect()
    assert [r[0] for r in got] == [want for _, want in cases]


def test_failing_extractor_costs_only_its_rows(spark):
    def step(batch):
        if (batch["i"] == 3).any():
            raise ValueError("three")
        return batch["i"].astype(str)

    got = validate.extract_with(spark.range(5).select(F.col("id").alias("i")).coalesce(1), step).orderBy("i").collect()
    assert [(r.payload, r.payload_error, r.payload_attempts) for r in got] == [
        ("0", None, 2), ("1", None, 2), ("2", None, 2), (None, "ValueError: three", 3), ("4", None, 2)]
