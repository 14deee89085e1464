"""Reports on a handful of postings whose figures can be counted by hand."""

import pytest
from pyspark.sql import functions as F

from postloom import vocab
from postloom.operators.nesting import flat_to_nested
from postloom.plans import reports as R

FLAT = """job_id string, title string, company string, ai_type string, ai_type_reasoning string, company_stage string, company_focus string,
responsibilities array<string>, use_cases array<string>, skills array<struct<name:string,category:string>>, is_customer_facing boolean, is_management boolean"""

ROWS = [
    ("1", "Senior AI Engineer", "Acme", "ai-first", "r", "Seed/Series A", None, ["Build agents", "fine-tune and fine-tuning"], ["Semantic search"],
     [("LangChain", "genai"), ("LangGraph", "genai"), ("PyTorch", "ml"), ("React", "web"), ("FastAPI", "web")], True, None),
    ("2", "AI Engineer", "Acme", "ai-first", "r", None, None, ["Deploy models"], ["Customer chatbot"], [("LangChain", "genai"), ("RAG", "genai")], None, True),
    ("3", "AI Engineer II", "Beta", "ai-first", "r", "Series B+", None, ["Use LoRA"], [], [("Docker", "ops")], False, False),
    ("4", "Platform Engineer, AI", "Beta", "ai-support", "r", "Public", None, ["Run clusters"], ["Enterprise search"], [("Docker", "ops"), ("Python", "languages")], True, False),
    ("5", "Research Scientist", "Gamma", "ml-first", "r", "Unicorn", None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def postings(spark):
    return flat_to_nested(spark.createDataFrame(ROWS, FLAT), extracted_at=F.lit("2026-01-01")).cache()


def got(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_overview(postings):
    r = R.overview(postings)
    assert got(r["ai_types"], "kind", "n", "pct") == [("ai-first", 3, 60.0), ("ai-support", 1, 20.0), ("ml-first", 1, 20.0)]
    assert got(r["roles"], "name", "n", "n_total") == [("customer_facing", 2, 5), ("management", 1, 5)]
    assert got(r["top_companies"], "company", "n") == [("Acme", 2), ("Beta", 2), ("Gamma", 1)]
    assert dict(got(r["findings"], "name", "n")) == {
        "customer_facing_support": 1, "first_with_few_genai_skills": 1, "engineer_title_but_support": 0, "forward_deployed": 0,
        "forward_deployed_first": 0, "ml_first": 1}
    assert ("ops", "Docker", 2, 1) in got(r["top_skills"], "category", "skill", "n", "rank")
    assert dict(got(r["use_case_tags"], "tag", "n")) == {
        "Search": 2, "Customer-facing": 1, "Enterprise": 1, "Fine-tuning": 1}  # "custom" is a substring of "customer"


def test_patterns(postings):
    r = R.patterns(postings)
    assert got(r["frameworks"], "skill", "n") == [("LangChain", 2), ("LangGraph", 1)]
    assert got(r["framework_pairs"], "a", "b", "n") == [("LangChain", "LangGraph", 1)]
    assert got(r["title_families"], "family", "n", "pct_first") == [("Platform", 1, 0.0), ("Research", 1, 0.0)]
    assert ("genai", "web", "ai-first", 1) in got(r["category_pair_mix"], "first", "second", "kind", "n")
    stages = got(r["skills_by_stage"], "bucket", "skill", "n")
    assert ("Early", "PyTorch", 1) in stages and ("Growth", "Docker", 1) in stages and ("Late", "Python", 1) in stages


def test_titles(postings):
    r = R.titles(postings)
    assert got(r["clusters"], "base", "n", "label") == [("a engneer", 3, "ai-first")]
    bases = {(k, b): (n, s) for k, b, n, s in got(r["base_titles"], "kind", "base", "n", "samples")}
    assert bases["ai-first", "a engneer"] == (3, ["AI Engineer", "AI Engineer II", "Senior AI Engineer"])
    assert ("ai-first", "engineer", 3, 100.0) in got(r["term_rates"], "kind", "term", "n", "pct")


def test_support_and_research(postings):
    r = R.support_roles(postings)
    assert got(r["categories"], "category", "n", "example") == [("Platform/Infrastructure", 1, "Run clusters...")]
    assert dict(got(r["research_split"], "role", "n")) == {"research": 1, "applied": 4}
    assert dict(got(r["research_by_type"], "kind", "n")) == {"ml-first": 1}
    s = R.support_skills(postings)
    rates = {m: (a, b) for m, a, b in got(s["comparison"], "metric", "n_first", "n_support")}
    assert rates["LangChain"] == (2, 0) and rates["Docker"] == (1, 1) and len(rates) == sum(map(len, vocab.COMPARED_SKILLS.values()))
    assert got(s["genai_presence"], "with_genai", "n") == [(False, 1)]


def test_skills_and_fine_tuning(postings):
    r = R.skills(postings)
    assert got(r["ml_any"], "n", "n_total") == [(1, 3)]
    assert dict(got(r["full_stack"], "name", "n")) == {"frontend": 1, "backend": 1, "both": 1}
    assert dict(got(r["mixture"], "name", "n")) == {"only_genai": 1, "genai_ml": 1, "genai_web": 1, "genai_ops": 0, "genai_any": 1}
    f = R.finetuning(postings)
    assert got(f["mention"], "n", "n_total") == [(2, 3)]
    assert dict(got(f["depth"], "depth", "n")) == {"primary": 2, "none": 1}


def test_items(postings):
    r = R.responsibilities(postings)
    assert dict(got(r["by_type"], "kind", "n")) == {"ai-first": 4, "ai-support": 1, "(all)": 5}
    assert dict(got(r["categories"], "category", "n")) == {
        "Build/Implement Systems": 1, "Deploy/Production": 1, "Fine-tuning/Training": 2, "Infrastructure/Platform": 1}
    assert got(R.use_cases(postings)["uncategorized"], "n") == [(0,)]


def test_cards(spark):
    rows = [(1, "AI Engineer", "A", "Remote", "Mid", "https://x/job/a/1"), (2, "AI Engineer", "A", "Hybrid", "Mid", "https://x/job/a/2"),
            (3, "Sales Engineer", None, "Remote", None, "https://x/job/b/3"), (4, "AI Engineer", "Z", "Remote", "Mid", "https://x/job/c/4")]
    cards = spark.createDataFrame(rows, "pos int, title string, company string, work_type string, level string, link string")
    r = R.explore_cards(cards, order="pos", excluded_company="Z")
    assert sorted(got(r["unique"], "pos", "id")) == [(1, "1"), (3, "3")]
    assert got(r["title_company"], "value", "n") == [("AI Engineer A", 2)]
    assert got(r["title_rates"], "words", "in_order", "adjacent") == [(0.5, 0.5, 0.5)]
    assert dict(got(R.title_classes(cards)["classes"], "classification", "n")) == {"ai_first": 3, "other": 1}
