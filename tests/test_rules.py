"""Classifiers and taxonomies on literal rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from postloom import vocab
from postloom.functions import classify as C
from postloom.functions.taxonomy import Taxonomy, bucket_contains
from postloom.functions.text import contains_any

T = F.col

TITLES = {
    "AI Engineer": "ai_first",
    "Machine Learning Engineer": "ai_first",
    "Senior Full Stack AI Engineer": "ai_first",
    "Software Engineer / AI Engineer": "ai_support",
    "AI Software Engineer": "ai_support",
    "Software Engineer, AI Platform": "ai_support",
    "Inference Engineer": "ai_first",
    "Customer Engineer": "ai_support",
    "Maintenance Platform Engineer": "ai_support",
    "Sales Engineer": "other",
    "Android Developer": "other",
    "Software Engineer – AI": "ai_support",
    "Équipe AI Engineer": "ai_first",
    "Engineer": "other",
    "": "other",
    "ai engineer": "ai_first",
    "Full Stack Engineer (AI)": "ai_support",
    "AI Engineer (Software)": "other",
}


def test_title_classes(col):
    assert dict(zip(TITLES, col(list(TITLES), C.classify_title("t")))) == TITLES


def guard_model(title):
    low = title.lower()
    words = low.split()
    near = any("ai" in w and any(p in " ".join(words[max(0, i - 3):i]) for p in vocab.GUARD_TERMS)
               for i, w in enumerate(words) if i > 0)
    return any(p in low for p in vocab.SUPPORT_PHRASES) and near


def test_guard_equals_its_definition(col):
    parts = ["Software Engineer", "Full Stack Engineer", "full  stack", "Data", "x", "AI", "mail,", "Staff Engineer", "devops"]
    titles = [" ".join(c) for n in (1, 2, 3, 4) for c in itertools.product(parts, repeat=n)]
    titles += ["a Software Engineer b AI", "\tsoftware engineer a b c ai", "software engineer a b ai "]
    assert col(titles, C.prefix_role_guard("t")) == [guard_model(t) for t in titles]


def test_stage_buckets_keep_order_and_case(col):
    stages = ["Seed/Series A", "pre-Series A", "Series B or later", "Series C/Public", "Public benefit corporation", "public", None]
    assert col(stages, bucket_contains("t", vocab.STAGE_BUCKETS)) == ["Early", "Growth", "Growth", "Growth", "Late", None, None]


def test_months(col):
    got = col([None, 0, 23, 24, 47, 48, 83, 84], C.months_to_level("t"), "int")
    assert got == ["", "", "Entry level", "Mid level", "Mid level", "Senior level", "Senior level", "Expert/Leader"]


def test_normalize_title_modes(col):
    titles = ["Senior AI Engineer", "AI Engineer II", "Sr. Lead Machine Engineer"]
    assert col(titles, C.normalize_title("t")) == ["a engneer", "a engneer", "machne engneer"]
    assert col(titles, C.normalize_title("t", mode="token")) == ["ai engineer", "ai engineer", "machine engineer"]


def test_keywords_are_substrings_unless_asked(col):
    texts = ["maintain", "an AI", "fairy ai.", ""]
    assert col(texts, contains_any("t", ["ai"])) == [True, True, True, False]
    assert col(texts, contains_any("t", ["ai"], word_boundary=True)) == [False, True, True, False]
    assert col(["Rag", "rag"], contains_any("t", ["rag"], lower=False)) == [False, True]


def test_first_match_order_decides(col):
    uses = ["Copilot for developers", "document search", "", "PDF reader"]
    got = col(uses, Taxonomy(vocab.USE_CASE_TAXONOMY).first_match("t"))
    assert got == ["Agents / Agentic AI", "RAG / Retrieval", None, "Document processing"]
    other = [("B", ["copilot"]), ("A", ["copilot", "pdf"])]
    assert col(uses, Taxonomy(other).first_match("t", "none")) == ["B", "none", "none", "A"]


def test_gate_and_multi_label(col):
    texts = ["custom thing", "domain expert", "nothing"]
    assert col(texts, Taxonomy(vocab.FINETUNING_TAXONOMY).gated("t", vocab.FINETUNING_GATE, "rest")) == ["rest", "Domain knowledge", None]
    tags = col(["custom agent search for business"], Taxonomy(vocab.USE_CASE_TAGS).all_matches("t"))
    assert tags == [["Agents", "Fine-tuning", "Enterprise", "Search"]]


def test_support_roles_look_at_title_or_body(spark):
    rows = spark.createDataFrame([(1, "platform lead", ""), (2, "x", "build the API api"), (3, "x", "Kubernetes"), (4, "x", "")], "i int, title string, body string")
    got = rows.orderBy("i").select(Taxonomy(vocab.SUPPORT_ROLE_TAXONOMY).first_match_in([F.lower("title"), T("body")], "Other").alias("c")).collect()
    assert [r.c for r in got] == ["Platform/Infrastructure", "Backend/General SWE", "Other", "Other"]


def test_research_score(spark):
    rows = spark.createDataFrame([
        (1, "research engineer", "", ""), (2, "engineer", "novel algorithm", ""), (3, "engineer", "novel algorithm in production", "deploy"),
        (4, "engineer", "novel", ""), (5, "engineer", "world", "model")], "i int, title string, body string, uses string")
    scored = C.score_compare(T("title"), [T("body"), T("uses")], for_words=vocab.RESEARCH_INDICATORS,
                             against_words=vocab.APPLIED_INDICATORS, title_words=vocab.RESEARCH_TITLE_WORDS)
    got = [tuple(r.s) for r in rows.orderBy("i").select(scored.alias("s")).collect()]
    assert got == [(True, "title"), (True, "content"), (False, "none"), (False, "none"), (False, "none")]


def test_fine_tuning_depth(spark):
    rows = spark.createDataFrame([
        (1, "Fine-tune lead", "fine-tuning"), (2, "x", "fine-tune and fine-tuning"), (3, "x", "use LoRA"), (4, "x", "finetune once"), (5, "x", "nothing"),
        (6, "x", "Fine-tuning and Fine-tuned")], "i int, title string, body string")
    level = C.depth_level(F.lower(F.concat_ws(" ", "title", "body")), T("title"), T("body"), indicators=vocab.FINETUNING_INDICATORS,
                          title_words=vocab.FINETUNING_TITLE_WORDS, repeated=vocab.FINETUNING_REPEATED, techniques=vocab.FINETUNING_TECHNIQUES)
    assert [r.d for r in rows.orderBy("i").select(level.alias("d")).collect()] == ["primary", "primary", "primary", "secondary", "none", "secondary"]


@pytest.mark.parametrize("a,b,kind", [(3, 1, "ai-first"), (1, 3, "ai-support"), (1, 1, "ai-first"), (0, 1, "ai-support"), (0, 0, "unknown"), (2, 2, "ai-first")])
def test_score_rule(spark, a, b, kind):
    assert spark.range(1).select(C.score_rule(F.lit(a), F.lit(b)).alias("k")).first().k == kind


def test_outside_field_is_optional(col):
    assert col(["GTM Engineer", "QA Engineer, AI", "QA Engineer"], C.is_outside_field("t")) == [True, False, True]
