"""Ready-made reports: each takes postings (live schema) or listing cards and returns named DataFrames.

Nothing runs until a section is used, but where sections share a search of the texts: that is done once and stored. Stage the postings once as parquet (`writers.compact`) and
pass that table: every section is then one pruned scan and one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import vocab
from postloom.functions import classify as C
from postloom.functions import predicates as P
from postloom.functions.access import flatten_skills, get_path, items, row_count
from postloom.functions.taxonomy import Taxonomy, bucket_contains
from postloom.functions.text import contains_any, link_tail_id, truncate_preview
from postloom.operators import cooccur, counts, joins, nesting, ranking, setops
from postloom.session import stored

Report = dict[str, DataFrame]
FIRST, SUPPORT, ML = "ai-first", "ai-support", "ml-first"
CATS = vocab.SKILL_CATEGORIES


def flat(postings: DataFrame) -> DataFrame:
    """The columns the reports ask for, at top level, with the defaults of the nested access."""
    return postings.select(
        get_path("meta.job_id").alias("job_id"), get_path("company.name", "Unknown").alias("company"),
        get_path("company.stage").alias("stage"), get_path("position.title", "Unknown").alias("title"),
        get_path("position.ai_type.type", "unknown").alias("kind"), items("position.responsibilities").alias("responsibilities"),
        items("position.use_cases").alias("use_cases"), F.col("position.skills").alias("skills"),
        P.truthy("position.is_customer_facing").alias("is_customer_facing"),
        P.truthy("position.is_management").alias("is_management"))


def _ranked(df: DataFrame, by: str) -> DataFrame:
    """Value counts, most frequent first. The sort sees one row per value only."""
    return ranking.order_by_size(counts.value_counts(df, by), "n", by)


def _ranked_shares(df: DataFrame, by: str) -> DataFrame:
    return ranking.order_by_size(counts.share_of_total(counts.value_counts(df, by)), "n", by)


def _examples(rows: DataFrame, label: Column, n: int, *shown: Column | str) -> DataFrame:
    """The first `n` rows of every label in job id order."""
    picked = rows.withColumn("label", label).filter(F.col("label").isNotNull())
    return ranking.top_k_per_group(picked, ["label"], n, [F.col("job_id").asc()], rank="rank").select("label", "rank", "job_id", *shown)


def _rate(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row per flag: name, n, n_total, pct."""
    wide = counts.flag_counts(df, flags)
    long = counts.unpivot(wide, ["n_total"], {f: f for f in flags}, "name", "n")
    return long.withColumn("pct", F.try_divide(F.lit(100.0) * F.col("n"), F.col("n_total").cast("double")))


def overview(postings: DataFrame) -> Report:
    """Type mix, companies, stages, roles, top skills per category, use-case tags and findings."""
    p = flat(postings)
    genai = items("skills.genai")
    findings = {
        "customer_facing_support": (F.col("kind") == SUPPORT) & F.col("is_customer_facing"),
        "first_with_few_genai_skills": (F.col("kind") == FIRST) & P.size_is(genai, "<=", 1),
        "engineer_title_but_support": contains_any("title", ["ai engineer"]) & (F.col("kind") == SUPPORT),
        "forward_deployed": contains_any("title", ["forward", "deployed"]),
        "forward_deployed_first": contains_any("title", ["forward", "deployed"]) & (F.col("kind") == FIRST),
        "ml_first": F.col("kind") == ML,
    }
    matched = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in findings.items()]))
    skills = counts.category_item_counts(nesting.unnest_skills(p, "skills", [], CATS))
    uses = p.select(F.explode("use_cases").alias("use_case"))
    return {
        "ai_types": _ranked_shares(p, "kind"),
        "company_total": counts.distinct_count(p, "company"),
        "top_companies": counts.value_counts(p, "company", top=20),
        "stages": _ranked(p.filter(F.length("stage") > 0), "stage"),
        "roles": _rate(p, {"customer_facing": F.col("is_customer_facing"), "management": F.col("is_management")}),
        "top_titles": counts.value_counts(p, "title", top=15),
        "top_skills": ranking.top_k_per_group(skills.filter(F.col("category").isin(*CATS[:8])), ["category"], 10,
                                              [F.col("n").desc(), F.col("skill").asc()], rank="rank"),
        "use_case_total": uses.agg(row_count().alias("n")),
        "use_case_tags": _ranked(
            uses.select(F.explode(Taxonomy(vocab.USE_CASE_TAGS).all_matches("use_case")).alias("tag")), "tag"),
        "findings": _rate(p, findings).select("name", "n"),
        "finding_examples": _examples(p.withColumn("_f", F.explode(matched)), F.col("_f"), 10, "company", "title"),
    }


def patterns(postings: DataFrame) -> Report:
    """Frameworks, title families, category pairs, skill pairs and skills by company stage."""
    p = flat(postings)
    genai = items("skills.genai")
    families = p.select("title", "kind", F.explode(Taxonomy(vocab.TITLE_FAMILIES).all_matches("title")).alias("family"))
    family_table = counts.title_families(p, Taxonomy(vocab.TITLE_FAMILIES).all_matches("title"), "kind", FIRST)
    pairs = cooccur.category_pairs(p, cooccur.present_categories("skills", CATS), "kind")
    totals = pairs.groupBy("first", "second").agg(F.sum("n").alias("n"))
    by_stage = counts.bucketed_item_counts(p, bucket_contains("stage", vocab.STAGE_BUCKETS), "skills", CATS)
    entries = p.select(F.explode(genai).alias("skill"))
    return {
        "frameworks": _ranked(entries.filter(F.col("skill").isin(*vocab.FRAMEWORKS)), "skill"),
        "framework_pairs": ranking.top_k(cooccur.listed_pairs(p, genai, vocab.FRAMEWORKS), 15, "n", ["a", "b"]),
        "title_families": ranking.order_by_share(family_table, "pct_first", "family"),
        "title_family_mix": families.groupBy("family", "kind").agg(row_count().alias("n")),
        "title_family_samples": counts.group_items(families, "family", "title", 5),
        "category_pairs": ranking.top_k(totals, 10, "n", ["first", "second"]),
        "category_pair_mix": pairs,
        "genai_pairs": ranking.top_k(cooccur.pair_counts(p, genai, min_count=10), 20, "n", ["a", "b"]),
        "skills_by_stage": ranking.top_k_per_group(by_stage, ["bucket"], 10, [F.col("n").desc(), F.col("skill").asc()], rank="rank"),
    }


def titles(postings: DataFrame) -> Report:
    """Titles per type, base titles, clusters and term rates."""
    p = flat(postings).select("title", "kind").withColumn("base", C.normalize_title("title"))
    shown = p.filter(F.col("kind").isin(FIRST, SUPPORT, ML))
    per_title = counts.value_counts(shown, ["kind", "title"])
    groups = counts.value_counts(shown, ["kind", "base"])
    top_groups = ranking.top_k_per_group(groups, ["kind"], 20, [F.col("n").desc(), F.col("base").asc()], rank="rank")
    variants = counts.group_items(shown.withColumn("key", F.struct("kind", "base")), "key", "title", 5)
    clusters = counts.cluster_label(p, "base", "kind", FIRST, SUPPORT).withColumn(
        "pct_first", F.lit(100.0) * F.col("n_first") / F.col("n")).withColumn("pct_second", F.lit(100.0) * F.col("n_second") / F.col("n"))
    kept = F.when(F.col("label") == "mixed", 15).otherwise(20)
    return {
        "top_titles": ranking.top_k_per_group(per_title, ["kind"], 30, [F.col("n").desc(), F.col("title").asc()], rank="rank"),
        "base_titles": top_groups.withColumn("key", F.struct("kind", "base")).join(variants.select("key", "samples"), "key").drop("key"),
        "clusters": ranking.top_k_per_group(clusters, ["label"], 20, [F.col("n").desc(), F.col("base").asc()], rank="rank").filter(F.col("rank") <= kept),
        "term_rates": counts.term_rates(p.filter(F.col("kind").isin(FIRST, SUPPORT)), "title", vocab.TITLE_TERMS, ["kind"]).filter(F.col("n") > 0),
    }


def support_roles(postings: DataFrame) -> Report:
    """What support roles do, and research against applied roles."""
    p = flat(postings)
    title, body, uses = F.lower("title"), F.array_join("responsibilities", " "), F.array_join("use_cases", " ")
    category = Taxonomy(vocab.SUPPORT_ROLE_TAXONOMY).first_match_in([title, body], "Other")
    research = C.score_compare(title, [body, uses], for_words=vocab.RESEARCH_INDICATORS, against_words=vocab.APPLIED_INDICATORS,
                               title_words=vocab.RESEARCH_TITLE_WORDS)
    # the texts are searched once, the sections read a few short columns
    judged = stored(p.select("job_id", "company", "title", "kind", F.when(F.col("kind") == SUPPORT, category).alias("category"), research.alias("research"),
                             (F.size("responsibilities") > 0).alias("has_tasks"), F.substring(F.get("responsibilities", F.lit(0)), 1, 100).alias("first_task")),
                    "support-roles")
    support = judged.filter(F.col("kind") == SUPPORT)
    hit, first_task = F.col("research.hit"), F.col("first_task")
    label = (F.when(hit, "research").when(F.col("kind") == FIRST, "applied").when(F.col("kind") == SUPPORT, "support"))
    samples = counts.group_items(support, "category", "title", 5)
    example = support.groupBy("category").agg(F.min_by(first_task, F.col("job_id")).alias("example"))
    return {
        "categories": ranking.order_by_size(
            samples.join(example.withColumn("example", truncate_preview(F.col("example"), 80)), "category", "left"), "n", "category"),
        "research_split": counts.share_of_total(judged.groupBy(F.when(hit, "research").otherwise("applied").alias("role")).agg(row_count().alias("n"))),
        "research_reasons": _ranked(judged.select("research.reason"), "reason"),
        "research_by_type": _ranked(judged.filter(hit), "kind"),
        "research_titles": judged.filter(hit).select("title").distinct().orderBy("title").limit(15),
        "examples": _examples(judged.filter("has_tasks"), label, 1, "company", "title", truncate_preview(first_task, 100).alias("example")),
    }


def skills(postings: DataFrame) -> Report:
    """ML terms, other skills, full-stack capability and skill mixtures of ai-first roles."""
    p = flat(postings).filter(F.col("kind") == FIRST).withColumn("all_skills", flatten_skills("skills", CATS))
    terms = [t.lower() for t in vocab.ML_TERMS]
    ml = F.filter("all_skills", lambda s: contains_any(s, terms, lower=False))
    with_ml = p.withColumn("ml_skills", ml).filter(F.size("ml_skills") > 0)
    by_term = counts.postings_with_term(p, "all_skills", vocab.ML_TERMS)
    rates = by_term.withColumn("pct", F.try_divide(F.lit(100.0) * F.col("n"), F.col("n_total").cast("double")))
    others = counts.category_item_counts(nesting.unnest_skills(p, "skills", [], CATS), without=["genai"])
    shown = others.filter(F.col("category").isin("web", "cloud", "ops", "languages", "databases", "data"))
    top_others = ranking.top_k_per_group(shown, ["category"], 8, [F.col("n").desc(), F.col("skill").asc()], rank="rank")
    size = {c: F.size(items(f"skills.{c}")) for c in CATS}
    other = size["ml"] + size["web"] + size["ops"] + size["cloud"] + size["data"] + size["databases"]
    front, back = C.capability("all_skills", vocab.FRONTEND_TERMS), C.capability("all_skills", vocab.BACKEND_TERMS)
    return {
        "ml_any": rates.filter(F.col("term") == "any"),
        "ml_terms": ranking.top_k(rates.filter((F.col("term") != "any") & (F.col("n") > 0)), 15, "n", ["term"]),
        "ml_heavy": ranking.largest_lists(with_ml, F.size("ml_skills"), "job_id").select("job_id", "company", "title", F.slice("ml_skills", 1, 5).alias("ml_skills")),
        "ml_light": ranking.largest_lists(with_ml, F.size("ml_skills"), "job_id", at_most=2).select("job_id", "company", "title", "ml_skills"),
        "other_skills": counts.share_of(top_others, p),
        "full_stack": _rate(p.select(front.alias("f"), back.alias("b")), {
            "frontend": F.col("f"), "backend": F.col("b"), "both": F.col("f") & F.col("b")}),
        "mixture": _rate(p, {
            "only_genai": (size["genai"] > 0) & (other == 0), "genai_ml": (size["genai"] > 0) & (size["ml"] > 0),
            "genai_web": (size["genai"] > 0) & (size["web"] > 0), "genai_ops": (size["genai"] > 0) & (size["ops"] > 0),
            "genai_any": (size["genai"] > 0) & (other > 0)}),
    }


def finetuning(postings: DataFrame) -> Report:
    """How many ai-first roles ask for fine-tuning, how deeply, and what for."""
    p = flat(postings).filter(F.col("kind") == FIRST)
    body, uses = F.array_join("responsibilities", " "), F.array_join("use_cases", " ")
    low = lambda c: F.array_join(F.transform(items(f"skills.{c}"), F.lower), " ")
    bundle = F.lower(F.concat_ws(" ", "title", body, uses, low("genai"), low("ml")))
    mention = F.lower(F.concat_ws(" ", "title", body, uses))
    level = C.depth_level(mention, F.col("title"), body, indicators=vocab.FINETUNING_INDICATORS, title_words=vocab.FINETUNING_TITLE_WORDS,
                          repeated=vocab.FINETUNING_REPEATED, techniques=vocab.FINETUNING_TECHNIQUES)
    asked = p.filter(contains_any(bundle, vocab.FINETUNING_KEYWORDS, lower=False))
    cases = asked.select("job_id", F.posexplode("use_cases").alias("pos", "use_case")).withColumn(
        "category", Taxonomy(vocab.FINETUNING_TAXONOMY).gated("use_case", vocab.FINETUNING_GATE, "(other mention)")).filter(F.col("category").isNotNull())
    deep = p.withColumn("depth", level)
    return {
        "mention": _rate(p, {"fine_tuning": contains_any(bundle, vocab.FINETUNING_KEYWORDS, lower=False)}),
        "depth": _ranked_shares(deep, "depth"),
        "use_case_categories": ranking.order_by_size(
            counts.group_items(cases.filter(F.col("category") != "(other mention)"), "category", "use_case", 3), "n", "category"),
        "other_mentions": P.first_rows(cases.filter(F.col("category") == "(other mention)"), 10, "job_id", "pos").select("use_case"),
        "examples": _examples(deep, F.when(F.col("depth") != "none", F.col("depth")), 5, "company", "title",
                              truncate_preview(F.get("responsibilities", F.lit(0)), 100).alias("example")),
    }


def support_skills(postings: DataFrame) -> Report:
    """ai-first against ai-support: skills, genai knowledge and entry level."""
    p = flat(postings).withColumn("all_skills", flatten_skills("skills", CATS))
    terms = {t: c for c, ts in vocab.COMPARED_SKILLS.items() for t in ts}
    both = p.filter(F.col("kind").isin(FIRST, SUPPORT))
    comparison = joins.compare_groups(both, F.col("kind"), {"first": FIRST, "support": SUPPORT},
                                      {t: C.capability("all_skills", [t.lower()]) for t in terms})
    category = F.element_at(F.create_map(*[F.lit(x) for kv in terms.items() for x in kv]), F.col("metric"))
    support = p.filter(F.col("kind") == SUPPORT)
    with_genai = P.size_is(items("skills.genai"), ">", 0)
    genai = counts.value_counts(support.select(F.explode(items("skills.genai")).alias("skill")), "skill", top=15)
    three_each = F.slice(F.flatten(F.array(*[F.slice(items(f"skills.{c}"), 1, 3) for c in CATS])), 1, 5)
    entry = joins.compare_groups(both, F.col("kind"), {"first": FIRST, "support": SUPPORT}, {"entry_level": C.entry_level("title")})
    return {
        "comparison": comparison.withColumn("category", category),
        "genai_presence": counts.share_of_total(support.groupBy(with_genai.alias("with_genai")).agg(row_count().alias("n"))),
        "genai_skills": counts.share_of(genai, support),
        "examples": _examples(support, F.when(with_genai, "with genai").otherwise("without genai"), 5, "company", "title",
                              F.when(with_genai, items("skills.genai")).otherwise(three_each).alias("skills")),
        "entry_level": entry,
    }


def _item_report(postings: DataFrame, column: str, taxonomy: list, stop_words: list[str]) -> Report:
    rows = nesting.explode_with_source(flat(postings), column, ["job_id", "company", "title", "kind"])
    # the items are labelled once, the sections read the columns they need
    labelled = stored(rows.withColumn("category", Taxonomy(taxonomy).first_match("item")), "items")
    rows = labelled.drop("category")
    return {
        "items": rows,
        "categories": ranking.order_by_size(counts.group_items(labelled, "category", "item", 5), "n", "category"),
        "uncategorized": labelled.filter(F.col("category").isNull()).agg(row_count().alias("n")),
        "by_type": counts.totals_by_type(rows, "kind"),
        "words": counts.word_frequency(rows, "item", stop_words=stop_words),
    }


def responsibilities(postings: DataFrame) -> Report:
    """Responsibility items, categories, totals by type and frequent words."""
    return _item_report(postings, "responsibilities", vocab.RESPONSIBILITY_TAXONOMY, vocab.RESPONSIBILITY_STOP_WORDS)


def use_cases(postings: DataFrame) -> Report:
    """Use-case items, categories, totals by type and frequent words."""
    return _item_report(postings, "use_cases", vocab.USE_CASE_TAXONOMY, vocab.USE_CASE_STOP_WORDS)


def title_classes(cards: DataFrame) -> Report:
    """Listing cards with their title class, the class counts and the first titles of every class."""
    classified = cards.withColumn("classification", C.classify_title("title"))
    samples = counts.exclusive_items(classified, "classification", "title", 30)
    return {
        "classified": classified,
        "classes": _ranked_shares(classified, "classification"),
        "samples": samples.filter((F.col("classification") != "other") | (F.col("rank") <= 20)),
    }


def explore_cards(cards: DataFrame, *, order: str, excluded_company: str) -> Report:
    """First look at combined listing cards; `order` is the ingest position that decides which duplicate stays."""
    with_id = cards.withColumn("id", link_tail_id("link"))
    kept = with_id.filter(P.differs("company", excluded_company))
    unique = setops.dedup_keep_first(kept, ["title", "company"], order)
    engineers = unique.filter(P.matches("title", r"ai\s+engineer"))
    return {
        "companies": counts.value_counts(with_id, "company", top=10),
        "first_link": ranking.first_per_group(with_id, ["company"], order, "link"),
        "title_company": counts.composite_counts(kept, "title", "company", top=5),
        "unique": unique,
        "title_rates": counts.match_rate(unique, words=contains_any("title", ["ai"]) & contains_any("title", ["engineer"]),
                                         in_order=P.matches("title", "ai.*engineer"), adjacent=P.matches("title", r"ai\s+engineer")),
        "engineers": engineers,
        "work_types": _ranked(engineers, "work_type"),
        "levels": _ranked(engineers, "level"),
    }


POSTING_REPORTS = {
    "overview": overview, "patterns": patterns, "titles": titles, "support_roles": support_roles, "skills": skills,
    "finetuning": finetuning, "support_skills": support_skills, "responsibilities": responsibilities, "use_cases": use_cases,
}
CARD_REPORTS = {"title_classes": title_classes, "explore_cards": explore_cards}
