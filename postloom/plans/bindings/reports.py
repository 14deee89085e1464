"""S13 and the eleven reports, as (section, key, n) rows over postings made from whole documents and cards made from parts."""

from pyspark.sql import functions as F

from postloom import vocab
from postloom.plans import reports as R
from postloom.plans.bindings.common import POSTING_SQL, any_sql, first_match_sql, lit_sql, postings, query, table
from postloom.plans.bindings.rules import CLASS_SQL, TITLES_SQL, titles
from postloom.session import scratch_path
from postloom.sources.writers import compact


def staged(spark, sf):
    """The postings written once; every section reads the staged table."""
    return compact(postings(spark, sf), scratch_path(spark, "postings"))


def rows(section, df, keys, n="n"):
    return df.select(F.lit(section).alias("section"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
                     F.col(n).cast("long").alias("n"))


def stack(*parts):
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _sql(*parts, ctes=""):
    return f"WITH {POSTING_SQL}{ctes} " + " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def _sec(section, key, n, rest):
    return f"SELECT '{section}' AS section, {key} AS key, ({n})::BIGINT AS n {rest}"


def _top(section, key, rest, k, group="GROUP BY 2"):
    return _sec(section, key, "count(*)", f"{rest} {group} ORDER BY n DESC, key LIMIT {k}")


_ITEMS = """, resp AS (SELECT doc_id, kind, unnest(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)) AS item FROM d),
  uses AS (SELECT doc_id, kind, unnest(list_filter(string_split(text, '. '), lambda x: length(trim(x)) > 0)) AS item FROM d)"""
_GENAI = ", g AS (SELECT d.*, (SELECT count(*) FROM w WHERE w.doc_id = d.doc_id AND category = 'genai') AS n_genai FROM d)"
_EIGHT = ", ".join(f"'{c}'" for c in vocab.SKILL_CATEGORIES[:8])


@query("report_overview", _sql(
    _sec("ai_types", "kind", "count(*)", "FROM d GROUP BY kind"),
    _sec("company_total", "''", "count(DISTINCT company)", "FROM d"),
    _top("top_companies", "company", "FROM d", 20),
    _sec("stages", "stage", "count(*)", "FROM d WHERE stage IS NOT NULL GROUP BY stage"),
    _sec("roles", "'customer_facing'", "count(*) FILTER (customer_facing)", "FROM d"),
    _sec("roles", "'management'", "count(*) FILTER (management)", "FROM d"),
    _top("top_titles", "title", "FROM d", 15),
    "SELECT 'top_skills' AS section, category || '|' || skill || '|' || rank AS key, n FROM (SELECT category, skill, count(*) AS n, "
    f"row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, skill) AS rank FROM w WHERE category IN ({_EIGHT}) GROUP BY category, skill) WHERE rank <= 10",
    _sec("use_case_total", "''", "count(*)", "FROM uses"),
    *[_sec("use_case_tags", lit_sql(name), "count(*)", f"FROM uses WHERE {any_sql('lower(item)', kws)} HAVING count(*) > 0") for name, kws in vocab.USE_CASE_TAGS],
    _sec("findings", "'customer_facing_support'", "count(*)", "FROM d WHERE kind = 'ai-support' AND customer_facing"),
    _sec("findings", "'first_with_few_genai_skills'", "count(*)", "FROM g WHERE kind = 'ai-first' AND n_genai <= 1"),
    _sec("findings", "'engineer_title_but_support'", "count(*)", "FROM d WHERE kind = 'ai-support' AND contains(lower(title), 'ai engineer')"),
    _sec("findings", "'forward_deployed'", "count(*)", "FROM d WHERE contains(lower(title), 'forward') OR contains(lower(title), 'deployed')"),
    _sec("findings", "'forward_deployed_first'", "count(*)", "FROM d WHERE kind = 'ai-first' AND (contains(lower(title), 'forward') OR contains(lower(title), 'deployed'))"),
    _sec("findings", "'ml_first'", "count(*)", "FROM d WHERE kind = 'ml-first'"),
    ctes=_ITEMS + _GENAI))
def overview(spark, sf):
    r = R.overview(staged(spark, sf))
    return stack(rows("ai_types", r["ai_types"], ["kind"]), rows("company_total", r["company_total"].withColumn("k", F.lit("")), ["k"], "n_company"),
                 rows("top_companies", r["top_companies"], ["company"]), rows("stages", r["stages"], ["stage"]),
                 rows("roles", r["roles"], ["name"]), rows("top_titles", r["top_titles"], ["title"]),
                 rows("top_skills", r["top_skills"], ["category", "skill", "rank"]),
                 rows("use_case_total", r["use_case_total"].withColumn("k", F.lit("")), ["k"]),
                 rows("use_case_tags", r["use_case_tags"], ["tag"]), rows("findings", r["findings"], ["name"]))


_FAM = " UNION ALL ".join(f"SELECT doc_id, kind, title, {lit_sql(name)} AS family FROM d WHERE {any_sql('lower(title)', kws)}" for name, kws in vocab.TITLE_FAMILIES)
_CAT_POS = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(vocab.SKILL_CATEGORIES)) + " END"
_FRAMEWORKS = ", ".join(lit_sql(f) for f in vocab.FRAMEWORKS)


@query("report_patterns", _sql(
    _sec("frameworks", "skill", "count(*)", f"FROM w WHERE category = 'genai' AND skill IN ({_FRAMEWORKS}) GROUP BY skill"),
    _sec("title_families", "family", "count(*)", "FROM f GROUP BY family"),
    _sec("title_family_mix", "family || '|' || kind", "count(*)", "FROM f GROUP BY family, kind"),
    _sec("category_pairs", "first || '|' || second", "sum(n)", "FROM cp GROUP BY first, second ORDER BY n DESC, first, second LIMIT 10"),
    _sec("category_pair_mix", "first || '|' || second || '|' || kind", "n", "FROM cp"),
    _sec("genai_pairs", "x.skill || '|' || y.skill", "count(*)", "FROM gs x JOIN gs y ON x.doc_id = y.doc_id AND x.skill < y.skill "
         "GROUP BY x.skill, y.skill HAVING count(*) >= 10 ORDER BY n DESC, x.skill, y.skill LIMIT 20"),
    "SELECT 'skills_by_stage' AS section, bucket || '|' || skill || '|' || rank AS key, n FROM (SELECT bucket, skill, count(*) AS n, "
    "row_number() OVER (PARTITION BY bucket ORDER BY count(*) DESC, skill) AS rank FROM st WHERE rn <= 10 AND bucket IS NOT NULL GROUP BY bucket, skill) WHERE rank <= 10",
    ctes=f""", f AS ({_FAM}), gs AS (SELECT DISTINCT doc_id, skill FROM w WHERE category = 'genai'),
  wc AS (SELECT DISTINCT w.doc_id, kind, category, {_CAT_POS} AS o FROM w JOIN d ON w.doc_id = d.doc_id),
  cp AS (SELECT x.category AS first, y.category AS second, x.kind, count(*) AS n FROM wc x JOIN wc y ON x.doc_id = y.doc_id AND x.o < y.o GROUP BY ALL),
  st AS (SELECT skill, {first_match_sql(vocab.STAGE_BUCKETS, 'stage')} AS bucket, row_number() OVER (PARTITION BY w.doc_id, category ORDER BY pos) AS rn
    FROM w JOIN d ON w.doc_id = d.doc_id)"""))
def patterns(spark, sf):
    r = R.patterns(staged(spark, sf))
    return stack(rows("frameworks", r["frameworks"], ["skill"]), rows("title_families", r["title_families"], ["family"]),
                 rows("title_family_mix", r["title_family_mix"], ["family", "kind"]),
                 rows("category_pairs", r["category_pairs"], ["first", "second"]),
                 rows("category_pair_mix", r["category_pair_mix"], ["first", "second", "kind"]),
                 rows("genai_pairs", r["genai_pairs"], ["a", "b"]), rows("skills_by_stage", r["skills_by_stage"], ["bucket", "skill", "rank"]))


def _base_sql(expr):
    for word in vocab.SENIORITY_WORDS:
        expr = f"trim(replace({expr}, {lit_sql(word)}, ''), ' ' || chr(9) || chr(10) || chr(13))"
    return expr


_SHOWN = "kind IN ('ai-first', 'ai-support', 'ml-first')"


def _ranked(section, source, keys, k, label):
    key = " || '|' || ".join(keys)
    return (f"SELECT '{section}' AS section, {key} || '|' || rank AS key, n FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY n DESC, {keys[-1]}) "
            f"AS rank FROM ({source})) WHERE rank <= {k}")


@query("report_titles", _sql(
    _ranked("top_titles", f"SELECT kind, title, count(*) AS n FROM b WHERE {_SHOWN} GROUP BY ALL", ["kind", "title"], 30, "kind"),
    _ranked("base_titles", f"SELECT kind, base, count(*) AS n FROM b WHERE {_SHOWN} GROUP BY ALL", ["kind", "base"], 20, "kind"),
    _ranked("clusters", "SELECT * FROM cl", ["label", "base"], "CASE WHEN label = 'mixed' THEN 15 ELSE 20 END", "label"),
    *[_sec("term_rates", f"kind || '|{t}'", f"count(*) FILTER (contains(lower(title), {lit_sql(t)}))",
           f"FROM b WHERE kind IN ('ai-first', 'ai-support') GROUP BY kind HAVING count(*) FILTER (contains(lower(title), {lit_sql(t)})) > 0") for t in vocab.TITLE_TERMS],
    ctes=f""", b AS (SELECT *, {_base_sql('lower(title)')} AS base FROM d),
  bc AS (SELECT base, count(*) AS n, count(*) FILTER (kind = 'ai-first') AS a, count(*) FILTER (kind = 'ai-support') AS s FROM b GROUP BY 1),
  cl AS (SELECT base, n, CASE WHEN 100.0 * a / n >= 75 THEN 'ai-first' WHEN 100.0 * s / n >= 75 THEN 'ai-support' ELSE 'mixed' END AS label FROM bc WHERE n >= 3)"""))
def title_report(spark, sf):
    r = R.titles(staged(spark, sf))
    return stack(rows("top_titles", r["top_titles"], ["kind", "title", "rank"]), rows("base_titles", r["base_titles"], ["kind", "base", "rank"]),
                 rows("clusters", r["clusters"], ["label", "base", "rank"]), rows("term_rates", r["term_rates"], ["kind", "term"]))


def _either(kws, *cols):
    return "(" + " OR ".join(any_sql(c, kws) for c in cols) + ")"


_ROLE_SQL = "CASE " + " ".join(f"WHEN {_either(kws, 'lower(title)', 'body')} THEN {lit_sql(name)}" for name, kws in vocab.SUPPORT_ROLE_TAXONOMY) + " ELSE 'Other' END"
_SCORE_A = " + ".join(f"(CASE WHEN {_either([k], 'lower(title)', 'body', 'ucs')} THEN 1 ELSE 0 END)" for k in vocab.RESEARCH_INDICATORS)
_SCORE_B = " + ".join(f"(CASE WHEN {_either([k], 'body', 'ucs')} THEN 1 ELSE 0 END)" for k in vocab.APPLIED_INDICATORS)
_BODY = """, j AS (SELECT *, array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0), ' ') AS body,
  array_to_string(list_filter(string_split(text, '. '), lambda x: length(trim(x)) > 0), ' ') AS ucs FROM d)"""


@query("report_support_roles", _sql(
    _sec("categories", _ROLE_SQL, "count(*)", "FROM j WHERE kind = 'ai-support' GROUP BY 2"),
    _sec("research_split", "CASE WHEN reason <> 'none' THEN 'research' ELSE 'applied' END", "count(*)", "FROM rs GROUP BY 2"),
    _sec("research_reasons", "reason", "count(*)", "FROM rs GROUP BY 2"),
    _sec("research_by_type", "kind", "count(*)", "FROM rs WHERE reason <> 'none' GROUP BY 2"),
    ctes=_BODY + f""", sc AS (SELECT *, {_SCORE_A} AS a, {_SCORE_B} AS b FROM j),
  rs AS (SELECT kind, CASE WHEN {any_sql('lower(title)', vocab.RESEARCH_TITLE_WORDS)} THEN 'title' WHEN a > b AND a >= 2 THEN 'content' ELSE 'none' END AS reason FROM sc)"""))
def support_roles(spark, sf):
    r = R.support_roles(staged(spark, sf))
    return stack(rows("categories", r["categories"], ["category"]), rows("research_split", r["research_split"], ["role"]),
                 rows("research_reasons", r["research_reasons"], ["reason"]), rows("research_by_type", r["research_by_type"], ["kind"]))


_HAS = lambda terms: f"EXISTS (SELECT 1 FROM w WHERE w.doc_id = d.doc_id AND {any_sql('lower(skill)', [t.lower() for t in terms])})"
_N_CAT = lambda *cats: f"(SELECT count(*) FROM w WHERE w.doc_id = d.doc_id AND category IN ({', '.join(lit_sql(c) for c in cats)}))"
_SIX = "'web', 'cloud', 'ops', 'languages', 'databases', 'data'"


@query("report_skills", _sql(
    _sec("ml_any", "'any'", f"count(*) FILTER ({_HAS(vocab.ML_TERMS)})", "FROM d WHERE kind = 'ai-first'"),
    "SELECT * FROM (" + " UNION ALL ".join(_sec("ml_terms", lit_sql(t), f"count(*) FILTER ({_HAS([t])})", "FROM d WHERE kind = 'ai-first'") for t in vocab.ML_TERMS)
    + ") WHERE n > 0 ORDER BY n DESC, key LIMIT 15",
    _ranked("other_skills", f"SELECT category, skill, count(*) AS n FROM w JOIN d ON w.doc_id = d.doc_id WHERE kind = 'ai-first' AND category IN ({_SIX}) GROUP BY ALL",
            ["category", "skill"], 8, "category"),
    _sec("full_stack", "'frontend'", f"count(*) FILTER ({_HAS(vocab.FRONTEND_TERMS)})", "FROM d WHERE kind = 'ai-first'"),
    _sec("full_stack", "'backend'", f"count(*) FILTER ({_HAS(vocab.BACKEND_TERMS)})", "FROM d WHERE kind = 'ai-first'"),
    _sec("full_stack", "'both'", f"count(*) FILTER ({_HAS(vocab.FRONTEND_TERMS)} AND {_HAS(vocab.BACKEND_TERMS)})", "FROM d WHERE kind = 'ai-first'"),
    *[_sec("mixture", lit_sql(name), "count(*)", f"FROM m WHERE g > 0 AND {cond}") for name, cond in
      [("only_genai", "o = 0"), ("genai_ml", "ml > 0"), ("genai_web", "web > 0"), ("genai_ops", "ops > 0"), ("genai_any", "o > 0")]],
    ctes=f""", m AS (SELECT {_N_CAT('genai')} AS g, {_N_CAT('ml')} AS ml, {_N_CAT('web')} AS web, {_N_CAT('ops')} AS ops,
  {_N_CAT('ml', 'web', 'ops', 'cloud', 'data', 'databases')} AS o FROM d WHERE kind = 'ai-first')"""))
def skills(spark, sf):
    r = R.skills(staged(spark, sf))
    return stack(rows("ml_any", r["ml_any"], ["term"]), rows("ml_terms", r["ml_terms"], ["term"]),
                 rows("other_skills", r["other_skills"], ["category", "skill", "rank"]), rows("full_stack", r["full_stack"], ["name"]),
                 rows("mixture", r["mixture"], ["name"]))


_BUNDLE = "lower(title || ' ' || body || ' ' || ucs || ' ' || {} || ' ' || {})".format(
    *[f"coalesce((SELECT string_agg(lower(skill), ' ' ORDER BY pos) FROM w WHERE w.doc_id = j.doc_id AND category = '{c}'), '')" for c in ("genai", "ml")])
_DEEP = (f"({any_sql('lower(title)', vocab.FINETUNING_TITLE_WORDS)} OR "
         + " + ".join(f"len(regexp_extract_all(body, {lit_sql(k)}))" for k in vocab.FINETUNING_REPEATED)
         + f" >= 2 OR {any_sql('mention', vocab.FINETUNING_TECHNIQUES)})")


@query("report_finetuning", _sql(
    _sec("mention", "'fine_tuning'", f"count(*) FILTER ({any_sql('bundle', vocab.FINETUNING_KEYWORDS)})", "FROM k"),
    _sec("depth", f"CASE WHEN {any_sql('mention', vocab.FINETUNING_INDICATORS)} THEN CASE WHEN {_DEEP} THEN 'primary' ELSE 'secondary' END ELSE 'none' END",
         "count(*)", "FROM k GROUP BY 2"),
    _sec("use_case_categories", "category", "count(*)", f"""FROM (SELECT {first_match_sql(vocab.FINETUNING_TAXONOMY, 'lower(item)')} AS category FROM uses
      JOIN k ON uses.doc_id = k.doc_id WHERE {any_sql('bundle', vocab.FINETUNING_KEYWORDS)}) WHERE category IS NOT NULL GROUP BY 2"""),
    ctes=_ITEMS + _BODY + f""", k AS (SELECT *, lower(title || ' ' || body || ' ' || ucs) AS mention, {_BUNDLE} AS bundle FROM j WHERE kind = 'ai-first')"""))
def finetuning(spark, sf):
    r = R.finetuning(staged(spark, sf))
    return stack(rows("mention", r["mention"], ["name"]), rows("depth", r["depth"], ["depth"]),
                 rows("use_case_categories", r["use_case_categories"], ["category"]))


_COMPARED = [t for ts in vocab.COMPARED_SKILLS.values() for t in ts]


@query("report_support_skills", _sql(
    *[_sec("comparison", f"'{t}|{label}'", f"count(*) FILTER ({_HAS([t])})", f"FROM d WHERE kind = '{kind}'")
      for t in _COMPARED for label, kind in (("first", "ai-first"), ("support", "ai-support"))],
    _sec("genai_presence", f"CASE WHEN {_N_CAT('genai')} > 0 THEN 'true' ELSE 'false' END", "count(*)", "FROM d WHERE kind = 'ai-support' GROUP BY 2"),
    _top("genai_skills", "skill", "FROM w JOIN d ON w.doc_id = d.doc_id WHERE kind = 'ai-support' AND category = 'genai'", 15),
    *[_sec("entry_level", f"'{label}'", f"count(*) FILTER ({any_sql('lower(title)', vocab.ENTRY_LEVEL_WORDS)})", f"FROM d WHERE kind = '{kind}'")
      for label, kind in (("first", "ai-first"), ("support", "ai-support"))]))
def support_skills(spark, sf):
    r = R.support_skills(staged(spark, sf))

    def sides(section, df, keys):
        return [rows(section, df.withColumn("side", F.lit(side)), [*keys, "side"], f"n_{side}") for side in ("first", "support")]

    return stack(*sides("comparison", r["comparison"], ["metric"]), rows("genai_presence", r["genai_presence"], ["with_genai"]),
                 rows("genai_skills", r["genai_skills"], ["skill"]), *sides("entry_level", r["entry_level"], []))


def _items_sql(source, taxonomy, stop):
    words = ", ".join(lit_sql(w) for w in stop)
    return _sql(
        _sec("total", "''", "count(*)", f"FROM {source}"),
        _sec("categories", f"coalesce({first_match_sql(taxonomy, 'lower(item)')}, '(none)')", "count(*)", f"FROM {source} GROUP BY 2"),
        _sec("by_type", "CASE WHEN grouping(kind) = 1 THEN '(all)' ELSE kind END", "count(*)", f"FROM {source} GROUP BY GROUPING SETS ((kind), ())"),
        f"SELECT 'words' AS section, word AS key, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(item), '\\s+')) AS word FROM {source}) "
        f"WHERE length(word) > 3 AND word NOT IN ({words}) GROUP BY word ORDER BY n DESC, word LIMIT 30", ctes=_ITEMS)


def _item_sections(r):
    total = r["items"].agg(F.count(F.lit(1)).alias("n"))
    return stack(rows("total", total.withColumn("k", F.lit("")), ["k"]), rows("categories", r["categories"], ["category"]),
                 rows("categories", r["uncategorized"].withColumn("k", F.lit("(none)")), ["k"]), rows("by_type", r["by_type"], ["kind"]),
                 rows("words", r["words"], ["word"]))


@query("report_responsibilities", _items_sql("resp", vocab.RESPONSIBILITY_TAXONOMY, vocab.RESPONSIBILITY_STOP_WORDS))
def responsibilities(spark, sf):
    return _item_sections(R.responsibilities(staged(spark, sf)))


@query("report_use_cases", _items_sql("uses", vocab.USE_CASE_TAXONOMY, vocab.USE_CASE_STOP_WORDS))
def use_cases(spark, sf):
    return _item_sections(R.use_cases(staged(spark, sf)))


def cards(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("company"), F.col("p_type").alias("work_type"),
                                           F.when(F.col("p_size") > 25, "Senior level").otherwise("Mid level").alias("level"))
    link = F.concat(F.lit("https://board.example.com/job/"), F.col("p_partkey").cast("string")).alias("link")
    return titles(spark, sf).join(part, "p_partkey").select("p_partkey", "title", "company", "work_type", "level", link)


_CARDS_SQL = f"""WITH {TITLES_SQL}, c AS (SELECT t.p_partkey, title, p_brand AS company, p_type AS work_type,
  CASE WHEN p_size > 25 THEN 'Senior level' ELSE 'Mid level' END AS level, string_split_regex(trim(lower(title)), '\\s+') AS ws FROM titles t JOIN part p ON t.p_partkey = p.p_partkey)"""


@query("report_title_classes", _CARDS_SQL + f""", k AS (SELECT title, {CLASS_SQL} AS classification FROM c),
  s AS (SELECT classification, title, row_number() OVER (PARTITION BY classification ORDER BY title) AS rank FROM (SELECT DISTINCT classification, title FROM k))
SELECT 'classes' AS section, classification AS key, count(*) AS n FROM k GROUP BY 2 UNION ALL
SELECT 'samples', classification || '|' || title, rank FROM s WHERE rank <= CASE WHEN classification = 'other' THEN 20 ELSE 30 END""")
def title_classes(spark, sf):
    r = R.title_classes(cards(spark, sf))
    return stack(rows("classes", r["classes"], ["classification"]), rows("samples", r["samples"], ["classification", "title"], "rank"))


@query("report_explore_cards", _CARDS_SQL + r""", k AS (SELECT * FROM c WHERE company IS DISTINCT FROM 'Brand#3'),
  u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, company ORDER BY p_partkey) AS rn FROM k) WHERE rn = 1),
  e AS (SELECT * FROM u WHERE regexp_matches(lower(title), 'ai\s+engineer'))
SELECT * FROM (SELECT 'companies' AS section, company AS key, count(*) AS n FROM c GROUP BY company ORDER BY n DESC, company LIMIT 10)
UNION ALL SELECT 'first_link', company || '|https://board.example.com/job/' || min(p_partkey), 1 FROM c GROUP BY company
UNION ALL SELECT * FROM (SELECT 'title_company', title || ' ' || company, count(*) AS n FROM k GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5)
UNION ALL SELECT 'unique', '', count(*) FROM u UNION ALL SELECT 'engineers', '', count(*) FROM e
UNION ALL SELECT 'work_types', work_type, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'levels', level, count(*) FROM e GROUP BY 2""")
def explore_cards(spark, sf):
    r = R.explore_cards(cards(spark, sf), order="p_partkey", excluded_company="Brand#3")
    one = lambda name: rows(name, r[name].agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit("")), ["k"])
    return stack(rows("companies", r["companies"], ["company"]), rows("first_link", r["first_link"].withColumn("n", F.lit(1)), ["company", "link"]),
                 rows("title_company", r["title_company"], ["value"]), one("unique"), one("engineers"),
                 rows("work_types", r["work_types"], ["work_type"]), rows("levels", r["levels"], ["level"]))


@query("s13_run_report", f"""
SELECT o_orderstatus, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM orders)::DOUBLE AS pct, round(100.0 * count(*) / (SELECT count(*) FROM orders)::DOUBLE, 1) AS pct_shown
FROM orders GROUP BY 1""")
def run_report(spark, sf):
    from postloom.operators.counts import share_of_total, shown_percent, value_counts

    return shown_percent(share_of_total(value_counts(table(spark, sf, "orders"), "o_orderstatus")))


