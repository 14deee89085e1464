"""The operators over the given tables, with the contracts' columns, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


CHAT_SQL = r"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ') AS safe,
  contains(text || '</turn>' || chr(10), '</turn>' || chr(10)) AND
  position('</turn>' || chr(10) IN text || '</turn>' || chr(10)) <= length(text) AS clash,
  length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# '), ':', '\:')) AS name FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(name + 6 + 8 + CASE WHEN clash THEN length(safe) + 1 ELSE length(text) END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""


@query("op8_chat_format", CHAT_SQL)
def chat_format(spark: SparkSession, sf: str) -> DataFrame:
    from postloom.llm.chat import format_chats, learned_text

    said = F.lit("\\### Assistant: </turn> ok")
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    chats = format_chats(given.unionByName(extra))
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(read, 256).alias("turns_sha256"),
        F.length(learned_text(chats)).cast("long").alias("loss_chars"), F.sha2(learned_text(chats), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op6_token_file")
def token_file(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from postloom.llm.token_file import read_tokens, write_tokens

    docs = table(spark, sf, "documents")
    return read_tokens(spark, write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))


@query("op1_mix_sources")
def mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    from postloom.llm.mixing import mix, words_taken

    return words_taken(*mix(table(spark, sf, "documents")))


def crc(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string"))


KEEP_AT = 0.7


@query("op2_quality_compression")
def quality_compression(spark: SparkSession, sf: str) -> DataFrame:
    from postloom.llm.quality import fit, score

    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf, "labels").select("doc_id", "quality"), F.coalesce(crc() % 4, F.lit(0)) != 2)
    return score(docs, model).select("doc_id", F.coalesce(crc() % 4 == 2, F.lit(False)).alias("held_out"), "score",
                                     F.when(F.col("score") >= KEEP_AT, 1).otherwise(0).alias("predicted"))


@query("op3_language_bytes")
def language_bytes(spark: SparkSession, sf: str) -> DataFrame:
    from postloom.llm.langid import fit, predict

    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    net = fit(docs, F.coalesce(crc() % 3, F.lit(0)) != 1)
    return predict(docs.select("doc_id", "text"), net).select(
        "doc_id", F.coalesce(crc() % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def shingle_sql(source: str, key: str, prefix: str = "") -> str:
    """CTEs `<p>w` (words), `<p>n` (whole rows) and `<p>s` (distinct five-word shingles, fewer words: the whole sequence)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""{prefix}w AS (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM {source}),
  {prefix}s AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [len(w) || ':' || array_to_string(w, ' ')] ELSE [] END) AS s FROM {prefix}w),
  {prefix}n AS (SELECT {key}, count(*) AS n FROM {prefix}s GROUP BY {key})"""


@query("op9_decontaminate", f"""
WITH {shingle_sql('documents', 'doc_id', 'd')}, {shingle_sql('benchmark', 'item_id', 'b')}
SELECT doc_id, item_id, n AS n_item, count(*) AS shared, count(*) / CAST(n AS DOUBLE) AS containment
FROM ds JOIN bs USING (s) JOIN bn USING (item_id) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n""")
def decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    from postloom.llm.decontaminate import contained_items

    return contained_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def span_text(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


@query("op5_pii_bootstrap")
def pii_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    from postloom.llm.pii import KINDS, find_pii

    found = find_pii(table(spark, sf, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


@query("op7_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    from postloom.llm.neighbours import nearest

    return nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op10_license_scan")
def license_scan(spark: SparkSession, sf: str) -> DataFrame:
    from postloom.llm.licenses import fit, scan_licenses

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return scan_licenses(docs, fit(docs))


@query("op4_jaccard_join", f"""
WITH RECURSIVE {shingle_sql('documents', 'doc_id', 'd')},
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM ds a JOIN ds b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN dn x ON x.doc_id = a.doc_id JOIN dn y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(dn.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN dn USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = d.doc_id""")
def jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    from postloom.llm.jaccard import classes

    return classes(table(spark, sf, "documents")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


@query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


def codebook_sql() -> str:
    """Six rounds as a chain of CTEs: `a<k>` the nearest entry of each part (distance * 16 + index), `e<k>` the codebooks by component."""
    near = """SELECT vec_id, p, min(16 * d + i) AS m FROM (SELECT vec_id, p, i, CAST(sum((x - e) * (x - e)) AS BIGINT) AS d
  FROM parts JOIN e{k} USING (p, j) GROUP BY vec_id, p, i) GROUP BY vec_id, p"""
    steps = []
    for k in range(6):
        steps.append(f"""a{k} AS MATERIALIZED ({near.format(k=k)}),
e{k + 1} AS MATERIALIZED (SELECT o.p, o.i, o.j, coalesce(n.e, o.e) AS e FROM e{k} o LEFT JOIN (
  SELECT p, i, j, CAST((s - ((s % c) + c) % c) // c AS BIGINT) AS e FROM (
    SELECT p, m % 16 AS i, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS c FROM parts JOIN a{k} USING (vec_id, p) GROUP BY p, m % 16, j)) n
  ON n.p = o.p AND n.i = o.i AND n.j = o.j)""")
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, (pos - 1) // 8 AS p, (pos - 1) % 8 AS j, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM kept)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM kept),
e0 AS MATERIALIZED (SELECT p, i, j, x AS e FROM parts JOIN first USING (vec_id) WHERE i < 16),
{", ".join(steps)},
a6 AS MATERIALIZED ({near.format(k=6)}),
coded AS (SELECT vec_id, string_agg(printf('%02x', m % 16), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a6 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(e AS VARCHAR), ',' ORDER BY p, i, j)) FROM e6) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


@query("op12_value_codes", codebook_sql())
def value_codes(spark: SparkSession, sf: str) -> DataFrame:
    from postloom.llm.value_codes import compress, with_label_error

    coded, books = compress(table(spark, sf, "embeddings"))
    return with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


PHRASE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS piece_no, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
w AS MATERIALIZED (SELECT lang, piece_no, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM numbered),
total AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
runs AS MATERIALIZED (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY piece_no ORDER BY i)),
f AS MATERIALIZED (SELECT lang, 1 AS k, w AS phrase, count(*) AS f, w, w AS w2, w AS w3 FROM runs GROUP BY lang, w HAVING count(*) >= 10
  UNION ALL SELECT lang, 2, w || ' ' || w2, count(*), w, w2, w2 FROM runs WHERE w2 IS NOT NULL GROUP BY lang, w, w2 HAVING count(*) >= 10
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*), w, w2, w3 FROM runs WHERE w3 IS NOT NULL GROUP BY lang, w, w2, w3 HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f AS a, w, w2, w3 FROM f WHERE k > 1),
parted AS (SELECT lang, k, phrase, a, 1 AS cut, w AS x, CASE WHEN k = 2 THEN w2 ELSE w2 || ' ' || w3 END AS y FROM c
  UNION ALL SELECT lang, k, phrase, a, 2, w || ' ' || w2, w3 FROM c WHERE k = 3),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, cut, x.f AS l, y.f AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM parted c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM c t WHERE t.lang = low.lang AND t.k > low.k AND 100 * t.a >= 50 * low.a
  AND (t.w || ' ' || t.w2 = low.phrase OR t.w2 || ' ' || t.w3 = low.phrase))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


@query("op13_collocations", PHRASE_SQL)
def phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    from postloom.llm.phrases import collocations

    return collocations(table(spark, sf, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# On the given pages: the marked article, its blocks divided by `p` and `h1` tags, three named references.
MAIN_TEXT_SQL = r"""
WITH inner_ AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS h FROM pages),
blocks AS (SELECT page_id, url, unnest(regexp_split_to_array(h, '</?(p|h1)>')) AS b, unnest(range(1, len(regexp_split_to_array(h, '</?(p|h1)>')) + 1)) AS i FROM inner_),
plain AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(replace(b, '<br>', ' '), '</?b>', '', 'g'),
  '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM blocks),
joined AS (SELECT page_id, url, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM plain WHERE t <> '' GROUP BY page_id, url)
SELECT p.page_id, p.url, coalesce(j.text, '') AS text, CAST(length(coalesce(j.text, '')) AS BIGINT) AS n_chars
FROM pages p LEFT JOIN joined j ON j.page_id = p.page_id AND j.url = p.url"""


@query("op11_main_text", MAIN_TEXT_SQL)
def main_text(spark: SparkSession, sf: str) -> DataFrame:
    from postloom.llm.site_templates import main_text

    return main_text(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")
