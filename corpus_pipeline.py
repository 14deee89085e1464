"""From raw documents to token files: the stages of a training-data pipeline, each an operator of `postloom.llm`.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of `docs`. Null and empty texts pass the filters like any other row; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.decontaminate import decontaminated
from postloom.llm.jaccard import one_per_group
from postloom.llm.mixing import mix, mixed_rows
from postloom.llm.quality import fit, score
from postloom.llm.queries import KEEP_AT, crc, table
from postloom.llm.token_file import read_tokens, write_tokens
from postloom.session import scratch_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject (score of at least 0.7)."""
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), F.coalesce(crc() % 4, F.lit(0)) != 2)
    return score(docs, model, name="_score").filter(F.col("_score") >= KEEP_AT).drop("_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % of their five-word shingles: the one with the smallest doc_id."""
    return one_per_group(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (80 % of its five-word shingles)."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: documents once per pass, in the order of the shards, cut where a source's share ends."""
    sizes, runs = mix(docs)
    return mixed_rows(docs, runs, sizes)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they say when read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return read_tokens(spark, write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", encode),
]

# The classifier, the permutations and the tokenizer have no SQL form; the tests compute each stage from the rows of the one before.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
