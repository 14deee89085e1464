"""Table functions: many rows from the rows of a partition."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import LongType, StringType, StructType

HELD = 1 << 16  # distinct words a partition holds at a time; then their counts go out and it starts anew
_WS = re.compile(r"[ \t\n\x0b\f\r]+")


@udtf
class Tokenize:
    """`tokenize(TABLE(rows) PARTITION BY …, text => 'text', keep => 'lang', longer_than => 3)`: (keep, word, n) partial counts of the lower-cased words.

    A partition gives a word once per HELD distinct words, so its memory is bounded; sum `n` for the totals. The partition columns
    must hold `keep`. Null and empty texts have no words.
    """

    def __init__(self) -> None:
        self.n: Counter[str] = Counter()
        self.kept = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, keep: AnalyzeArgument, longer_than: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        for name in (text.value, keep.value):
            if name not in rows.dataType.fieldNames():
                raise ValueError(f"no column {name}")
        schema = StructType().add(keep.value, rows.dataType[keep.value].dataType).add("word", StringType()).add("n", LongType())
        return AnalyzeResult(schema=schema)

    def eval(self, rows, text: str, keep: str, longer_than: int):
        self.kept = rows[keep]
        self.n.update(w for w in _WS.split((rows[text] or "").lower()) if len(w) > longer_than)
        if len(self.n) > HELD:
            yield from self.terminate()

    def terminate(self):
        for word, n in self.n.items():
            yield self.kept, word, n
        self.n = Counter()


def register(spark: SparkSession) -> None:
    """Make `tokenize` known to SQL."""
    spark.udtf.register("tokenize", Tokenize)


def words_by(df: DataFrame, text: str, by: str, *, longer_than: int = 3, parts: int = 64) -> DataFrame:
    """by, word, n: word counts per value of `by`. A value's rows are dealt over `parts` partitions, so a hot value is no hot task."""
    dealt = df.select(F.col(by).alias(by), F.col(text).alias(text)).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    counted = Tokenize(dealt.asTable().partitionBy(by, "_part"), F.lit(text), F.lit(by), F.lit(longer_than))
    return counted.groupBy(by, "word").agg(F.sum("n").alias("n"))
