"""Coercion and validation of flat extractions, with reasons instead of exceptions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom import vocab
from postloom.functions.classify import classify_title
from postloom.functions.text import as_col, contains_any, let


@dataclass(frozen=True)
class Field:
    """A field rule: Spark type, whether it must be there, and its closed set of values if it has one."""

    type: str
    required: bool = False
    allowed: tuple[str, ...] | None = None


EXTRACTION_RULES = {
    "ai_type": Field("string", True, tuple(vocab.AI_TYPES)),
    "ai_type_reasoning": Field("string", True),
    "company_stage": Field("string"),
    "company_focus": Field("string"),
    "responsibilities": Field("array<string>"),
    "use_cases": Field("array<string>"),
    "skills": Field("array<struct<name:string,category:string>>"),
    "is_customer_facing": Field("boolean"),
    "is_management": Field("boolean"),
}


def _coerced(name: str, payload: Column) -> Column:
    """The field as a variant; text that is itself JSON counts as what it says."""
    raw = F.try_variant_get(payload, f"$.{name}", "variant")
    as_text = F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string"))
    return F.coalesce(F.try_parse_json(as_text), raw)


def coerce_and_validate(df: DataFrame, payload: Column | str, rules: dict[str, Field] = EXTRACTION_RULES) -> DataFrame:
    """Add one typed column per rule, `errors` (array of `reason:field`) and `status` (ok / quarantine)."""
    parsed = df.withColumn("_v", F.try_parse_json(as_col(payload)))
    parsed = parsed.withColumns({f"_f_{n}": _coerced(n, F.col("_v")) for n in rules})
    typed, problems = {}, [F.when(F.col("_v").isNull() | (F.schema_of_variant("_v").substr(1, 6) != "OBJECT"), F.lit("json:payload"))]
    for name, rule in rules.items():
        raw = F.col(f"_f_{name}")
        shape = F.schema_of_variant(raw)
        absent = raw.isNull() | (shape == "VOID")
        listed = rule.type.startswith("array")
        value = F.try_variant_get(raw, "$", rule.type)
        if rule.type == "string":
            value = F.when(shape == "STRING", value)
        typed[name] = value
        bad = ~absent & value.isNull()
        if rule.type == "array<string>":
            bad = bad | ~F.forall(F.coalesce(F.try_variant_get(raw, "$", "array<variant>"), F.array().cast("array<variant>")),
                                  lambda v: F.schema_of_variant(v) == "STRING")
        problems.append(F.when(F.col("_v").isNotNull() & F.lit(rule.required) & absent, F.lit(f"missing:{name}")))
        if rule.type == "array<struct<name:string,category:string>>":
            bad = bad | ~F.forall(F.coalesce(F.try_variant_get(raw, "$", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.forall(
                F.array(F.lit("$.name"), F.lit("$.category")), lambda p: F.coalesce(
                    F.schema_of_variant(F.try_variant_get(v, p, "variant")), F.lit("VOID")).isin("STRING", "VOID")))
        # a list may be left out, but not be an explicit null
        bad = ~absent & bad if not listed else (~absent & bad) | (raw.isNotNull() & (shape == "VOID"))
        problems.append(F.when(bad, F.lit(f"type:{name}")))
        if rule.allowed:
            problems.append(F.when(value.isNotNull() & ~value.isin(*rule.allowed), F.lit(f"value:{name}")))
        if name == "skills":
            problems.append(F.when(F.exists(value, lambda s: s.getField("name").isNull() | s.getField("category").isNull()
                                            | ~s.getField("category").isin(*vocab.SKILL_CATEGORIES)),
                                   F.lit("value:skills")))
    out = parsed.withColumns({**typed, "errors": F.array_compact(F.array(*problems))})
    out = out.withColumn("status", F.when(F.size("errors") == 0, "ok").otherwise("quarantine"))
    return out.drop("_v", *[f"_f_{n}" for n in rules])


def split_by_status(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, quarantine)."""
    return df.filter(F.col("status") == "ok").drop("errors", "status"), df.filter(F.col("status") != "ok")


class Extractor(Protocol):
    """A pluggable step from posting text to flat-extraction JSON, called once per Arrow batch."""

    def __call__(self, batch: pd.DataFrame) -> pd.Series: ...


def extract_with(df: DataFrame, extractor: Extractor, *, out: str = "payload", attempts: int = 3) -> DataFrame:
    """Run an external extractor over (title, company, description) batches.

    Adds `out` (the JSON, or null), `<out>_error` (type and message of the last failure, or null) and `<out>_attempts`.
    A batch that fails is tried again row by row, each row up to `attempts` times (the batch call counts as one), so a
    failing row costs neither the job nor its neighbours.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType()),
                           T.StructField(f"{out}_attempts", T.IntegerType())])

    def one(row: pd.DataFrame, error: Exception) -> tuple[str | None, str | None, int]:
        for tried in range(2, attempts + 1):
            try:
                return extractor(row).iloc[0], None, tried
            except Exception as again:  # noqa: BLE001, any failure is a result here
                error = again
        return None, f"{type(error).__name__}: {error}", attempts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                results = [(payload, None, 1) for payload in extractor(batch)]
            except Exception as error:  # noqa: BLE001
                results = [one(batch.iloc[[i]], error) for i in range(len(batch))]
            payloads, errors, tries = zip(*results) if results else ((), (), ())
            yield batch.assign(**{out: list(payloads), f"{out}_error": list(errors), f"{out}_attempts": list(tries)})

    return df.mapInPandas(run, schema)


def rule_extraction(title: Column | str, text: Column | str) -> Column:
    """The built-in extractor: the title class and the taxonomy hits as flat-extraction JSON. Stays in the JVM."""
    kinds = F.create_map(*[F.lit(x) for x in ("ai_first", "ai-first", "ai_support", "ai-support", "other", "unknown")])
    # a lambda of one argument: with F.trim itself the line's number would be the characters to trim
    lines = F.filter(F.transform(F.split(as_col(text), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    skills = let([F.lower(as_col(text))], lambda low: F.array_compact(F.array(*[
        F.when(F.contains(low, F.lit(term.lower())), F.struct(F.lit(term).alias("name"), F.lit(category).alias("category")))
        for category, terms in vocab.COMPARED_SKILLS.items() for term in terms])))
    return F.to_json(F.struct(
        F.element_at(kinds, classify_title(title)).alias("ai_type"),
        F.lit("title rules").alias("ai_type_reasoning"),
        lines.alias("responsibilities"), F.array().cast("array<string>").alias("use_cases"),
        skills.alias("skills"), contains_any(text, ["customer", "client"]).alias("is_customer_facing"),
        contains_any(title, ["manager", "director", "lead"]).alias("is_management")))
