"""Explicit schemas of every record the engine reads. Nothing is inferred."""

from pyspark.sql import types as T

from postloom import vocab

_S = T.StringType()
_STRINGS = T.ArrayType(_S)

CARD = T.StructType([T.StructField(name, _S) for name in vocab.CARD_COLUMNS])

EXTRACTED = T.StructType([
    T.StructField("job_id", _S), T.StructField("title", _S), T.StructField("company", _S),
    T.StructField("location", _S), T.StructField("work_type", _S), T.StructField("level", _S),
    T.StructField("skills", _STRINGS), T.StructField("company_size", _S),
    T.StructField("compensation", _S), T.StructField("description", _S),
    T.StructField("industries", _STRINGS), T.StructField("posted_date", _S),
    T.StructField("url", _S), T.StructField("source", _S),
])

SKILL_ITEM = T.StructType([T.StructField("name", _S), T.StructField("category", _S)])

FLAT_EXTRACTION = T.StructType([
    T.StructField("ai_type", _S), T.StructField("ai_type_reasoning", _S),
    T.StructField("company_stage", _S), T.StructField("company_focus", _S),
    T.StructField("responsibilities", _STRINGS), T.StructField("use_cases", _STRINGS),
    T.StructField("skills", T.ArrayType(SKILL_ITEM)),
    T.StructField("is_customer_facing", T.BooleanType()), T.StructField("is_management", T.BooleanType()),
])

SKILLS = T.StructType([T.StructField(c, _STRINGS) for c in vocab.SKILL_CATEGORIES])
AI_TYPE = T.StructType([T.StructField("type", _S), T.StructField("reasoning", _S)])

STRUCTURED = T.StructType([
    T.StructField("company", T.StructType([
        T.StructField("name", _S), T.StructField("stage", _S), T.StructField("focus", _S)])),
    T.StructField("position", T.StructType([
        T.StructField("title", _S), T.StructField("ai_type", AI_TYPE),
        T.StructField("responsibilities", _STRINGS), T.StructField("use_cases", _STRINGS),
        T.StructField("skills", SKILLS),
        T.StructField("is_customer_facing", T.BooleanType()), T.StructField("is_management", T.BooleanType())])),
    T.StructField("meta", T.StructType([T.StructField("job_id", _S), T.StructField("extracted_at", _S)])),
])

# Both generations of the structured record in one schema: `normalize_postings` folds them into STRUCTURED.
EITHER_GENERATION = T.StructType([
    T.StructField("company", T.StructType([
        T.StructField("name", _S), T.StructField("stage", _S), T.StructField("focus", _S),
        T.StructField("use_cases", _S)])),
    T.StructField("position", STRUCTURED["position"].dataType),
    T.StructField("meta", STRUCTURED["meta"].dataType),
    T.StructField("job_id", _S), T.StructField("title", _S), T.StructField("ai_type", AI_TYPE),
    T.StructField("responsibilities", _S),
    T.StructField("skills", T.StructType([
        T.StructField("all", _STRINGS), T.StructField("by_category", SKILLS), T.StructField("count", T.IntegerType())])),
    T.StructField("is_customer_facing", T.BooleanType()), T.StructField("is_management", T.BooleanType()),
    T.StructField("extracted_at", _S),
])
