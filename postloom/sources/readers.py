"""Readers with explicit schemas. Readers of fallible formats return (ok, bad)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom import schemas
from postloom.functions.access import items
from postloom.functions.text import strip
from postloom.operators.nesting import normalize_postings


def _wrong_types(value: object, kind: T.DataType, path: str) -> Iterator[str]:
    """Paths whose value is not of the schema's kind; absent and null fit everywhere, text takes any scalar."""
    if value is None:
        return
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            yield path
            return
        for field in kind:
            yield from _wrong_types(value.get(field.name), field.dataType, f"{path}.{field.name}" if path else field.name)
    elif isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            yield path
            return
        for item in value:
            yield from _wrong_types(item, kind.elementType, f"{path}[]")
    elif isinstance(kind, T.BooleanType):
        if not isinstance(value, bool):
            yield path
    elif isinstance(kind, T.IntegralType):
        if isinstance(value, bool) or not isinstance(value, int):
            yield path
    elif isinstance(value, (dict, list)):
        yield path


def yaml_record(text: str | None, schema: T.StructType | None) -> tuple[str | None, str | None]:
    """JSON text of a YAML record, or the reason why there is none: a file ends in exactly one of the two, whatever it holds."""
    import yaml

    try:
        record = yaml.load(text or "", getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        if not isinstance(record, dict):
            return None, "not a record"
        wrong = sorted(set(_wrong_types(record, schema, ""))) if schema is not None else []
        if wrong:
            return None, "type:" + ",".join(wrong)
        return json.dumps(record, default=str, ensure_ascii=False), None
    except yaml.YAMLError as error:
        return None, (str(error).splitlines() or ["YAMLError"])[0]
    except Exception as error:  # noqa: BLE001  an odd date, key, number, alias or depth must not end the job
        return None, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}".strip()


def _yaml_to_json(schema: T.StructType):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [yaml_record(v, schema) for v in batch["value"]]
            yield pd.DataFrame({"file_name": batch["file_name"], "json": [p[0] for p in parsed], "error": [p[1] for p in parsed]})

    return run


def yaml_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (file_name, value)."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_name").alias("file_name"), "value"))


def parse_yaml(files: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """One record per (file_name, value) row: (file_name plus the schema's columns, file_name plus error)."""
    # Parsing takes a hundred times longer than reading: a few small files of rows would be a few long tasks. AQE keeps a number that is given.
    dealt = files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism)
    parsed = dealt.mapInPandas(_yaml_to_json(schema), "file_name string, json string, error string")
    ok = (parsed.filter(F.col("error").isNull())
          .select("file_name", F.from_json("json", schema).alias("r")).select("file_name", "r.*"))
    return ok, parsed.filter(F.col("error").isNotNull()).select("file_name", "error")


def structured_records(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok, bad = parse_yaml(files, schemas.EITHER_GENERATION)
    return normalize_postings(ok), bad


def extracted_records(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok, bad = parse_yaml(files, schemas.EXTRACTED)
    text = [f.name for f in schemas.EXTRACTED if isinstance(f.dataType, T.StringType)]
    lists = [f.name for f in schemas.EXTRACTED if isinstance(f.dataType, T.ArrayType)]
    ok = ok.fillna("", subset=text).withColumns({c: items(c) for c in lists})
    return ok, bad


def read_structured(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Structured postings of either generation as the live record, and the files that do not parse."""
    return structured_records(yaml_files(spark, path))


def read_extracted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Extracted postings (`job_id` is text, absent text fields are empty), and the files that do not parse."""
    return extracted_records(yaml_files(spark, path))


def read_cards_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.CARD, link: str = "link") -> DataFrame:
    """Listing cards with header; rows without a link are left out."""
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
    return rows.filter(F.length(F.coalesce(F.col(link), F.lit(""))) > 0)


def read_cards_json(spark: SparkSession, paths: list[str], schema: T.StructType | str = schemas.CARD, *, multi_line: bool = True) -> DataFrame:
    """A listed set of files, arrays of objects (`multi_line`) or JSON lines; missing files are passed over."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    conf, found = spark._jsc.hadoopConfiguration(), []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).globStatus(place):
            found.append(path)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(found, multiLine=multi_line).select(*schema.names)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw HTML, one document per file: (file_name, html). A parquet path is read as a table of pages."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("html")))


def parse_queue(lines: DataFrame, line: str = "value") -> DataFrame:
    """`url` or `url|error` lines, split at the first bar."""
    text = strip(line)
    at = F.instr(text, "|")
    return lines.filter(F.length(text) > 0).select(
        F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text).alias("url"),
        F.when(at > 0, F.substr(text, at + 1)).alias("error"))


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return parse_queue(spark.read.text(path))


def parse_listing(blocks: DataFrame, block: str = "value") -> DataFrame:
    """Markdown listing records: `### n. title` and `**Key:** value` lines."""
    text = F.col(block)

    def value(key: str):
        return F.nullif(strip(F.regexp_extract(text, rf"(?m)^\*\*{key}:\*\*[ \t]*(.*)$", 1)), F.lit(""))

    head = r"(?m)^###\s+(\d+)\.\s+(.*)$"
    return blocks.filter(text.rlike(head)).select(
        F.regexp_extract(text, head, 1).cast("int").alias("n"), strip(F.regexp_extract(text, head, 2)).alias("title"),
        value("Company").alias("company"), value("Location").alias("location"),
        value("Date Posted").alias("date_posted"), value("Source").alias("source"), value("Link").alias("link"))


def read_markdown_listing(spark: SparkSession, path: str) -> DataFrame:
    """Records divided by `---` lines; the file is split while it is read."""
    return parse_listing(spark.read.option("lineSep", "\n---\n").text(path))

