"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.session import give_back, scratch_path

# Rows of an Arrow batch are handed on in slices of about so many bytes of text.
PIECE_BYTES = 8 << 20


def kept(df: DataFrame, label: str) -> DataFrame:
    """`df` written as a table in the shared folder and read back: its work is done once, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    give_back()  # the driver's Python is a long-lived one too
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: int = PIECE_BYTES) -> Iterator[None]:
    """Jobs started inside hand Python batches of at most about `size` bytes, so that rows with long arrays do not add up."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def row_key(columns: list[str]):
    """Two 64-bit values that stand for the content of a row, nulls included."""
    quoted = [F.col(f"`{c}`") for c in columns]
    cells = [F.coalesce(c.cast("string"), F.lit("\0")) for c in quoted]
    marks = [c.isNull() for c in quoted]
    return F.xxhash64(*cells, *marks), F.xxhash64(F.lit(1), *marks, *cells)


def lean(run: Callable) -> Callable:
    """`run` over batches, with its memory given back at the end of the task."""
    def work(batches):
        yield from run(batches)
        give_back()
    return work


def text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of bounded text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = batch.column(column).cast(pa.large_binary())
        first, held = 0, 0
        for at, value in enumerate(pa.compute.binary_length(sizes).to_pylist()):
            if held and held + (value or 0) > PIECE_BYTES:
                yield batch.slice(first, at - first)
                first, held = at, 0
            held += value or 0
        if first < batch.num_rows:
            yield batch.slice(first)


def map_text(df: DataFrame, column: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """`mapInArrow` over slices of bounded text. `make` runs once a task; its result turns a slice into columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for piece in pieces(batches, column):
            columns = work(piece)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type
                 else c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(lean(run), schema)
