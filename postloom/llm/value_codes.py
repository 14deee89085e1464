"""Vector codes by per-dimension value dictionaries: integer product quantisation, exact at every step.

Component x is the integer floor(scale * x); a vector is cut into `parts` consecutive parts (component j of d belongs to the
part p with p * d // parts <= j < (p + 1) * d // parts). A part's codebook starts as that part of the first vectors by
(vec_id, vector) and is refined in rounds: nearest entry (squared distance, ties to the lower index), then the floor of the mean.

The vectors are read once and written as blocks. A block keeps, for each dimension, the dictionary of its distinct
integers and every row's position in it. A round tabulates, per dimension, the squared differences of the dictionary to all
entries; the distances of a part are gathers from these tables by position, added up. The sums for new entries come from
counts per (dictionary value, entry), so they are products of small integers too.

A round ships the codebooks (entries x dimensions) to the tasks and gets one row per (part, entry) and task back, added up by
Spark; nothing else passes the driver. Blocks hold at most `BLOCK_VALUES` components.

Where squared distances could pass 64 bits, the same code runs on Python integers; an `error` that no long can hold is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import kept, lean
from postloom.operators.joins import MAX_BROADCAST_ROWS

BLOCK_VALUES = 1 << 19
LONGEST = (1 << 63) - 1


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite components only."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(vector).isNotNull()).filter(~odd)


def whole(values: np.ndarray, scale: int, exact: bool) -> np.ndarray:
    """The integers behind quantised values (floor(scale * x) / scale): int64, or Python integers where they could pass it."""
    return np.array([int(v * scale) if abs(v) < 1e15 else int(v) * scale for v in values.tolist()], object) if exact else (
        values * scale).astype(np.int64)


def bounds(dims: int, parts: int) -> list[tuple[int, int]]:
    return [(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]


def _blocks(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, label (arrays, one entry a row), most, values, codes: per dimension its distinct values and each row's place."""
    label = rows.schema["label"].dataType.simpleString()
    id_ = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id array<{id_}>, label array<{label}>, most double, values array<array<double>>, codes array<binary>"
    size = min(1 << 16, max(1, BLOCK_VALUES // max(1, dims)))  # a place fits two bytes

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = batch.column(2)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
        with np.errstate(over="ignore"):
            scaled = np.floor(flat * scale) / scale
        scaled = np.where(np.isfinite(scaled), scaled, flat)  # so large that x is its own floor
        values, codes = [], []
        for j in range(dims):
            found, places = np.unique(scaled[:, j], return_inverse=True)
            values.append(found + 0.0)
            codes.append(places.astype("<u2").tobytes())
        one = lambda column: pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), column)
        return pa.RecordBatch.from_arrays(
            [one(batch.column(0)), one(batch.column(1)), pa.array([float(np.abs(scaled).max(initial=0.0))]),
             pa.array([values], pa.list_(pa.list_(pa.float64()))), pa.array([codes], pa.list_(pa.binary()))],
            ["vec_id", "label", "most", "values", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = batch.slice(at, size - n)
                held.append(take)
                at, n = at + take.num_rows, n + take.num_rows
                if n == size:
                    yield pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.mapInArrow(lean(run), schema)


class Codebooks:
    """entries[p][i]: the integers of entry i of part p."""

    def __init__(self, entries: list[list[list[int]]], cut: list[tuple[int, int]], scale: int, exact: bool):
        self.entries, self.cut, self.scale, self.exact = entries, cut, scale, exact

    def nearest(self, values: list, codes: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """Per part: its number, each row's nearest entry and distance, and (dictionary, places) of its dimensions."""
        kind = object if self.exact else np.int64
        rows = len(codes[0]) if codes else 0
        for p, (a, b) in enumerate(self.cut):
            entries = np.array(self.entries[p], kind).reshape(len(self.entries[p]), b - a)
            total, dictionaries = np.zeros((rows, len(entries)), kind), []
            for j in range(a, b):
                dictionary = whole(values[j], self.scale, self.exact)
                table = (dictionary[:, None] - entries[None, :, j - a]) ** 2
                total += table[codes[j]]
                dictionaries.append((dictionary, codes[j]))
            best = total.argmin(axis=1)
            yield p, best, total[np.arange(rows), best], dictionaries

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def _read(batch: pa.RecordBatch, at: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    values = [v.values.to_numpy(zero_copy_only=False) for v in batch.column("values")[at].values]
    return values, [np.frombuffer(c, "<u2") for c in batch.column("codes")[at].as_py()]


def _refined(blocks: DataFrame, books: Codebooks) -> list[list[list[int]]]:
    """One round: the entries after every part went to its nearest one. Sums travel as decimal text, which has no limit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                for p, best, _, dictionaries in books.nearest(*_read(batch, at)):
                    n = len(books.entries[p])
                    counts = np.bincount(best, minlength=n)
                    columns = [dictionary @ np.bincount(places.astype(np.int64) * n + best, minlength=len(dictionary) * n)
                               .reshape(len(dictionary), n).astype(dictionary.dtype) for dictionary, places in dictionaries]
                    for i in np.flatnonzero(counts).tolist():
                        own = sums.setdefault((p, i), [0, [0] * len(columns)])
                        own[0] += int(counts[i])
                        own[1] = [x + int(c[i]) for x, c in zip(own[1], columns)]
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in sums], pa.int32()), pa.array([i for _, i in sums], pa.int32()),
                 pa.array([n for n, _ in sums.values()], pa.int64()),
                 pa.array([[str(x) for x in v] for _, v in sums.values()], pa.list_(pa.string()))], ["p", "i", "n", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = [sum(map(int, x)) for x in zip(*rows["sums"])]
        return pd.DataFrame({"p": rows["p"][:1], "i": rows["i"][:1], "n": [int(rows["n"].sum())], "sums": [[str(x) for x in total]]})

    schema = "p int, i int, n long, sums array<string>"
    entries = [[list(e) for e in part] for part in books.entries]
    for r in blocks.select("values", "codes").mapInArrow(lean(run), schema).groupBy("p", "i").applyInPandas(add, schema).collect():  # parts x entries rows
        entries[r["p"]][r["i"]] = [int(s) // r["n"] for s in r["sums"]]
    return entries


def compress(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8,
             entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code, error per usable row, and the codebooks. `code` has two hex digits per part.

    Null vectors and those that hold null or non-finite components are dropped; an empty table gives no rows and no codebooks.
    Repeated rows and equal ids are rows of their own; a null id counts as the largest. With fewer than `entries` rows the codebooks
    are shorter. Vectors of another length than that of the smallest id have no parts in common with the others: their code and error are
    null. A vector without components has distance 0. Other columns, whatever their names, are not read. `entries` is at most 256.
    """
    rows = usable(vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")), "v")
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    # ids first: of every partition only `entries` ids, not vectors, meet
    ids = [r[0] for r in rows.select("vec_id").orderBy(order[0]).limit(entries).collect()]
    if not ids:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")).limit(0), None
    first = rows.filter(F.lit(True) if ids[-1] is None else F.col("vec_id") <= ids[-1])
    dims = len(first.orderBy(*order).limit(1).collect()[0]["v"])
    first = [r["v"] for r in first.filter(F.size("v") == dims).orderBy(*order).limit(entries).collect()]
    alike = rows.filter(F.size("v") == dims)
    if len(first) < len(ids):  # other lengths stand among the smallest ids
        ids = [r[0] for r in alike.select("vec_id").orderBy(order[0]).limit(entries).collect()]
        first = [r["v"] for r in alike.filter(F.lit(True) if ids[-1] is None else F.col("vec_id") <= ids[-1]).orderBy(*order).limit(entries).collect()]

    blocks = kept(_blocks(alike, dims, scale), "blocks")
    most = blocks.agg(F.max("most")).first()[0] * scale
    exact = not (2 * most + 2) ** 2 * max(1, dims) < 2 ** 62
    cut = bounds(dims, parts)
    with np.errstate(over="ignore"):
        start = [np.where(np.isfinite(q := np.floor(np.array(v) * scale) / scale), q, np.array(v)) for v in first]
    start = [[int(x) for x in whole(q, scale, exact)] for q in start]
    books = Codebooks([[v[a:b] for v in start] for a, b in cut], cut, scale, exact)
    for _ in range(rounds):
        books = Codebooks(_refined(blocks, books), cut, scale, exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids_, labels = batch.column("vec_id")[at].values, batch.column("label")[at].values
                codes = np.zeros((len(ids_), parts), np.uint8)
                error = np.zeros(len(ids_), object if exact else np.int64)
                values, places = _read(batch, at)
                if dims:
                    for p, best, distance, _ in books.nearest(values, places):
                        codes[:, p] = best
                        error += distance
                digits = codes.tobytes().hex()
                texts = [digits[k:k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
                errors = pa.array([e if e <= LONGEST else None for e in error.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids_, labels, pa.array(texts), errors], ["vec_id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    coded = blocks.mapInArrow(lean(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    other = rows.filter(F.size("v") != dims).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(other), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """`label_error` added: the errors summed over rows of equal label, nulls together; null where no long holds the sum.

    Labels are summed first, so a hot label is one row; the sums go back by broadcast if they are few, else by a join whose hot
    partitions AQE splits."""
    coded = kept(coded, "codes")
    sums = kept(coded.groupBy(F.col("label").alias("_of")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    small = F.broadcast(sums) if sums.count() <= MAX_BROADCAST_ROWS else sums
    return coded.join(small, F.col("label").eqNullSafe(F.col("_of")), "left").drop("_of")
