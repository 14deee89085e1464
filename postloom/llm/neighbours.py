"""Nearest neighbours by inner product with an adaptive scan of the dimensions.

Vectors get one more component so that all have the length of the longest: the nearest by distance is then the one with the
largest inner product. They are dealt to lists by centroids, and rotated at random, so a run of components is a fair sample of
the distance. A query scans the lists of its nearest centroids, as many more as it takes to hold enough candidates; in a list its distances grow block of columns by block, and
after each block a test drops the candidates whose partial distance, scaled up, lies beyond the k-th best by more than chance
allows. What is left is measured exactly, in double precision on the given vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import kept

FIT_ROWS = 8192      # vectors that the centroids are fitted on, the first by hash
MOST_LISTS = 4096
RECALL = 0.95        # of the sample's own neighbours, by which the number of probed lists is chosen
FIT_QUERIES = 256    # of the sample, for that choice
PART_ROWS = 8192     # rows of a list that one task scans; larger lists are split by hash
QUERY_ROWS = 8192    # queries that scan a part in one task; a list that more queries ask is copied once per so many of them
COLUMNS = 16
EPSILON = 2.1
FIRST = 128          # candidates of a part that are measured fully and give the first k-th best
CHUNK = 1024
TOGETHER = 32        # queries weighed at a time against a chunk


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, x: every row with an id whose vector takes part. Vectors null, empty, zero, with null or non-finite components take
    none, nor do those of another dimension than most (no inner product with the rest; ties: the larger dimension counts)."""
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("x", lambda c: c != 0))
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (top["d"] if top else 0))


def fit_sample(rows: DataFrame, n: int) -> np.ndarray:
    """At most FIT_ROWS of the `n` vectors, by a hash threshold that lets about so many through, so that tasks send no more than these."""
    place = F.pmod(F.xxhash64("vec_id", "row"), F.lit(1 << 40))
    most = int(min(1.0, 1.1 * FIT_ROWS / n) * (1 << 40))
    drawn = rows.filter(place < most).select("x", "vec_id", "row", place.alias("place"))
    return np.array([r["x"] for r in drawn.orderBy("place", "vec_id", "row").limit(FIT_ROWS).collect()])


def centroids(sample: np.ndarray, lists: int, *, seed: int = 5, turns: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(turns):
        near = (sample @ found.T * 2 - (found**2).sum(1)).argmax(1)
        sums, counts = np.zeros_like(found), np.bincount(near, minlength=lists)
        np.add.at(sums, near, sample)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def rotation(d: int, *, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def lengthened(x: np.ndarray, top: float) -> np.ndarray:
    """One more component: all vectors get the squared length `top`."""
    return np.concatenate((x, np.sqrt(np.maximum(0, top - (x**2).sum(1)))[:, None]), 1)


def scan(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, turned: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, turned_queries: np.ndarray,
         k: int):
    """The k nearest of a part, ids ascending, for each of a few queries, but the query's own row: (query, id, inner product), a row each.
    Blocks of candidates are weighed for all queries at once by their first columns; each later block of columns sees the pairs left."""
    d, none = turned.shape[1], np.zeros(0, np.int64)
    best_of, best_ids, best = none, none, np.zeros(0)
    # squared distance of the k-th best: |x|^2 + |q|^2 - 2 <x, q>, the same for all candidates up to the product
    lengths, kth = (turned[:1] ** 2).sum() + (turned_queries**2).sum(1), np.full(len(queries), -np.inf)
    e = min(d, COLUMNS)
    head, heads = turned[:, :e], turned_queries[:, :e]
    head_lengths, heads_lengths = (head**2).sum(1), (heads**2).sum(1)
    for first in [0, *range(FIRST, len(ids), CHUNK)]:
        behind = min(first + CHUNK if first else FIRST, len(ids))
        far = lengths - 2 * kth
        part = heads_lengths[:, None] + head_lengths[first:behind] - 2 * heads @ head[first:behind].T
        own, at = np.nonzero(part * d / e <= (far * (1 + (EPSILON / np.sqrt(e) if e < d else 1e-9)) ** 2)[:, None])
        part, at = part[own, at], at + first
        for c in range(e, d, COLUMNS):
            if not len(at):
                break
            f = min(d, c + COLUMNS)
            part = part + ((turned[at, c:f] - turned_queries[own, c:f]) ** 2).sum(1)
            go = part * d / f <= far[own] * (1 + (EPSILON / np.sqrt(f) if f < d else 1e-9)) ** 2
            own, at, part = own[go], at[go], part[go]
        other = rows[at] != query_rows[own]
        own, at = own[other], at[other]
        if not len(at):
            continue
        best_of, best_ids = np.concatenate((best_of, own)), np.concatenate((best_ids, ids[at]))
        best = np.concatenate((best, (x[at] * queries[own]).sum(1)))
        order = np.lexsort((best_ids, -best, best_of))
        starts = np.searchsorted(best_of[order], np.arange(len(queries) + 1))
        rank = np.arange(len(order)) - starts[best_of[order]]
        order = order[rank < k]
        best_of, best_ids, best = best_of[order], best_ids[order], best[order]
        full = rank[rank < k] == k - 1
        kth[best_of[full]] = best[full]
    return best_of, best_ids, best


def probes_needed(sample: np.ndarray, long_: np.ndarray, middle: np.ndarray, k: int) -> int:
    """The lists a query must probe to meet `RECALL` of its nearest, by brute force within the sample. In all data the
    neighbours lie nearer than in a sample, so this errs on the safe side."""
    q = sample[:FIT_QUERIES]
    own = (long_ @ middle.T * 2 - (middle**2).sum(1)).argmax(1)
    products = q @ sample.T
    products[np.arange(len(q)), np.arange(len(q))] = -np.inf
    true = np.argsort(-products, axis=1, kind="stable")[:, :min(k, max(1, len(sample) - 1))]
    near = np.argsort(-(q @ middle[:, :-1].T * 2 - (middle**2).sum(1)), axis=1, kind="stable")
    place = np.empty_like(near)
    np.put_along_axis(place, near, np.arange(len(middle))[None, :].repeat(len(q), 0), 1)
    return int(np.quantile(np.take_along_axis(place, own[true], 1), RECALL, method="higher")) + 1


def nearest(vectors: DataFrame, is_query, *, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query (condition on `vec_id`), nearest first, ties to the smaller id.

    A query's own row is no candidate. Rows of one id are rows of their own: each is found, and each is searched for. Fewer than `k`
    candidates in the whole table give fewer rows, an empty table none. Lists longer than PART_ROWS are split by hash of the row and
    so are their queries, so equal vectors, however many, are spread over tasks. A list goes only to the queries that ask it.
    """
    spark = vectors.sparkSession
    rows = kept(usable(vectors, vec_id, vector).select("vec_id", F.monotonically_increasing_id().alias("row"), "x"), "vectors")
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    n, top = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    sample = fit_sample(rows, n)
    lists = int(min(MOST_LISTS, len(sample), max(1, round(np.sqrt(n) / 4))))
    long_ = lengthened(sample, top)
    found = centroids(long_, lists)
    probes = probes_needed(sample, long_, found, k)
    middle = spark.sparkContext.broadcast(found)  # at most MOST_LISTS vectors

    def place(batches):
        for b in batches:
            more = lengthened(np.array(b["x"].tolist()), top)
            b["list"] = (more @ middle.value.T * 2 - (middle.value**2).sum(1)).argmax(1)
            yield b

    placed = kept(rows.mapInPandas(place, "vec_id long, row long, x array<double>, list long"), "vector-lists")
    held_by = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # at most MOST_LISTS rows
        held_by[r["list"]] = r["count"]

    def probed(b: pd.DataFrame) -> list[np.ndarray]:
        q = np.array(b["x"].tolist())
        near = np.argsort(-(q @ middle.value[:, :-1].T * 2 - (middle.value**2).sum(1)), axis=1, kind="stable")
        full = (np.cumsum(held_by[near], 1) < k + 1).sum(1) + 1  # lists that hold k rows besides the query
        return [row[:m] for row, m in zip(near, np.minimum(np.maximum(probes, full), lists))]

    def ask(batches):
        for b in batches:
            asked = probed(b)
            most = [len(a) for a in asked]
            yield pd.DataFrame({"query_id": np.repeat(b["vec_id"].to_numpy(), most), "query_row": np.repeat(b["row"].to_numpy(), most),
                                "list": np.concatenate(asked), "q": [v for v, m in zip(b["x"], most) for _ in range(m)]})

    def tally(batches):
        n = np.zeros(lists, np.int64)
        for b in batches:
            n += np.bincount(np.concatenate(probed(b)), minlength=lists)
        yield pd.DataFrame({"list": np.flatnonzero(n), "n": n[n > 0]})

    wanted = rows.filter(is_query)
    asks = wanted.mapInPandas(tally, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()  # at most MOST_LISTS rows
    cut = [(r["list"], int(-(-held_by[r["list"]] // PART_ROWS)), -(-r["n"] // QUERY_ROWS)) for r in asks if held_by[r["list"]]]
    sizes = F.broadcast(spark.createDataFrame(cut, "list long, parts long, blocks long"))

    def each(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    held = placed.join(sizes, "list").select("vec_id", "row", "x", "list", F.pmod(F.xxhash64("row"), F.col("parts")).alias("part"), each("blocks").alias("block"))
    asked = wanted.mapInPandas(ask, "query_id long, query_row long, list long, q array<double>").join(sizes, "list").select(
        "query_id", "query_row", "q", "list", each("parts").alias("part"), F.pmod(F.xxhash64("query_row"), F.col("blocks")).alias("block"))

    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            candidates = candidates.sort_values(["vec_id", "row"])
            ids, own, x = candidates["vec_id"].to_numpy(), candidates["row"].to_numpy(), np.array(candidates["x"].tolist())
            turn = rotation(x.shape[1] + 1)
            turned = lengthened(x, top) @ turn
            for first in range(0, len(queries), TOGETHER):
                some = queries.iloc[first:first + TOGETHER]
                q = np.array(some["q"].tolist(), float)
                of, found, score = scan(ids, own, x, turned, some["query_row"].to_numpy(), q, lengthened(q, 0.0) @ turn, k)
                out.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[of], "query_row": some["query_row"].to_numpy()[of], "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []})

    keys = ["list", "part", "block"]
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, query_row long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
