"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is a line of words: its documents in an order given by a keyed hash, one behind the other. The line is cut
into blocks of `BLOCK` words (the last one shorter). A source whose target is t words gives exactly round(t) of them: whole
passes over its line and then a part of one more, block after block in a keyed permutation of the pass (the short block last),
the last block only as far as needed. The drawn blocks of a source are its quota.

The tree splits the vector of quotas among the output shards: a node that stands for s shards halves them and draws, source
by source, how many blocks go left: hypergeometric given what is left of the node and of its left half, drawn by one method at
every size. The leaves hold exact counts, and a shard takes consecutive draws of every source: disjoint permuted blocks. Inside a shard the blocks are
shuffled by a keyed hash.

Only word counts travel; one row per source, per shard and source, and per block is all that is gathered. The order inside
a source is a prefix sum over hash buckets, so a hot source is many small windows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import kept, row_key

BLOCK = 16_384
SHARD_WORDS = 1 << 22
BUCKET_ROWS = 2048
FANOUT = 64
SEED = 20_240_601
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: list[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, size, target: sources by code point, null last, weigh `weights` in turn and share `share` of all sizes; none
    is above `most` times its size, the excess goes to the others by weight until none is above.

    In the order of most * size / weight the full sources are a prefix; the level of the others is what remains by weight.
    """
    line = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(line) - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy(most * F.col("size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumns({
        "level": (share * F.sum("size").over(every) - most * F.coalesce(F.sum("size").over(before), F.lit(0))) / F.sum("weight").over(after),
        "brim": most * F.col("size") / F.col("weight")})
    open_ = F.min(F.when(F.col("level") < F.col("brim"), F.struct("brim", F.col("source").isNull(), "source", "level"))).over(every)["level"]
    s = s.withColumn("open", open_)
    return s.select("source", "size", F.least(most * F.col("size").cast("double"), F.coalesce(
        F.col("weight") * F.col("open"), F.lit(math.inf))).alias("target"))


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without the loss of digits where both are close."""
    if x == 0:
        return mean
    gap = (x - mean) / (x + mean)
    if abs(gap) > 0.1:
        return x * math.log(x / mean) + mean - x
    total, power, k = (x - mean) * gap, 2 * x * gap, 0
    while True:
        power *= gap * gap
        k += 1
        grown = total + power / (2 * k + 1)
        if grown == total:
            return total
        total = grown


def _stirling_rest(n: float) -> float:
    """log n! less Stirling's (n + 1/2) log n - n + log(2 pi) / 2."""
    if n <= 15:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    if x in (0, n):
        return n * math.log(q if x == 0 else p) if n else 0.0
    return (_stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
            + 0.5 * math.log(n / (2 * math.pi * x * (n - x))))


def log_chance(x: int, own: int, others: int, drawn: int) -> float:
    """Logarithm of the hypergeometric chance of x of `own` among `drawn` of own + others, precise at any size (saddle point form)."""
    if x < max(0, drawn - others) or x > min(own, drawn):
        return -math.inf
    every = own + others
    p, q = drawn / every, (every - drawn) / every
    return _log_binomial(x, own, p, q) + _log_binomial(drawn - x, others, p, q) - _log_binomial(drawn, every, p, q)


def hypergeometric(own: int, others: int, drawn: int, rng: np.random.Generator) -> int:
    """How many of `own` are among `drawn` of own + others: rejection for log-concave chances from their mode, alike at every size."""
    if not own or not drawn:
        return 0
    if drawn == own + others or not others:
        return min(own, drawn)
    mode = (own + 1) * (drawn + 1) // (own + others + 2)
    top = log_chance(mode, own, others, drawn)
    peak = math.exp(top)
    wide = 1 + peak / 2
    while True:
        far = rng.random() * wide / peak if rng.random() <= wide / (1 + wide) else (wide + rng.exponential()) / peak
        x = mode + (round(far) if rng.random() < 0.5 else -round(far))
        if math.log(1 - rng.random()) + min(0.0, wide - peak * far) <= log_chance(x, own, others, drawn) - top:
            return x


def split(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of quotas for the left and the right half of `shards` shards, exact by source; each half gets its share of blocks."""
    rest = int(quota.sum())
    need, left = rest * (shards // 2) // shards, np.zeros_like(quota)
    for i, own in enumerate(map(int, quota)):
        left[i] = hypergeometric(own, rest - own, need, rng)
        need -= int(left[i])
        rest -= own
    return np.stack([left, quota - left])


def _descent(seed: int, stop: int):
    return lambda node: _descend(node, seed, stop)


def _descend(node: pd.DataFrame, seed: int, stop: int) -> pd.DataFrame:
    """The node's descendants that stand for at most `stop` shards."""
    node = node.sort_values("source", na_position="last")
    work, out = [(int(node["first"].iloc[0]), int(node["shards"].iloc[0]), node["quota"].to_numpy(np.int64))], []
    while work:
        first, shards, quota = work.pop()
        if shards <= stop:
            some = (quota > 0) | (first == 0)  # sources that give nothing go no further down; the first shard names them all
            out.append(pd.DataFrame({"source": node["source"].to_numpy()[some], "first": first, "shards": shards, "quota": quota[some]}))
            continue
        halves = split(quota, shards, np.random.default_rng([seed, first, shards]))
        work += [(first, shards // 2, halves[0]), (first + shards // 2, shards - shards // 2, halves[1])]
    return pd.concat(out)


def splitting_tree(quotas: DataFrame, shards: int, *, seed: int = SEED) -> DataFrame:
    """source, shard, quota from (source, quota): the tree, `FANOUT` leaves of a node at a time; a group has one row per source."""
    schema = "source string, first long, shards long, quota long"
    nodes = quotas.select("source", F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("shards"), "quota")
    left = shards
    while left > 1:
        left = max(1, math.ceil(left / FANOUT))
        nodes = nodes.groupBy("first").applyInPandas(_descent(seed, left), schema)
    return nodes.select("source", F.col("first").alias("shard"), "quota")


def permuted(rank: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 at `rank`, row by row: a Feistel network that is walked until it is inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = rank.astype(np.uint64), np.ones(len(rank), bool)
    while open_.any():
        left, right = out[open_] >> half[open_], out[open_] & low[open_]
        for turn in range(4):
            f = (right + np.uint64(turn) + key[open_]) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, (left ^ (f >> np.uint64(32))) & low[open_]
        out[open_] = (left << half[open_]) | right
        open_ = out >= n.astype(np.uint64)
    return out.astype(np.int64)


def _blocks_of_draws(batches):
    for b in batches:
        full = b["full"].to_numpy(np.int64)
        turn, rank = b["draw"].to_numpy(np.int64) // b["blocks"].to_numpy(np.int64), b["draw"].to_numpy(np.int64) % b["blocks"].to_numpy(np.int64)
        block = rank.copy()
        inside = rank < full
        key = b["salt"].to_numpy(np.int64).astype(np.uint64) + turn.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        if inside.any():
            block[inside] = permuted(rank[inside], full[inside], key[inside])
        yield pd.DataFrame({"source": b["source"], "shard": b["shard"], "turn": turn, "block": block, "words": b["words"]})


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", shard_words: int = SHARD_WORDS,
        block: int = BLOCK, weights: list[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = SEED):
    """(sizes, runs).

    sizes: k1, k2, doc_id, source, size, copies, source_size, target: one row per distinct row; all columns tell rows apart, rows
    equal in all are one with their number in `copies` (their words stand behind each other in the line). Columns may have any name.
    runs: k1, k2, shard, place, turn, word_from, word_to: the words the mix takes, shard by shard in the order of place; word
    positions count through the copies. A run lies in one block. Null or empty text, or a source without words: nothing to take.
    An empty table gives empty results. Fixed seed and data: the same mix.
    """
    k1, k2 = row_key(docs.columns)
    entries = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                          n_words(F.col(text)).alias("size"))
    entries = kept(entries.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    held = entries.withColumn("span", F.col("size") * F.col("copies"))
    per_source = held.groupBy("source").agg(F.sum("span").alias("size"), F.count(F.lit(1)).alias("entries"))
    plan = targets(per_source.select("source", "size"), weights=weights, share=share, most=most)
    total = plan.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, math.ceil(total / shard_words))
    plan = plan.join(per_source.drop("size"), plan["source"].eqNullSafe(per_source["source"])).drop(per_source["source"])
    take, size = F.round("target").cast("long"), F.col("size")
    full = (size / block).cast("long")
    blocks = F.when(size > full * block, full + 1).otherwise(full)
    rest = F.col("take") % size
    plan = plan.withColumns({"take": take, "full": full, "blocks": blocks, "buckets": F.ceil(F.col("entries") / BUCKET_ROWS),
                             "salt": F.xxhash64("source", F.lit(seed)).bitwiseAND((1 << 62) - 1)})
    # a partial pass never takes the short block before all full ones
    plan = plan.withColumn("quota", F.when(size > 0, (F.col("take") / size).cast("long") * F.col("blocks") + F.ceil(rest / block)).otherwise(0))
    plan = kept(plan, "mix-plan")

    leaves = splitting_tree(plan.select("source", F.col("quota").cast("long")), shards, seed=seed)
    ranges = Window.partitionBy("source").orderBy("shard")
    leaves = leaves.withColumn("until", F.sum("quota").over(ranges)).filter("quota > 0")
    draws = leaves.join(plan.select("source", "full", "blocks", "salt", "quota", "take", "size").withColumnRenamed("quota", "all").alias("p"),
                        leaves["source"].eqNullSafe(F.col("p.source"))).select(
        leaves["source"], "shard", "full", "blocks", "salt", "take", "size", "all",
        F.explode(F.sequence(F.col("until") - F.col("quota"), F.col("until") - 1)).alias("draw"))
    cut = F.when(F.col("draw") < F.col("all") - 1, F.lit(block)).otherwise(  # only the very last draw may be cut
        F.col("take") - (F.col("take") / F.col("size")).cast("long") * F.col("size")
        - (F.col("draw") % F.col("blocks")) * block)
    cut = F.when(cut <= 0, F.lit(block)).otherwise(cut)
    drawn = draws.select("source", "shard", "draw", "full", "blocks", "salt", cut.cast("long").alias("words")).mapInPandas(
        _blocks_of_draws, "source string, shard long, turn long, block long, words long")

    spot = F.pmod(F.xxhash64("k1", "k2", F.lit(seed)), F.col("buckets"))
    line = held.filter("span > 0").join(plan.select(F.col("source").alias("of"), "buckets"), F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", spot)
    sums = line.groupBy("source", "bucket").agg(F.sum("span").alias("words"))
    sums = sums.select(F.col("source").alias("of"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(
        Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    order = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("k2", "k1", F.lit(seed)), "k1", "k2")
    placed = line.withColumn("inner", F.coalesce(F.sum("span").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.drop("of").join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("b"))).select(
        "k1", "k2", "source", "span", (F.col("start") + F.col("inner")).alias("start"))
    parts = placed.select("k1", "k2", "source", "start", "span", F.explode(F.sequence(
        (F.col("start") / block).cast("long"), ((F.col("start") + F.col("span") - 1) / block).cast("long"))).alias("at"))
    head, tail = F.greatest("start", F.col("at") * block), F.least(F.col("start") + F.col("span"), F.col("at") * block + F.col("words"))
    runs = parts.join(drawn.alias("d"), parts["source"].eqNullSafe(F.col("d.source")) & (F.col("at") == F.col("d.block"))).select(
        "k1", "k2", "shard", F.xxhash64("k1", "k2", "at", "turn", F.lit(seed)).alias("place"), "turn",
        (head - F.col("start")).alias("word_from"), (tail - F.col("start")).alias("word_to")).filter("word_to > word_from")
    sizes = entries.join(plan.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target"),
                         F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return sizes, runs


def words_taken(sizes: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken. Equal rows take turns: the first get the odd words."""
    sums = runs.groupBy("k1", "k2").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("all"))
    joined = sizes.join(sums, ["k1", "k2"], "left").withColumn("all", F.coalesce("all", F.lit(0)))
    share = F.floor(F.col("all") / F.col("copies"))
    return joined.select("doc_id", "size", "source_size", "target", "all", "copies", share.alias("share"), F.explode(
        F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("share") + F.when(F.col("copy") <= F.col("all") - F.col("share") * F.col("copies"), 1).otherwise(0)).cast("long").alias("taken"))


def cut_words(text: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    """The text from word `first` up to before word `last`, as it stands."""
    import re

    out = []
    for t, a, b in zip(text, first, last):
        begin = end = 0
        for n, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", t)):
            if n == a:
                begin = m.start()
            if n == b - 1:
                end = m.end()
                break
        out.append(t[begin:end])
    return pd.Series(out)


def mixed_rows(docs: DataFrame, runs: DataFrame, sizes: DataFrame, *, text: str = "text",
               length: str | None = "n_chars") -> DataFrame:
    """The rows of `docs` as the mix takes them: once per pass, shard by shard, a document that a block border or the end of the
    draw cuts with the words taken only (`length`, if it is a column, is that of the text given out). Columns as in `docs`, of any name."""
    k1, k2 = row_key(docs.columns)
    spans = runs.join(sizes.select("k1", "k2", "size"), ["k1", "k2"])
    each = spans.select("k1", "k2", "shard", "place", "size", "word_from", "word_to", "turn", F.explode(F.sequence(
        (F.col("word_from") / F.col("size")).cast("long"), ((F.col("word_to") - 1) / F.col("size")).cast("long"))).alias("copy"))
    each = each.select("k1", "k2", "shard", "place", "turn", "copy", "size",
                       (F.greatest("word_from", F.col("copy") * F.col("size")) - F.col("copy") * F.col("size")).alias("a"),
                       (F.least("word_to", (F.col("copy") + 1) * F.col("size")) - F.col("copy") * F.col("size")).alias("b"))
    # pieces of one copy in one pass that lie in neighbouring blocks and both were drawn are one text again
    order = Window.partitionBy("k1", "k2", "turn", "copy").orderBy("a")
    each = each.withColumn("new", F.when(F.lag("b").over(order) == F.col("a"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    each = each.groupBy("k1", "k2", "turn", "copy", "run", "size").agg(
        F.min(F.struct("a", "shard", "place")).alias("m"), F.max("b").alias("b")).select(
        "k1", "k2", "size", F.col("m.a").alias("a"), "b", F.col("m.shard").alias("_shard"), F.col("m.place").alias("_place"))
    cut = F.pandas_udf(cut_words, "string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = docs.select(row.alias("row"), k1.alias("k1"), k2.alias("k2")).groupBy("k1", "k2").agg(F.first("row").alias("row"))  # equal rows
    joined = one.join(each, ["k1", "k2"])
    whole = (F.col("a") == 0) & (F.col("b") == F.col("size"))
    rows = joined.filter(whole).select("row", "_shard", "_place")
    bits = joined.filter(~whole).select("row", "_shard", "_place", cut(F.col("row").getField(text), "a", "b").alias("text"))
    new = F.col("row").withField(f"`{text}`", F.col("text"))
    if length in docs.columns:
        new = new.withField(f"`{length}`", F.length("text").cast(docs.schema[length].dataType))
    mixed = rows.unionByName(bits.select(new.alias("row"), "_shard", "_place"))
    return mixed.repartition("_shard").sortWithinPartitions("_shard", "_place").select("row.*")
