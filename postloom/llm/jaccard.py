"""N-gram Jaccard join: documents linked by 80 % of their distinct word shingles, exactly, as a T-occurrence search.

Documents are lists of 64-bit shingles; equal sets (by 128 bits) are one class from the start. A link needs at least T = ceil(80 % n) common
shingles, so in any common order the first n - T + l shingles of both share at least l (l about 5 % of n). These prefixes
are the inverted lists. The order puts shingles that a bounded sample shows to be frequent last: it decides what is
cheap, never what is found.

1. `shared`: prefix shingles in more than one class (map-side combined). They fill a Bloom table of fixed size; a second read
   of the texts keeps the sets of those documents alone that have enough of them (too many, never too few).
2. Stars: every class is compared with one class of another component in the list, the one met in most lists; in a large group of near
   copies nearly all become one component, so none of its pairs need be listed. Two rounds with other leaders.
3. Lists that still hold several components are divided (DivideSkip). In a short one every class outside the list's largest component meets
   the others of other components: these occurrences are merged and counted, and a pair stays if it could
   still reach l given the long lists left out. Long lists are then probed by binary search in the sorted sets. Classes that
   could be linked through long lists alone are searched in pairs of bounded blocks of those lists, in which the same search runs on the
   local lists.

Every link between classes of different components is either found or refuted exactly; links inside a component change nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import kept, lean, map_text, row_key, small_batches, text_bytes
from postloom.llm.words import mix, shingle_sets
from postloom.operators.joins import join_known

PERCENT = 80
EXTRA = 20           # l = n / EXTRA, 1 at least
SAMPLE_ROWS = 20_000
SAMPLE_LEAST = 4     # sampled documents that make a shingle frequent
FREQUENT = 400_000   # frequent shingles that are placed last, most frequent first
BLOOM_BITS = 27
LONG = 64            # classes outside a list's largest component that make the list long
BLOCK = 256
SHORT = 4            # classes of a block in a list that is merged by counting
PROBED = 4096


def least_common(n):
    return -(-PERCENT * n // 100)


def extra(n):
    return np.maximum(1, n // EXTRA)


def _bloom_keys(values: np.ndarray) -> list[np.ndarray]:
    u = mix(values.view(np.uint64))
    low = np.uint64((1 << BLOOM_BITS) - 1)
    return [((u >> np.uint64(s)) & low).astype(np.int64) for s in (0, 18, 36)]


def signature(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit values that stand for a set; the first is its class, the second tells sets apart that share the first."""
    with np.errstate(over="ignore"):
        once = mix(own.view(np.uint64))
        sums = np.array([once.sum() + np.uint64(len(own)), mix(once).sum()], np.uint64)
        return tuple(mix(sums).view(np.int64).tolist())


class Order:
    """Frequent shingles last, otherwise by hash."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent
        self.table = np.zeros(1 << 22, bool)
        self.table[frequent & ((1 << 22) - 1)] = True

    def prefix(self, own: np.ndarray) -> np.ndarray:
        n = len(own)
        last = self.table[own & ((1 << 22) - 1)]
        if last.any():
            at = np.flatnonzero(last)
            low = np.searchsorted(self.frequent, own[at])
            low[low == len(self.frequent)] = 0
            last[at] = self.frequent[low] == own[at]
            own = np.concatenate((own[~last], own[last]))
        return own[:n - least_common(n) + int(extra(n))]


def frequent_shingles(rows: DataFrame, text: str) -> np.ndarray:
    """Shingles of at least SAMPLE_LEAST of about SAMPLE_ROWS rows, at most FREQUENT; they only shape the order."""
    n = rows.count()
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    picked = rows.filter(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(share * (1 << 30))).select(text)

    def make():
        return lambda piece: {"s": [x.tolist() for x in shingle_sets(text_bytes(piece.column(text)))]}

    counts = map_text(picked, text, "s array<long>", make).select(F.explode("s").alias("s")).groupBy("s").count()
    top = counts.filter(F.col("count") >= SAMPLE_LEAST).orderBy(F.desc("count"), "s").limit(FREQUENT).select("s").toPandas()
    return np.sort(top["s"].to_numpy(np.int64))


def arrays(values: list[np.ndarray | None]) -> pa.Array:
    """array<long> without a Python object per element."""
    sizes = [0 if v is None else len(v) for v in values]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    flat = np.concatenate([v for v in values if v is not None and len(v)] or [np.zeros(0, np.int64)])
    mask = pa.array([v is None for v in values]) if any(v is None for v in values) else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=mask)


def _shared_bits(rows: DataFrame, text: str, order) -> np.ndarray:
    """The Bloom table of all prefix shingles in more than one class: 2^BLOOM_BITS bits, whatever the size of the corpus."""
    def make():
        def work(piece: pa.RecordBatch) -> dict:
            sets = list(shingle_sets(text_bytes(piece.column(text))))
            return {"sig": [signature(s)[0] if len(s) else None for s in sets], "s": arrays([order.value.prefix(s) for s in sets])}
        return work

    lists = map_text(rows.select(text), text, "sig long, s array<long>", make).select("sig", F.explode("s").alias("s"))
    return bit_table(lists.groupBy("s").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).filter("a <> b").select("s"))


def bit_table(values: DataFrame) -> np.ndarray:
    """The Bloom table of the 64-bit values in column s: 2^BLOOM_BITS bits, however many they are."""
    def keys(batches):
        for b in batches:
            flat = np.unique(np.concatenate(_bloom_keys(b["s"].to_numpy(np.int64))))
            yield pd.DataFrame({"k": flat})

    bits = values.mapInPandas(lean(keys), "k long").groupBy(F.bitmap_bucket_number(F.col("k") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("k") + 1)).alias("bits"))
    table = np.zeros((1 << BLOOM_BITS) // 8, np.uint8)
    for r in bits.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        table[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return table


def in_bloom(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    first, *rest = _bloom_keys(values)
    found = (table[first >> 3] >> (first & 7).astype(np.uint8)) & 1 == 1
    for k in rest:
        at = np.flatnonzero(found)
        found[at] = (table[k[at] >> 3] >> (k[at] & 7).astype(np.uint8)) & 1 == 1
    return found


def _searched(rows: DataFrame, keys: list[str], text: str, order, bloom) -> DataFrame:
    """keys, n, sig, sig2, set, hits: the set and its shared prefix shingles where a link is possible, else null."""
    ddl = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", n long, sig long, sig2 long, set array<long>, hits array<long>"

    def make():
        def work(piece: pa.RecordBatch) -> dict:
            n, marks, sets, hits = [], [], [], []
            for own in shingle_sets(text_bytes(piece.column(text))):
                n.append(len(own))
                marks.append(signature(own) if len(own) else (None, None))
                got = None
                if len(own):
                    prefix = order.value.prefix(own)
                    got = prefix[in_bloom(bloom.value, prefix)]
                    if len(got) < int(extra(least_common(len(own)))):
                        got = None
                sets.append(None if got is None else own)
                hits.append(got)
            return {**{k: piece.column(k) for k in keys}, "n": n, "sig": [a for a, _ in marks], "sig2": [b for _, b in marks],
                    "set": arrays(sets), "hits": arrays(hits)}
        return work

    return map_text(rows.select(*keys, text), text, ddl, make)


def apart(found: DataFrame) -> DataFrame:
    """`found` with a `sig` of its own for every set: where sets that differ (by `sig2`) share one, both values together give new ones."""
    shared = found.filter("sig is not null").groupBy("sig").agg(F.min("sig2").alias("low"), F.max("sig2").alias("high"))
    shared = shared.filter("low <> high").select(F.col("sig").alias("twice"))
    if shared.isEmpty():
        return found
    marked = found.join(shared, F.col("sig") == F.col("twice"), "left")
    fresh = F.when(F.col("twice").isNotNull(), F.xxhash64("sig", "sig2")).otherwise(F.col("sig"))
    return apart(kept(marked.withColumn("sig", fresh).drop("twice").select(*found.columns), "jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node each node of `edges` (a, b) reaches. Labels fall along the edges and jump to their label's label."""
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp"))
    labels = kept(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        stepped = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("low"))
        jumped = stepped.join(labels.select(F.col("node").alias("low"), F.col("comp").alias("further")), "low", "left")
        new = kept(jumped.select("node", "was", F.least("low", F.coalesce("further", "low")).alias("comp")), "labels")
        if new.filter("comp <> was").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def _roots(edges: DataFrame) -> DataFrame:
    """node, comp of a forest: every `a` of the edges (a, b) has one `b` and nothing leads back. Pointers jump to their end."""
    up = kept(edges.select(F.col("a").alias("node"), F.col("b").alias("comp")), "labels")
    while True:
        far = up.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = kept(up.join(far, "comp", "left").select("node", F.coalesce("further", "comp").alias("comp"), F.col("further").isNotNull().alias("moved")), "labels")
        if new.filter("moved").isEmpty():
            return new.select("node", "comp")
        up = new.select("node", "comp")


def _merge_components(comps: DataFrame, links: DataFrame, forest: bool = False) -> DataFrame:
    """sig, comp after the links (a, b) between classes."""
    of = comps.select(F.col("sig").alias("s"), F.col("comp").alias("c"))
    edges = links.join(of.withColumnsRenamed({"s": "a", "c": "ca"}), "a").join(of.withColumnsRenamed({"s": "b", "c": "cb"}), "b")
    edges = edges.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    found = _roots(edges.groupBy("a").agg(F.min("b").alias("b"))) if forest else components(edges)
    return kept(comps.join(found, comps["comp"] == found["node"], "left").select("sig", F.coalesce(found["comp"], comps["comp"]).alias("comp")), "comps")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """By binary search of the shorter sorted set in the longer."""
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(long_, short)
    at[at == len(long_)] = 0
    return int((long_[at] == short).sum()) if len(long_) else 0


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = _common(a, b)
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked; `sets` has sig, set, one row per class."""
    left = pairs.join(sets.select(F.col("sig").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("sig").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")

    def check(batches):
        for batch in batches:
            (xo, xv), (yo, yv) = ((c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column("x"), batch.column("y")))
            good = [linked(xv[xo[i]:xo[i + 1]], yv[yo[i]:yo[i + 1]]) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(lean(check), "a long, b long")


def _close(n_a: Column, n_b: Column) -> Column:
    return (100 * F.least(n_a, n_b)) >= PERCENT * F.greatest(n_a, n_b)


def _stars(postings: DataFrame, comps: DataFrame, turn: int) -> DataFrame:
    """a, b: for each class one of another component, the leader of the most lists both are in. The leader's component comes
    first in the keyed order of the components in its list, so such links never form a circle."""
    p = postings.join(comps, "sig")
    lists = p.groupBy("s").agg(F.min_by(F.struct("sig", "comp", "n"), F.struct(F.xxhash64("comp", F.lit(turn)), "comp", F.xxhash64("sig", F.lit(turn)), "sig")).alias("lead"),
                               F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("s", "lead")
    met = p.join(lists, "s").filter((F.col("comp") != F.col("lead.comp")) & _close(F.col("n"), F.col("lead.n")))
    counts = met.groupBy(F.col("sig").alias("a"), F.col("lead.sig").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Common shingles of all pairs of a block: short local lists are merged by counting, long ones are probed as bits of a
    matrix, `PROBED` lists at a time."""
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(values)) + 1, [len(values)]))
    sizes, n = np.diff(starts), len(sets)
    out = np.zeros(n * n, np.int64)
    for size in range(2, SHORT + 1):
        at = starts[:-1][sizes == size]
        for i in range(size):
            for j in range(i + 1, size):
                out += np.bincount(owners[at + i] * n + owners[at + j], minlength=n * n)
    out = out.reshape(n, n)
    out = out + out.T
    long_ = np.flatnonzero(sizes > SHORT)
    for k in range(0, len(long_), PROBED):
        lists = long_[k:k + PROBED]
        bits = np.zeros((n, len(lists)), np.float32)
        for c, i in enumerate(lists):
            bits[owners[starts[i]:starts[i + 1]], c] = 1
        out += (bits @ bits.T).astype(np.int64)
    return out


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between classes of different components in a pair of blocks; those that join what is not joined yet."""
    rows = rows.drop_duplicates("sig").sort_values("sig").reset_index(drop=True)
    sets = [np.asarray(s, np.int64) for s in rows["set"]]
    shared, n = _overlaps(sets), np.array([len(s) for s in sets])
    comp, sig = rows["comp"].to_numpy(), rows["sig"].tolist()
    good = (100 * shared >= PERCENT * (n[:, None] + n[None, :] - shared)) & (comp[:, None] != comp[None, :])
    group = {c: c for c in comp.tolist()}

    def top(c):
        while group[c] != c:
            group[c] = group[group[c]]
            c = group[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(good, 1))):
        x, y = top(int(comp[i])), top(int(comp[j]))
        if x != y:
            group[x] = y
            out.append((sig[i], sig[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def _low(n: Column) -> Column:
    """l of the smallest set that can be linked with one of n."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * (PERCENT / 100)) / EXTRA)).cast("long")


def _remaining(postings: DataFrame, comps: DataFrame, sets: DataFrame, long_: int, block: int) -> DataFrame:
    """a, b: links between classes of different components, at least as many as join them."""
    p = postings.join(comps, "sig")
    by_comp = p.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("h"))
    lists = by_comp.groupBy("s").agg(F.sum("k").alias("m"), F.max("k").alias("most"), F.max_by("comp", F.struct("k", "comp")).alias("main"),
                                     F.sum("h").alias("h")).filter("most < m")
    same = lists.groupBy("m", "h", "main", "most").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("w"))  # lists of the same classes are one
    live = kept(p.join(same.select("s", "w", "main", (F.col("m") - F.col("most") > long_).alias("long"), "m"), "s"), "lists")
    left_out = live.filter("long").groupBy("sig").agg(F.sum("w").alias("skipped"))
    live = live.join(left_out, "sig", "left").withColumn("skipped", F.coalesce("skipped", F.lit(0)))

    other = live.filter("not long")
    a, b = other.filter("comp <> main").alias("a"), other.alias("b")
    met = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.comp") != F.col("b.comp")) & _close(F.col("a.n"), F.col("b.n"))
                 & ((F.col("b.comp") == F.col("b.main")) | (F.col("a.sig") < F.col("b.sig"))))
    low, high = F.least("a.sig", "b.sig"), F.greatest("a.sig", "b.sig")
    need = F.least(F.greatest(F.lit(1), F.floor(F.col("a.n") / EXTRA)), F.greatest(F.lit(1), F.floor(F.col("b.n") / EXTRA))) - F.least("a.skipped", "b.skipped")
    pairs = met.groupBy(low.alias("a"), high.alias("b")).agg(F.sum("a.w").alias("c"), F.min(need).alias("need")).filter(
        F.col("c") >= F.greatest(F.lit(1), F.col("need"))).select("a", "b")
    found = verified(pairs, sets)

    # classes that could be linked through long lists alone, next to those they share most of them with
    full = live.filter(F.col("long") & (F.col("skipped") >= _low(F.col("n")))).select("s", "sig", "comp", "w")
    lead = full.groupBy("s").agg(F.min("sig").alias("lead"))
    near = full.join(lead, "s").groupBy("sig", "comp", "lead").agg(F.sum("w").alias("k")).groupBy("sig", "comp").agg(
        F.max_by("lead", F.struct("k", "lead")).alias("lead"))
    parts = near.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    spots = kept(near.join(parts, "lead").select("sig", "comp", F.xxhash64("lead", F.pmod(F.xxhash64("sig"), F.col("parts"))).alias("block")), "blocks")
    on = full.join(spots.select("sig", "block"), "sig").select("s", "block").distinct()
    couples = on.alias("a").join(on.alias("b"), (F.col("a.s") == F.col("b.s")) & (F.col("a.block") <= F.col("b.block"))).select(
        F.col("a.block").alias("i"), F.col("b.block").alias("j")).distinct()
    couples = couples.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    members = spots.join(sets.select("sig", "set"), "sig")
    blocks = couples.join(members, "block").select("i", "j", "sig", "comp", "set").groupBy("i", "j").applyInPandas(_block_links, "a long, b long")
    return found.unionByName(blocks)


def classes(docs: DataFrame, *, keys: list[str] = ("doc_id",), doc_id: str = "doc_id", text: str = "text", long_: int = LONG, block: int = BLOCK) -> DataFrame:
    """keys, n, sig, comp, component_id per row of `docs`: the size of its set, what stands for the set (null: empty), what stands
    for its component, and the smallest doc_id it reaches.

    Null and empty texts have no shingles and are linked with nothing: their own doc_id. Equal texts are linked, rows with equal
    ids are rows of their own, a null id never is the smallest unless there is no other. An empty table gives none.
    """
    spark, keys = docs.sparkSession, list(dict.fromkeys([doc_id, *keys]))
    rows = docs.select(*keys, F.col(text).alias("_text"))
    with small_batches(spark):
        order = spark.sparkContext.broadcast(Order(frequent_shingles(rows, "_text")))   # at most FREQUENT values
        bloom = spark.sparkContext.broadcast(_shared_bits(rows, "_text", order))         # 2^BLOOM_BITS bits
        found = kept(_searched(rows, keys, "_text", order, bloom), "jaccard")
        for sent in (order, bloom):  # the tables are written: nothing asks for these again
            sent.destroy()
        found = apart(found)
        held = found.filter(F.col("set").isNotNull())
        sets = held.groupBy("sig").agg(F.first("set").alias("set"))
        postings = kept(held.select("sig", "n", F.explode("hits").alias("s")).distinct(), "postings")
        comps = kept(postings.select("sig", F.col("sig").alias("comp")).distinct(), "comps")
        for turn in range(2):
            comps = _merge_components(comps, verified(_stars(postings, comps, turn), sets), forest=True)
        comps = _merge_components(comps, _remaining(postings, comps, sets, long_, block))

    least = found.filter("sig is not null").groupBy("sig").agg(F.min(doc_id).alias("low"))
    least = least.join(comps.withColumnRenamed("sig", "of"), F.col("sig") == F.col("of"), "left").select("sig", "low", F.coalesce("comp", "sig").alias("comp"))
    smallest = least.groupBy("comp").agg(F.min("low").alias("component_id"))
    reach = least.join(smallest, "comp").select(F.col("sig").alias("of"), "comp", "component_id")
    return found.join(reach, F.col("sig") == F.col("of"), "left").select(
        *keys, "n", "sig", "comp", F.when(F.col("sig").isNull(), F.col(doc_id)).otherwise(F.col("component_id")).alias("component_id"))


def one_per_group(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, one of each group of linked ones: that with the smallest doc_id (ties: by content); rows without
    words are linked with nothing and stay. Columns as in `docs`."""
    k1, k2 = row_key([doc_id, text])
    keyed = docs.withColumns({"_k1": k1, "_k2": k2})
    found = classes(keyed, keys=["_k1", "_k2"], doc_id=doc_id, text=text).filter("comp is not null")
    found = kept(found.select(F.struct(F.col(doc_id).isNull(), doc_id, "_k1", "_k2").alias("at"), "comp"), "groups")
    first = found.groupBy("comp").agg(F.min("at").alias("first"))
    judged = kept(found.join(first, "comp").groupBy(F.col("at._k1").alias("_k1"), F.col("at._k2").alias("_k2")).agg(
        F.max(F.col("at") == F.col("first")).alias("stays"), F.count(F.lit(1)).alias("copies")), "judged")
    gone = judged.filter("not stays or copies > 1").select("_k1", "_k2")
    rest = join_known(keyed, gone, gone.count(), ["_k1", "_k2"], "left_anti")
    repeated = judged.filter("stays and copies > 1").select("_k1", "_k2")
    n = repeated.count()
    if n:  # equal rows with equal ids: one of them
        rest = rest.unionByName(join_known(keyed, repeated, n, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]))
    return rest.drop("_k1", "_k2")
