"""Phrase collocations: Misra-Gries summaries per hash partition, then exact counts of what survives.

Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends and into words at blanks and tabs. All runs of one to
three words inside a piece are counted per language.

1. Every run is a 64-bit code; its upper bits name a hash partition, the lower 32 stand for it there. Tasks count the codes of a chunk exactly and send, per
   partition, one row (codes, counts). A partition's rows come together in one task, its masses first, so the mass m of the
   partition is known before the first code is merged. The summary keeps more than m / threshold counters (`SPARE` times that
   many): when more are held, the first one too many is subtracted from all. What was subtracted in sum stays below
   threshold / `SPARE`, so every code counted `threshold` times or more survives, and what could not reach the threshold goes.
2. Survivors fill a Bloom table of fixed size. The texts are read again; runs found in the table leave their task as (language, text,
   count) and are counted exactly, by their text, in Spark. A full table only lets more runs through to the exact count.

A partition's mass is `PART_MASS` on average, whatever the corpus; a hot phrase is one counter. Every sub-run of a frequent
run is frequent, so all counts that the scores need are among the survivors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import kept, lean, pieces, text_bytes
from postloom.llm.words import _power_tables, mix

LONGEST = 3
PART_MASS = 1 << 21
SPARE = 4
CHUNK = 1 << 21        # codes a task counts at a time
SLICE = 1 << 20        # bytes hashed at a time
BLOOM_BITS = 27
_INSIDE = np.ones(256, bool)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_INSIDE[[0x20, 0x09]] = False
_INSIDE[_ENDS] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HALF, _LOW32, _UPPER = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)
_BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


class Words:
    """Words of a slice: byte bounds, hashes, and the number of the piece each lies in. The first `known` words were in the slice before."""

    def __init__(self, raw: np.ndarray, known: int):
        self.raw, self.known = raw, known
        inside = np.concatenate(([False], _INSIDE[raw], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.stops = edges[::2], edges[1::2]
        self.piece = np.cumsum(_ENDS[raw], dtype=np.int32)[self.starts]
        forward, back = _power_tables(max(SLICE, len(raw)) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * forward[:len(raw)])))
        self.hashes = mix((sums[self.stops] - sums[self.starts]) * back[self.starts] + (self.stops - self.starts).astype(np.uint64))

    def runs(self, n: int, seed: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all runs of n words inside a piece whose last word is new, and the first word of each."""
        low, count = max(0, self.known - n + 1), len(self.hashes) - n + 1
        if count <= low:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = np.full(count - low, np.uint64(seed) + np.uint64(n), np.uint64)
        for k in range(n):
            out = out * _BASES[base] + self.hashes[low + k:count + k]
        at = np.flatnonzero(self.piece[low + n - 1:] == self.piece[low:count]) if n > 1 else np.arange(count - low)
        return mix(out[at]), at + low


def word_slices(data: bytes) -> Iterator[Words]:
    """Slices of about SLICE bytes, cut between words; each repeats the last LONGEST - 1 words of the one before."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    at, end, known = 0, 0, 0
    while end < len(raw):
        end = min(len(raw), end + SLICE)
        while end < len(raw) and _INSIDE[raw[end]]:
            gap = np.flatnonzero(~_INSIDE[raw[end:end + SLICE]])
            end = end + int(gap[0]) if len(gap) else min(len(raw), end + SLICE)
        words = Words(raw[at:end], known)
        yield words
        known = min(LONGEST - 1, len(words.starts))
        at = at + int(words.starts[-known]) if known else end


def _seed(lang: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode()) >> 2


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of a batch by language, joined by a piece end, in runs of about SLICE bytes (a longer text is a run of its own)."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text"))):
        if held.get(lang) and sizes[lang] + len(text) > SLICE:
            yield lang, b"\n".join(held.pop(lang))
        if lang not in held:
            held[lang], sizes[lang] = [], 0
        held[lang].append(text)
        sizes[lang] += len(text) + 1
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def places(codes: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition in the upper, code within it in the lower 32 bits. Two runs may share a place: it is then only counted too high."""
    return (((codes >> _HALF) * np.uint64(parts)) & _UPPER) | (codes & _LOW32)


def _planes(values: np.ndarray) -> bytes:
    """uint32 as four rows of bytes, the upper of which are mostly zero and vanish when the shuffle is compressed."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(n, first) if len(first) else n)


class Summary:
    """A Misra-Gries summary that is merged from counts: at most `capacity` counters, none too low by more than `lost`."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.codes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._codes, self._counts, self._held = [], [], 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self._codes.append(codes)
        self._counts.append(counts)
        self._held += len(codes)
        if self._held > self.capacity:
            self.settle()

    def settle(self) -> None:
        self.codes, self.counts = _merged([self.codes, *self._codes], [self.counts, *self._counts])
        self._codes, self._counts, self._held = [], [], 0
        if len(self.codes) > self.capacity:
            least = int(-np.partition(-self.counts, self.capacity)[self.capacity])  # the largest counter that is one too many
            left = self.counts > least
            self.codes, self.counts, self.lost = self.codes[left], self.counts[left] - least, self.lost + least

    def survivors(self, threshold: int) -> np.ndarray:
        self.settle()
        return self.codes[self.counts + self.lost >= threshold]


def _partial_counts(docs: DataFrame, parts: int) -> DataFrame:
    """part, mass, codes, counts: per chunk and hash partition a row with the mass alone and one with the codes."""
    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        part = (found >> _HALF).astype(np.int64)
        bounds = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        n = len(bounds) - 1
        codes = [_planes(np.diff(found[a:b] & _LOW32, prepend=np.uint64(0))) for a, b in zip(bounds[:-1], bounds[1:])]
        numbers = [_planes(counts[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.tile(part[bounds[:-1]], 2)), pa.array([*np.add.reduceat(counts, bounds[:-1]).tolist(), *[None] * n], pa.int64()),
             pa.array([None] * n + codes, pa.binary()), pa.array([None] * n + numbers, pa.binary())], ["part", "mass", "codes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in pieces(batches, "text"):
            for lang, data in by_language(batch):
                seed = _seed(lang)
                for words in word_slices(data):
                    for n in range(1, LONGEST + 1):
                        held.append(places(words.runs(n, seed)[0], parts))
                        size += len(held[-1])
                    if size >= CHUNK:
                        yield pack(held)
                        held, size = [], 0
        if size:
            yield pack(held)

    return docs.mapInArrow(lean(run), "part long, mass long, codes binary, counts binary")


def _survivors(partial: DataFrame, threshold: int) -> DataFrame:
    """Bloom positions of the places that may occur `threshold` times, found partition by partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = None, 0, None

        def done():
            if summary is not None:
                found = summary.survivors(threshold)
                for at in range(0, len(found), 1 << 16):
                    keys = [bloom_key(found[at:at + (1 << 16)], k) for k in range(2)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(keys)))], ["k"])

        for batch in batches:
            for p, m, codes, counts in zip(*(batch.column(c) for c in ("part", "mass", "codes", "counts"))):
                if p.as_py() != part:
                    yield from done()
                    part, mass, summary = p.as_py(), 0, None
                if m.is_valid:
                    mass += m.as_py()
                    continue
                if summary is None:  # all masses came first
                    summary = Summary(SPARE * mass // threshold + 1)
                low = np.cumsum(_from_planes(codes.as_buffer()), dtype=np.uint64)
                summary.add(low | np.uint64(part << 32), _from_planes(counts.as_buffer()).astype(np.int64))
        yield from done()

    dealt = partial.repartition(F.col("part")).sortWithinPartitions("part", F.col("mass").isNull())
    return dealt.mapInArrow(lean(run), "k long")


def bloom_key(found: np.ndarray, k: int) -> np.ndarray:
    if k:
        found = (found * _BASES[1]) >> np.uint64(64 - BLOOM_BITS)
    return (found & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)


def _bloom(keys: DataFrame) -> np.ndarray:
    """2^BLOOM_BITS bits, whatever the number of keys."""
    bits = keys.groupBy(F.bitmap_bucket_number(F.col("k") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("k") + 1)).alias("bits"))
    table = np.zeros((1 << BLOOM_BITS) // 8, np.uint8)
    for r in bits.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        table[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return table


def _in_bloom(table: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Indexes of the places that the table holds."""
    at = np.arange(len(found))
    for k in range(2):
        keys = bloom_key(found[at], k)
        at = at[(table[keys >> 3] >> (keys & 7).astype(np.uint8)) & 1 == 1]
    return at


def _exact_counts(docs: DataFrame, bloom, parts: int, threshold: int) -> DataFrame:
    """lang, words, phrase, f: the exact counts of all runs that occur `threshold` times; words 0: all words of the language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            for lang, data in by_language(batch):
                seed = _seed(lang)
                for words in word_slices(data):
                    found, lower = [(0, [b""], np.array([len(words.hashes) - words.known]))], words.raw.tobytes()
                    for n in range(1, LONGEST + 1):
                        codes, starts = words.runs(n, seed)
                        at = _in_bloom(bloom.value, places(codes, parts))
                        if not len(at):
                            continue
                        codes, starts, second = codes[at], starts[at], words.runs(n, seed, 1)[0][at]
                        _, first, which, counts = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
                        if (second[first][which] != second).any():  # two runs of one code: told apart by both codes
                            _, first, counts = np.unique(np.stack((codes, second), axis=1), axis=0, return_index=True, return_counts=True)
                        a, b = words.starts[starts[first]].tolist(), words.stops[starts[first] + n - 1].tolist()
                        found.append((n, [lower[i:j] for i, j in zip(a, b)] if n == 1 else
                                      [b" ".join(lower[i:j].split()) for i, j in zip(a, b)], counts))
                    size = sum(len(t) for _, t, _ in found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * size, pa.string()), pa.array(np.concatenate([np.full(len(t), n, np.int32) for n, t, _ in found])),
                         pa.array([x for _, t, _ in found for x in t], pa.binary()),
                         pa.array(np.concatenate([c.astype(np.int64) for _, _, c in found]))], ["lang", "words", "phrase", "f"])

    rows = docs.mapInArrow(lean(run), "lang string, words int, phrase binary, f long").withColumn("phrase", F.col("phrase").cast("string"))
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= threshold) | (F.col("words") == 0))


def frequent_runs(docs: DataFrame, *, threshold: int = 10, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, words, phrase, f: every run of one to three words that occurs `threshold` times in its language, counted exactly, and
    per language a row of 0 words with the number of all words. Null text: empty. Null language: `und`."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, size // (2 * PART_MASS))  # a word takes about six bytes and starts three runs
    bloom = spark.sparkContext.broadcast(_bloom(_survivors(_partial_counts(rows, parts), threshold)))  # 2^BLOOM_BITS bits
    return _exact_counts(rows, bloom, parts, threshold)


def _looked_up(rows: DataFrame, of: DataFrame, part: Column, name: str) -> DataFrame:
    """`name`: the count of the run `part` in `of`. Each run has one row there; AQE splits the partitions of a hot word and broadcasts a side it finds small."""
    side = of.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("f").alias(name))
    return rows.withColumn("_part", part).join(side, (F.col("lang") == F.col("_l")) & (F.col("_part") == F.col("_p"))).drop("_l", "_p", "_part")


def collocations(docs: DataFrame, *, threshold: int = 10, covered: int = 50, most: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, words, a, l, r, n, score: the first `most` phrases of two or three words of each language.

    `a` is the phrase's count (at least `threshold`), cut into a first part counted `l` and a rest counted `r` where floor(10^6 a a / (l r))
    is lowest (ties: the shorter first part). A phrase that lies inside a longer one with at least `covered` % of its count is dropped. Order:
    score and a descending, then the phrase by its UTF-8 bytes. Equal texts count as often as they occur, ids and other columns are not
    read; null and empty texts hold no words; a language without phrases, and an empty table, give no rows. A word may have any length.
    """
    counts = kept(frequent_runs(docs, threshold=threshold, lang=lang, text=text), "runs")
    single, pairs, triples = (counts.filter(F.col("words") == n).select("lang", "phrase", "f") for n in (1, 2, 3))
    words = F.split("phrase", " ")
    wide = lambda c: F.col(c).cast("decimal(38,0)")

    def joined(a: int, b: int) -> Column:
        return F.array_join(F.slice(words, a, b), " ")

    def scored(rows: DataFrame, l: str, r: str) -> Column:
        top, bottom = F.lit(1_000_000).cast("decimal(38,0)") * wide("a") * wide("a"), wide(l) * wide(r)
        return F.floor((top - top % bottom) / bottom).cast("long")

    two = _looked_up(pairs.withColumnRenamed("f", "a"), single, joined(1, 1), "l")
    two = _looked_up(two, single, joined(2, 1), "r")
    two = two.withColumn("score", scored(two, "l", "r"))
    three = _looked_up(triples.withColumnRenamed("f", "a"), single, joined(1, 1), "l1")
    three = _looked_up(three, pairs, joined(2, 2), "r1")
    three = _looked_up(three, pairs, joined(1, 2), "l2")
    three = _looked_up(three, single, joined(3, 1), "r2")
    three = three.withColumns({"s1": scored(three, "l1", "r1"), "s2": scored(three, "l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", "phrase", "a", *[F.when(first, F.col(x + "1")).otherwise(F.col(x + "2")).alias(y)
                                                 for x, y in (("l", "l"), ("r", "r"), ("s", "score"))])

    inner = triples.select("lang", F.col("f"), F.explode(F.array_distinct(F.array(joined(1, 2), joined(2, 2)))).alias("_p"))
    inner = inner.groupBy(F.col("lang").alias("_l"), "_p").agg(F.max("f").alias("_longer"))
    same = (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")) & (100 * F.col("_longer") >= covered * F.col("a"))
    two = two.join(inner, same, "left_anti")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    total = counts.filter(F.col("words") == 0).select(F.col("lang").alias("_l"), F.col("f").alias("n"))
    top = ranked.filter(F.col("rank") <= most)
    return top.join(total, F.col("lang") == F.col("_l")).select(
        "lang", "rank", "phrase", F.size(words).alias("words"), "a", "l", "r", "n", "score")
