"""Texts joined with a table of keywords: every text is scanned once, however many keywords there are.

Up to `BLOCK_BYTES` of keywords are one automaton (a trie with failure links) that travels to the tasks. A larger table stays a table: a bit table of
fixed size, made of the hashes of all keywords, leaves of each text the substrings that may be keywords (of the lengths that keywords have), and those
rows, joined with the table on the keyword, are the result. No row meets a keyword it may not hold: there is no theta join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import as_col
from postloom.session import scratch_path

BLOCK_BYTES = 1 << 20  # the automaton takes some fifty times that
TABLE_BITS = 27        # 16 MB; ten million keywords fill a quarter of it
PIECE_CHARS = 1 << 18  # texts are scanned in pieces of about so many characters; a longer text is a piece of its own
ANCHOR = 64            # the longest beginning of a keyword that is looked up alone


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def automaton(words: list[str]):
    """Each word's number in the list is what a hit gives."""
    import ahocorasick

    built = ahocorasick.Automaton()
    for n, word in enumerate(words):
        built.add_word(word, n)
    built.make_automaton()
    return built


def hits(built, words: list[str], text: str, whole_words: bool) -> dict[int, int]:
    """How often each keyword occurs, overlaps included; with `whole_words` only where no letter, digit or `_` stands next to it."""
    found: dict[int, int] = {}
    for last, n in built.iter(text):
        if whole_words:
            a, b = last - len(words[n]), last + 1
            if (a >= 0 and _is_word(text[a])) or (b < len(text) and _is_word(text[b])):
                continue
        found[n] = found.get(n, 0) + 1
    return found


def keyword_table_join(df: DataFrame, text: Column | str, keywords: DataFrame, keyword: str, keep: list[str], *, lower: bool = True,
                       whole_words: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """keep, keyword, n: one row per row of `df` and keyword its text holds, with the number of occurrences.

    Keywords count once however often the table repeats them; null and empty ones are left out, as are null texts. `lower` compares texts and
    keywords in lower case and returns the lower-cased keyword.
    """
    spark = df.sparkSession
    fold = F.lower if lower else (lambda c: c)
    words = keywords.select(fold(F.col(keyword)).alias("keyword")).filter(F.length("keyword") > 0).distinct()
    path = scratch_path(spark, "keywords")
    words.write.parquet(path)  # read again for its size, its bits and the join
    words = spark.read.schema(words.schema).parquet(path)
    size = words.agg(F.sum(F.octet_length("keyword"))).first()[0] or 0
    rows = df.select(*keep, fold(as_col(text)).alias("_text")).filter(F.col("_text").isNotNull())
    out = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep) + ", keyword string, n long"
    if size <= block_bytes:
        listed = spark.sparkContext.broadcast(sorted(r["keyword"] for r in words.collect()))
        return rows.mapInArrow(_automaton_scan(listed, keep, whole_words), out)
    lengths = sorted(r[0] for r in words.select(F.length("keyword")).distinct().collect())
    table = spark.sparkContext.broadcast(_bit_table(words))
    found = rows.mapInArrow(_bit_table_scan(table, lengths, keep, whole_words), out)
    return found.join(words.hint("shuffle_hash"), "keyword", "left_semi").select(*keep, "keyword", "n")


def _automaton_scan(listed: Broadcast, keep: list[str], whole_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = listed.value
        built = automaton(names) if names else None
        for batch in batches:
            at, which, counts = [], [], []
            for i, value in enumerate(batch.column("_text")):
                for n, times in (hits(built, names, value.as_py(), whole_words) if built else {}).items():
                    at.append(i)
                    which.append(names[n])
                    counts.append(times)
            left = batch.select(keep).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(which, pa.string()), pa.array(counts, pa.int64())], [*keep, "keyword", "n"])

    return run


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i up to n, a power of two."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(n + 1, base, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    return tuple(out)


class _Hashes:
    """64-bit hashes of any substring of a text from sums over its beginnings."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        powers, self.back = _powers(1 << max(12, len(self.codes).bit_length()))
        c = (self.codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        c ^= c >> np.uint64(32)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * powers[:len(c)], dtype=np.uint64)])

    def at(self, start: np.ndarray, length: int | np.ndarray, salt: int | np.ndarray) -> np.ndarray:
        return self._mixed((self.sums[start + length] - self.sums[start]) * self.back[start], salt)

    def everywhere(self, length: int, salt: int) -> np.ndarray:
        n = len(self.codes) - length + 1
        return self._mixed((self.sums[length:] - self.sums[:n]) * self.back[:n], salt) if n > 0 else np.zeros(0, np.uint64)

    @staticmethod
    def _mixed(h: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(salt, np.int64).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << TABLE_BITS) - 1)
    return ((h >> np.uint64(64 - TABLE_BITS)).astype(np.int64), ((h >> np.uint64(8)) & low).astype(np.int64))


def _in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of the hashes that may be in the table."""
    first, second = _bits(h)
    at = np.flatnonzero((table[first >> 3] >> (first & 7).astype(np.uint8)) & 1)
    k = second[at]
    return at[(table[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1]


def _anchor(length: int) -> int:
    return min(ANCHOR, 1 << (length.bit_length() - 1))


def _bit_table(words: DataFrame) -> np.ndarray:
    """2^TABLE_BITS bits: those of each keyword, and those of its beginning of `_anchor` characters."""
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b["keyword"].tolist()
            n = np.array([len(w) for w in own], np.int64)
            start = np.cumsum(n) - n
            hashes, anchors = _Hashes("".join(own)), np.array([_anchor(int(x)) for x in n], np.int64)
            every = np.concatenate([hashes.at(start, n, n), hashes.at(start, anchors, -anchors)])
            yield pd.DataFrame({"k": np.unique(np.concatenate(_bits(every)))})

    bits = words.mapInPandas(keys, "k long").groupBy(F.bitmap_bucket_number(F.col("k") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("k") + 1)).alias("bits"))
    table = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    for r in bits.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        table[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return table


@lru_cache(1)
def _word_codes() -> np.ndarray:
    return np.array([_is_word(chr(c)) for c in range(0x110000)])


def _candidates(table: np.ndarray, classes: dict[int, list[int]], texts: list[str], whole_words: bool) -> tuple[np.ndarray, pa.Array]:
    """(number of the text, substring) wherever a substring may be a keyword."""
    joined = "".join(texts)
    hashes, sizes = _Hashes(joined), np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    end = np.repeat(ends, sizes)  # of the text a position lies in
    spots, lengths = [], []
    for anchor, longer in classes.items():
        at = _in_table(table, hashes.everywhere(anchor, -anchor))
        for n in longer:
            here = at[at + n <= end[at]]
            here = here[_in_table(table, hashes.at(here, n, n))]
            spots.append(here)
            lengths.append(np.full(len(here), n))
    start, length = np.concatenate(spots), np.concatenate(lengths)
    if whole_words and len(start):
        word = np.append(_word_codes()[hashes.codes], False)
        begin = np.repeat(ends - sizes, sizes)
        alone = ((start == begin[start]) | ~word[start - 1]) & ((start + length == end[start]) | ~word[start + length])
        start, length = start[alone], length[alone]
    return np.searchsorted(ends, start, "right"), _substrings(joined, hashes.codes, start, length)


def _substrings(text: str, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """text[start:start + length] for every start, copied as UTF-8 bytes in one go."""
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
    first, sizes = at[start], at[start + length] - at[start]
    ends = np.cumsum(sizes)
    taken = data[np.repeat(first - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(taken))


def _bit_table_scan(table: Broadcast, lengths: list[int], keep: list[str], whole_words: bool):
    classes: dict[int, list[int]] = {}
    for n in lengths:
        classes.setdefault(_anchor(n), []).append(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            first, held = 0, 0
            for i, t in enumerate([*texts, None]):
                if t is not None and held + len(t) <= PIECE_CHARS or i == first and t is not None:
                    held += len(t)
                    continue
                if i > first:
                    which, found = _candidates(table.value, classes, texts[first:i], whole_words)
                    coded = found.dictionary_encode()
                    names = max(1, len(coded.dictionary))
                    both, counts = np.unique(which * names + coded.indices.to_numpy(), return_counts=True)
                    left = batch.select(keep).take(pa.array(both // names + first))
                    words = coded.dictionary.take(pa.array(both % names)).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*left.columns, words, pa.array(counts, pa.int64())], [*keep, "keyword", "n"])
                first, held = i, len(t or "")

    return run
