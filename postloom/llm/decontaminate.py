"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash sketches.

An item is contained in a document when at least 80 % of its distinct word shingles are among the document's. Items are
partitioned by size into powers of two; in the partition of sizes below 2^p an item is sketched by its k smallest hash values,
k = its size - ceil(80 %) + 1 at the upper end. Whatever 80 % of an item a document holds, one of these values is among
them: the search misses nothing. A banded MinHash of whole documents would need as many hash functions as a document is longer
than the item to see it; bottom-k sketches of the items cost one.

Items stay a table, however many there are. Documents are read once and whole: a bit table of fixed size, made of all shingles of
the items, leaves of each document the few shingles that an item may have. Joined with the sketches they give the candidates, of
which those too large for what the document has left go at once; the full shingle sets of the candidates, joined with the same few
shingles, are counted and decide. Equal texts are searched once. A shingle in very many documents, or an item in very many, is dealt
to `SALT` keys by the hash of the document; a long document is spread by its shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import kept, map_text, row_key, text_bytes
from postloom.llm.jaccard import arrays, bit_table, in_bloom, signature
from postloom.llm.words import SHINGLE, batches, gram_hashes, shingle_sets
from postloom.operators.joins import join_known

PERCENT = 80
SALT = 8


def sketch_size(n: int) -> int:
    top = (1 << n.bit_length()) - 1  # the largest size of the item's partition
    return min(n, top - -(-PERCENT * top // 100) + 1)


def item_table(items: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, h1, h2, n, set, sketch, a row per item row with words; h1 and h2 stand for its set of n shingles."""
    def make():
        def work(piece: pa.RecordBatch) -> dict:
            sets = list(shingle_sets(text_bytes(piece.column("t"))))
            marks = [signature(own) if len(own) else (None, None) for own in sets]
            return {"item_id": piece.column("item_id"), "h1": [a for a, _ in marks], "h2": [b for _, b in marks], "n": [len(own) for own in sets],
                    "set": arrays(sets), "sketch": arrays([own[:sketch_size(len(own))] for own in sets])}
        return work

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("t"))
    found = map_text(rows, "t", "item_id long, h1 long, h2 long, n long, set array<long>, sketch array<long>", make)
    return kept(found.filter("n > 0"), "items")


def held_shingles(texts: list[bytes | None], table: np.ndarray) -> list[np.ndarray | None]:
    """Per text its distinct shingles that the bit table knows, ascending; none: None. Fewer words than a shingle: the sequence as one."""
    out: list[np.ndarray | None] = [None] * len(texts)
    for first, words, offsets in batches(texts):
        grams = gram_hashes(words, SHINGLE).view(np.int64)
        maybe = np.flatnonzero(in_bloom(table, grams))
        docs = np.searchsorted(offsets, maybe, "right") - 1
        inside = maybe + SHINGLE <= offsets[docs + 1]
        maybe, docs = maybe[inside], docs[inside]
        starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(docs) else []
        for a, b in zip(starts, [*starts[1:], len(docs)]):
            out[first + docs[a]] = np.unique(grams[maybe[a:b]])
        sizes = np.diff(offsets)
        for d in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
            own = gram_hashes(words[offsets[d]:offsets[d + 1]], int(sizes[d])).view(np.int64)
            if in_bloom(table, own)[0]:
                out[first + d] = own
    return out


def _held(rows: DataFrame, bits: Broadcast) -> DataFrame:
    """doc_id, k1, k2, s of the `rows` (doc_id, k1, k2, text) with shingles that an item may have."""
    def make():
        def work(piece: pa.RecordBatch) -> dict:
            return {**{c: piece.column(c) for c in ("doc_id", "k1", "k2")}, "s": arrays(held_shingles(text_bytes(piece.column("text")), bits.value))}
        return work

    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, s array<long>"
    return map_text(rows, "text", ddl, make).filter("s is not null")


def contained(docs: DataFrame, items: DataFrame, *, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs) for an item table: doc_id, k1, k2 of the document rows that may hold an item, and k1, k2, h1, h2, n, shared of the
    distinct texts and the distinct sets they contain; k1, k2 stand for the text."""
    k1, k2 = row_key([text])
    rows = docs.select(F.col(doc_id).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    sets = kept(items.groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("n", "set", "sketch")]), "item-sets")
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(sets.select(F.explode("set").alias("s"))))  # 2^BLOOM_BITS bits
    found = kept(_held(rows, bits), "held")
    bits.destroy()  # the table is written: nothing asks for it again
    texts = kept(found.groupBy("k1", "k2").agg(F.first("s").alias("s")), "held-texts")
    said = texts.select("k1", "k2", F.size("s").alias("m"), F.explode("s").alias("s"))

    salt, each = F.pmod(F.xxhash64("k1", "k2"), F.lit(SALT)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))
    salted = sets.select("h1", "h2", "n", "set", "sketch", each.alias("salt"))
    sketches = salted.select("h1", "h2", "n", "salt", F.explode("sketch").alias("s"))
    pairs = said.withColumn("salt", salt).join(sketches, ["s", "salt"]).filter(100 * F.col("m") >= PERCENT * F.col("n"))
    pairs = pairs.select("k1", "k2", "h1", "h2", "salt").distinct()
    wanted = pairs.join(salted.select("h1", "h2", "n", "set", "salt"), ["h1", "h2", "salt"]).select("k1", "k2", "h1", "h2", "n", F.explode("set").alias("s"))
    shared = wanted.join(said.drop("m"), ["k1", "k2", "s"]).groupBy("k1", "k2", "h1", "h2", "n").agg(F.count(F.lit(1)).alias("shared"))
    return found.drop("s"), shared.filter(100 * F.col("shared") >= PERCENT * F.col("n"))


def contained_items(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                    item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_item, shared, containment: one row per document row and item row contained in it.

    Null and empty texts contain nothing and are contained in nothing; an item of fewer than five words is contained in the
    documents that are that word sequence. Repeated rows give repeated results; empty tables none. Other columns play no part.
    """
    known = item_table(items, item_id=item_id, text=item_text)
    rows, pairs = contained(docs, known, doc_id=doc_id, text=text)
    out = rows.join(pairs, ["k1", "k2"]).join(known.select("item_id", "h1", "h2"), ["h1", "h2"])
    return out.select("doc_id", "item_id", F.col("n").alias("n_item"), "shared", (F.col("shared").cast("double") / F.col("n")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """The rows of `docs` that contain no item; columns as in `docs`, of any name. Null and empty texts stay; an empty table stays empty."""
    _, pairs = contained(docs, item_table(items, item_id=item_id, text=item_text), doc_id=doc_id, text=text)
    bad = kept(pairs.select("k1", "k2").distinct(), "contaminated")
    k1, k2 = row_key([text])
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1.alias("k1"), k2.alias("k2"))
    return join_known(keyed, bad, bad.count(), ["k1", "k2"], "left_anti").select("row.*")
