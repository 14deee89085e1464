"""Token ids of whole texts in directly addressable codes.

File format: a table with one row per segment of at most `SEGMENT` tokens.

    part, seq      the run of the global order the segment belongs to, and its place there
    n_tokens       tokens of the segment
    doc_id, length the documents that begin or go on here, in order, and their tokens here; `opens` tells the former
    levels         level 0 holds the low 8 bits of every id, level k the next 8 bits of those ids that go on
    bitmaps        per level one continuation bit per entry, lowest bit first: set where the id has a further byte
    ranks          per level, little-endian uint32: the set bits before every run of `RUN` entries

Any token is read without decoding others: entry i of level 0; while its bit is set, entry rank(i) of the next level.
Parts are numbered in document order, so the tokens before a part are a prefix sum over one small row per part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import kept, lean, pieces, text_bytes
from postloom.operators.joins import join_known
from postloom.session import scratch_path

SEGMENT = 1 << 18
RUN = 512
END_ID = 2
CACHED = 1 << 19
TAILS = ".,;:!?$%&*#+="
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100), 0x153]))
SEGMENT_SCHEMA = ("part int, seq int, n_tokens long, doc_id array<long>, length array<long>, opens array<boolean>, "
                  "levels array<binary>, bitmaps array<binary>, ranks array<binary>")


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, bitmaps and rank directories of non-negative ids below 2^32."""
    levels, bitmaps, ranks, left = [], [], [], ids.astype(np.uint32)
    while True:
        more = left > 255
        levels.append((left & np.uint32(255)).astype(np.uint8).tobytes())
        bitmaps.append(np.packbits(more, bitorder="little").tobytes())
        counts = np.add.reduceat(more, np.arange(0, len(more), RUN), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks.append((np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4").tobytes())
        left = left[more] >> np.uint32(8)
        if not len(left):
            return levels, bitmaps, ranks


def access(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """Token `i`, from one entry per level."""
    value = 0
    for level, (entries, bits, directory) in enumerate(zip(levels, bitmaps, ranks)):
        value |= entries[i] << (8 * level)
        if not bits[i >> 3] >> (i & 7) & 1:
            return value
        run = i // RUN
        before = int.from_bytes(directory[4 * run:4 * run + 4], "little")
        head = np.unpackbits(np.frombuffer(bits[run * RUN // 8:(i >> 3) + 1], np.uint8), bitorder="little")
        i = before + int(head[:i - run * RUN].sum())
    raise ValueError("an id goes on behind the last level")


def unpack(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    out = np.frombuffer(levels[0], np.uint8).astype(np.uint32)
    at = np.arange(len(out))
    for level in range(1, len(levels)):
        more = np.unpackbits(np.frombuffer(bitmaps[level - 1], np.uint8), bitorder="little", count=len(at)).view(bool)
        at = at[more]
        out[at] |= np.frombuffer(levels[level], np.uint8).astype(np.uint32) << np.uint32(8 * level)
    return out


class Encoder:
    """Ids of a batch of texts. Ids never span a blank, so texts fall into chunks at blanks, and before a mark that ends a
    chunk behind a-z. The distinct chunks of a batch are encoded once and all ids gathered from there. At most about `CACHED` chunks of earlier
    batches are known, as flat arrays; they go with the task.

    A chunk of plain letters, with marks behind it, passes normaliser and pre-tokeniser in lower case and falls apart before the marks, so the
    letters go to the model alone, in the byte alphabet that the pre-tokeniser shows; whether that holds for a tokenizer is tried once."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model.tokenize
        shown = (lambda c: c) if self.tokenizer.pre_tokenizer is None else (lambda c: "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)))
        self.shown = {ord(x): shown(c) for c in LETTERS for x in (c, c.upper()) if len(x) == 1 and x.lower() == c}
        self.plain = re.compile(rf"([a-z{''.join(chr(c) for c in self.shown if c > 127)}]+)([{re.escape(TAILS)}]*)")
        if [t.id for t in self.model(LETTERS.translate(self.shown))] != self.tokenizer.encode(LETTERS, add_special_tokens=False).ids:
            self.plain = re.compile(r"(?!)")  # no chunk
        self._forget()

    def _forget(self) -> None:
        self.tails: dict[str, list[int]] = {}
        self.words, self.ids, self.counts = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _chunks(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """All chunks, and how many of them each text has. A-Z becomes a-z where no special string could be in a text."""
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        lower = _LOWER[raw]
        ends = np.cumsum([len(t) + 1 for t in texts])
        for i, t in enumerate(texts):
            if b"<|" in t:  # special strings are matched before the tokenizer lower-cases
                lower[ends[i] - 1 - len(t):ends[i]] = _BLANKS[raw[ends[i] - 1 - len(t):ends[i]]]
        inside = lower != 0x20
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        stop = _STOPS[lower[1:-1]] & ~inside[2:]
        begins[1:-1] |= stop & (lower[:-2] >= 0x61) & (lower[:-2] <= 0x7A)
        starts = np.flatnonzero(begins)
        sizes = np.cumsum(inside, dtype=np.int64)
        offsets = np.append(sizes[starts] - 1, sizes[-1]).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(lower[inside])))
        return chunks, np.diff(np.searchsorted(starts, ends), prepend=0)

    def _ids(self, chunk: str) -> list[int]:
        m = self.plain.fullmatch(chunk)
        if not m:
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        letters, tail = m.groups()
        ids = [t.id for t in self.model(letters if letters.isascii() else letters.translate(self.shown))]
        if tail:
            if tail not in self.tails and len(tail) < 9:
                self.tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
            ids += self.tails[tail] if tail in self.tails else self.tokenizer.encode(tail, add_special_tokens=False).ids
        return ids

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of each of the (distinct) words stand in `ids` and `counts`, which hold those of earlier batches too."""
        known = pc.index_in(words, value_set=self.words)
        new = words.filter(known.is_null())
        found = list(map(self._ids, new.to_pylist()))
        places = known.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        places[known.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))))
        self.counts = np.concatenate((self.counts, counts))
        self.words = pa.concat_arrays([self.words, new])
        return places

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind, and the bounds of the texts in them."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self.words) > CACHED:
            self._forget()
        chunks, per_text = self._chunks(texts)
        coded = chunks.dictionary_encode()
        places = self._places(coded.dictionary)
        ids, counts = np.append(self.ids, np.uint32(END_ID)), np.append(self.counts, 1)  # one chunk more, the end
        first = np.cumsum(counts) - counts
        ends = np.cumsum(per_text)
        order = np.insert(places[coded.indices.to_numpy(zero_copy_only=False)], ends, len(counts) - 1)
        sizes = counts[order]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        out = ids[np.repeat(first[order] - bounds[:-1], sizes) + np.arange(bounds[-1])]
        return out, np.concatenate(([0], bounds[ends + np.arange(1, len(texts) + 1)]))


_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".,;:!?"]] = True
_BLANKS = np.arange(256, dtype=np.uint8)
_BLANKS[[0x09, 0x0A, 0x0D]] = 0x20
_LOWER = _BLANKS.copy()
_LOWER[65:91] += 32


def write_tokens(docs: DataFrame, tokenizer_path: str, *, parts: int | None = None, doc_id: str = "doc_id",
                 text: str = "text", path: str | None = None) -> str:
    """Encode every whole text, end id behind each, in ascending doc_id order (nulls first; equal ids by text hash, equal
    rows as they come), and write the segments; returns the folder. Null or empty text: the end id alone. No rows: no
    segments. Other columns are not read. `parts` (shuffle partitions by default) is the number of range partitions;
    equal doc_ids are spread by the hash of their text. A task holds one segment and one document's ids at a time."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = ["doc_id", F.xxhash64("text")]
    ordered = (rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seq = Encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held, size, ids_of, lengths, opens = [], 0, [], [], []

        def segment():
            levels, bitmaps, ranks = pack(np.concatenate(held))
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "n_tokens": [size], "doc_id": [ids_of], "length": [lengths], "opens": [opens],
                 "levels": [levels], "bitmaps": [bitmaps], "ranks": [ranks]}, schema=schema)

        for piece in pieces(batches, "text"):
            flat, bounds = encode(text_bytes(piece.column("text")))
            for key, a, b in zip(piece.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                ids, first = flat[a:b], True
                while len(ids):
                    take = ids[:SEGMENT - size]
                    held.append(take.copy())  # not the whole batch
                    ids_of.append(key)
                    lengths.append(len(take))
                    opens.append(first)
                    size, ids, first = size + len(take), ids[len(take):], False
                    if size == SEGMENT:
                        yield segment()
                        held, size, ids_of, lengths, opens, seq = [], 0, [], [], [], seq + 1
        if size:
            yield segment()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SEGMENT_SCHEMA))
    ordered.mapInArrow(lean(run), SEGMENT_SCHEMA).write.parquet(path)
    return path


def crc32_joined(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings one behind the other, from theirs and the length of the second: `length` zero bytes act on the
    first as a linear map, whose powers of two are squared."""
    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit

    def times(matrix: list[int], vector: int) -> int:
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector, i = vector >> 1, i + 1
        return out

    left = 8 * length
    while left:
        if left & 1:
            first = times(step, first)
        step, left = [times(step, x) for x in step], left >> 1
    return first ^ second


def segment_starts(segments: DataFrame) -> DataFrame:
    """part, seq, start (tokens before the segment), opened (documents of the part that began before it): one small row per segment."""
    sizes = segments.select("part", "seq", "n_tokens", F.size(F.filter("opens", lambda o: o)).alias("n"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("part_start"))
    return sizes.join(F.broadcast(parts), "part").select(  # one row per range partition of the writer
        "part", "seq", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"),
        F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("opened"))


def read_tokens(spark, path: str) -> DataFrame:
    """Per document: doc_id, start (ids before it), n_tokens, ids_crc32 (unsigned, over little-endian uint32), from the files.

    Segments are read apart, wherever they lie; of a document that reaches over several, the checksums of its pieces are joined."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    starts = kept(segment_starts(segments), "segments")
    placed = join_known(segments, starts, starts.count(), ["part", "seq"], "inner")
    columns = ["doc_id", "start", "n_tokens", "ids_crc32", "part", "nth", "edge"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in ("part", "start", "opened", "levels", "bitmaps", "doc_id", "length", "opens")}
                ids, first, out = unpack(row["levels"], row["bitmaps"]).astype("<u4"), 0, []
                nth = row["opened"] - 1
                for i, (key, length, opens) in enumerate(zip(row["doc_id"], row["length"], row["opens"])):
                    nth += opens
                    edge = not opens or i == len(row["opens"]) - 1  # may have more pieces
                    out.append((key, row["start"] + first, length, zlib.crc32(ids[first:first + length]), row["part"], nth, edge))
                    first += length
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], columns)

    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.bool_()]
    found = kept(placed.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long, part int, nth long, edge boolean"), "pieces")

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for own in batch.column("pieces").to_pylist():  # one entry per segment the document reaches over
                crc = own[0]["crc"]
                for piece in own[1:]:
                    crc = crc32_joined(crc, piece["crc"], 4 * piece["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns[:3]), pa.array(crcs, pa.int64())], columns[:4])

    piece = F.struct("start", F.col("n_tokens").alias("n"), F.col("ids_crc32").alias("crc"))
    edges = found.filter("edge").groupBy("part", "nth").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    joined = edges.select("doc_id", "start", "n_tokens", "pieces").mapInArrow(lean(join), "doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.filter("not edge").select(*columns[:4]).unionByName(joined)
