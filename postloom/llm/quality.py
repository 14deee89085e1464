"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A whole text is compressed window by window with either dictionary; the difference of the two sizes over their sum is the one
feature. A logistic curve through it, fitted on labelled rows that made no dictionary, gives the score: the share of good rows
among rows like this one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import map_text, text_bytes

WINDOW = 2048
DICT_BYTES = 64 << 10
FIT_ROWS = 1500        # labelled rows a class for the dictionaries, and as many for the calibration
FIT_BYTES = 8192       # bytes of each such row that a dictionary is trained on
LEVEL = 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    bias: float


def _compressor(content: bytes, level: int = LEVEL):
    import zstandard as zstd

    if not content:
        return zstd.ZstdCompressor(level=level, write_content_size=False)
    data = zstd.ZstdCompressionDict(content)
    data.precompute_compress(level=level)
    return zstd.ZstdCompressor(dict_data=data, level=level, write_content_size=False, write_dict_id=False)


def build_dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself (newest last)."""
    import zstandard as zstd

    samples = [t[i:i + WINDOW] for t in texts for i in range(0, len(t), WINDOW) if t[i:i + WINDOW]]
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def difference(texts: list[bytes | None], good, bad) -> np.ndarray:
    """(bytes by the bad dictionary - bytes by the good one) / their sum, over all windows of each text; no text: 0."""
    out = np.zeros(len(texts))
    for k, text in enumerate(texts):
        g = b = 0
        for i in range(0, len(text or b""), WINDOW):
            piece = text[i:i + WINDOW]
            g += len(good(piece))
            b += len(bad(piece))
        if g + b:
            out[k] = (b - g) / (b + g)
    return out


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """Slope and bias of the logistic curve through (x, y), by Newton steps; the slope is never below 0."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w, keep = np.zeros(2), np.diag([ridge, ridge * 1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep + 1e-9 * np.eye(2), a.T @ (y - p) - keep @ w)
        w = np.clip(w + np.clip(step, -5, 5), -200, 200)
        if abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])) / scale, float(w[1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        rows: int = FIT_ROWS) -> QualityModel:
    """Learn from at most 2 * `rows` rows a class, the first by hash of the id, half for either step.

    `learn` is a condition on the labels' doc_id. Rows without a label of 0 or 1, or with both, teach nothing. A class without
    rows leaves an empty dictionary; without any labels the score is 0.5 for all.
    """
    known = labels.filter(learn).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("most"))
    known = known.filter("label = most and label in (0, 1)").withColumn("h", F.xxhash64("doc_id"))
    picked = [known.filter(F.col("label") == v).orderBy("h", "doc_id").limit(2 * rows) for v in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # at most 4 * rows ids
    taught = docs.select(F.col(doc_id).alias("doc_id"), F.substring(F.col(text), 1, FIT_BYTES).alias("head"), F.col(text).alias("text")).join(few, "doc_id")
    build = taught.filter("pmod(h, 2) = 0").select("label", "head").filter("head is not null").orderBy("label", "h", "head").collect()
    good, bad = (build_dictionary([r["head"].encode() for r in build if r["label"] == v]) for v in (1, 0))

    def make():
        g, b = _compressor(good).compress, _compressor(bad).compress
        return lambda piece: {"x": difference(text_bytes(piece.column("text")), g, b), "y": piece.column("label")}

    points = map_text(taught.filter("pmod(h, 2) = 1").select("text", F.col("label").cast("int").alias("label")), "text",
                      "x double, y int", make).collect()
    x, y = np.array([p["x"] for p in points]), np.array([p["y"] for p in points], float)
    slope, bias = calibrate(x, y) if len(points) else (0.0, 0.0)
    share = known.filter("label = most and label in (0, 1)").agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if min(*share, y.sum(), (1 - y).sum()) > 0:  # the sample holds the classes evenly, the corpus doesn't
        bias += math.log(share[0] / share[1]) - math.log(y.sum() / (1 - y).sum())
    return QualityModel(good, bad, slope, bias)


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` and its score, 0 to 1: higher, likelier good. Null and empty texts get the calibrated score of no difference.
    Empty tables stay empty; a column of that name is replaced, all others are kept."""
    columns = [c for c in docs.columns if c != name]
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + f", `{name}` double"

    def make():
        g, b = _compressor(model.good).compress, _compressor(model.bad).compress

        def work(piece: pa.RecordBatch) -> dict:
            x = difference(text_bytes(piece.column(text)), g, b)
            return {**{c: piece.column(c) for c in columns}, name: 1 / (1 + np.exp(-np.clip(model.slope * x + model.bias, -40, 40)))}
        return work

    return map_text(docs.select(*columns), text, ddl, make)
