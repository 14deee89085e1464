"""Language of whole texts by a byte convolutional network trained in numpy.

A text is cut into windows of `WINDOW` bytes, the last one padded with zeros. A window's bytes are embedded; filters of several
widths slide over them (one matrix product, the narrow ones padded with zeros), the largest response of each filter is kept and
a softmax over the known languages follows. A text's probabilities are the mean over its windows, weighed by their bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import map_text, text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 10
EMBED = 6
BATCH = 128
FIT_ROWS = 400       # texts a language
FIT_WINDOWS = 12     # windows of each such text, evenly over it
EPOCHS = 6
UNKNOWN = "und"


@dataclass
class ByteNet:
    langs: list[str]
    embed: np.ndarray    # 256 x EMBED
    filters: np.ndarray  # max(WIDTHS) * EMBED x filters
    bias: np.ndarray
    out: np.ndarray      # filters x langs
    out_bias: np.ndarray

    def windows(self, x: np.ndarray) -> np.ndarray:
        """The patches of each position of (n, WINDOW) bytes: a view."""
        wide = max(WIDTHS)
        e = np.zeros((len(x), WINDOW + wide - 1, EMBED), np.float32)
        np.take(self.embed, x, axis=0, out=e[:, :WINDOW])
        row = e.strides[0]
        return as_strided(e, (len(x), WINDOW, wide * EMBED), (row, EMBED * 4, 4))

    def respond(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        patches = self.windows(x)
        return patches, patches.reshape(-1, patches.shape[2]) @ self.filters

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        found = np.empty((len(x), len(self.langs)), np.float32)
        for i in range(0, len(x), BATCH):
            part = x[i:i + BATCH]
            _, response = self.respond(part)
            pooled = np.maximum(response.reshape(len(part), WINDOW, -1).max(1) + self.bias, 0)
            z = pooled @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            found[i:i + BATCH] = z / z.sum(1, keepdims=True)
        return found


def cut(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text and the bytes in each."""
    n = max(1, -(-len(text) // WINDOW))
    x = np.zeros(n * WINDOW, np.uint8)
    x[:len(text)] = np.frombuffer(text, np.uint8)
    sizes = np.full(n, WINDOW, np.float64)
    sizes[-1] = len(text) - (n - 1) * WINDOW
    return x.reshape(n, WINDOW), sizes


def train(x: np.ndarray, y: np.ndarray, langs: list[str], *, seed: int = 7, epochs: int = EPOCHS, rate: float = 5e-3) -> ByteNet:
    """Adam over shuffled batches; the gradient goes back through the largest response only."""
    rng, wide = np.random.default_rng(seed), max(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(wide) < w).astype(np.float32), EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1)
    k = mask.shape[1]
    net = ByteNet(langs, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                  (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(k, np.float32),
                  rng.normal(0, 0.1, (k, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = (len(y) / np.maximum(1, np.bincount(y, minlength=len(langs))))[y]
    weight = (weight / weight.mean()).astype(np.float32)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            xb, yb = x[rows], y[rows]
            patches, response = net.respond(xb)
            response = response.reshape(len(xb), WINDOW, k)
            at = response.argmax(1)
            pooled = np.maximum(np.take_along_axis(response, at[:, None, :], 1)[:, 0] + net.bias, 0)
            z = pooled @ net.out + net.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(yb)), yb] -= 1
            z *= weight[rows][:, None] / len(yb)
            back = (z @ net.out.T) * (pooled > 0)
            taken = patches[np.arange(len(xb))[:, None], at]
            grads = [np.zeros_like(net.embed), np.einsum("nk,nkc->ck", back, taken) * mask, back.sum(0), pooled.T @ z, z.sum(0)]
            to_patch = back[:, :, None] * net.filters.T[None]
            padded = np.concatenate((xb, np.zeros((len(xb), wide - 1), np.uint8)), 1)
            inside = at[:, :, None] + np.arange(wide) < WINDOW
            bytes_ = np.take_along_axis(padded[:, None, :], at[:, :, None] + np.arange(wide), 2)
            np.add.at(grads[0], bytes_[inside], to_patch.reshape(*at.shape, wide, EMBED)[inside])
            step += 1
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, learn: Column, *, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> ByteNet | None:
    """Learn from the first `rows` texts of each non-null language by hash, of the rows where `learn` holds; no such row: None.

    Only `FIT_WINDOWS` windows of a text leave the executors: at most rows * FIT_WINDOWS * WINDOW bytes a language.
    """
    known = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))

    def make():
        def work(piece: pa.RecordBatch) -> dict:
            out = []
            for t in text_bytes(piece.column("text")):
                x, _ = cut(t)
                out.append(x[np.unique(np.linspace(0, len(x) - 1, FIT_WINDOWS).astype(int))].tobytes())
            return {"lang": piece.column("lang"), "h": piece.column("h"), "x": out}
        return work

    few = known.select("lang", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= rows)
    picked = known.join(F.broadcast(few.select("lang", "h").distinct()), ["lang", "h"])  # at most `rows` pairs a language
    got = map_text(picked, "text", "lang string, h long, x binary", make).dropDuplicates(["lang", "h"]).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], r["h"]))
    langs = sorted({r["lang"] for r in got})
    each = [np.frombuffer(r["x"], np.uint8).reshape(-1, WINDOW) for r in got]
    y = np.repeat([langs.index(r["lang"]) for r in got], [len(e) for e in each])
    return train(np.concatenate(each), y, langs)


_ASCII, _WORDLIKE = re.compile(rb"[A-Za-z]"), re.compile(r"[^\W\d_]")


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_ASCII.search(text)) or any(m[0].isalpha() for m in _WORDLIKE.finditer(text.decode("utf-8", "replace")))


def predict(docs: DataFrame, net: ByteNet | None, *, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (the mean probability of that language). Null text or text without a letter: `und`, 0;
    so is every text where nothing was learned. Columns of those names are replaced, all others kept; empty tables stay empty."""
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", lang_pred string, score double"

    def make():
        def work(piece: pa.RecordBatch) -> dict:
            texts = text_bytes(piece.column(text))
            names, scores, held, owners, sizes = [UNKNOWN] * len(texts), np.zeros(len(texts)), [], [], []
            mean = np.zeros((len(texts), len(net.langs) if net else 1))

            def flush():
                p = net.probabilities(np.concatenate(held)) * np.concatenate(sizes)[:, None]
                np.add.at(mean, np.concatenate(owners), p)
                held.clear(), owners.clear(), sizes.clear()

            for i, t in enumerate(texts):
                if net and has_letter(t):
                    x, n = cut(t)
                    held.append(x), sizes.append(n / len(t)), owners.append(np.full(len(x), i))
                    if sum(map(len, held)) >= 4096:
                        flush()
            if held:
                flush()
            for i in np.flatnonzero(mean.sum(1) > 0):
                best = int(mean[i].argmax())
                names[i], scores[i] = net.langs[best], min(1.0, float(mean[i, best]))
            return {**{c: piece.column(c) for c in columns}, "lang_pred": names, "score": scores}
        return work

    return map_text(docs.select(*columns), text, ddl, make)
