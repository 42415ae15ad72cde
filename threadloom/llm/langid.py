"""Language ID: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed character n-grams (word ends included); a linear layer and a
softmax over the languages follow. Embeddings and layer are trained together by stochastic gradient descent in numpy,
on a bounded sample of labelled rows (`max_train`). Part of the sample is left out of training; on it a temperature is
fitted, and the score below which a prediction is rejected. For prediction, embeddings times layer fold into one small
table of a row per bucket, so a text costs one histogram and one product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

BUCKETS = 4096
MAX_GRAM = 3
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-cased words of letters alone, one space around each; empty if there is no letter."""
    if not text:
        return ""
    s = _NOT_LETTERS.sub(" ", text.lower())
    return f" {s.strip()} " if any(map(str.isalpha, s)) else ""


def histogram(s: str) -> np.ndarray:
    """How many n-grams of 1 to MAX_GRAM characters fall into each bucket."""
    c = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    out, h = np.zeros(BUCKETS, np.int64), np.zeros(len(c), np.uint32)
    for n in range(1, MAX_GRAM + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
        m = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out += np.bincount(m >> np.uint32(20), minlength=BUCKETS)
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score and whether it is rejected."""
        s = letters(text)
        if not s or not self.langs:
            return UNKNOWN, 0.0, True
        h = histogram(s)
        p = _softmax((h @ self.table / h.sum() + self.bias)[None] / self.temperature)[0]
        i = int(p.argmax())
        return self.langs[i], float(p[i]), bool(p[i] < self.reject_below)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], *, dim: int = 16, epochs: int = 12, rate: float = 0.2, batch: int = 32, seed: int = 7, reject_share: float = 0.001, reject_most: float = 0.5) -> Model:
    """Train on rows x (histograms divided by their sums) with classes y; every fifth row calibrates.

    The rejection score is the one that `reject_share` of the rightly predicted calibration rows stay below, at most
    `reject_most`: what is as sure as the training texts is never rejected.
    """
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    e = rng.normal(0, 1, (BUCKETS, dim)) / np.sqrt(dim)
    w, b = np.zeros((dim, len(langs))), np.zeros(len(langs))
    scale = np.sqrt(BUCKETS) / 4
    own = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            v = x[rows] * scale
            hidden = v @ e
            g = _softmax(hidden @ w + b)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = g @ w.T
            w -= step * hidden.T @ g
            b -= step * g.sum(0)
            e -= step * v.T @ back
    table = e @ w * scale
    check = np.flatnonzero(held) if held.any() else own
    z = x[check] @ table + b
    at = np.arange(len(check))
    loss = {t: -np.log(_softmax(z / t)[at, y[check]] + 1e-12).mean() for t in np.geomspace(0.25, 16, 49)}
    temperature = float(min(loss, key=loss.get))
    p = _softmax(z / temperature)
    right = p.max(1)[p.argmax(1) == y[check]]
    return Model(langs, table, b, temperature, float(min(np.quantile(right, reject_share), reject_most)) if len(right) else 0.0)


def train(labelled: DataFrame, *, max_train: int = 4000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of at most `max_train` rows of `labelled` with a language and a letter, first by a hash of their key.

    Histograms, not texts, reach the driver: their size is bounded however long a text is. Of rows that repeat a key the
    one with the least language and histogram counts, so the model doesn't depend on their order. Without any row the
    model knows no language and rejects everything.
    """
    chosen = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(key).agg(F.min(lang).alias(lang)).orderBy(F.xxhash64(key), key).limit(max_train)
    have = labelled.select(key, text).join(F.broadcast(chosen), key)  # at most max_train rows are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys, texts, langs = (b.column(i).to_pylist() for i in range(3))
            rows = [(k, t, s) for k, x, t in zip(keys, texts, langs, strict=True) if (s := letters(x))]
            if not rows:
                continue
            packed = []
            for _, _, s in rows:
                h = histogram(s)
                at = np.flatnonzero(h)
                packed.append(at.astype(np.uint16).tobytes() + (h[at] / h.sum()).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array(packed, pa.binary())], names=["key", "lang", "h"])

    kind = dict(labelled.dtypes)[key]
    rows = have.select(key, text, F.col(lang).cast("string")).mapInArrow(run, f"key {kind}, lang string, h binary").groupBy("key").agg(F.min(F.struct("lang", "h")).alias("r")).select("key", "r.*").collect()
    rows.sort(key=lambda r: r[0])
    langs = sorted({r[1] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        n = len(r[2]) // 6
        x[i, np.frombuffer(r[2][: 2 * n], np.uint16)] = np.frombuffer(r[2][2 * n :], np.float32)
    return fit(x, np.array([langs.index(r[1]) for r in rows]), langs)


def predict(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred, score (0 to 1) and rejected.

    A null text or one without letters is `und` with score 0, rejected. Rows pass one by one.
    """
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [model.predict(t) for t in b.column(0).to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            cols = [*(b.column(i + 1) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*(f"k{i}" for i in range(len(keep))), "lang_pred", "score", "rejected"])

    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), "lang_pred string, score double, rejected boolean"])
    out = docs.select(F.col(text).alias("_t"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).mapInArrow(run, schema)
    return out.toDF(*keep, "lang_pred", "score", "rejected")


def held_out(key: Column) -> Column:
    """Whether a document is never learned from: crc32 of its key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
