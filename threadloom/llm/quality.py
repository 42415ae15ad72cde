"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are grown here in numpy on a bounded sample of labelled rows (`max_train`), with monotonic constraints: more
symbols, repeats or shouting can never raise a score. A grown forest is flattened into node arrays, which tasks walk
for a whole batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK_BYTES, slices

SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGIT, _SHOUT = bytes(range(65, 91)), bytes(range(48, 58)), b"!?"
#: Name and direction of each statistic: -1 if a larger value may never raise the score.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "shout_share": -1,
    "mark_word_share": -1,
    "echo_share": -1,
    "digit_share": 0,
    "distinct_share": 1,
}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _without(b: bytes, drop: bytes) -> int:
    return len(b) - len(b.translate(None, drop))


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the values of FEATURES."""
    b = (text or "").encode()
    words = b.split()
    n = len(words)
    if not n:
        return [0, 0, 0, 0, 0], [0.0] * len(FEATURES)
    word_chars = len(text) - _without(b, BLANK_BYTES)
    symbols = _without(b, SYMBOLS)
    lines = [x for x in b.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    code: dict[bytes, int] = {}
    ids = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
    repeat = _repeat_words(ids, len(code))
    marks = sum(1 for w in words if len(w) < 4 and not w.translate(None, SYMBOLS + b".,;:!?-_+=/"))
    size = len(b)
    base = [n, word_chars, symbols, dup_lines, repeat]
    return base, [
        float(np.log1p(n)),
        word_chars / n,
        symbols / size,
        dup_lines / len(lines),
        repeat / n,
        _without(b, _UPPER) / size,
        _without(b, _SHOUT) / size,
        marks / n,
        float((ids[1:] == ids[:-1]).sum()) / n,
        _without(b, _DIGIT) / size,
        len(code) / n,
    ]


def _repeat_words(ids: np.ndarray, k: int) -> int:
    """Words that lie in a 3-word window found at least twice."""
    if len(ids) < 4:
        return 0
    if k < 2_000_000:
        window = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # a product of three would not fit 64 bits
        _, pair = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)
        window = pair * k + ids[2:]
    s = np.sort(window)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(window, twice)
    cover = np.zeros(len(ids), bool)
    for i in range(3):
        cover[i : len(ids) - 2 + i] |= hit
    return int(cover.sum())


@dataclass
class Forest:
    """Trees as one set of node arrays. A leaf points at itself, so that a walk of `depth` steps ends in it."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality by row of x."""
        z, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.root:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            z += self.value[at]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, direction: list[int], *, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 64, min_weight: float = 2.0) -> Forest:
    """Histogram boosting on logistic loss. A split on a constrained feature is taken only if its leaves are in order,
    and the halves keep to either side of their mean further down, so the whole forest is monotonic in that feature."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    z = np.full(len(y), np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-total_g / (total_h + ridge), low, high))
        nodes.append([0, np.inf, me, me, value * rate])
        best = (1e-6, -1, -1, 0.0, 0.0)
        if level < depth and len(rows) > 1:
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                gl = np.bincount(code[rows, f], g[rows], len(cuts[f]) + 1).cumsum()[:-1]
                hl = np.bincount(code[rows, f], h[rows], len(cuts[f]) + 1).cumsum()[:-1]
                gr, hr = total_g - gl, total_h - hl
                a, b = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(a * gl + 0.5 * a * a * (hl + ridge)) - (b * gr + 0.5 * b * b * (hr + ridge)) + value * total_g + 0.5 * value * value * (total_h + ridge)
                gain[(hl < min_weight) | (hr < min_weight) | (direction[f] * (b - a) < 0)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), f, i, float(a[i]), float(b[i]))
        _, f, i, a, b = best
        if f >= 0:
            left = code[rows, f] <= i
            middle = (a + b) / 2
            bound = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[direction[f]]
            nodes[me][:2] = [f, cuts[f][i]]
            nodes[me][2] = grow(rows[left], g, h, level + 1, *bound[0])
            nodes[me][3] = grow(rows[~left], g, h, level + 1, *bound[1])
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        tree = _flat(nodes, roots[-1:], 0.0, depth)
        rows, at = np.arange(len(y)), np.full(len(y), roots[-1])
        for _ in range(depth):
            at = np.where(x[rows, tree.feature[at]] <= tree.threshold[at], tree.left[at], tree.right[at])
        z += tree.value[at]
    return _flat(nodes, roots, float(np.log(share / (1 - share))), depth)


def _flat(nodes: list[list[float]], roots: list[int], bias: float, depth: int) -> Forest:
    a = np.array(nodes, float).reshape(-1, 5)
    whole = lambda c: a[:, c].astype(np.int64)
    return Forest(np.array(roots, np.int64), whole(0), a[:, 1], whole(2), whole(3), a[:, 4], bias, depth)


def train(docs: DataFrame, labels: DataFrame, *, max_train: int = 20_000, key: str = "doc_id", text: str = "text", label: str = "quality") -> Forest | None:
    """A forest fitted on at most `max_train` labelled documents, those that come first by a hash of their key.

    Labels of one key that differ count as the lowest, texts of one key as the one of the least statistics, so the forest
    doesn't depend on their order. None if fewer than two classes are left.
    """
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_label")).orderBy(F.xxhash64(key), key).limit(max_train)
    have = docs.select(key, text).join(F.broadcast(chosen), key)  # at most max_train rows are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [measure(t)[1] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.float64()), pa.array(x, pa.list_(pa.float64()))], names=["key", "y", "x"])

    kind = dict(docs.dtypes)[key]
    rows = have.select(key, text, F.col("_label").cast("double")).mapInArrow(run, f"key {kind}, y double, x array<double>").groupBy("key").agg(F.min(F.struct("y", "x")).alias("r")).select("key", "r.*").collect()
    rows.sort(key=lambda r: r[0])
    x, y = np.array([r[2] for r in rows]), np.array([r[1] > 0 for r in rows], float)
    return fit(x, y, list(FEATURES.values())) if len(set(y)) > 1 else None


def apply_rules(docs: DataFrame, forest: Forest | None, *, keep_above: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    A null or blank text has no words and fails the base rules. Without a forest, the base rules alone decide and score
    is null. Rows pass one by one: repeated rows and null keys stay, other columns aren't read.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if not b.num_rows:
                continue
            base, x = zip(*map(measure, b.column(1).to_pylist()), strict=True)
            base = np.array(base, np.int64)
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
            score = forest.score(np.array(x)) if forest else None
            kept = ~failed if score is None else ~failed & (score >= keep_above)
            cols = [b.column(0), *map(pa.array, base.T.copy()), pa.array(failed), pa.array(kept), pa.nulls(len(kept), pa.float64()) if score is None else pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", *names, "base_failed", "kept", "score"])

    kind = dict(docs.dtypes)[key]
    counts = ", ".join(f"{n} long" for n in names)
    return docs.select(key, text).mapInArrow(run, f"key {kind}, {counts}, base_failed boolean, kept boolean, score double").withColumnRenamed("key", key)
