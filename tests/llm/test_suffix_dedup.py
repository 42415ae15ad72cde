import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import suffix_dedup


def plain_version(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(t), sum(gone), sum(k for k, _ in itertools.groupby(gone)), bytes(b for b, g in zip(t, gone) if not g)))
    return out


def corpus(rng):
    words = ["ab", "é", "日本", "c d", "\n", "xyz", "\x00", "w"]
    own = lambda n: "".join(rng.choice(words) for _ in range(n))
    passages = [own(n) for n in (16, 20, 40, 90)]
    texts = [None, "", "short", "x" * 39, "x" * 40, "x" * 41, "y" * 300, "z" * 40, "z" * 39, "ab" * 50, "abc" * 90, "k" * 40 + "q" + "k" * 40]
    for _ in range(60):
        texts.append(own(rng.randrange(60)) + rng.choice(passages) + own(rng.randrange(60)))
    for t in texts[20:40]:
        texts += [t, t[: len(t) // 2] + "#" + t[len(t) // 2 :], t[5:]]
    return texts + [own(4000), "p" * 70_000 + "q"]


@pytest.mark.parametrize("hot", [4096, 3])
def test_against_brute_force(spark, hot):
    texts = corpus(random.Random(hot))
    rows = [(i if i % 9 else None if i else 1, t, f"s{i % 3}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    got = suffix_dedup.dedup(docs, length=40, carry=("source",), hot=hot).collect()
    want = [(k, s, n, gone, runs, kept) for (k, _, s), (n, gone, runs, kept) in zip(rows, plain_version(texts, 40), strict=True)]
    assert sorted(((*r[:5], bytes(r.kept)) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.n_removed > 0 for r in got) > 30 < sum(0 < r.n_removed < r.n_bytes for r in got)


def test_empty_and_wrong_arguments(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup(docs).count() == 0
    assert [r.n_removed for r in suffix_dedup.dedup(spark.createDataFrame([(1, None), (2, "a" * 400)], "doc_id long, text string")).collect()] == [0, 0]
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.dedup(docs, length=39)


def test_deep_shallow_sorts_suffixes():
    rng = random.Random(7)
    text = bytes(rng.choice(b"ab\0") for _ in range(1500)) + b"abcabc" * 40 + b"a" * 200
    strings = [text[i : i + 150] for i in range(len(text))]
    strings += strings[:200] + [b""] * 3
    rng.shuffle(strings)
    order, shared = suffix_dedup.deep_shallow(strings)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order.tolist()) == list(range(len(strings)))
    for a, b, n in zip(order, order[1:], shared[1:]):
        assert n == suffix_dedup.common_prefix(strings[a], strings[b]) and strings[a][:n] == strings[b][:n]
    for few in (1, 4000):  # tries alone, and quicksort as far as it goes
        was, suffix_dedup.FEW = suffix_dedup.FEW, few
        try:
            again, _ = suffix_dedup.deep_shallow(strings)
        finally:
            suffix_dedup.FEW = was
        assert [strings[i] for i in again] == sorted(strings)


def test_anchors_depend_on_the_window_alone():
    import pyarrow as pa

    rng = random.Random(8)
    same = "".join(rng.choice("abcdefgh ") for _ in range(90))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(200))) + same + "tail" * rng.randrange(9) for _ in range(50)] + ["a" * 500]
    spans = suffix_dedup.Spans(pa.table({"text": texts}), 40)
    at = {}
    for first, last, anchor in zip(spans.first.tolist(), spans.last.tolist(), spans.anchor.tolist()):
        for p in range(first, last + 1):
            assert 0 <= anchor - p < suffix_dedup.reach(40)
            assert at.setdefault(spans.joined[p : p + 40], anchor - p) == anchor - p
    assert int((spans.last - spans.first + 1).sum()) == sum(max(0, len(t) - 39) for t in texts)
    segment, suffix_dedup._SEGMENT = suffix_dedup._SEGMENT, 64
    try:
        again = suffix_dedup.Spans(pa.table({"text": texts}), 40)
    finally:
        suffix_dedup._SEGMENT = segment
    assert all(np.array_equal(getattr(spans, c), getattr(again, c)) for c in ("first", "last", "anchor"))
