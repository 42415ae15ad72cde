import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(key, text, seed=42):
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_a_plain_version(spark):
    rng = random.Random(1)
    texts = [None, "", " ", " \n", "a", " a", "a ", "a  b\t", "<P>", "x <S> y", "<<P", "<P S>", "é ü z 日本 \x00 \x1c", "𝄞 " * 700, "x" * 300_000, "ab cd\n" * 40_000]
    texts += ["".join(rng.choice("ab <>PSM\n\té日") for _ in range(rng.randrange(40))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b c d"), (3, "again 3"), (3, "again 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit(0)).repartition(3)
    got = fill_middle.restore(fill_middle.transform(docs)).collect()
    want = [(k, *plain_version(k, t or ""), t or "") for k, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rotation_is_in_place_and_blocks_may_be_empty():
    rng = random.Random(2)
    was, fill_middle.STEP = fill_middle.STEP, 3
    try:
        for _ in range(300):
            b = bytearray(rng.randbytes(rng.randrange(30)))
            start, border, end = sorted(rng.randrange(len(b) + 1) for _ in range(3))
            want = b[:start] + b[border:end] + b[start:border] + b[end:]
            same = b
            fill_middle.rotate(b, start, border, end)
            assert b == want and b is same
    finally:
        fill_middle.STEP = was


def test_kept_columns_and_clashes(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert fill_middle.transform(docs, keep=("lang",), plain_percent=0).columns == ["doc_id", "lang", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {r.form for r in fill_middle.transform(docs, plain_percent=0).collect()} == {"plain"}
    with pytest.raises(ValueError, match="form"):
        fill_middle.transform(docs.withColumn("form", F.lit(1)), keep=("form",))
    assert fill_middle.transform(docs.limit(0)).count() == 0
    r = fill_middle.restore(fill_middle.transform(docs).withColumn("form", F.lit(None).cast("string")))
    assert [x.restored for x in r.collect()] == [None, None]
