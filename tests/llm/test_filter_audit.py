import itertools
import random
import re

from pyspark.sql import functions as F

from threadloom.llm import filter_audit


def plain_version(rows, labels):
    first, good, toxic = {}, set(), set()
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    for k, q, x in ((k, q, x) for k, q, x in labels if k is not None):
        good |= {k} if q == 1 else set()
        toxic |= {k} if x == 1 else set()
    docs = {}
    for k, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {"A"} if len(w) < 200 else set()
        failed |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        failed |= {"D"} if re.search("[#$%&*|]", t) else set()
        failed |= {"E"} if k is not None and first[t] < k else set()
        docs.setdefault(part or "", []).append((k, failed))
    out = []
    for part, every in docs.items():
        removed = {}
        got = []
        for order in itertools.permutations("ABCDE"):
            left = every
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removed[f] = removed.get(f, 0) + len(gone)
                fails = sum(f in d[1] for d in every)
                got.append(("".join(order), step, len(left), len(gone), fails - len(gone), sum(d[1] == {f} for d in every), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out += [(part, *g, removed[g[0][g[1] - 1]]) for g in got]
    return sorted(out)


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    head = "same head of many texts " * 30
    texts = [None, "", " ", "A", "#", "é" * 50, "A" + "b" * 49, "A" + "b" * 48, "x " * 199, "x " * 200, head, head + "a", head + "b", head[:-1]]
    texts += [" ".join(rng.choices(words, k=rng.choice((5, 100, 130, 250)))) + rng.choice(("", "", "|", " THE END")) for _ in range(80)]
    texts += [head + rng.choice(words) for _ in range(120)] + ["long " * 300_000 + "TAIL", " ".join(str(i) for i in range(210))]
    rows = [(i, rng.choice(texts), rng.choice((None, "", "a", "b", "b", "b"))) for i in range(500)]
    rows += [(600 + i, t, "all") for i, t in enumerate(texts)] + [(None, "", "a"), (None, "x", "a"), (7, "other text of 7", "b"), (7, "other text of 7", "b"), (2000, "other text of 7", "c")]
    labels = [(rng.randrange(700), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(500)] + [(None, 1, 1), (5, 1, 0), (5, 0, 1)]
    return rows, labels


def test_against_a_plain_version(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F.lit("clash")).withColumn("part", F.lit(1)).repartition(5)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(map(tuple, got)) == plain_version(rows, labels)
    assert len(got) == 600 * 5
    without = {r.part: r.good_lost for r in filter_audit.audit(docs).collect()}
    assert set(without) == {"", "a", "b", "c", "all"} and not any(without.values())


def test_windows_and_heavy_prefixes_change_nothing(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    first = {}
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    want = sorted({(k, t or "") for k, t, _ in rows if k is not None and first[t or ""] < k})
    texts = {filter_audit.xxhash.xxh3_128_digest((t or "").encode()): t or "" for _, t, _ in rows}
    for window, most in ((1 << 25, 1 << 26), (2000, 1), (1, 3000)):
        got = [(r.doc_id, texts[bytes(r.digest)]) for r in filter_audit.duplicates(docs, window=window, most_key_bytes=most).collect()]
        assert sorted(got) == want


def test_trie_holds_whole_texts():
    rng = random.Random(5)
    trie, least = filter_audit.Trie(), {}
    for i in rng.sample(range(4000), 4000):
        t = bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) * rng.choice((1, 1, 50))
        assert trie.least[trie.insert(t, i)] == least.setdefault(t, i) or i < least[t]
        least[t] = min(i, least[t])
    assert [(t, trie.least[at]) for at, t in trie.terminals()] == sorted(least.items())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert filter_audit.duplicates(docs).count() == 0
