"""The pipeline's stages and the operators' edge cases against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from threadloom.llm import html_extract, jaccard_join, langid, media, mixing, packing, quality, substring_dedup, token_counts, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("key", "g", "p", "n", "number", "first", "captures", "_salt", "_salts", "_row", "_n", "tokens", "cluster", "shard", "region", "set", "size", "links", "h", "t", "_k", "_s", "_t", "k0", "mix_pass", "mix_rank", "n_words", "kept", "score", "lang_pred", "host", "periods")


def corpus():
    rng = random.Random(21)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(300)]
    passage = " ".join(rng.choices(words, k=55))
    texts = []
    for i in range(60):
        t = rng.choices(words, k=rng.choice([4, 40, 120]))
        texts.append(" ".join(t))
        if i % 4 == 0:
            c = list(t)
            c[len(c) // 2] = "edited"
            texts.append(" ".join(c))
        if i % 6 == 0:
            texts.append(f"{' '.join(t[:20])} {passage} end{i}")
    texts += [None, "", "  \n ", "1234 !!", texts[3], texts[3].upper(), "a b", "long " * 4000]
    rng.shuffle(texts)
    return [(i, t, "en" if i % 3 else None, "big" if i % 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)] + [(None, "no key here at all", None, None, None), (7, "seven is here twice", "en", None, 1), (7, "seven is here twice", "en", None, 1), (9, "this one is nine but not the same", "en", None, 1)]


def shingle_set(t):
    w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_duplicates(rows):
    """Of each group of linked rows one of the smallest id, and all rows without an id."""
    some = sorted({r for r in rows if r[0] is not None}, key=str)
    sets = [shingle_set(r[1]) for r in some]
    least = list(range(len(some)))
    for a, b in itertools.combinations(range(len(some)), 2):
        if some[a][:2] == some[b][:2] or sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            p, q = least[a], least[b]
            least = [min(p, q) if v in (p, q) else v for v in least]
    groups = {}
    for r, v in zip(some, least, strict=True):
        groups.setdefault(v, []).append(r)
    return [min(g, key=lambda r: r[0]) for g in groups.values()] + [r for r in rows if r[0] is None]


def without_repeats(rows):
    windows = lambda t: list(zip(*((t or "").split()[i:] for i in range(13))))
    first = {}
    for r in rows:
        for w in windows(r[1]) if r[0] is not None else ():
            first[w] = min(first.get(w, r[0]), r[0])
    out = []
    for r in rows:
        gone = {j for i, w in enumerate(windows(r[1])) if r[0] is not None and first[w] < r[0] for j in range(i, i + 13)}
        text = " ".join(w for i, w in enumerate(r[1].split()) if i not in gone) if gone else r[1]
        out.append((r[0], text, r[2], r[3], len(text) if gone else r[4]))
    return out


def test_stages_against_plain_versions(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(pipeline.STAGES)

    def step(name, df):
        out = [tuple(r) for r in stages[name](spark, df, str(tmp_path)).select(*pipeline.COLUMNS).collect()]
        return out, spark.createDataFrame(out, DOCS)

    known, df = step("language_id", docs)
    assert sorted(known, key=str) == sorted([(*r[:2], r[2] or "en", *r[3:]) for r in rows if any(c.isalpha() for c in r[1] or "")], key=str)
    single, df = step("near_duplicates", df)
    assert sorted(single, key=str) == sorted(near_duplicates(known), key=str)
    assert len(single) < len(known) - 10
    clean, df = step("substring_dedup", df)
    assert sorted(clean, key=str) == sorted(without_repeats(single), key=str)
    assert clean != single
    mixed, df = step("mixing", df)
    times = {r: mixed.count(r) for r in clean}
    assert set(mixed) == set(clean) and set(times.values()) <= {1, 2} and 2 in times.values()
    words = {s: sum(len(r[1].split()) for r in clean if r[3] == s) for s in {r[3] for r in clean}}
    top = max(words, key=words.get)  # the largest source isn't repeated
    assert all(n == 1 for r, n in times.items() if r[3] == top)
    packed = stages["packing"](spark, df, str(tmp_path)).collect()
    assert sum(r.n_tokens for r in packed) == sum(len((r[1] or "").split()) for r in mixed)
    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.piece, r.n_tokens) for r in whole) == sorted((str(r.doc_id), r.piece, r.n_tokens) for r in packed)


def operators(spark, tokenizer):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    return {
        "mixing": lambda d: mixing.mix(d, max_repeats=2.0).select("doc_id", "text"),
        "substring_dedup": lambda d: substring_dedup.dedup(d),
        "media": lambda d: media.media_column(d).select("doc_id", "n_bytes", "payload_sha256"),
        "language_id": lambda d: langid.predict(d, langid.train(d)),
        "jaccard_join": lambda d: jaccard_join.classes(d),
        "packing": lambda d: packing.pack(d).groupBy("doc_id").agg(F.sum("n_tokens")),
        "token_counts": lambda d: token_counts.count_tokens(d, tokenizer),
        "quality": lambda d: quality.apply_rules(d, quality.train(d, labels)),
        "html": lambda d: html_extract.extract_text(d.select("*", F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))).select("page_id", "text"),
        "url_filter": lambda d: url_filter.filter_urls(d.select("*", F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.lit(1).alias("fetched_at")), spark.createDataFrame([], "list string, pattern string, at int, seq int, listed boolean")),
    }


@pytest.mark.parametrize("name", ["mixing", "substring_dedup", "media", "language_id", "jaccard_join", "packing", "token_counts", "quality", "html", "url_filter"])
def test_clashing_names_nulls_and_empty_tables(spark, name):
    P = pytest.importorskip("public_tokenizers")
    run = operators(spark, P.path("word_bpe_49k.json"))[name]
    docs = spark.createDataFrame(corpus()[:60] + [(900, None, None, None, None), (None, None, None, None, None), (900, None, None, None, None)], DOCS)
    plain = sorted(map(str, (tuple(r) for r in run(docs).collect())))
    extra = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))
    assert sorted(map(str, (tuple(r) for r in run(extra).collect()))) == plain
    assert len(plain) >= 55
    assert run(docs.where("false")).count() == 0
