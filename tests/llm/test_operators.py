import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from threadloom.llm import common, components, html_extract, jaccard_join, langid, media, mixing, packing, quality, queries, substring_dedup, token_counts, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    out = []
    for i in range(120):
        t = rng.choices(words, k=rng.choice([3, 20, 80, 200]))
        out.append(" ".join(t))
        if i % 3 == 0:
            for _ in range(rng.randrange(1, 4)):
                c = list(t)
                for _ in range(len(t) // 60):
                    c[rng.randrange(len(c))] = "edit"
                out.append(" ".join(c).upper() if i % 2 else "\n".join(c))
        if i % 5 == 0:
            out.append(f"{' '.join(t[:9])} {passage} tail{i}")
    out += [None, "", "   ", "ab cd", "ab cd", passage * 40, "x " * 3000]
    rng.shuffle(out)
    return [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate(out)] + [(None, "a b c", None, None, None), (5, "twice five", "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("clash")).withColumn("g", F.lit(1)).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_substring_dedup_against_brute_force(spark, docs, rows):
    first = {}
    windows = [((k, t), tuple(zip(*((t or "").split()[i:] for i in range(13))))) for k, t, *_ in rows]
    for (k, _), ws in windows:
        for w in ws if k is not None else ():
            first[w] = min(first.get(w, k), k)
    want = []
    for (k, t), ws in windows:
        words = (t or "").split()
        gone = {j for i, w in enumerate(ws) if k is not None and first[w] < k for j in range(i, i + 13)}
        want.append((k, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    got = [tuple(r) for r in substring_dedup.dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in got) > 500
    assert substring_dedup.dedup(empty(spark)).count() == 0


def dedup_in_place(rows, groups, adds):
    """The passes of substring dedup without Spark: (key, n_removed) of all rows, and the words of each automaton."""

    class Counting(substring_dedup.Automaton):
        def __init__(self):
            super().__init__()
            adds.append(0)

        def add(self, words, key):
            adds[-1] += len(words)
            super().add(words, key)

    S, by = substring_dedup, lambda ts, c: (lambda t: {v: t.filter(pc.equal(t.column(c), v)) for v in t.column(c).unique().to_pylist()})(pa.concat_tables(ts))
    was, S.Automaton = S.Automaton, Counting
    try:
        dealt = {g: pa.table({"g": pa.array([g] * len(r), pa.int64()), "key": [k for k, _ in r], "text": [t for _, t in r]}) for g in range(groups) if (r := rows[g::groups])}
        met = by([S.frequencies.classify_as(t, S.COUNTED) for t in by([S.profile(t, 13, groups) for t in dealt.values()], "shard").values()], "g")
        sent = by([S.send(t, met[g], 13, groups, groups) for g, t in dealt.items()], "shard")
        back = by([S.match(t, 13) for t in sent.values()], "g")
        told = {g: pa.concat_tables([met[g], *([back[g]] if g in back else [])], promote_options="default") for g in dealt}
        empty = pa.schema([("digests", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("windows", pa.binary())]).empty_table()
        out = [S.remove(t, pa.concat_tables([told[g], empty], promote_options="default"), 13, groups, False) for g, t in dealt.items()]
        return sorted((k, n) for t in out for k, n in zip(t.column("key").to_pylist(), t.column("n_removed").to_pylist()))
    finally:
        S.Automaton = was


@pytest.mark.parametrize("kind", ["phrase", "repeated", "passage"])
def test_a_hot_minimizer_fills_no_automaton(kind):
    rng = random.Random(3)
    own = lambda n: [f"u{rng.randrange(1 << 40)}" for _ in range(n)]
    # four words of a low hash are the minimizer wherever they stand
    phrase = min((own(4) for _ in range(3000)), key=lambda p: substring_dedup.gram_hashes(substring_dedup.hashed_words([" ".join(p).encode()])[0], 4)[0])
    passage = own(3) + phrase + own(30)
    rows = []
    for i in range(4000):
        if kind == "phrase":  # what surrounds it is another text everywhere
            t = own(12) + phrase + own(12)
        elif kind == "repeated":  # one document has the phrase many times
            t = sum((own(12) + phrase for _ in range(1500)), []) if i in (7, 1200) else own(15)
        else:
            t = own(9) + passage + own(9)
        rows.append((i, " ".join(t)))
    rows += [(5000, rows[7][1]), (4999, rows[8][1] + " end"), (5001, "x " * 9000), (5002, "y " + "x " * 9000)]
    first, want = {}, []
    ws = {k: list(zip(*(t.split()[i:] for i in range(13)))) for k, t in rows}
    for k in sorted(ws):
        for w in ws[k]:
            first.setdefault(w, k)
        want.append((k, len({j for i, w in enumerate(ws[k]) if first[w] < k for j in range(i, i + 13)})))
    adds = []
    assert dedup_in_place(rows, 3, adds) == want
    assert max(adds, default=0) < 46_000  # an automaton's words and one minimizer's


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


#: Hosts as browsers take them.
HOSTS = {
    "http://[2001:db8::1]/": "[2001:db8::1]", "http://[2001:DB8::2]:80/x": "[2001:db8::2]", "http://u:p@[::1]:9/": "[::1]", "http://user:p@ss@h.com/": "h.com", "http://a.com\\@b.com/": "a.com",
    "http:\\\\a.com\\x": "a.com", "https://A.Com.:443?q@z.com": "a.com", "http://a.com#@b.com": "a.com", " \thttp://a.c\nom/": "a.com", "ftp://x": "x", "http://": None, "http:///p": None, "mailto:a@b.com": None,
    "a.com/x": None, "": None, "http://:80/": None, "http://@/": None, "http://a b.com/": "a b.com", "HTTP://BÜCHER.de/": "bücher.de",
}


def test_hosts_of_urls(spark):
    got = spark.createDataFrame([(u,) for u in [*HOSTS, None]], "url string").select("url", url_filter.host(F.col("url"))).collect()
    assert {u: h for u, h in got} == {**HOSTS, None: None}


def test_words_made_to_collide_dont(spark):
    from threadloom.llm.common import hashed_words

    words = {f(n, *x) for n in (64, 1024, 4096) for f in (thue_morse, lambda n, a, b: thue_morse(n, b, a)) for x in ("ab", "cz", "01")}
    words |= {w[i : i + 8 * k] for w in words for i in range(0, 64, 8) for k in (1, 2, 3)}
    words |= {"\0" * i + x + "\0" * j for x in ("", "a") for i in range(30) for j in range(30)} - {""}
    words = [w.encode() for w in words]
    assert len(set(hashed_words(words)[0].tolist())) == len(words)
    texts = [f"one two three four {thue_morse(1024, *x)}" for x in ("ab", "ba")]
    texts += [f"{texts[0]} five six", f"{texts[1]} five six", "one two", "one  two", "one two three", "a a a a a", "a a a a a a", "a a a a"]
    got = jaccard_join.classes(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 0), (1, 1, 1), (2, 3, 2), (3, 3, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 7), (9, 1, 9)]


@pytest.mark.parametrize("chunk", [1024, 3])
def test_jaccard_classes_against_brute_force(spark, docs, rows, chunk, monkeypatch):
    if chunk == 3:  # hot keys are dealt over tasks
        monkeypatch.setattr(common, "SALTED_FROM", 0)
    sets = {}
    for k, t, *_ in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets.setdefault(k, []).append(s)
    root = {k: k for k in sets if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if any(100 * len(x & y) >= 80 * len(x | y) > 0 for x in sets[a] for y in sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = jaccard_join.classes(docs, chunk=chunk).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id))
        assert r.n_shingles in [len(s) for s in sets[r.doc_id]]
    assert jaccard_join.classes(empty(spark)).count() == 0


def test_region_cells_are_exact():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 1 << 40, 100) for _ in range(12)]
    sets = [np.unique(np.where(rng.random(100) < 0.06, rng.integers(0, 1 << 40, 100), base[i % 12])).astype(np.uint64) for i in range(240)]
    region = jaccard_join.Region(list(range(240)), sets, 80)
    region.join(list(range(240)))
    want = list(range(240))
    for a, b in itertools.combinations(range(240), 2):
        c = len(np.intersect1d(sets[a], sets[b]))
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            x, y = want[a], want[b]
            want = [min(x, y) if v in (x, y) else v for v in want]
    classes = {}
    for i in range(240):
        classes.setdefault(region._find(i), set()).add(i)
    wanted = {}
    for i, v in enumerate(want):
        wanted.setdefault(v, set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, wanted.values()))


def test_tiles_find_the_links_of_a_large_region(spark):
    rng = random.Random(8)
    core = [f"c{i}" for i in range(120)]
    texts = []
    for i in range(150):  # all share passages, few are near copies: regions keep more than a chunk
        own = rng.sample(range(120), rng.choice([2, 4, 8]))
        texts.append(" ".join(f"x{rng.randrange(4)}" if j in own else w for j, w in enumerate(core[: rng.choice([90, 105, 120])])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    want = list(range(150))
    for a, b in itertools.combinations(range(150), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            want = [min(want[a], want[b]) if v in (want[a], want[b]) else v for v in want]
    for chunk in (4, 1024):
        assert {r.doc_id: r.component_id for r in jaccard_join.classes(docs, chunk=chunk).collect()} == dict(enumerate(want))
    assert len(set(want)) > 10


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (7, 7), (None, 3)], "a long, b long")
    got = dict(tuple(r) for r in components.components(links).collect())
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 100: 90}


def test_media_round_trip(spark, docs, rows, tmp_path):
    got = media.media_column(docs, path=str(tmp_path / "a")).collect()
    want = sorted((str(k), hashlib.sha256(media.payload(t)).hexdigest(), len((t or "").encode())) for k, t, *_ in rows)
    assert sorted((str(r.doc_id), r.payload_sha256, r.n_bytes) for r in got) == want
    assert all(r.payload_bytes % 576 == 0 and r.payload_bytes for r in got)
    small = media.load(spark, str(tmp_path / "a"), split=200)
    assert small.count() == len(rows)
    assert media.load(spark, str(tmp_path / "none")).count() == 0


def test_media_member_is_tried_again(tmp_path):
    class Flaky:
        fails = 2

        def open_input_file(self, path):
            if Flaky.fails:
                Flaky.fails -= 1
                raise OSError("gone")
            return media.pafs.LocalFileSystem().open_input_file(path)

    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m", b"data")
        info = z.infolist()[0]
    with media.Members(Flaky(), str(tmp_path / "z.zip"), 3) as m:
        assert m.read(info.header_offset, info.file_size, info.CRC, "m") == b"data"
    with media.Members(media.pafs.LocalFileSystem(), str(tmp_path / "z.zip"), 2) as m, pytest.raises(OSError):
        m.read(info.header_offset, info.file_size, info.CRC ^ 1, "m")


def test_packing_holds_its_conditions(spark, docs, rows):
    got = packing.pack(docs, capacity=64, max_per_source=2).collect()
    words = sum(len((t or "").split()) for _, t, *_ in rows)
    assert sum(r.n_tokens for r in got) == words
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    assert all(sum(r.n_tokens for r in b) <= 64 for b in bins.values())
    text = {k: t for k, t, *_ in rows}
    for b in bins.values():
        seen = [(text[r.doc_id] or "").lower() for r in b if r.doc_id not in (None, 5)]
        assert len(seen) == len(set(seen))
    assert packing.pack(empty(spark)).count() == 0


def test_no_bin_of_op8_holds_near_copies(spark, tmp_path):
    rng = random.Random(6)
    texts = []
    for i in range(25):
        t = [f"é{i}x{rng.randrange(90)}" for _ in range(rng.choice([40, 70]))]
        chain = [list(t)]
        for _ in range(3):  # each a near copy of the one before
            chain.append([*chain[-1]])
            chain[-1][rng.randrange(len(t))] = f"edit{rng.randrange(1000)}"
        texts += [" ".join(chain[0]), "\n".join(chain[0]), *(" ".join(c) for c in chain[1:]), chain[0][0] + " alone", " ".join(t).upper()]
    texts += [None, "", "a b", "A b"]
    rows = [(i, t, None, f"s{i}", 0) for i, t in enumerate(texts)] + [(None, texts[0], None, "n1", 0), (None, texts[0].upper(), None, "n2", 0), (3, "another text of a key", None, "n3", 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_best_fit_packing(spark, str(tmp_path)).collect()
    assert sum(r.n_tokens for r in got) == sum(len((t or "").split()) for _, t, *_ in rows)
    assert len(got) == len(rows)
    words = [(t or "").encode().lower().split() for _, t, *_ in rows]
    sets = [frozenset(zip(*(w[j:] for j in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in words]
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0 or (rows[a][1] or "").lower() == (rows[b][1] or "").lower()
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if linked(a, b) or rows[a][0] is not None and rows[a][0] == rows[b][0]:
            root = [min(root[a], root[b]) if v in (root[a], root[b]) else v for v in root]
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r.doc_id)
    of = {k: root[i] for i, (k, *_) in enumerate(rows)}  # rows without a key are all in the class of the first text
    for b in bins.values():
        assert len({of[k] for k in b}) == len(b)
    assert len(bins) < 20


def test_clusters_count_words_where_they_are_hashed(spark, docs, monkeypatch):
    odd = [(1000, "\x0b a\u00a0b\x0cc\r\n", None, "o", 0), (1001, "w" * (common.SEGMENT + 9) + " é " + "x" * 30, None, "o", 0), (1001, " \t", None, "p", 0), (None, "\x1f\x85 \u2003", None, None, 0)]
    rows = docs.select("doc_id", "source", "text").unionByName(spark.createDataFrame(odd, DOCS).select("doc_id", "source", "text"))
    want = sorted((tuple(r) for r in rows.select("doc_id", "source", common.word_count(F.col("text")), packing.exact_hash("text")).collect()), key=str)

    def again(text):
        raise AssertionError("words are counted by a pass of its own")

    monkeypatch.setattr(packing, "word_count", again)
    got = packing.with_clusters(rows).collect()
    assert sorted(((r.doc_id, r.source, r.tokens) for r in got), key=str) == sorted((r[:3] for r in want), key=str)
    assert all((r.doc_id, r.source, 0, r.cluster) in want for r in got if not r.tokens)  # no words, no class


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(5)
    sizes, sources, clusters = ([rng.randrange(1, 50) for _ in range(300)], [rng.randrange(4) for _ in range(300)], [rng.randrange(40) for _ in range(300)])
    at = packing.best_fit(sizes, sources, clusters, 100, 2)
    bins = []
    for k in sorted(range(300), key=lambda k: (-sizes[k], k)):
        fits = [(100 - sum(sizes[i] for i in b), j) for j, b in enumerate(bins) if sum(sizes[i] for i in b) + sizes[k] <= 100 and clusters[k] not in [clusters[i] for i in b] and [sources[i] for i in b].count(sources[k]) < 2]
        if not fits:
            bins.append([])
        j = min(fits)[1] if fits else len(bins) - 1
        bins[j].append(k)
        assert at[k] == j


def test_tokens_like_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [None, "", "It's 12½ <|endoftext|> Ünïcödé!!", "日本語 Σς İ", "x" * 3000, "a\x00b\x1c c\x85d\xa0e", "the " * 3000]
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert [r.over_limit for r in sorted(got)] == [False] * 6 + [True]


def test_quality_counts_and_monotony():
    base, _ = quality.measure("a b c a b c\nx #$ y\nx #$ y\n\n é")
    assert base == [13, 15, 4, 1, 12]
    assert quality.measure(None)[0] == [0] * 5
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    y = (x[:, 0] + rng.normal(0, 0.3, 600) < 0.6).astype(float)
    f = quality.fit(x, y, [-1, 0])
    line = np.stack([np.linspace(0, 1, 50), np.full(50, 0.4)], 1)
    assert (np.diff(f.score(line)) <= 1e-12).all()
    assert ((f.score(x) > 0.5) == (y > 0)).mean() > 0.75


def test_language_id_learns_and_rejects(spark):
    rng = random.Random(1)
    kinds = {"aa": "zor mip tok", "bb": "élu ñan içe"}
    rows = [(i, " ".join(rng.choices(w.split(), k=30)), k) for i in range(200) for k, w in [rng.choice([*kinds.items()])]] + [(900, None, "aa"), (901, "123", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(d, langid.train(d)).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:200])
    assert (got[900].lang_pred, got[901].lang_pred, got[901].rejected) == ("und", "und", True)
    assert langid.train(d.where("false")).langs == []


def test_url_lists_in_force(spark):
    caps = spark.createDataFrame([(1, "http://a.Bad.com/x", 5), (2, "http://a.bad.com:80", 15), (3, None, 5), (4, "https://u@ok.org", 5), (5, "http://a.bad.com", None)], "page_id long, url string, fetched_at int")
    entries = spark.createDataFrame([("l", "bad.com", 3, 0, True), ("l", "bad.com", 10, 0, True), ("l", "bad.com", 10, 1, False), ("m", "a.bad.com", 4, 0, True), ("l", None, 1, 0, True)], "list string, pattern string, at int, seq int, listed boolean")
    got = {r.page_id: (r.n_active, r.lists, r.pattern) for r in url_filter.filter_urls(caps, entries).collect()}
    assert got == {1: (2, "l,m", "a.bad.com"), 2: (1, "m", "a.bad.com"), 3: (0, "", None), 4: (0, "", None), 5: (0, "", None)}


def test_main_text():
    page = "<html><header>Site</header><nav>a</nav><article><h1>T &amp; t</h1><p>One\n  two<p>x<div class=ad>Buy now, it is cheap today.</div></article><div id=comments><p>I liked this one a lot.</p></div><footer>f</footer>"
    assert html_extract.extract(page)[0] == "T & t\nOne two\nx"
    assert html_extract.extract(None)[0] == "" == html_extract.extract("")[0]


@pytest.mark.parametrize("around", ["<form id='aspnetForm'>{}</form>", "<form id=f><div id=wrap><article>{}</article></div></form>", "<div class='page has-sidebar'>{}</div>", "<div class='content with-sidebar'>{}</div>", "<div class='layout menu-open'><div>{}</div></div>", "<div class='wrapper social-enabled'>{}</div>", "<div class=sidebar-layout>{}</div>", "<div class=widget><main>{}</main></div>"])
def test_weak_signs_around_the_text(around):
    said = [f"Paragraph {i} of this story tells what has happened in the town on that day, and why." for i in range(4)]
    body = "<h1>The news</h1>" + "".join(f"<p>{p}</p>" for p in said)
    page = "<html><body><nav><a href=/>Home</a></nav>" + around.format(body) + "<div id=comments><p>I liked it.</p></div><div class=sidebar><ul><li><a href=/x>More</a></ul><p>Follow us</div><footer>Imprint</footer>"
    got = html_extract.extract(page)[0].split("\n")
    assert [t for t in got if t != "The news"] == said
    assert "The news" in got or "sidebar-layout" in around


@pytest.mark.parametrize("tag", ["button", "select", "svg", "object", "canvas", "audio", "video", "template", "noscript"])
def test_element_without_end_tag_keeps_the_page(tag):
    text = "<article><h1>Title</h1><p>One <{0}>in<p>two</{0}> three</article>".format(tag)
    for page in (f"<body><{tag}>Menu{text}<p>after", f"<body><div><{tag}>Menu</div>{text}<{tag}>x</{tag}><p>after", f"<body><{tag}>Menu{text}<{tag} id=b>x</{tag}>"):
        assert html_extract.extract(page)[0].split("\n")[:2] == ["Title", "One three"]
    assert html_extract.extract(f"<article><p>a <{tag}><div>in</div></{tag}> b</article>")[0] == "a b"


def test_math_stays_and_raw_text_goes():
    page = "<article><p>As <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x eq 1</annotation></math> says<script>var a='<p>no</p>'</script>.</p></article>"
    assert html_extract.extract(page)[0] == "As x=1 says ."


def test_minimum_cut_against_all_labellings():
    rng = random.Random(4)
    for _ in range(40):
        n = 7
        u = [rng.uniform(-3, 3) for _ in range(n)]
        e = [(i, i + 1, rng.uniform(0, 2)) for i in range(n - 1)] + [(0, 4, 1.0)]
        cost = lambda k: sum(max(x, 0) if not a else max(-x, 0) for x, a in zip(u, k)) + sum(w for i, j, w in e if k[i] != k[j])  # noqa: B023, E731
        assert cost(html_extract.minimum_cut(u, e)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_mixture_meets_its_target(spark):
    rows = [(i, "w " * 10, "big" if i < 800 else "small", 0) for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    out = mixing.mix(d, max_repeats=2.0).groupBy("source", "doc_id").count().groupBy("source").agg(F.sum("count"), F.count("*"), F.max("count")).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in out} == {"big": (800, 800, 1), "small": (400, 200, 2)}
    part = mixing.mix(d, target_entropy=0.6, budget_tokens=5000).groupBy("source").count().collect()
    w = {r[0]: r[1] for r in part}
    assert abs(sum(w.values()) - 500) < 4
    p = w["big"] / sum(w.values())
    assert -(p * np.log(p) + (1 - p) * np.log(1 - p)) == pytest.approx(0.6, abs=0.02)
    assert mixing.mix(empty(spark), max_repeats=2.0).count() == 0


def test_tokens_of_any_characters():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ours = token_counts.Counter(path, {})
    rng = random.Random(1)
    odd = [*"ΣσςİıẞƁƆəƏŌƦćƉȺɄ’—中文가각" "각ཱི́̊‍ 　 ﻿", "<|endoftext|>", "'s", "'LL", "İ'"]

    def one():
        kind = rng.random()
        if kind < 0.6:
            return chr(rng.randrange(32, 127)) if kind < 0.3 else rng.choice(odd) if kind < 0.5 else chr(rng.randrange(0x250))
        c = rng.randrange(0x110000 if kind < 0.8 else 0x3000)
        return chr(c) if not 0xD800 <= c < 0xE000 else " "

    for _ in range(50_000):
        s = "".join(one() for _ in range(rng.randrange(1, 10)))
        assert ours.count(s) == len(library.encode(s, add_special_tokens=False).ids), ascii(s)


def test_language_predictions_by_a_plain_replay(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(w.split(), k=20)) + "é!", k) for i, (k, w) in enumerate([("aa", "zor mip tok"), ("bb", "elu nan ice")] * 60)] + [(7, "Twice", "aa"), (8, None, "bb")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d)
    again = langid.train(d.repartition(5))
    assert np.array_equal(model.table, again.table) and model.reject_below == again.reject_below
    got = langid.predict(d, model).collect()
    for r, (i, text, _) in zip(got, rows, strict=True):
        s = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        s = f" {' '.join(s.split())} " if s.strip() else ""
        counts = {}
        for n in (1, 2, 3):
            for j in range(len(s) - n + 1):
                h = 0
                for c in s[j : j + n]:
                    h = ((h * 0x01000193) & 0xFFFFFFFF) ^ ((ord(c) * 0x9E3779B1) & 0xFFFFFFFF)
                m = ((h ^ (h >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF
                counts[m >> 20] = counts.get(m >> 20, 0) + 1
        if not s:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        z = [sum(c * model.table[b][k] for b, c in counts.items()) / sum(counts.values()) + model.bias[k] for k in range(2)]
        p = np.exp(np.array(z) / model.temperature)
        p /= p.sum()
        assert (r.doc_id, r.lang_pred) == (i, model.langs[int(p.argmax())])
        assert r.score == pytest.approx(p.max()) and r.rejected == (r.score < model.reject_below)


def test_media_columns_against_plain_code(spark, docs, rows, tmp_path):
    import zlib

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_media_columns(spark, str(tmp_path)).collect()
    want = []
    for k, t, *_ in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
        png = media.encode(p)
        lines = [p[i : i + 576] for i in range(0, len(p), 576)]
        mean = sum(p) / len(p)
        std = (sum((x - mean) ** 2 for x in p) / len(p)) ** 0.5
        columns = [sum(line[j] for line in lines) / len(lines) for j in range(576)]
        bits = "".join("01"[sum(columns[j : j + 9]) / 9 > mean] for j in range(0, 576, 9))
        want.append((k, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(png), hashlib.sha256(png).hexdigest(), f"h={len(lines)};mean={mean:.4f};std={std:.4f};hash={int(bits, 2):016x}"))
        assert b"".join(bytes(x) for x in media.decode(png)) == p
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_media_of_null_keys_and_odd_ones(spark, tmp_path):
    big = "".join(f"{random.Random(5).getrandbits(64 << 10):x}" for _ in range(1)) * 300
    rows = [(None, big), (None, None), ("", "a"), ("a/b_c.png", "b"), ("%\x00é", "c"), (None, big + "x")]
    got = media.media_column(spark.createDataFrame(rows, "k string, t string").coalesce(1), key="k", text="t", path=str(tmp_path / "a")).collect()
    assert sorted((str(r.k), r.n_bytes) for r in got) == sorted((str(k), len((t or "").encode())) for k, t in rows)
    assert not [f for f in (tmp_path / "a").iterdir() if f.name.startswith(".pending")]
    batch = media._batch([(None, b"x", "a", 1, None)])
    assert batch.schema.field("key").type == pa.string()


def test_unreadable_member_is_a_row_if_asked_for(spark, tmp_path):
    media.store(spark.createDataFrame([(i, f"text {i}" * 50) for i in range(5)], "doc_id long, text string").coalesce(1), str(tmp_path / "a"))
    (archive,) = (tmp_path / "a").glob("*.zip")
    offset = media.load(spark, str(tmp_path / "a")).where("key = '2'").first().offset
    b = bytearray(archive.read_bytes())
    b[offset + 120] ^= 255
    archive.write_bytes(bytes(b))
    got = {r.key: r for r in media.load(spark, str(tmp_path / "a"), tries=2, skip_unreadable=True).collect()}
    assert [k for k, r in got.items() if r.media is None] == ["2"] and "damaged" in got["2"].error
    assert media.describe(media.load(spark, str(tmp_path / "a"), tries=2, skip_unreadable=True)).where("payload_sha256 IS NULL").count() == 1


def test_hot_and_overlong_hosts(spark):
    rows = [(i, "http://www.hot.com/x", i % 9) for i in range(300)] + [(1000 + i, f"https://h{i}.org", 5) for i in range(300)]
    rows += [(5000, f"http://{'a' * 200}.{'b.' * 3000}spam.com/", 5), (5001, f"http://{'c' * 900}", 5), (5002, "http://x" + "y" * 300 + "spam.com", 5), (None, None, None)]
    entries = spark.createDataFrame([("l", "hot.com", 3, 0, True), ("l", "hot.com", 6, 0, False), ("m", "spam.com", 1, 0, True)], "list string, pattern string, at int, seq int, listed boolean")
    caps = spark.createDataFrame(rows, "page_id long, url string, fetched_at int")
    got = url_filter.filter_urls(caps, entries, hot_shares=8)
    blocked = {r.page_id for r in got.where("blocked").collect()}
    assert blocked == {i for i in range(300) if 3 <= i % 9 < 6} | {5000}
    assert got.count() == len(rows)
    assert len({r.host for r in got.where("page_id = 5000").collect()}.pop()) == 200 + 1 + 6000 + 8
    # no task of the last join has the whole host: it is dealt over as many salts as shares
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        most = url_filter.filter_urls(caps, entries, hot_shares=64).withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert most < 150
    assert url_filter.filter_urls(caps, entries.where("false")).where("blocked").count() == 0


def test_mixture_keeps_its_limit_with_null_and_repeated_keys(spark):
    rows = [(None, f"text number {i}", "null keys") for i in range(400)] + [(7, f"again {i % 200} .", "one key") for i in range(400)] + [(i, "w " * 40, "big") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(d, max_repeats=1.5)
    n = {r[0]: r[1] for r in out.groupBy("source").count().collect()}
    assert n["big"] == 400 and 595 <= n["null keys"] <= 600 and 590 <= n["one key"] <= 600
    assert {r[0] for r in out.groupBy("source", "text", "mix_pass").count().where("source = 'null keys'").select("count").collect()} == {1}
    same = spark.createDataFrame([(None, "a b c", "s")] * 50 + [(i, "a b c d e f", "t") for i in range(100)], "doc_id long, text string, source string")
    assert mixing.mix(same, max_repeats=1.5).where("source = 's'").count() <= 75


def test_packing_does_not_depend_on_the_layout(spark, docs):
    rows = docs.select("doc_id", "text", "source").unionByName(docs.where("doc_id IS NULL OR doc_id < 9").select("doc_id", "text", "source"))
    one, two = (sorted(map(tuple, packing.pack(d, capacity=64, shard_docs=32).collect()), key=str) for d in (rows.coalesce(1), rows.repartition(7)))
    assert one == two and len({r[4] >> 32 for r in one}) > 3
    same = spark.createDataFrame([(None, "a b", None)] * 9000, "doc_id long, text string, source string")
    got = packing.pack(same, shard_docs=1000).groupBy(F.expr("bin_id >> 32")).count().collect()
    assert sum(r[1] for r in got) == 9000 and len(got) == 9 and max(r[1] for r in got) < 1200


def test_base_counts_of_op10_in_sql(spark, docs, rows, tmp_path):
    import duckdb

    more = spark.createDataFrame([(900 + i, t, "en", "s", 0) for i, t in enumerate(["a a a a a " * 30, "x\ny\nx\n \n\ny z\ty\n", "# $ | é é é " * 20, "one two three " * 40 + "\r\n\x0b"])], DOCS)
    docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 150, 3)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op10_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, ws[i:i+2] AS g FROM w, unnest(range(1, len(ws) - 1)) u(i)),
many AS (SELECT r, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM win JOIN many USING (r, g), range(0, 3) k(j) GROUP BY r),
line AS (SELECT r, l FROM w, unnest(string_split(t, chr(10))) u(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM line GROUP BY r)
SELECT doc_id, len(ws)::BIGINT, length(array_to_string(ws, ''))::BIGINT, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT, coalesce(dup.n, 0)::BIGINT, coalesce(rep.n, 0)::BIGINT,
 len(ws) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(ws) FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)""").fetchall()
    base = [tuple(r)[:7] for r in got.collect()]
    assert sorted(base, key=str) == sorted(want, key=str)
    assert not got.where("base_failed AND kept").count()


LONG = "A sentence of some length that an article would hold, with a comma and a full stop. "


@pytest.mark.parametrize("page, want", [
    (f'<body><nav>menu</nav><article class="teaser"><h1>Head</h1><p>{LONG}</p></article></body>', ["Head", LONG]),
    (f'<body><article><h1>Head</h1><p>{LONG}</p><section id="discussion"><h2>Discussion</h2><p>{LONG}</p></section></article></body>', ["Head", LONG, "Discussion", LONG]),
    (f'<body><article style="display:none"><h1>Head</h1><p>{LONG}</p></article><footer>end</footer></body>', ["Head", LONG]),
    (f'<body><article hidden class="teaser related"><p>{LONG}</p></article></body>', [LONG]),
    (f'<body><main><article class="post"><p>{LONG}</p></article></main></body>', [LONG]),
])
def test_names_do_not_empty_an_article(page, want):
    assert html_extract.extract(page)[0].split("\n") == [x.strip() for x in want]


@pytest.mark.parametrize("place", ['div class="responses"', 'section id="kommentare"', 'div id="commentaires"', 'div class="comentarios"', 'ol class="comment-list"', 'div id="discussion"', 'section class="reader-comments"', 'div class="leserkommentare"'])
def test_comments_of_any_name_go(place):
    close = place.split()[0]
    page = f'<body><article><h1>Head</h1><p>{LONG}</p></article><{place}><h3>3</h3>' + "".join(f"<div class=item><b>user{i}</b><p>{LONG}</p></div>" for i in range(3)) + f"</{close}></body>"
    assert html_extract.extract(page)[0].split("\n") == ["Head", LONG.strip()]
    inside = f'<body><article><h1>Head</h1><p>{LONG}</p><div class="commentaires"><p>{LONG}</p><p>short one</p></div></article></body>'
    assert html_extract.extract(inside)[0].split("\n") == ["Head", LONG.strip()]
    called = f'<body><article><p>{LONG}</p></article><article class="comment"><p>{LONG}</p></article></body>'
    assert html_extract.extract(called)[0] == LONG.strip()


def test_the_cut_turns_blocks_by_their_neighbours():
    said = [f"Paragraph {i} of this story tells what has happened in the town on that day, and why." for i in range(2)]
    p = "".join(f"<p>{s}</p>" for s in said)
    page = f"<body><div id=top><a href=/>Home</a> <a href=/a>About us</a></div><div class='post-related-content'><h1>The news</h1>{p}<p>Yes.</p><div>Interlude</div>{p}</div><div><h3>Read more</h3><ul><li><a href=1>One thing</a><li><a href=2>Another thing</a></ul></div><p>© 2024 Somebody</p>"
    found = html_extract.blocks(page)
    alone = {b.text: html_extract.score(b, False) > 0 for b in found}
    kept = html_extract.extract(page)[0].split("\n")
    assert kept == ["The news", *said, "Yes.", "Interlude", *said]
    assert not alone["The news"] and not alone["Interlude"] and alone["Read more"]


@pytest.mark.parametrize("around", [
    "<div class='cookie-notice'>{}</div><div>", "<div class=notice><div><div>{}</div></div></div><div>", "<div class=comment-list><div class=comment>{}</div></div><div>", "<div class=right-sidebar>{}</div><div class=content>",
    "<div class=post-comments>{}</div><article>", "<article><form>{}<input></form>", "<article><aside>{}</aside>", "<div class='-- site-header'>{}</div><div id=content>", "<div role=navigation>{}</div><div>", "<template>{}</template><div>", "<div style='display: none'>{}</div><div>",
])
def test_long_boilerplate_goes_by_where_it_stands(around):
    said = [f"Paragraph {i} of this story tells what has happened in the town on that day, and why it came to pass there." for i in range(3)]
    other = "<p>We and our partners would like to tell you of a good many things that you can change at any time in your browser.</p>"
    assert html_extract.extract("<body>" + around.format(other) + "".join(f"<p>{s}</p>" for s in said))[0].split("\n") == said


@pytest.mark.parametrize("page", ['<a href="' * 100_000, '<a "> "' * 60_000, "<span>" * 50_000 + "<i>x</i>" * 50_000, "<p><table><td>" + "<span>" * 20_000 + "<div>x</div>" * 20_000, "<button>" * 20_000 + "<div>x</div>" * 20_000, "<svg>" * 50_000 + "<p>x", "<!--" * 100_000, "<div>" * 20_000 + "<p>some words." * 20_000])
def test_long_malformed_pages_take_time_in_proportion(page):
    import time

    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 8


def test_words_hash_alike_wherever_they_stand():
    from threadloom.llm.common import SEGMENT, hashed_words

    rng = random.Random(2)
    texts = [b"", b" a", b"a b\x0bc\x1cd", b"x" * (SEGMENT * 2) + b" y", b"a " * SEGMENT, b"z" * SEGMENT, b"z" * (SEGMENT + 1)]
    texts += [bytes(rng.choice(b"ab \n\x80\xffc") for _ in range(rng.randrange(60))) for _ in range(300)]
    hashes, lengths, counts = hashed_words(texts)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and lengths.tolist() == [len(w) for w in words]
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))


def test_keys_that_are_no_whole_numbers_are_named(spark):
    d = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    for f in (jaccard_join.classes, substring_dedup.dedup):
        with pytest.raises(TypeError, match="doc_id is string"):
            f(d)


def test_queries_leave_the_settings_of_the_session(spark, docs, tmp_path):
    before = dict(spark.conf.getAll)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    queries.op9_token_counts(spark, str(tmp_path)).count()
    queries.op7_jaccard_join(spark, str(tmp_path))
    assert dict(spark.conf.getAll) == before


def test_pack_against_a_plain_version(spark, docs):
    capacity = 64
    rows = docs.select("doc_id", packing.word_count(F.col("text")), packing.exact_hash("text"), F.xxhash64("source")).collect()
    rows.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2], r[3]))
    pieces = [(i, first, min(capacity, n - first)) for i, (_, n, *_) in enumerate(rows) for first in (range(0, n, capacity) if n else [0])]
    bins, at = [], {}
    for i, first, n in sorted(pieces, key=lambda p: -p[2]):
        fits = [(capacity - sum(x[2] for x in b), j) for j, b in enumerate(bins) if sum(x[2] for x in b) + n <= capacity > sum(x[2] for x in b) and rows[i][2] not in [rows[x[0]][2] for x in b] and [rows[x[0]][3] for x in b].count(rows[i][3]) < 2]
        if not fits:
            bins.append([])
        j = min(fits)[1] if fits else len(bins) - 1
        bins[j].append((i, first, n))
        at[i, first] = j
    want = sorted((str(rows[i][0]), first, n, at[i, first]) for i, first, n in pieces)
    got = packing.pack(docs, capacity=capacity, shard_docs=10_000).collect()
    assert sorted((str(r.doc_id), r.first_token, r.n_tokens, r.bin_id) for r in got) == want
