"""One query for each operator over its whole table, with production parameters; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_middle, filter_audit, html_extract, jaccard_join, langid, media, mixing, packing, quality, substring_dedup, suffix_dedup, token_counts, url_filter
from .common import table

MAX_REPEATS = 2.0
TOKENIZER = "word_bpe_49k.json"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, up to MAX_REPEATS times, in the passes of its source."""
    out = mixing.mix(table(spark, sf_dir, "documents"), max_repeats=MAX_REPEATS)
    return out.select("doc_id", "source", "mix_pass", F.floor(F.col("mix_rank") * 1e9).cast("long").alias("rank_e9"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a null or empty page, or one of boilerplate alone, has an empty one. Repeated rows stay."""
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without passages that an earlier one has; null and empty texts keep the empty text, rows of
    one id don't count against each other, a null id loses nothing."""
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an image in an archive, read back; a null text is stored as an empty one, null ids and repeats as
    members of their own."""
    return media.media_column(table(spark, sf_dir, "documents"))


def _hex(text, start: int, length: int):
    return F.conv(F.substring(F.md5(text), start, length), 16, 10).cast("long")


def captures_and_lists(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages table has no dates: a page's fetch time follows from its id, and each host and parent domain gets up
    to four dated entries from its digest. So the lists grow with the hosts."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    minutes = F.pmod(F.col("page_id") * 7919, F.lit(525_600)).cast("int")
    captures = pages.select("page_id", "url", (start + F.make_interval(mins=minutes)).alias("fetched_at"))
    host = url_filter.host(F.col("url"))
    hosts = pages.select(host.alias("host")).where("host IS NOT NULL").distinct()
    parent = F.regexp_replace("host", r"^[^.]*\.?", "")
    names = hosts.select(F.explode(F.array("host", parent)).alias("pattern")).where("pattern LIKE '%.%'").distinct()
    each = names.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(3)))).where(F.col("seq") < _hex(F.col("pattern"), 1, 4) % 5)
    tag = F.concat_ws("|", "pattern", F.col("seq").cast("string"))
    entries = each.select(
        F.when(_hex(F.col("pattern"), 5, 4) % 2 == 0, "spam").otherwise("malware").alias("list"),
        "pattern", (start + F.make_interval(days=(_hex(tag, 1, 6) % 365).cast("int"))).alias("at"), "seq",
        (_hex(tag, 7, 4) % 3 > 0).alias("listed"),
    )
    return captures, entries


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture with the list entries in force; a null URL or one without a host matches none."""
    captures, entries = captures_and_lists(table(spark, sf_dir, "pages"))
    out = url_filter.filter_urls(captures, entries)
    return out.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; a null text or one without letters is `und` with score 0. A null id isn't held out."""
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class; null and wordless texts are classes of their own, rows of one id one document with several
    texts; a null id has a null class."""
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins, of which none holds two near copies. Null and empty texts are pieces of 0, repeated
    rows pieces of their own."""
    return packing.pack(packing.with_clusters(table(spark, sf_dir, "documents")), tokens=F.col("tokens"), cluster=F.col("cluster"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text; null and empty ones have 0. Repeated rows stay."""
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict; null and blank texts have no words and fail the base rules."""
    docs = table(spark, sf_dir, "documents")
    return quality.apply_rules(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters over every document, by source; null texts are empty, a null source is the part ''."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, cuts and output, and its text restored from those. Null and empty texts are plain; a null id
    draws as an empty one, repeated rows alike."""
    out = fill_middle.restore(fill_middle.transform(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without the 400-byte strings that also start elsewhere; null texts are empty, null and
    repeated ids are rows like others."""
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mixing, op2_html_extraction, op3_substring_dedup, op4_media_columns, op5_url_filters, op6_language_id, op7_jaccard_join, op8_best_fit_packing, op9_token_counts, op10_quality_rules, op11_filter_audit, op12_fill_middle, op13_suffix_dedup]
    return {f.__name__: f for f in found}


_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"


def _h52(turn: str) -> str:
    return f"('0x' || substr(md5('17:' || {turn} || ':' || own), 1, 13))::BIGINT"


ORACLE_1 = f"""
WITH d AS (SELECT coalesce('=' || source, '') AS s, source, doc_id, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS own, {_WORDS} AS t FROM documents),
st AS (SELECT s, sum(t)::BIGINT AS tokens, count(*) AS docs FROM d GROUP BY s),
ends AS (SELECT max(tokens)::DOUBLE AS top, min(tokens)::DOUBLE AS low FROM st WHERE tokens > 0),
ex AS (SELECT top, greatest(0, least(1000000, CASE WHEN top IS NULL THEN 1000000 WHEN top = low THEN 0
        ELSE ceil(1000000 * (1 - ln({MAX_REPEATS}::DOUBLE) / ln(top / low))) END))::DOUBLE / 1000000::DOUBLE AS a FROM ends),
sized AS (SELECT s, tokens, docs, CASE WHEN tokens > 0 THEN floor(pow(top / tokens, 1::DOUBLE - a) * tokens + 0.5::DOUBLE) ELSE 0 END::BIGINT AS budget FROM st, ex),
pl AS (SELECT s, tokens, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest,
        ceil(sqrt(docs::DOUBLE))::BIGINT AS blocks, CASE WHEN tokens > 0 THEN budget::DOUBLE / tokens ELSE 1 END AS repeats FROM sized),
lastp AS (SELECT d.s, d.t, pl.rest, h, floor(h / 4503599627370496::DOUBLE * blocks)::BIGINT AS block
        FROM (SELECT d.*, {_h52('passes')} AS h FROM d JOIN pl USING (s)) d JOIN pl USING (s) WHERE rest > 0),
sums AS (SELECT s, rest, block, sum(t) AS t FROM lastp GROUP BY ALL),
run AS (SELECT *, sum(t) OVER (PARTITION BY s ORDER BY block) AS upto FROM sums),
edge AS (SELECT s, min(block) AS block, arg_min(rest - upto + t, block) AS room FROM run WHERE upto > rest GROUP BY s),
inside AS (SELECT s, room, h, sum(t) AS t, count(*) AS n FROM lastp JOIN edge USING (s, block) GROUP BY ALL),
ahead AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY s ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM inside),
cut AS (SELECT s, max(h) AS last FROM ahead WHERE before < room AND (n = 1 OR before + t <= room) GROUP BY s),
turns AS (SELECT d.*, pl.passes, pl.blocks, pl.repeats, unnest(range(0, pl.passes + 1)) AS turn FROM d JOIN pl USING (s)),
hashed AS (SELECT *, {_h52('turn')} AS h FROM turns)
SELECT doc_id, source, turn::BIGINT AS mix_pass, floor((turn + h / 4503599627370496::DOUBLE) / repeats * 1e9::DOUBLE)::BIGINT AS rank_e9
FROM hashed LEFT JOIN edge USING (s) LEFT JOIN cut USING (s)
WHERE turn < passes OR floor(h / 4503599627370496::DOUBLE * blocks)::BIGINT < coalesce(block, -1)
   OR (floor(h / 4503599627370496::DOUBLE * blocks)::BIGINT = coalesce(block, -1) AND h <= coalesce(last, -1))
"""

ORACLE_5 = r"""
WITH raw AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(((page_id * 7919) % 525600)::INTEGER) AS fetched_at,
        regexp_replace(lower(regexp_extract(regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[\t\n\r]', '', 'g'),
        '^[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}([^/\\?#]*)', 1), '^.*@', ''), '^(\[[^\]]*\]|[^:]*)', 1)), '\.$', '') AS h FROM pages),
cap AS (SELECT page_id, url, fetched_at, nullif(h, '') AS host FROM raw),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM cap WHERE host IS NOT NULL),
parents AS (SELECT host, unnest(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.'))) AS pattern, unnest(range(1, len(labels) + 1)) AS i FROM hosts),
names AS (SELECT DISTINCT pattern FROM parents WHERE i <= 2 AND pattern LIKE '%.%'),
entries AS (SELECT CASE WHEN ('0x' || substr(md5(pattern), 5, 4))::BIGINT % 2 = 0 THEN 'spam' ELSE 'malware' END AS list, pattern, seq,
        TIMESTAMP '2024-01-01' + to_days((('0x' || substr(md5(pattern || '|' || seq), 1, 6))::BIGINT % 365)::INTEGER) AS since,
        ('0x' || substr(md5(pattern || '|' || seq), 7, 4))::BIGINT % 3 > 0 AS listed
        FROM names, range(0, 4) r(seq) WHERE seq < ('0x' || substr(md5(pattern), 1, 4))::BIGINT % 5),
last AS (SELECT list, pattern, since, arg_max(listed, seq) AS listed FROM entries GROUP BY ALL),
periods AS (SELECT *, lead(since) OVER (PARTITION BY list, pattern ORDER BY since) AS upto FROM last),
hit AS (SELECT cap.page_id, cap.url, list, p.pattern FROM cap JOIN parents USING (host) JOIN periods p ON p.pattern = parents.pattern
        AND p.listed AND p.since <= cap.fetched_at AND (p.upto IS NULL OR p.upto > cap.fetched_at)),
per AS (SELECT page_id, url, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, arg_max(pattern, length(pattern)) AS pattern FROM hit GROUP BY ALL)
SELECT cap.page_id, cap.url, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, host, coalesce(n, 0)::BIGINT AS n_active,
       coalesce(lists, '') AS lists, pattern, coalesce(n, 0) > 0 AS blocked
FROM cap LEFT JOIN per ON per.page_id = cap.page_id AND per.url IS NOT DISTINCT FROM cap.url
"""

ORACLE_3 = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i+12], ' ')) AS h FROM w, unnest(range(1, len(words) - 11)) r(i) WHERE len(words) >= 13),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
hit AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN first USING (h), range(0, 13) r(j) WHERE m < doc_id),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hit GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


ORACLE_7 = r"""
WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM low),
sets AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, any_value(s) AS s, min(doc_id) AS doc_id FROM sh WHERE len(s) > 0 GROUP BY 1),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
df AS (SELECT g, count(*) AS c FROM e GROUP BY g),
ranked AS (SELECT e.doc_id, n, g, c, row_number() OVER (PARTITION BY e.doc_id ORDER BY c, g) AS k FROM e JOIN df USING (g)),
pre AS (SELECT doc_id, g FROM ranked WHERE k <= n - ceil(0.8 * n) + 1 AND c > 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id),
link AS (SELECT a, b FROM cand JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
   WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
walk AS (SELECT doc_id AS node, doc_id AS root FROM sets UNION SELECT ways.b, walk.root FROM walk JOIN ways ON ways.a = walk.node),
comp AS (SELECT node, min(root) AS root FROM walk GROUP BY node)
SELECT sh.doc_id, len(sh.s)::BIGINT AS n_shingles, coalesce(comp.root, sh.doc_id) AS component_id
FROM sh LEFT JOIN sets ON sets.k = md5(array_to_string(list_sort(sh.s), chr(10))) AND len(sh.s) > 0 LEFT JOIN comp ON comp.node = sets.doc_id
"""

ORACLE_11 = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
first AS (SELECT text, min(doc_id) AS m FROM t GROUP BY text),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT
        + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(m < t.doc_id, false)::INT AS mask
        FROM t LEFT JOIN first USING (text) LEFT JOIN lab ON lab.doc_id = t.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
        WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit <> b.bit AND a.bit <> c.bit AND a.bit <> d.bit AND a.bit <> e.bit AND b.bit <> c.bit AND b.bit <> d.bit AND b.bit <> e.bit AND c.bit <> d.bit AND c.bit <> e.bit AND d.bit <> e.bit),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
        FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x
"""

ORACLE_12 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok FROM documents),
d AS (SELECT *, len(tok) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
        ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
s AS (SELECT *, array_to_string(tok[1:a], '') AS p, array_to_string(tok[a+1:b], '') AS m, array_to_string(tok[b+1:n], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
"""

ORACLE_13 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS h FROM documents),
n AS (SELECT doc_id, r, h, octet_length(h) AS n FROM d),
win AS (SELECT r, i, md5(array_slice(h, i + 1, i + 400)) AS k FROM (SELECT r, h, unnest(range(0, n - 399)) AS i FROM n WHERE n >= 400)),
many AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i FROM win JOIN many USING (k)),
marked AS (SELECT r, i, CASE WHEN i > lag(i) OVER w + 400 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM hit WINDOW w AS (PARTITION BY r ORDER BY i)),
isl AS (SELECT r, i, sum(s) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
runs AS (SELECT r, run, min(i) AS a, max(i) + 400 AS b FROM isl GROUP BY ALL),
keep AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b, a AS o FROM runs UNION ALL SELECT r, max(b), NULL, max(b) FROM runs GROUP BY r),
kept AS (SELECT keep.r, string_agg(hex(array_slice(h, a + 1, coalesce(keep.b, n))), '' ORDER BY o) AS k FROM keep JOIN n ON n.r = keep.r GROUP BY keep.r),
sums AS (SELECT r, sum(b - a) AS gone, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, n.n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, hex(h)))) AS kept_sha256
FROM n LEFT JOIN sums ON sums.r = n.r LEFT JOIN kept ON kept.r = n.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": ORACLE_1, "op3_substring_dedup": ORACLE_3, "op5_url_filters": ORACLE_5, "op7_jaccard_join": ORACLE_7, "op11_filter_audit": ORACLE_11, "op12_fill_middle": ORACLE_12, "op13_suffix_dedup": ORACLE_13}
