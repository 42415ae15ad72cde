"""Suffix-array dedup: every byte that lies in a string of `length` bytes which also starts elsewhere goes.

Suffixes are sorted where it can matter only. Of every `length`-byte window the anchor is the place in its first
4/5 with the least hash of 8 bytes: windows that are equal have it at the same distance from their start. Consecutive
windows of one anchor are a span, some 160 windows in 560 bytes for `length` 400.

1. Documents are dealt into groups. For each anchor a group tells a hash of the bytes that all its windows share behind
   the anchor, and a 128-bit digest of the span, copies within the group as one row. Spans whose hash nobody else has are
   done. Spans that are equal throughout are the same string: all their windows are repeated, and one of them goes on.
2. Different spans of one hash meet in a shard. There the suffixes behind the anchors are sorted, and so are the reversed
   prefixes before them, by deep-shallow sorting: multikey quicksort by 8 bytes at a time down to a shallow depth, then a
   blind trie for each group that is still tied, which compares each suffix with one other and orders it by the common
   prefix. Common prefixes of neighbours in both orders tell which windows are equal, for every distance from the anchor.
3. Results go back to the groups, where covered bytes are removed.
A hash that HOT or more different spans share (a phrase in ever other surroundings) would fill a shard: windows of such
spans meet by 128-bit digests of their own, counted before they are shuffled.

Every exchange is one of slim rows in proportion to the input; every pass over the texts reads one shuffle of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, group_count, grouped, mixed, parts, salted_join, words_at, written
from .substring_dedup import _least

GRAM = 8
#: Different spans of one hash that a shard sorts.
HOT = 4096
#: Bytes that multikey quicksort looks at; groups of FEW aren't worth its passes.
SHALLOW = 64
FEW = 16
SHARD_BYTES = 8 << 20
_SEGMENT = 1 << 16
_LOW, _HIGH = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)


def reach(length: int) -> int:
    """In how many places a window may have its anchor."""
    return length * 4 // 5


class Spans:
    """The spans of a group's documents: `first` and `last` window and `anchor` of each, as places in `joined`."""

    def __init__(self, t: pa.Table, length: int) -> None:
        self.length = length
        texts = t.column("text").combine_chunks().cast(pa.binary()).fill_null(b"").to_pylist() if t.num_rows else []
        self.joined = b"".join(texts)
        self.bounds = np.cumsum([0, *map(len, texts)])
        whole = np.zeros(len(self.joined), bool)
        for a, e in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            whole[a : max(a, e - length + 1)] = True
        self.bytes = np.frombuffer(self.joined, np.uint8)
        w = reach(length)
        runs = [np.zeros((3, 0), np.int64)]
        for a in range(0, len(whole), _SEGMENT):
            starts = np.flatnonzero(whole[a : a + _SEGMENT])
            if len(starts):
                piece = np.ascontiguousarray(self.bytes[a : a + int(starts[-1]) + w + GRAM - 1])
                v = words_at(piece)
                least = _least(mixed(v) & _HIGH | np.arange(len(v), dtype=np.uint64), w)
                anchor = (least[starts] & _LOW).astype(np.int64)
                new = np.flatnonzero(np.diff(anchor, prepend=-1))
                runs.append(a + np.stack([starts[new], starts[np.append(new[1:], len(starts)) - 1], anchor[new]]))
        first, last, anchor = np.concatenate(runs, axis=1)
        new = np.diff(anchor, prepend=-1) != 0  # a run that a segment's border has cut is one
        self.first, self.anchor = first[new], anchor[new]
        self.last = last[np.append(np.flatnonzero(new)[1:], len(new)) - 1] if len(new) else last

    def hashes(self) -> np.ndarray:
        """A hash of what all windows of a span share behind its anchor."""
        n = (self.length - reach(self.length) + 1) // GRAM
        at = self.anchor[:, None] + np.arange(n * GRAM)
        words = np.ascontiguousarray(self.bytes[at]).view(np.uint64) if len(at) else np.zeros((0, n), np.uint64)
        h = np.zeros(len(at), np.uint64)
        for i in range(n):
            h = mixed(h + words[:, i])
        return h.view(np.int64)

    def digests(self, some: np.ndarray | None = None) -> np.ndarray:
        """Digests of the spans (of `some` of them), as two numbers each."""
        first, end = self.first, self.last + self.length
        if some is not None:
            first, end = first[some], end[some]
        out = b"".join(hashlib.blake2b(self.joined[a:e], digest_size=16).digest() for a, e in zip(first.tolist(), end.tolist(), strict=True))
        return np.frombuffer(out, np.int64).reshape(-1, 2)


def _distinct(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct digest is first, and how many there are of it."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    ranked = digests[order]
    starts = np.flatnonzero(np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(1)])) if len(order) else order
    return order[starts], np.diff(np.append(starts, len(order)))


def profile(t: pa.Table, length: int) -> pa.Table:
    """h, d1, d2, g, n (2 for more than one) of each different span of a group."""
    spans = Spans(t, length)
    digests = spans.digests()
    at, n = _distinct(digests)
    g = t.column("g")[0].as_py()
    return pa.table({"h": spans.hashes()[at], "d1": digests[at, 0], "d2": digests[at, 1], "g": np.full(len(at), g), "n": np.minimum(n, 2).astype(np.int32)})


SENT = "h long, g long, d1 long, d2 long, n long, hot boolean, back int, low int, span binary"


def send(t: pa.Table, asked: pa.Table, length: int) -> pa.Table:
    """The asked spans of a group. back: bytes before the anchor; low: the least distance of the anchor from a window's start."""
    spans = Spans(t, length)
    wanted = {(a, b): (n, hot) for a, b, n, hot in zip(*(asked.column(c).to_pylist() for c in ("d1", "d2", "n", "hot")), strict=True)}
    some = np.flatnonzero(np.isin(spans.hashes(), asked.column("h").to_numpy())) if wanted else np.zeros(0, np.int64)
    digests = spans.digests(some)
    rows = []
    for i, h, d in zip(some.tolist(), spans.hashes()[some].tolist(), map(tuple, digests.tolist()), strict=True):
        if d in wanted:
            n, hot = wanted.pop(d)
            first, last, anchor = int(spans.first[i]), int(spans.last[i]), int(spans.anchor[i])
            rows.append((h, t.column("g")[0].as_py(), *d, n, hot, anchor - first, anchor - last, spans.joined[first : last + length]))
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip([*zip(*rows, strict=True)] or [[]] * 9, kinds, strict=True)], ["h", "g", "d1", "d2", "n", "hot", "back", "low", "span"])


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Trie of branching places alone. A string finds its place blindly, by the bytes there; one comparison with the leaf it
    came to tells how long their common prefix is, and so where it belongs. Leaves are ~number."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.depth: list[int] = []
        self.kids: list[dict[int, int]] = []
        self.equal: dict[int, list[int]] = {}
        self.root: int | None = None

    def insert(self, number: int) -> None:
        s = self.strings[number]
        if self.root is None:
            self.root = ~number
            return
        at = self.root
        while at >= 0:
            kids, d = self.kids[at], self.depth[at]
            b = s[d] if d < len(s) else -1
            at = kids[b] if b in kids else next(iter(kids.values()))
        leaf = ~at
        other = self.strings[leaf]
        n = common_prefix(s, other)
        own, theirs = (x[n] if n < len(x) else -1 for x in (s, other))
        if own == theirs:
            self.equal.setdefault(leaf, []).append(number)
            return
        above, edge, at = -1, -1, self.root
        while at >= 0 and self.depth[at] < n:
            above, edge = at, s[self.depth[at]]
            at = self.kids[at][edge]
        if at >= 0 and self.depth[at] == n:
            self.kids[at][own] = ~number
            return
        self.depth.append(n)
        self.kids.append({own: ~number, theirs: at})
        if above < 0:
            self.root = len(self.kids) - 1
        else:
            self.kids[above][edge] = len(self.kids) - 1

    def sorted(self) -> list[tuple[int, int]]:
        """All strings in order, with the length of the common prefix with the one before (0 for the first)."""
        out: list[tuple[int, int]] = []
        todo = [(self.root, 0)] if self.root is not None else []
        while todo:
            at, shared = todo.pop()
            if at < 0:
                out.append((~at, shared))
                out += [(i, len(self.strings[i])) for i in self.equal.get(~at, ())]
            else:
                ordered = [self.kids[at][b] for b in sorted(self.kids[at])]
                todo += [(k, self.depth[at]) for k in reversed(ordered[1:])]
                todo.append((ordered[0], shared))
        return out


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the strings in order (a prefix before what it begins), and the length of each one's common prefix with the
    one before."""
    head = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(len(strings), SHALLOW // 8).astype(np.uint64)
    out: list[tuple[int, int]] = []
    todo = [(np.arange(len(strings)), 0)]
    while todo:
        group, word = todo.pop()
        if len(group) <= FEW or word == head.shape[1]:
            trie = BlindTrie(strings)
            for i in group.tolist():
                trie.insert(i)
            ranked = trie.sorted()
            if ranked and out:
                ranked[0] = (ranked[0][0], common_prefix(strings[out[-1][0]], strings[ranked[0][0]]))
            out += ranked
            continue
        keys = head[group, word]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        todo += [(group[keys > pivot], word), (group[keys == pivot], word + 1), (group[keys < pivot], word)]
    order, shared = np.array(out, np.int64).reshape(-1, 2).T
    return order, shared


def repeated(spans: list[bytes], back: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """Which windows of different spans are equal to another: a row for each span, a column for each of its windows."""
    n = len(spans)
    order, shared = deep_shallow([s[k:] for s, k in zip(spans, back.tolist(), strict=True)])
    before, shared_before = deep_shallow([s[:k][::-1] for s, k in zip(spans, back.tolist(), strict=True)])
    hit = np.zeros((n, int((back - low).max(initial=0)) + 1), bool)
    behind, ahead = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(low.min(initial=0)), int(back.max(initial=-1)) + 1):
        some = np.flatnonzero((low <= o) & (o <= back))
        behind[order] = np.cumsum(shared < length - o)
        ahead[before] = np.cumsum(shared_before < o)
        key = behind[some] * (n + 1) + ahead[some]
        by_key = np.argsort(key)
        same = key[by_key[1:]] == key[by_key[:-1]]
        twice = np.zeros(len(some), bool)
        twice[by_key[1:][same]] = twice[by_key[:-1][same]] = True
        hit[some, back[some] - o] = twice
    return hit


BACK = "h long, g long, d1 long, d2 long, bits binary"


def match(t: pa.Table, length: int) -> pa.Table:
    """The repeated windows of a shard's spans, as bits, of those that have any. Copies are known to be repeated and take
    part without an answer."""
    spans, n = t.column("span").to_pylist(), t.column("n").to_numpy()
    back, low = (t.column(c).to_numpy().astype(np.int64) for c in ("back", "low"))
    hit = repeated(spans, back, low, length)
    some = np.flatnonzero(hit.any(1) & (n == 1))
    bits = [np.packbits(x).tobytes() for x in hit[some]]
    own = t.select(["h", "g", "d1", "d2"]).take(pa.array(some))
    return own.append_column("bits", pa.array(bits, pa.binary()))


def _windows(batches, length: int):
    """A row for each window of spans: its digest and number, and the span's h, g, d1, d2 and n."""
    for b in batches:
        for h, g, d1, d2, n, span in zip(*(c.to_pylist() for c in b.columns), strict=True):
            m = len(span) - length + 1
            own = np.frombuffer(b"".join(hashlib.blake2b(span[i : i + length], digest_size=16).digest() for i in range(m)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(np.arange(m, dtype=np.int32)), *(pa.array(np.full(m, x)) for x in (h, g, d1, d2, n))], ["w1", "w2", "i", "h", "g", "d1", "d2", "n"])


def hot_windows(hot: DataFrame, length: int) -> DataFrame:
    """For spans whose hash too many others share: h, g, d1, d2 and the numbers of their repeated windows."""
    windows = written(hot.select("h", "g", "d1", "d2", "n", "span").mapInArrow(lambda bs: _windows(bs, length), "w1 long, w2 long, i int, h long, g long, d1 long, d2 long, n long"), "suffix-windows")
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("_n")).where("_n > 1").drop("_n")
    found = salted_join(windows.where("n = 1"), twice, ["w1", "w2"], rows="rows", total=windows.count())
    return found.groupBy("h", "g", "d1", "d2").agg(F.collect_list("i").alias("numbers"))  # a span has `reach` windows at most


def remove(t: pa.Table, told: pa.Table, length: int) -> pa.Table:
    """Rows of a group with n_bytes, n_removed, n_spans and the kept bytes. told: d1, d2 of spans that have repeated windows, as
    bits or numbers; all of them where there is neither."""
    spans = Spans(t, length)
    answers = {(a, b): (bits, numbers) for a, b, bits, numbers in zip(*(told.column(c).to_pylist() for c in ("d1", "d2", "bits", "numbers")), strict=True)}
    hit = np.zeros(len(spans.joined), bool)
    some = np.flatnonzero(np.isin(spans.hashes(), told.column("h").to_numpy())) if answers else np.zeros(0, np.int64)
    for i, d in zip(some.tolist(), map(tuple, spans.digests(some).tolist()), strict=True):
        if d in answers:
            bits, numbers = answers[d]
            a, e = int(spans.first[i]), int(spans.last[i]) + 1
            if bits is not None:
                hit[a:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - a)
            elif numbers is not None:
                hit[a + np.array(numbers)] = True
            else:
                hit[a:e] = True
    removed, runs, kept = [], [], []
    for a, e in zip(spans.bounds[:-1].tolist(), spans.bounds[1:].tolist(), strict=True):
        starts = np.flatnonzero(hit[a:e])
        if not len(starts):
            removed.append(0)
            runs.append(0)
            kept.append(spans.joined[a:e])
            continue
        first = np.flatnonzero(np.diff(starts, prepend=-length - 1) > length)  # strings that touch are one run
        left = starts[first]
        right = starts[np.append(first[1:], len(starts)) - 1] + length
        removed.append(int((right - left).sum()))
        runs.append(len(first))
        edges = [0, *np.stack([left, right], 1).ravel().tolist(), e - a]
        kept.append(b"".join(spans.joined[a + x : a + y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
    names = [c for c in t.column_names if c.startswith("c_")]
    sizes = np.diff(spans.bounds).astype(np.int64)
    return pa.table([t.column("key"), *(t.column(c) for c in names), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["key", *names, "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, *, length: int = 400, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """Per row: key (a whole number), the columns `carry`, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes, which
    needn't be whole characters).

    Every occurrence of a repeated string goes, the first one too, within a document as well; strings never cross
    documents. A null text is an empty one; a text under `length` bytes keeps all. Keys don't matter: null and repeated
    ones are rows like others, so repeated rows of `length` bytes or more lose all. Other columns aren't read.
    """
    if length < 40:
        raise ValueError("length must be at least 40")
    n = group_count(docs, text)
    kinds = dict(docs.dtypes)
    texts = grouped(docs, n, key, text, *carry)
    by_group = texts.groupBy("p", "g")
    name = ["h", "d1", "d2"]
    spans = written(by_group.applyInArrow(lambda t: profile(t, length), "h long, d1 long, d2 long, g long, n int"), "suffix-spans")
    by_hash = spans.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("_n")).where("_n > 1").drop("_n")
    total = spans.count()
    shared = written(salted_join(spans, by_hash, ["h"], rows="rows", total=total), "suffix-shared")
    different = written(shared.groupBy(*name).agg(F.sum("n").alias("n"), F.min("g").alias("g"), F.count(F.lit(1)).alias("rows")), "suffix-different")
    met = different.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("hot", F.col("rows") >= hot)
    asked = salted_join(different.drop("rows"), met, ["h"], rows="rows", total=total).select("g", *name, F.least("n", F.lit(2)).alias("n"), "hot")
    sent = written(by_group.cogroup(dealt(asked, "g", n).groupBy("p", "g")).applyInArrow(lambda a, b: send(a, b, length), SENT), "suffix-sent")
    size = sent.where("NOT hot").agg(F.sum(F.octet_length("span"))).first()[0] or 0
    shards = parts(size, SHARD_BYTES, min(48, 2 * docs.sparkSession.sparkContext.defaultParallelism))
    sorted_out = dealt(sent.where("NOT hot").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))), "shard", shards).groupBy("p", "shard").applyInArrow(lambda t: match(t, length), BACK)
    found = sorted_out.unionByName(hot_windows(sent.where("hot"), length), allowMissingColumns=True)
    copies = salted_join(shared.select("g", *name), different.where("n > 1").select(*name, "rows"), name, rows="rows", total=total)
    told = dealt(found.unionByName(copies, allowMissingColumns=True), "g", n)
    schema = ", ".join(["key long", *(f"`c_{c}` {kinds[c]}" for c in carry), "n_bytes long, n_removed long, n_spans long, kept binary"])
    return by_group.cogroup(told.groupBy("p", "g")).applyInArrow(lambda a, b: remove(a, b, length), schema).toDF(key, *carry, "n_bytes", "n_removed", "n_spans", "kept")
