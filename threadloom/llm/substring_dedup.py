"""Substring dedup: suffix automata of reference shards, by which documents lose passages that came earlier.

Reference and input are the same corpus here: a window of `window` words goes if the same words also stand in a document
of a smaller key. No automaton of a corpus has a size bound, so it isn't broadcast; it is cut into shards, and what a
shard must be matched with is sent to it:

1. Documents are dealt into groups. A task cuts each into spans: runs of windows that have the same least 4-word hash
   (minimizer), of at most as many windows as one place of it can serve. Equal windows have equal minimizers, so the
   minimizer names the one shard where both must meet. The spans of each minimizer are counted first, and a span whose
   minimizer no other one has stays at home. Equal spans of a group travel once, with the group's smallest key: a passage
   in a third of all documents reaches its shard once from each group.
   A minimizer of 2^HOT spans or more (a frequent phrase, whose neighbours differ everywhere) names no shard: its windows
   are dealt by their own 128-bit digests, each once from a group with the group's smallest key, and need no automaton.
2. A shard builds suffix automata over its distinct spans, every state with the smallest key of the texts that reach
   it, and streams the spans through them: the state of a window tells in which document it came first. Spans that
   share no window with another are settled without. No minimizer of an automaton has 2^HOT spans. Of windows dealt by
   digest, a shard takes the smallest key of each.
3. What a shard finds, for spans that some other group had earlier, goes back to the groups, where covered words are
   removed. Every pass over the texts reads the one shuffle of them by group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from . import frequencies
from .common import dealt, gram_hashes, group_count, grouped, hashed_words, mixed, pack, squeeze, unpack, unsqueeze

MINIMIZER = 4
AUTOMATON_WORDS = 20_000
#: From 2^HOT spans on, a minimizer's windows are dealt one by one; as many spans fill an automaton.
HOT = 10
COUNTED = np.uint16
NEVER = np.iinfo(np.int64).max


def _least(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    have, m = 1, g
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (w - have)], m[w - have :]) if have < w else m


def spans(grams: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end window of each span, and its minimizer, from the hashes of MINIMIZER words."""
    least = _least(grams, window - MINIMIZER + 1)
    new = np.concatenate([[True], least[1:] != least[:-1]])
    at = np.arange(len(least))
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % (window - MINIMIZER + 1) == 0  # a phrase repeated has a run without end
    start = np.flatnonzero(new)
    return start, np.append(start[1:], len(least)), least[start]


def digests_of(pieces: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of the windows of all pieces, as two numbers each; how many each piece has."""
    out: list[bytes] = []
    counts = []
    for p in pieces:
        words = p.split(b" ")
        counts.append(len(words) - window + 1)
        out += [xxhash.xxh3_128_digest(b" ".join(words[i : i + window])) for i in range(counts[-1])]
    return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2), np.array(counts, np.int64)


def least_keys(digests: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct digests in order, the smallest key of each, and the place of every given one among them."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    ranked = digests[order]
    new = np.ones(len(order), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(1)
    at = np.empty(len(order), np.int64)
    at[order] = new.cumsum() - 1
    least = np.full(int(new.sum()), NEVER)
    np.minimum.at(least, at, keys)
    return ranked[new], least, at


class Texts:
    """Spans of a group's documents."""

    def __init__(self, t: pa.Table, window: int, shards: int) -> None:
        self.window = window
        self.keys = t.column("key").to_pylist()
        self.cuts: list[tuple[np.ndarray, ...]] = []
        nothing = np.zeros(0, np.int64)
        self.joined = [b" ".join(x.encode().split()) if x else b"" for x in t.column("text").to_pylist()]
        hashes, lengths, counts = hashed_words(self.joined)
        grams = gram_hashes(hashes, MINIMIZER) if len(hashes) >= MINIMIZER else hashes
        self.counts = counts.tolist()
        for key, n, upto in zip(self.keys, self.counts, counts.cumsum().tolist(), strict=True):
            if n < window or key is None:
                self.cuts.append((nothing, nothing, nothing.astype(np.uint64), nothing, nothing))
                continue
            start, end, least = spans(grams[upto - n : upto - MINIMIZER + 1], window)
            at = np.zeros(n + 1, np.int64)
            np.cumsum(lengths[upto - n : upto] + 1, out=at[1:])
            self.cuts.append((start, end, least, at[start], at[end + window - 1] - 1))
        self.places = [frequencies.places(c[2], shards) for c in self.cuts]

    def profile(self) -> np.ndarray:
        """Minimizers of all documents, once for each span."""
        return np.concatenate([*self.places, np.zeros(0, np.uint64)])

    def read(self, classes: np.ndarray) -> None:
        """Keep the spans whose minimizer some other span has: `pieces` and `cuts` of each document, the smallest key by
        distinct span, the minimizer of those that meet by it, and a list of the others (`hot`)."""
        self.least: dict[bytes, int] = {}
        self.minimizer: dict[bytes, int] = {}
        self.hot: list[bytes] = []
        self.pieces: list[list[bytes]] = []
        _, at = np.unique(np.concatenate([*self.places, np.zeros(0, np.uint64)]), return_inverse=True)
        kinds = np.split(classes[at], np.cumsum([len(x) for x in self.places])[:-1])
        for d, (key, kind, joined) in enumerate(zip(self.keys, kinds, self.joined, strict=True)):
            keep = kind > 0
            start, end, least, a, b = self.cuts[d] = tuple(x[keep] for x in self.cuts[d])
            pieces = [joined[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            self.pieces.append(pieces)
            for p, m, hot in zip(pieces, least.tolist(), (kind[keep] >= HOT).tolist(), strict=True):
                was = self.least.get(p)
                if was is None and hot:
                    self.hot.append(p)
                elif was is None:
                    self.minimizer[p] = m
                if was is None or key < was:
                    self.least[p] = key

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the hot spans: distinct windows and the group's smallest key of each; each window's place among them; how
        many each span has."""
        digests, counts = digests_of(self.hot, self.window)
        keys = np.repeat(np.array([self.least[p] for p in self.hot], np.int64), counts)
        return *least_keys(digests, keys), counts


def profile(t: pa.Table, window: int, shards: int) -> pa.Table:
    return frequencies.send(t.column("g")[0].as_py(), Texts(t, window, shards).profile(), COUNTED)


def _by_shard(shard: np.ndarray) -> list[np.ndarray]:
    """Places of each shard."""
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(shard) else []


def send(t: pa.Table, back: pa.Table, window: int, counted: int, shards: int) -> pa.Table:
    """A row for each shard that this group has spans for, and one for each that it has windows for. counted: in how many
    shards minimizers were counted."""
    rows = []
    if t.num_rows:
        g = t.column("g")[0].as_py()
        texts = Texts(t, window, counted)
        texts.read(frequencies.known(back))
        lines = list(texts.minimizer)
        least = np.array([texts.least[p] for p in lines], np.int64)
        minimizer = np.fromiter(texts.minimizer.values(), np.uint64, len(lines))
        shard = (mixed(minimizer) % np.uint64(shards)).astype(np.int64)
        for i in _by_shard(shard):
            rows.append((int(shard[i[0]]), g, squeeze(b"\n".join([lines[k] for k in i.tolist()])), pack(least[i]), pack(minimizer[i].astype(np.uint32)), None))
        digests, least, _, _ = texts.windows()
        shard = (digests[:, 0] % np.uint64(shards)).astype(np.int64)
        for i in _by_shard(shard):
            rows.append((int(shard[i[0]]), g, None, pack(least[i]), None, digests[i].tobytes()))
    cols = [*zip(*rows, strict=True)] or [[]] * 6
    kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["shard", "g", "lines", "least", "minimizer", "windows"])


class Automaton:
    """Suffix automaton over several word sequences; `first` of a state: the smallest key of texts that reach it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [NEVER]

    def _new(self, edges: dict[int, int], length: int, first: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for what p reaches by w, where q stands for longer texts as well."""
        if self.length[p] + 1 == self.length[q]:
            return q
        c = self._new(dict(self.next[q]), self.length[p] + 1, NEVER)
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def add(self, words: list[int], key: int) -> None:
        at = 0
        for w in words:
            q = self.next[at].get(w)
            if q is not None:
                at = self._split(at, w, q)
            else:
                new = self._new({}, self.length[at] + 1, NEVER)
                p = at
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, w, self.next[p][w])
                at = new
            if key < self.first[at]:
                self.first[at] = key

    def close(self) -> None:
        """Hand keys on to the states of shorter texts."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            p = self.link[v]
            if self.first[v] < self.first[p]:
                self.first[p] = self.first[v]

    def stream(self, words: list[int], window: int) -> list[int]:
        """Matching statistics of a text, read as: the smallest key of each of its windows (NEVER: none has it)."""
        out, at, n = [], 0, 0
        for i, w in enumerate(words):
            while at and w not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if w in self.next[at]:
                at, n = self.next[at][w], n + 1
            while n >= window and self.length[self.link[at]] >= window:
                at = self.link[at]
                n = self.length[at]
            if i >= window - 1:
                out.append(self.first[at] if n >= window else NEVER)
        return out


def _sharing(lines: list[bytes], window: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which of the spans share a window with another one, by hash (the automaton decides); all spans as word numbers."""
    number: dict[bytes, int] = {}
    counts = np.array([p.count(b" ") + 1 for p in lines])
    flat = np.array([number.setdefault(w, len(number)) for w in b" ".join(lines).split(b" ")], np.int64)
    ends = counts.cumsum()
    of = np.repeat(np.arange(len(lines)), counts)
    h = gram_hashes(mixed(flat.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), window)
    whole = of[: len(h)] == of[window - 1 :]
    h, of = h[whole], of[: len(whole)][whole]
    order = np.lexsort((of, h))
    hs, os = h[order], of[order]
    meet = hs[1:][(hs[1:] == hs[:-1]) & (os[1:] != os[:-1])]
    marked = np.zeros(len(lines), bool)
    if len(meet):
        marked[of[np.isin(h, meet)]] = True
    return marked, np.split(flat, ends[:-1])


def match_windows(t: pa.Table) -> list[tuple]:
    """For each group: those of its windows that another group has with a smaller key, and that key."""
    if not t.num_rows:
        return []
    sent = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in t.column("windows").to_pylist()]
    own = [unpack(x, np.int64) for x in t.column("least").to_pylist()]
    _, least, at = least_keys(np.concatenate(sent), np.concatenate(own))
    rows = []
    for g, digests, mine, i in zip(t.column("g").to_pylist(), sent, own, np.split(at, np.cumsum([len(x) for x in own])[:-1]), strict=True):
        earlier = least[i] < mine
        if earlier.any():
            rows.append((g, None, None, pack(least[i][earlier]), digests[earlier].tobytes()))
    return rows


def match(t: pa.Table, window: int) -> pa.Table:
    """For each group: digests of its spans that hold a window which came earlier elsewhere, with each window's key; and
    its windows dealt one by one that did, with their keys."""
    rows = match_windows(t.filter(pc.is_valid(t.column("windows"))))
    t = t.filter(pc.is_valid(t.column("lines")))
    index: dict[bytes, int] = {}
    received = []
    for g, lines, least, minimizer in zip(*(t.column(c).to_pylist() for c in ("g", "lines", "least", "minimizer")), strict=True):
        own = np.array([index.setdefault(p, len(index)) for p in unsqueeze(lines).split(b"\n")])
        received.append((g, own, unpack(least, np.int64), unpack(minimizer, np.uint32)))
    distinct = list(index)
    first, minimizers = np.full(len(distinct), NEVER), np.zeros(len(distinct), np.uint32)
    for _, own, least, minimizer in received:
        first[own] = np.minimum(first[own], least)  # a group names each span once
        minimizers[own] = minimizer
    order = np.argsort(minimizers, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(minimizers[order]) != 0])) if len(order) else np.zeros(0, int)
    bounds = np.append(starts, len(order))
    found: dict[int, np.ndarray] = {}
    bundle: list[int] = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:  # one span by itself is its own reference
            bundle += order[a:b].tolist()
        if len(bundle) * (window + 6) > AUTOMATON_WORDS or b == len(order):
            if bundle:
                marked, words = _sharing([distinct[i] for i in bundle], window)
                some = np.flatnonzero(marked).tolist()
                automaton = Automaton()
                for i in some:
                    automaton.add(words[i].tolist(), int(first[bundle[i]]))
                automaton.close()
                for i in some:
                    found[bundle[i]] = np.array(automaton.stream(words[i].tolist(), window), np.int64)
            bundle = []
    lowest = first.copy()
    for i, keys in found.items():
        lowest[i] = keys.min()
    for g, own, least, _ in received:
        earlier = own[lowest[own] < least].tolist()
        if earlier:
            keys = [found.get(i, first[i : i + 1]) for i in earlier]
            rows.append((g, squeeze(b"".join([xxhash.xxh3_128_digest(distinct[i]) for i in earlier])), pack(np.array([len(k) for k in keys], np.uint32)), pack(np.concatenate(keys)), None))
    cols = [*zip(*rows, strict=True)] or [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), *[pa.binary()] * 4), strict=True)], ["g", "digests", "counts", "keys", "windows"])


def remove(t: pa.Table, back: pa.Table, window: int, counted: int, as_was: bool) -> pa.Table:
    """Rows of a group with n_words, n_removed and the kept words; as_was: a text that loses nothing stays unchanged."""
    texts = Texts(t, window, counted) if t.num_rows else None
    told: dict[bytes, np.ndarray] = {}
    found = back.filter(pc.is_valid(back.column("digests")))
    for digests, counts, keys in zip(*(found.column(c).to_pylist() for c in ("digests", "counts", "keys")), strict=True):
        digests, counts = unsqueeze(digests), unpack(counts, np.uint32)
        for i, k in enumerate(np.split(unpack(keys, np.int64), counts.cumsum()[:-1])):
            told[digests[16 * i : 16 * i + 16]] = k
    removed, kept = [], []
    if texts:
        texts.read(frequencies.known(back.filter(pc.is_valid(back.column("classes")))))
        earlier: dict[bytes, np.ndarray] = {}
        if told:
            for p in texts.least:
                if (k := told.get(xxhash.xxh3_128_digest(p))) is not None:
                    earlier[p] = k
        if texts.hot:
            some = back.filter(pc.is_valid(back.column("windows")))
            digests, least, at, counts = texts.windows()
            told_of = [digests, *(np.frombuffer(x, np.uint64).reshape(-1, 2) for x in some.column("windows").to_pylist())]
            _, least, places = least_keys(np.concatenate(told_of), np.concatenate([least, *(unpack(x, np.int64) for x in some.column("keys").to_pylist())]))
            keys = least[places[: len(digests)]][at]
            for p, k in zip(texts.hot, np.split(keys, counts.cumsum()[:-1]), strict=True):
                if k.min() < texts.least[p]:
                    earlier[p] = k
        for key, pieces, (start, end, *_), joined, n in zip(texts.keys, texts.pieces, texts.cuts, texts.joined, texts.counts, strict=True):
            own = [texts.least[p] < key or p in earlier for p in pieces]
            if not any(own):
                removed.append(0)
                kept.append(joined)
                continue
            hit = np.zeros(n - window + 2, np.int64)
            for p, o, a, b in zip(pieces, own, start.tolist(), end.tolist(), strict=True):
                if o:
                    k = earlier.get(p)
                    hit[a + 1 : b + 1] = True if texts.least[p] < key else k < key
            upto = hit.cumsum()
            at = np.arange(n)
            keep = upto[np.minimum(at, n - window) + 1] == upto[np.maximum(at - window + 1, 0)]
            removed.append(n - int(keep.sum()))
            kept.append(b" ".join([w for w, k in zip(joined.split(b" "), keep.tolist(), strict=True) if k]))
    names = [c for c in t.column_names if c.startswith("c_")]
    done = [k.decode() for k in kept]
    if as_was:
        done = [d if n else x for d, n, x in zip(done, removed, t.column("text").to_pylist(), strict=True)]
    return pa.table(
        [t.column("key"), *(t.column(c) for c in names), pa.array(texts.counts if texts else [], pa.int64()), pa.array(removed, pa.int64()), pa.array(done, pa.string())],
        ["key", *names, "n_words", "n_removed", "kept"],
    )


def dedup(docs: DataFrame, *, window: int = 13, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), as_was: bool = False) -> DataFrame:
    """Per row: key (a whole number), the columns `carry`, n_words, n_removed, kept (the words that stay, joined by one space; with
    `as_was`, a text that loses nothing as it was, a null one too).

    Null and empty texts have no words. A text under `window` words keeps all. A row with a null key loses nothing and
    is no reference. Rows of equal keys don't count against each other. Other columns aren't read.
    """
    if window < MINIMIZER:
        raise ValueError(f"window must be at least {MINIMIZER}")
    n = group_count(docs, text)
    counted = frequencies.shards(n)
    kinds = dict(docs.dtypes)
    texts = grouped(docs, n, key, text, *carry)
    # all three passes read the texts by one shuffle: the plans below it are the same
    places = texts.groupBy("p", "g").applyInArrow(lambda t: profile(t, window, counted), frequencies.SENT)
    met = dealt(places, "shard", counted).groupBy("p", "shard").applyInArrow(lambda t: frequencies.classify_as(t, COUNTED), frequencies.BACK)
    by_group = texts.groupBy("p", "g")
    sent = by_group.cogroup(dealt(met, "g", n).groupBy("p", "g")).applyInArrow(lambda a, b: send(a, b, window, counted, n), "shard long, g long, lines binary, least binary, minimizer binary, windows binary")
    back = dealt(sent, "shard", n).groupBy("p", "shard").applyInArrow(lambda t: match(t, window), "g long, digests binary, counts binary, keys binary, windows binary")
    schema = ", ".join(["key long", *(f"`c_{c}` {kinds[c]}" for c in carry), "n_words long, n_removed long, kept string"])
    told = dealt(back.unionByName(met, allowMissingColumns=True), "g", n)
    out = by_group.cogroup(told.groupBy("p", "g")).applyInArrow(lambda a, b: remove(a, b, window, counted, as_was), schema)
    return out.toDF(key, *carry, "n_words", "n_removed", "kept")
