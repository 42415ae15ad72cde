"""N-gram Jaccard join: an exact metric-space join of documents as sets of word shingles.

Jaccard distance is a metric. Each document is placed in the regions of the pivots it may be near; a region is first
held against its pivot, and by the triangle inequality only documents whose distances to the pivot differ by at most
the radius can link, so that what is settled leaves the region and the rest is joined by further pivots, recursively.

1. Documents are dealt into groups, where equal sets collapse. Frequencies of all shingles are counted in shards and go
   back as classes (log2). A document with too few shingles that occur elsewhere can't link and is done: linked
   documents share 80 % of either.
2. With shingles ordered from rare to frequent, linked documents share one of their first (prefix). The pivot of a
   prefix shingle is the document of the smallest key that has it there; a document's regions are those of its prefix
   shingles' pivots. So the two ends of a link always meet in some region.
3. Regions are dealt out in chunks, each with the pivot: a region of any size is spread. Documents within the radius of
   the pivot link with it. Of these only the boundary goes on: those that a document outside the radius could reach.
4. What is left of a region recurses: new pivots cut it into Voronoi cells, boundary documents are copied into every
   cell that they're within twice the radius of, and small or inseparable cells are joined by prefix with windows.
5. A region that leaves more than a chunk is cut into tiles of at most about a chunk, by set size and distance to the
   pivot. Neighbouring tiles meet two at a time, each pair in a task of its own; tiles further apart can't hold a link,
   and members that link with the pivot are connected, so that two tiles of them don't meet.

Pairs already connected are not compared again: the result is each document's class, and links that connect it.
Shingles are compared by 64-bit hashes, which a word of any bytes enters whole; a set of one shingle by 128 bits. A collision of
two shingles changes an intersection by one, so that a false link takes a collision between two documents that are one shingle short of a link.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frequencies
from .common import dealt, gram_hashes, group_count, grouped, hashed_words, salted_join, written
from .components import components

CHUNK = 256
CELL = 64
PIVOTS = 8


def shingles(texts: list[str | None], n: int) -> list[tuple[int, int, np.ndarray]]:
    """Words of all texts, sizes of their sets of n-word shingles, and the sets as sorted 64-bit hashes. Of fewer words, the
    whole sequence is the one shingle. A set of one has two hashes of it, as there a single collision would be a link; it links
    with sets of one alone, so nothing else changes."""
    lower = [t.encode().lower() if t else b"" for t in texts]  # of bytes, lower() changes A-Z alone
    words, _, counts = hashed_words(lower)
    grams = gram_hashes(words, n) if len(words) >= n else np.zeros(0, np.uint64)
    out = []
    for text, count, end in zip(lower, counts.tolist(), counts.cumsum().tolist(), strict=True):
        h = np.sort(grams[end - count : end - n + 1]) if count >= n else np.zeros(min(count, 1), np.uint64)
        h = h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
        two = xxhash.xxh3_128_digest(b" ".join(text.split(None, n)[:n])) if len(h) == 1 else b""
        out.append((count, len(h), np.sort(np.frombuffer(two, np.uint64)) if two else h))
    return out


class Sets:
    """Distinct sets of a group, with the smallest key that has each."""

    def __init__(self, t: pa.Table, n: int) -> None:
        self.keys = t.column("key").to_pylist()
        self.words: list[int] = []
        self.sizes: list[int] = []
        self.of: list[int] = []
        self.sets: list[np.ndarray] = []
        self.least: list[int] = []
        index: dict[bytes, int] = {}
        for key, (words, size, s) in zip(self.keys, shingles(t.column("text").to_pylist(), n), strict=True):
            self.words.append(words)
            self.sizes.append(size)
            if not len(s) or key is None:
                self.of.append(-1)
                continue
            i = index.setdefault(xxhash.xxh3_128_digest(s.tobytes()), len(index))
            if i == len(self.sets):
                self.sets.append(s)
                self.least.append(key)
            elif key < self.least[i]:
                self.least[i] = key
            self.of.append(i)
        self.digests = list(index)
        self.flat = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)


def send(t: pa.Table, n: int, shards: int) -> pa.Table:
    """Shingles of a group by shard, with how many of its sets have each."""
    return frequencies.send(t.column("g")[0].as_py(), frequencies.places(Sets(t, n).flat, shards))


def select(t: pa.Table, back: pa.Table, n: int, shards: int, percent: int) -> pa.Table:
    """Rows of kind 0: a document's key, words, set size, the smallest key of its set in the group, and the columns it
    carries. Rows of kind 1: a set that may link, with its prefix."""
    sets = Sets(t, n) if t.num_rows else None
    keys, words, sizes, same = [], [], [], []
    some: list[tuple[int, int, bytes, bytes, bytes]] = []
    if sets:
        keys, words, sizes = sets.keys, sets.words, sets.sizes
        same = [k if i < 0 else sets.least[i] for k, i in zip(sets.keys, sets.of, strict=True)]
        if len(sets.flat):
            _, at = np.unique(frequencies.places(sets.flat, shards), return_inverse=True)
            kinds = np.split(frequencies.known(back)[at], np.cumsum([len(s) for s in sets.sets])[:-1])
            for s, kind, key, digest in zip(sets.sets, kinds, sets.least, sets.digests, strict=True):
                shared = int((kind > 0).sum())
                if 100 * shared < percent * len(s):
                    continue
                prefix = np.lexsort((s, kind))[: len(s) - -(-percent * len(s) // 100) + 1]
                some.append((key, len(s), digest, s.tobytes(), s[prefix[kind[prefix] > 0]].tobytes()))
    m = len(keys)
    cols = [*zip(*some, strict=True)] or [[]] * 5
    return pa.table({
        "kind": pa.array([0] * m + [1] * len(some), pa.int32()),
        "key": pa.array([*keys, *cols[0]], pa.int64()),
        "words": pa.array([*words, *[None] * len(some)], pa.int64()),
        "size": pa.array([*sizes, *cols[1]], pa.int64()),
        "same": pa.array([*same, *[None] * len(some)], pa.int64()),
        "digest": pa.array([*[None] * m, *cols[2]], pa.binary()),
        "set": pa.array([*[None] * m, *cols[3]], pa.binary()),
        "prefix": pa.array([*[None] * m, *cols[4]], pa.binary()),
        **{c: pa.chunked_array([*t.column(c).chunks, pa.nulls(len(some), t.column(c).type)]) for c in t.column_names if c.startswith("c_")},
    })


def _prefixes(t: pa.Table) -> pa.Table:
    sets = [np.frombuffer(x, np.int64) for x in t.column("prefix").to_pylist()]
    n = [len(x) for x in sets]
    return pa.table({"key": np.repeat(t.column("key").to_numpy(), n), "shingle": np.concatenate(sets) if sets else np.zeros(0, np.int64)})


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _links(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def star(t: pa.Table, percent: int) -> pa.Table:
    """One chunk of a region against its pivot: distance of every member; whether it links.

    The pivot's set travels as the row whose key is the region.
    """
    keys, sets = t.column("key").to_pylist(), [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
    region = t.column("region")[0].as_py()
    pivots = [i for i, k in enumerate(keys) if k == region]
    out = []
    for i, (key, s) in enumerate(zip(keys, sets, strict=True)):
        if i in pivots:
            continue
        best = max((_common(s, sets[p]) / (len(s) + len(sets[p]) - c) if (c := _common(s, sets[p])) else 0.0, _links(c, len(s), len(sets[p]), percent)) for p in pivots)
        out.append((key, 1 - best[0], best[1]))
    cols = [*zip(*out, strict=True)] or [[]] * 3
    return pa.table({"region": pa.array([region] * len(out), pa.int64()), "key": pa.array(cols[0], pa.int64()), "d": pa.array(cols[1], pa.float64()), "links": pa.array(cols[2], pa.bool_())})


class Region:
    """Exact join of one region, recursive by pivots. `found` holds links that connect what belongs together."""

    def __init__(self, keys: list[int], sets: list[np.ndarray], percent: int, linked: list[bool] | None = None, side: list[int] | None = None) -> None:
        """`linked`: members that are connected already. `side`: only members of different sides are to be compared."""
        self.keys, self.sets, self.percent, self.side = keys, sets, percent, side
        self.radius = 1 - percent / 100
        self.found: list[tuple[int, int]] = []
        self.root = list(range(len(keys)))
        together = [i for i, x in enumerate(linked or []) if x]
        for i in together:
            self.root[i] = together[0]

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def _distance(self, i: int, j: int) -> float:
        """Distance; a link is noted on the way."""
        a, b = self.sets[i], self.sets[j]
        c = _common(a, b)
        x, y = self._find(i), self._find(j)
        if x != y and _links(c, len(a), len(b), self.percent):
            self.root[x] = y
            self.found.append((self.keys[i], self.keys[j]))
        return 1 - c / (len(a) + len(b) - c)

    def join(self, members: list[int]) -> None:
        todo = [members]
        while todo:
            cell = todo.pop()
            if len(cell) < 2 or len({self._find(i) for i in cell}) == 1:
                continue
            cells = self._cells(cell) if len(cell) > CELL else []
            if cells and max(map(len, cells)) <= 0.7 * len(cell) and sum(map(len, cells)) <= 2 * len(cell):
                todo += cells
            else:
                self._by_prefix(cell)

    def _cells(self, cell: list[int]) -> list[list[int]]:
        """Voronoi cells of pivots far from each other, boundary documents copied: of two linked documents, one is
        within twice the radius of the other's pivot, compared with its own."""
        pivots = [min(cell, key=self.keys.__getitem__)]
        far = [self._distance(pivots[0], i) for i in cell]
        table = [far]
        while len(pivots) < PIVOTS:
            nearest = [min(d) for d in zip(*table, strict=True)]
            k = max(range(len(cell)), key=nearest.__getitem__)
            if nearest[k] <= self.radius:
                break
            pivots.append(cell[k])
            table.append([self._distance(cell[k], i) for i in cell])
        d = np.array(table)
        own = d.argmin(0)
        near = d <= d.min(0) + 2 * self.radius + 1e-9
        near[own, np.arange(len(cell))] = True
        return [[i for i, x in zip(cell, row.tolist(), strict=True) if x] for row in near]

    def _by_prefix(self, cell: list[int]) -> None:
        """Candidates share a rare shingle; a window on the distance to the first member spares most comparisons."""
        flat = np.concatenate([self.sets[i] for i in cell])
        _, at, many = np.unique(flat, return_inverse=True, return_counts=True)
        lengths = [len(self.sets[i]) for i in cell]
        number = np.split(at, np.cumsum(lengths)[:-1])
        to_first = [self._distance(cell[0], i) for i in cell]
        lists: dict[int, list[int]] = {}
        for k in sorted(range(len(cell)), key=lambda k: lengths[k]):
            n = lengths[k]
            rare = number[k][np.lexsort((number[k], many[number[k]]))[: n - -(-self.percent * n // 100) + 1]]
            candidates: set[int] = set()
            for x in rare.tolist():
                if many[x] > 1:
                    others = lists.setdefault(x, [])
                    candidates.update(others)
                    others.append(k)
            for o in sorted(candidates):
                if self.side and self.side[cell[o]] == self.side[cell[k]]:
                    continue
                if 100 * lengths[o] >= self.percent * n and abs(to_first[o] - to_first[k]) <= self.radius + 1e-9 and self._find(cell[o]) != self._find(cell[k]):
                    self._distance(cell[o], cell[k])


def _found(region: Region) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in region.found], pa.int64()), "b": pa.array([x for _, x in region.found], pa.int64())})


def leaf(t: pa.Table, percent: int) -> pa.Table:
    """Links of what a region leaves, of at most a chunk."""
    region = Region(t.column("key").to_pylist(), [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()], percent, t.column("links").to_pylist())
    region.join(list(range(len(region.keys))))
    return _found(region)


def tile_pair(t: pa.Table, percent: int) -> pa.Table:
    """Links between two tiles of a region, or within one if both are the same."""
    side = t.column("side").to_pylist()
    two = 1 in side
    region = Region(t.column("key").to_pylist(), [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()], percent, t.column("links").to_pylist(), side if two else None)
    if two and 0 in side:
        region._by_prefix(list(range(len(side))))
    elif not two:
        region.join(list(range(len(side))))
    return _found(region)


def tile_links(left: DataFrame, sizes: DataFrame, sets: DataFrame, *, percent: int, chunk: int) -> DataFrame:
    """Links of regions of any size. `left`: region, key, d (distance to the pivot), links (whether it links with it).
    `sizes`: key, size. `sets`: key, set.

    A tile is a range of sizes and of distances that a link spans at most one border of, dealt by hash into parts.
    """
    radius, width = 1 - percent / 100 + 1e-6, math.log(100 / percent) + 1e-6
    x, y = F.floor(F.log("size") / width).cast("int"), F.floor(F.col("d") / radius).cast("int")
    placed = left.join(sizes, "key").select("region", "key", "links", x.alias("x"), y.alias("y"))
    at = ["region", "x", "y", "links"]
    counts = written(placed.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).withColumn("parts", F.ceil(F.col("_n") / chunk).cast("long")), "jaccard-tiles")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    in_parts = salted_join(placed, counts, at, rows="_n", total=total).select(*at, F.pmod(F.xxhash64("key"), "parts").alias("part"), "key")
    tiles = counts.select(*at, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    tile = F.struct("x", "y", "links", "part")
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    ones = tiles.select("region", tile.alias("a"), F.explode(steps).alias("s")).select("region", "a", (F.col("a.x") + F.col("s.i")).alias("x"), (F.col("a.y") + F.col("s.j")).alias("y"))
    pairs = ones.join(tiles.select("region", "x", "y", tile.alias("b")), ["region", "x", "y"]).where((F.col("a") <= F.col("b")) & ~(F.col("a.links") & F.col("b.links"))).select("region", "a", "b")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("t")), F.struct(F.lit(1).alias("side"), F.col("b").alias("t")))
    ends = pairs.select("region", "a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.slice(sides, 1, 1)).otherwise(sides)).alias("e")).select("region", F.struct("a", "b").alias("pair"), "e.side", "e.t.*")
    loaded = in_parts.join(ends, [*at, "part"]).select("region", "pair", "side", "links", "key").join(sets, "key")
    return loaded.groupBy("region", "pair").applyInArrow(lambda t: tile_pair(t.select(["key", "set", "links", "side"]), percent), "a long, b long")


def near_links(heads: DataFrame, sets: DataFrame, *, percent: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect all sets within the radius. `heads`: key, size, prefix; equal sets only once. `sets`: key, set,
    of these keys and others. A key with several sets meets with all of them, head or not: what they link with links with it."""
    postings = heads.select("key", "prefix").mapInArrow(lambda bs: (b for x in bs for b in _prefixes(pa.Table.from_batches([x])).to_batches()), "key long, shingle long")
    pivots = postings.groupBy("shingle").agg(F.min("key").alias("region"), F.max("key").alias("_most"), F.count(F.lit(1)).alias("_n")).where("region < _most").drop("_most")
    total = heads.agg(F.sum(F.octet_length("prefix")) / 8).first()[0] or 0
    places = written(salted_join(postings, pivots, ["shingle"], rows="_n", total=int(total)).where("key <> region").select("region", "key").distinct(), "jaccard-places")
    # a chunk holds part of a region and the pivot, so no region gathers in one task
    sized = places.groupBy("region").agg(F.count(F.lit(1)).alias("_n")).withColumn("chunks", F.ceil(F.col("_n") / chunk).cast("long"))
    total = places.count()
    members = salted_join(places, sized, ["region"], rows="_n", total=total).select("region", "key", F.pmod(F.xxhash64("key"), "chunks").alias("chunk"))
    own = sized.select("region", F.col("region").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    loaded = members.unionByName(own).join(sets, "key")
    met = written(loaded.groupBy("region", "chunk").applyInArrow(lambda t: star(t, percent), "region long, key long, d double, links boolean"), "jaccard-star")
    links = met.where("links").select(F.col("region").alias("a"), F.col("key").alias("b"))
    radius = 1 - percent / 100
    outside = met.groupBy("region").agg(F.min(F.when(~F.col("links"), F.col("d"))).alias("_out"), F.count(F.lit(1)).alias("_n")).where("_out IS NOT NULL")
    left = written(salted_join(met, outside, ["region"], rows="_n", total=total).where(~F.col("links") | (F.col("d") >= F.col("_out") - F.lit(radius + 1e-9))).select("region", "key", "d", "links"), "jaccard-left")
    sizes = left.groupBy("region").agg(F.count(F.lit(1)).alias("_n")).withColumn("many", F.col("_n") > chunk)
    sorted_out = salted_join(left, sizes, ["region"], rows="_n", total=total)
    few = sorted_out.where("NOT many").select("region", "key", "links").join(sets, "key")
    rest = few.groupBy("region").applyInArrow(lambda t: leaf(t.select(["key", "set", "links"]), percent), "a long, b long")
    many = sorted_out.where("many").drop("many")
    return links.unionByName(rest).unionByName(tile_links(many, heads.select("key", "size"), sets, percent=percent, chunk=chunk))


def class_rows(docs: DataFrame, *, percent: int = 80, n: int = 5, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """As `classes`, with the columns `carry` and n_words: words are counted where they are hashed."""
    g = group_count(docs, text)
    shards = frequencies.shards(g)
    kinds = dict(docs.dtypes)
    texts = grouped(docs, g, key, text, *carry)
    sent = texts.groupBy("p", "g").applyInArrow(lambda t: send(t, n, shards), frequencies.SENT)
    back = dealt(sent, "shard", shards).groupBy("p", "shard").applyInArrow(frequencies.classify, frequencies.BACK)
    schema = ", ".join(["kind int, key long, words long, size long, same long, digest binary, set binary, prefix binary", *(f"`c_{c}` {kinds[c]}" for c in carry)])
    found = written(texts.groupBy("p", "g").cogroup(dealt(back, "g", g).groupBy("p", "g")).applyInArrow(lambda a, b: select(a, b, n, shards, percent), schema), "jaccard-sets")
    rows = found.where("kind = 0").select("key", "words", "size", "same", *(f"c_{c}" for c in carry))
    some = found.where("kind = 1")
    least = some.groupBy("digest").agg(F.min("key").alias("head"))
    # without the sets, which are several times what their prefixes take and are loaded where they meet
    placed = written(some.select("key", "size", "digest", "prefix").join(least, "digest").select("key", "head", "size", F.when(F.col("key") == F.col("head"), F.col("prefix")).alias("prefix")), "jaccard-heads")
    equal = placed.where("key <> head").select("key", "head")
    heads = placed.where("key = head").select("key", "size", "prefix")
    links = equal.toDF("a", "b").unionByName(near_links(heads, some.select("key", "set"), percent=percent, chunk=chunk))
    found_in = components(links)
    return rows.join(found_in, F.col("same") == F.col("node"), "left").select(F.col("key").alias(key), *(F.col(f"c_{c}").alias(c) for c in carry), F.col("words").alias("n_words"), F.col("size").alias("n_shingles"), F.coalesce("component", "same").alias("component_id"))


def classes(docs: DataFrame, *, percent: int = 80, n: int = 5, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row: key (a whole number), n_shingles, component_id (the smallest key that links of at least percent/100 lead to).

    Null and wordless texts have no shingles and link with nothing; a row with a null key has a null component. Rows of
    one key count as one document with several texts. Other columns aren't read. `chunk`: how many sets a task holds of a
    region.
    """
    return class_rows(docs, percent=percent, n=n, key=key, text=text, chunk=chunk).select(key, "n_shingles", "component_id")
