"""In how many places do hashes occur? Groups send sorted, difference-coded hashes to shards; classes come back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import pack, unpack

SENT = "shard long, g long, hashes binary, counts binary"
BACK = "g long, shard long, classes binary"


def shards(groups: int) -> int:
    """Fewer shards than groups, so that what a group sends to each isn't small: it sends a row for each, at the most for
    each of its hashes."""
    return max(4, groups // 2)


def places(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard and 32 bits of each hash, in one number. The number of shards grows with the input, and so the bits do;
    two hashes in one place can only raise a frequency."""
    return ((h >> np.uint64(32)) % np.uint64(shards)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def send(g: int, at: np.ndarray, kind: type = np.uint8) -> pa.Table:
    """A row for each shard with the distinct places of a group and how often it has each, as far as `kind` counts."""
    at, counts = np.unique(at, return_counts=True)
    shard = (at >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    cut = lambda x: np.split(x, starts[1:]) if len(starts) else []
    rest = [pack(np.diff(x.astype(np.uint32), prepend=np.uint32(0))) for x in cut(at)]
    many = [pack(np.minimum(x, np.iinfo(kind).max).astype(kind)) for x in cut(counts)]
    return pa.table({"shard": pa.array(shard[starts], pa.int64()), "g": pa.array([g] * len(starts), pa.int64()), "hashes": pa.array(rest, pa.binary()), "counts": pa.array(many, pa.binary())})


def classify(t: pa.Table) -> pa.Table:
    """Classes of what was sent with the default kind of counts."""
    return classify_as(t, np.uint8)


def classify_as(t: pa.Table, kind: type) -> pa.Table:
    """For each group the classes of what it sent, in that order: 0 for one occurrence, k for 2^k to 2^(k+1) - 1."""
    sent = [np.cumsum(unpack(x, np.uint32), dtype=np.uint32) for x in t.column("hashes").to_pylist()]
    counts = [unpack(x, kind) for x in t.column("counts").to_pylist()]
    _, at = np.unique(np.concatenate(sent), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts))
    classes = np.floor(np.log2(total[at])).astype(np.uint8)
    ends = np.cumsum([len(x) for x in sent])[:-1]
    return pa.table({"g": t.column("g"), "shard": t.column("shard"), "classes": pa.array([pack(x) for x in np.split(classes, ends)], pa.binary())})


def known(back: pa.Table) -> np.ndarray:
    """Classes of a group's distinct places, in their order."""
    parts = [unpack(x, np.uint8) for x in back.sort_by("shard").column("classes").to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)
