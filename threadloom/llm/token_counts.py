"""Token counts of a word-level BPE, by a map-side two-tier lookup.

Tier one is a broadcast table of pre-token lengths: every word-final entry of the vocabulary, encoded once on the
driver and sent as one text and one byte a word. Its size is bounded by the vocabulary, whatever the corpus. Tier two is
a cache in each Python worker, which lives as long as the worker: a pre-token that misses tier one is encoded once and
its length kept. No pre-token is ever shuffled and no row leaves its partition.

Every text goes through both tiers. ASCII and Latin texts are lower-cased here, others by the library's own normaliser;
pre-tokens are split by one pattern over all of Unicode. Only where a text holds a character that this Python's Unicode
tables don't know yet, the library splits it, and its pre-tokens are looked up like any other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

CACHE_ENTRIES = 1_000_000
CACHED_CHARS = 64
LATIN_TOP = 0x250


def _class(first: str, below: int) -> str:
    """The characters below a code point whose category starts with `first`, as ranges of a regular expression."""
    runs: list[list[int]] = []
    for c in range(below):
        if unicodedata.category(chr(c))[0] == first:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _byte_characters() -> list[str]:
    """The character that byte-level BPE puts for each byte: printable Latin-1 stays, the rest are numbered from 256."""
    keeps = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    new = iter(range(256, 512))
    return [chr(b if b in keeps else next(new)) for b in range(256)]


_BYTE = _byte_characters()
_BACK = {c: b for b, c in enumerate(_BYTE)}
#: Unicode's white space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _pattern(below: int) -> re.Pattern:
    """The split pattern of the vocabulary file, for characters below a code point: the fewer ranges, the faster."""
    letters, digits = _class("L", below), _class("N", below)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{_SPACE}{letters}{digits}]+")


LATIN, BASIC = map(_pattern, (LATIN_TOP, 0x10000))
#: For texts beyond the basic plane, where ranges would be many; the characters that Python knows are classed alike.
ALL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BEYOND_LATIN = re.compile(rf"[^\x00-\u{LATIN_TOP - 1:04x}]")
BEYOND_BASIC = re.compile("[\U00010000-\U0010ffff]")


def split(text: str) -> list[str]:
    """Pre-tokens of a normalised text."""
    if text.isascii() or not BEYOND_LATIN.search(text):
        return LATIN.findall(text)
    return (ALL if BEYOND_BASIC.search(text) else BASIC).findall(text)


class Lengths(dict):
    """Length in tokens by pre-token; a missing one is encoded and kept."""

    def __init__(self, known: dict[str, int], tokenizer) -> None:
        super().__init__(known)
        self.base, self.model = len(known), tokenizer.model
        self.known, self.misses = known, 0

    def __missing__(self, word: str) -> int:
        self.misses += 1
        n = len(self.model.tokenize("".join([_BYTE[b] for b in word.encode()])))
        if len(word) <= CACHED_CHARS:
            if len(self) - self.base >= CACHE_ENTRIES:
                self.clear()
                self.update(self.known)
            self[word] = n
        return n


class Counter:
    """Counts tokens as `tokenizer.encode(text, add_special_tokens=False)` would."""

    def __init__(self, path: str, known: dict[str, int]) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normalise, self.library_split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.lengths = Lengths(known, self.tokenizer)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" in text and self.special.search(text):
            pieces = self.special.split(text)
            return len(pieces) - 1 + sum(map(self._plain, pieces))
        return self._plain(text)

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii() or not BEYOND_LATIN.search(text):  # no marks that compose, and the same lower case in any Unicode
            return split(text.lower())
        normal = self.normalise(text)
        if all(unicodedata.category(c) != "Cn" for c in set(normal)):
            return split(normal)
        return [bytes(_BACK[c] for c in p).decode() for p, _ in self.library_split(normal)]

    def _plain(self, text: str) -> int:
        return sum(map(self.lengths.__getitem__, self.pre_tokens(text)))


def frequent_lengths(path: str) -> tuple[str, bytes]:
    """Tier one: the pre-tokens that the vocabulary holds as whole words, one a line, and the length of each."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    end = tokenizer.model.end_of_word_suffix or ""
    words = []
    for v in tokenizer.get_vocab():
        if (w := v.removesuffix(end)) != v and all(c in _BACK for c in w):
            try:
                words.append(bytes(_BACK[c] for c in w).decode())
            except UnicodeDecodeError:  # part of a character
                continue
    words = sorted(w for w in words if split(w.lower()) == [w])
    lengths = [len(tokenizer.model.tokenize("".join([_BYTE[b] for b in w.encode()]))) for w in words]
    return "\n".join(words), bytes(min(n, 255) for n in lengths)


_counters: dict[str, Counter] = {}


def counter(path: str, known: tuple[str, bytes]) -> Counter:
    """One per worker process: its cache outlives batches and tasks."""
    if path not in _counters:
        _counters[path] = Counter(path, dict(zip(known[0].split("\n"), known[1], strict=True)) if known[1] else {})
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null keys pass through one by one; other columns
    of `docs` are not read. Special strings inside a text count as their one token, as the library's default has it.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent_lengths(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path, known.value).count
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            n = [count(t) for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["key", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)[key]
    out = docs.select(key, text).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("key", key)
