"""Fill-in-middle transformation by in-place block rotation.

A text is cut into prefix, middle and suffix between its tokens (a word with the blanks before it, or the blanks at the
end). Its bytes stand in one bytearray; sentinels are inserted in front of the three segments, and segments are exchanged
by rotation: a block's two parts are reversed one by one, then the block as a whole. The inverse rotation and the removal
of the sentinels restore the text exactly.

    psm  <P>prefix<S>suffix<M>middle    the block (middle, suffix) is rotated
    spm  <S>suffix<P>prefix<M>middle    the block (prefix and middle, suffix) is rotated

Each row is by itself: no shuffle, and memory is a slice of a batch or the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import BLANK_BYTES, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes exchanged at a time by a reversal; what a rotation takes besides the buffer.
STEP = 1 << 16
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANK_BYTES)] = True


def reverse(buffer: bytearray, start: int, end: int) -> None:
    """Reverse buffer[start:end] in place, by exchanging blocks from both ends."""
    while end - start > 1:
        n = min(STEP, (end - start) // 2)
        head, tail = buffer[start : start + n], buffer[end - n : end]
        head.reverse()
        tail.reverse()
        buffer[start : start + n], buffer[end - n : end] = tail, head
        start, end = start + n, end - n


def rotate(buffer: bytearray, start: int, border: int, end: int) -> None:
    """Exchange buffer[start:border] with buffer[border:end] in place, by three reversals."""
    reverse(buffer, start, border)
    reverse(buffer, border, end)
    reverse(buffer, start, end)


def token_ends(text: bytes) -> np.ndarray:
    """Where each token ends: after every word, and after blanks at the end of the text."""
    blank = _IS_BLANK[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    return np.append(ends, len(text)) if len(blank) and blank[-1] else ends


def arrange(text: bytes, first: int, second: int, form: str) -> bytes:
    """`text` with sentinels, cut at two places and arranged as `form` (psm or spm)."""
    buffer = bytearray(text)
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return bytes(buffer)


def rearrange(output: bytes, form: str) -> bytes:
    """The text that `arrange` made `output` of; needs nothing but output and form."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    suffix, middle = buffer.find(SUFFIX), buffer.find(MIDDLE)
    if form == "psm":
        rotate(buffer, suffix, middle, len(buffer))
        middle, suffix = suffix, suffix + len(buffer) - middle
    else:
        prefix = buffer.find(PREFIX)
        rotate(buffer, 0, prefix, len(buffer))
        middle, suffix = middle - prefix, len(buffer) - prefix
    for at, sentinel in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        del buffer[at : at + len(sentinel)]
    return bytes(buffer)


def draws(seed: int, key: object) -> tuple[int, ...]:
    """Four 32-bit numbers that depend on seed and key alone. A null key draws as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def _characters(b: bytes) -> int:
    return int(((np.frombuffer(b, np.uint8) & 0xC0) != 0x80).sum())


def one(key: object, text: str | None, seed: int, plain_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """n tokens, form, code points of prefix and middle, output."""
    b = text.encode() if text else b""
    ends = token_ends(b)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, key)
    if not b or PREFIX in b or SUFFIX in b or MIDDLE in b or h3 % 100 >= plain_percent:
        return n, "plain", None, None, text or ""
    form = "spm" if h4 % 100 < spm_percent else "psm"
    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    return n, form, _characters(b[:first]), _characters(b[first:second]), arrange(b, first, second, form).decode()


def _by_rows(make: Callable[[pa.RecordBatch], list[pa.Array]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with what `make` gives for the rows of a slice beside their own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, *make(b)], [*b.schema.names, *names])

    return run


def _with(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    if clash := {f.lower() for f in fields} & {f.name.lower() for f in schema}:
        raise ValueError(f"columns {sorted(clash)} are there already; rename them or leave them out")
    return T.StructType([*schema, *(T.StructField(k, v) for k, v in fields.items())])


def transform(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), seed: int = 42, plain_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Per row: key, the columns `keep`, n (tokens), form (plain, psm or spm), prefix_chars and middle_chars (code points;
    null if plain), output.

    Cuts and form follow from seed and key alone. `plain_percent`: from this part of a hundred on a text stays plain;
    `spm_percent`: of the others so many are spm. A null or empty text, or one that holds a sentinel, is plain. Rows with
    a null key draw as if it were empty; repeated rows are transformed alike. Cuts may meet, so any segment may be empty.
    Columns not named aren't read; one in `keep` that has a result's name is an error that names it.
    """

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        cols = [*zip(*(one(k, t, seed, plain_percent, spm_percent) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), strict=True)] or [[]] * 5
        return [pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]

    rows = docs.select(key, text, *keep)
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    schema = _with(rows.schema, **dict(zip(names, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()), strict=True)))
    return rows.mapInArrow(_by_rows(make, names), schema).drop(text)


def restore(transformed: DataFrame, *, form: str = "form", output: str = "output") -> DataFrame:
    """All columns and `restored`, the text rebuilt from output and form. A null output or form restores to null."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        pairs = zip(b.column(output).to_pylist(), b.column(form).to_pylist(), strict=True)
        return [pa.array([None if o is None or f is None else rearrange(o.encode(), f).decode() for o, f in pairs], pa.string())]

    return transformed.mapInArrow(_by_rows(make, ["restored"]), _with(transformed.schema, restored=T.StringType()))
