"""Numpy kernels over the bytes of Arrow string columns.

A string column of an Arrow batch is one byte buffer plus offsets, so a whole batch is
tokenised and hashed with a few vector operations instead of a Python loop per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

# Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z is lower-cased: digits, a-z
# and every byte of a non-ASCII character.
WORD_TABLE = np.full(256, 32, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    WORD_TABLE[_b] = _b
for _b in range(0x41, 0x5B):
    WORD_TABLE[_b] = _b + 32
# Words of ``[^\x20\x09-\x0D]+``: everything but ASCII white space, A-Z lower-cased. Bytes
# below 33 that are not white space stay words, so a shift to another free value marks space.
SPACE_TABLE = np.arange(256, dtype=np.uint8)
for _b in range(0x41, 0x5B):
    SPACE_TABLE[_b] = _b + 32
IS_SPACE = np.zeros(256, bool)
for _b in [0x20, *range(0x09, 0x0E)]:
    IS_SPACE[_b] = True
IS_WORD = WORD_TABLE != 32

DOC_END = 10


def text_chunks(column: pa.Array, max_bytes: int = 4 << 20, pad: bytes = b"  ") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields ``(first, last, bytes, ends)`` over runs of rows of about ``max_bytes`` (one
    row at least): every text followed by ``pad``, a null counting as empty;
    ``ends`` are the end offsets of the rows, the pad included."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if pad:
        column = pc.binary_join_element_wise(column, pa.scalar(pad, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i] : offs[j]], offs[i + 1 : j + 1] - offs[i]
        i = j


class WordStream:
    """The words of several texts as one normal form: lower-cased words, one space after
    each, one ``DOC_END`` byte after each text. Built from texts padded with two spaces.

    ``data`` holds the bytes, ``starts`` the offset of every word, ``first`` the number of
    the first word of each text (one more entry than texts), ``doc_ends`` the offsets of the
    ``DOC_END`` bytes.
    """

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        mapped = WORD_TABLE[raw]
        mapped[ends - 1] = DOC_END
        word = mapped > 32
        keep = word.copy()
        keep[1:] |= word[:-1]
        keep[ends - 1] = True
        self.data = mapped[keep]
        word = self.data > 32
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        self.starts = np.flatnonzero(begin)
        self.doc_ends = np.flatnonzero(self.data == DOC_END)
        self.first = np.concatenate([[0], np.searchsorted(self.starts, self.doc_ends)])

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (multiply, xor-shift), in place on uint64."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


BYTE_CODE = seeds(256, 11)
BASE = U64(0xD6E8FEB86659FD93)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def inverse64(base: np.uint64) -> np.uint64:
    """Inverse of an odd number modulo 2**64."""
    return U64(pow(int(base), -1, 1 << 64))


def strings(values: list[bytes | str | None]) -> pa.Array:
    return pa.array(values, pa.string())
