"""Vectorised text kernel shared by the text operators.

Everything works on Arrow string buffers: a batch of texts is viewed as one
UTF-8 byte array, tokens are found with table look-ups and hashed by
differences of running polynomial sums, so no Python code runs per word.

Two tokenisations are offered, both defined on bytes so that SQL can state
them exactly:

* ``SPACE``  - maximal runs of bytes other than ASCII white space
  (``[ \\t\\n\\v\\f\\r]``), case kept;
* ``ALNUM``  - maximal runs of ASCII letters, digits and all non-ASCII bytes,
  with ASCII letters lowered.

Null texts have no tokens, as have empty texts.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

from parley import worker_cache

U64 = np.uint64
CHUNK_BYTES = (1 << 20) - 64

#: Odd multipliers of the two polynomial hashes (bytes in a word, words in a window), modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F

_byte = np.arange(256)
_SPACE = np.isin(_byte, [9, 10, 11, 12, 13, 32])
_ALNUM_SEP = (_byte < 128) & ~(((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)))
_LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_CODE = mix(np.arange(1, 257, dtype=U64))
_CODE_LOWER = _CODE[_LOWER]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept between calls)."""
    kept = worker_cache()
    have = kept.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, U64)
            p[0] = 1
            filled = 1
            while filled < size:
                step = min(filled, size - filled)
                p[filled : filled + step] = p[:step] * U64(pow(b, filled, 1 << 64))
                filled += step
            both.append(p)
        have = kept[base] = (both[0], both[1])
    return have


class Words:
    """Tokens of a chunk of texts.

    ``data`` bytes, ``start``/``end`` byte positions of tokens, ``doc`` index of
    each token's text in the chunk, ``first`` index of each text's first token
    (length texts + 1), ``hash`` 64-bit token hashes.
    """

    __slots__ = ("data", "start", "end", "doc", "first", "hash", "offsets")

    def __init__(self, data, offsets, mode="SPACE"):
        self.data, self.offsets = data, offsets
        sep = (_SPACE if mode == "SPACE" else _ALNUM_SEP)[data]
        n = len(data)
        edge = np.empty(n + 1, bool)
        if n:
            edge[0] = not sep[0]
            edge[n] = not sep[n - 1]
            np.not_equal(sep[1:], sep[:-1], out=edge[1:n])
            # a text's boundary splits tokens that touch it
            cut = offsets[1:-1]
            cut = np.unique(cut[(cut > 0) & (cut < n)])
            split = cut[~sep[cut] & ~sep[cut - 1]]
            pos = np.flatnonzero(edge)
            if len(split):
                pos = np.sort(np.concatenate([pos, split, split]))
            self.start, self.end = pos[0::2], pos[1::2]
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        code = (_CODE if mode == "SPACE" else _CODE_LOWER)[data]
        p, q = powers(BYTE_BASE, n + 1)
        run = np.empty(n + 1, U64)
        run[0] = 0
        np.cumsum(code * p[:n], out=run[1:])
        self.hash = mix((run[self.end] - run[self.start]) * q[self.start])

    def __len__(self):
        return len(self.start)

    def prefix(self) -> np.ndarray:
        """Running polynomial sums over token hashes, for `span`."""
        p, _ = powers(WORD_BASE, len(self) + 1)
        run = np.empty(len(self) + 1, U64)
        run[0] = 0
        np.cumsum(self.hash * p[: len(self)], out=run[1:])
        return run

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start tokens and hashes of all windows of n tokens within one text."""
        if len(self) < n:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        run = self.prefix()
        ok = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self) - n + 1])
        return ok, span(run, ok, n)


def span(run: np.ndarray, at: np.ndarray, n) -> np.ndarray:
    """Hash of n tokens from token `at`, from the running sums of `Words.prefix`."""
    _, q = powers(WORD_BASE, len(run))
    return mix((run[at + n] - run[at]) * q[at])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if off is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, end row, bytes, offsets) of consecutive runs of at most 65,536 texts and about `limit` bytes; a longer text comes alone, whole."""
    data, offsets = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n, row + 65_536)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def tokenised(column: pa.Array, mode: str = "SPACE", limit: int = CHUNK_BYTES):
    """(first row, end row, Words) over a string column, chunk by chunk."""
    for row, end, data, offsets in chunks(column, limit):
        yield row, end, Words(data, offsets, mode)


def trim() -> None:
    """Gives memory that a task has freed back to the system, as workers live on between tasks."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()
