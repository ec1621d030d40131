"""Feature hashing of token lists in Arrow batches: MD5 and sums by array arithmetic, a bounded number of words at a time.

The hashes are those of `text.hash_blocks` and `text.hashed`, so SQL can state them.
"""

from __future__ import annotations

import hashlib
from math import floor, sin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose features are held at once; a longer text is taken whole.
WORDS = 1 << 16
#: Cells (rows x places) of sums that are held at once.
CELLS = 1 << 20
#: Messages that are hashed at once: few enough for a core's cache.
MESSAGES = 1 << 13

_TURNS = [np.uint32(x) for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in row * 4]
_SINES = [np.uint32(floor(abs(sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5(blocks: np.ndarray) -> np.ndarray:
    """The MD5 states (n x 4, little-endian numbers) after one block of 64 bytes each, padded as MD5 has it."""
    m = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = (np.full(len(blocks), x) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            at = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            at = 7 * i % 16
        np.add(f, a, out=f)
        np.add(f, _SINES[i], out=f)
        np.add(f, m[at], out=f)
        np.left_shift(f, _TURNS[i], out=g)
        np.right_shift(f, np.uint32(32) - _TURNS[i], out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, f = f, a  # the old a's memory is used again
        a, b, c, d = d, a, b, c
    return np.stack([x + y for x, y in zip((a, b, c, d), _START)], axis=1)


def digests(tokens: pa.Array, seed: int, bands: int) -> np.ndarray:
    """One row of `bands` 32-bit numbers for each token: eight hex digits of an MD5 each."""
    blocks = -(-max(1, bands) // 4)
    out = np.empty((len(tokens), 4 * blocks), np.uint32)
    raw = tokens.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if len(raw) and raw.buffers()[2] else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    for b in range(blocks):
        head = f"{seed}|{b}|".encode()
        room = max(55 - len(head), 1)
        for i in range(0, len(raw), MESSAGES):
            j = min(len(raw), i + MESSAGES)
            n = size[i:j]
            part = np.concatenate([data[offsets[i] : offsets[j]], np.zeros(room, np.uint8)])
            short = np.minimum(n, room)
            block = np.zeros((j - i, 64), np.uint8)
            block[:, : len(head)] = np.frombuffer(head, np.uint8)
            body = block[:, len(head) : len(head) + room]
            body[:] = np.lib.stride_tricks.sliding_window_view(part, room)[offsets[i:j] - offsets[i]]
            body *= np.arange(room) < short[:, None]
            block[np.arange(j - i), len(head) + short] = 0x80
            block[:, 56:].view("<u8")[:, 0] = 8 * (len(head) + short).astype(np.uint64)
            out[i:j, 4 * b : 4 * b + 4] = _md5(block).byteswap()
        for i in np.flatnonzero(size > 55 - len(head)):  # more than one block
            out[i, 4 * b : 4 * b + 4] = np.frombuffer(hashlib.md5(head + data[offsets[i] : offsets[i + 1]].tobytes()).digest(), ">u4")
    return out[:, : max(1, bands)]


def _kept(words, stop: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number of the word, the words) of lists of words; empty words and stop words are left out."""
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    code = words.flatten().dictionary_encode()
    names, index = code.dictionary, code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = ~pc.is_in(names, pa.array(["", *stop], names.type)).to_numpy(zero_copy_only=False)
    on = keep[index] if len(index) else np.zeros(0, bool)
    return np.repeat(np.arange(len(size)), size)[on], index[on], names


def features(words, bigrams: bool = True, stop: list[str] = ()) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, feature number) of every unigram and, after stop words are dropped, bigram of lists of words, and the features; empty words don't count."""
    row, index, names = _kept(words, stop)
    if not bigrams or len(index) < 2:
        return row, index, names
    pair = np.flatnonzero(row[1:] == row[:-1])
    pairs = pc.binary_join_element_wise(names.take(pa.array(index[pair])), names.take(pa.array(index[pair + 1])), "_")
    return np.concatenate([row, row[pair]]), np.concatenate([index, np.arange(len(pair)) + len(names)]), pa.concat_arrays([names, pairs])


def bigrams(words, stop: list[str] = ()) -> tuple[pa.Array, pa.Array]:
    """(bigram, how often it occurs) in lists of words, after stop words are dropped."""
    row, index, names = _kept(words, stop)
    pair = np.flatnonzero(row[1:] == row[:-1])
    found = pc.binary_join_element_wise(names.take(pa.array(index[pair])), names.take(pa.array(index[pair + 1])), "_").value_counts()
    return found.field("values"), found.field("counts")


def parts(words, rows: int):
    """(first row, lists of words) of at most `rows` rows and about WORDS words each."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(words):
        before = ends[first - 1] if first else 0
        last = min(first + rows, max(first + 1, int(np.searchsorted(ends, before + WORDS, "right"))))
        yield first, words.slice(first, last - first)
        first = last


def components(words, dim: int, seed: int = 7, bands: int = 4, bigrams: bool = True, stop: list[str] = (), count: bool = True):
    """(first row, sums, hits) of blocks of rows: the signed sums and, with `count`, the numbers of hits of each place, rows x dim."""
    for first, part in parts(words, max(1, CELLS // dim)):
        row, feature, tokens = features(part, bigrams, stop)
        h = digests(tokens, seed, bands)
        place = ((h >> np.uint32(4)) % np.uint32(dim)).astype(np.int64)
        sign = np.where(h & np.uint32(8), 1.0, -1.0)
        n = len(part)
        total, hits = np.zeros(n * dim), np.zeros(n * dim, np.int64)
        for i in range(0, len(row), 1 << 18):
            of = feature[i : i + (1 << 18)]
            at = ((row[i : i + (1 << 18)] * dim)[:, None] + place[of]).ravel()
            total += np.bincount(at, sign[of].ravel(), n * dim)
            if count:
                hits += np.bincount(at, minlength=n * dim)
        yield first, total.reshape(n, dim).astype(np.int64), hits.reshape(n, dim)


def signature_words(words, bits: int, **options) -> list[np.ndarray]:
    """Words of the sign bits of each row's components; a component of zero sets its bit."""
    out = [np.full(len(words), -1, np.int64) for _ in range(bits // 64)]
    for first, total, _ in components(words, bits, count=False, **options):
        packed = np.packbits(total >= 0, axis=1).view(">u8").astype(np.uint64).view(np.int64)
        for w, col in enumerate(out):
            col[first : first + len(packed)] = packed[:, w]
    return out
