"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text; only A-Z change when lowered.
Words are named by 64 bits. A word of up to seven bytes has a name of its own: its bytes and length, mixed by a bijection. Longer words go through two lanes of
mixed eight-byte blocks, words over LONG bytes through BLAKE2b. Names of different words can be equal by chance only, once in 2^64 pairs; who must be
sure compares bytes with same(). Constants are fixed, so every process of every run agrees.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18  # bytes of text that are hashed together
LONG = 64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LANE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Masks of the first 0 to 8 bytes of a little-endian block.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and the offset of each row; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray):
    """Runs (first, end) of rows with about CHUNK bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def blocks(raw: np.ndarray) -> np.ndarray:
    """For every place in ``raw`` the eight bytes from it on as one number; bytes after the end are 0. ``raw`` must own 8 bytes after its end, as padded() gives."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))


def padded(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 8, np.uint8)
    out[: len(raw)] = raw
    return out


def names_of(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of the words at [starts, ends) of a padded text."""
    at = blocks(text)
    size = ends - starts
    first = at[starts] & _MASK[np.minimum(size, 8)]
    with np.errstate(over="ignore"):
        names = mix(first | (np.minimum(size, 8).astype(np.uint64) << np.uint64(56)))  # of eight bytes or more it is made anew
        long = np.flatnonzero(size > 7)
        if len(long):
            a = mix(first[long] ^ (size[long].astype(np.uint64) * _LANE[0]))
            b = mix(first[long] + (size[long].astype(np.uint64) ^ _LANE[1]))
            pos, left, own = starts[long] + 8, size[long] - 8, np.arange(len(long))
            done = (left <= 0) | (size[long] > LONG)
            while True:
                own = own[~done]
                if not len(own):
                    break
                pos, left = pos[~done], left[~done]
                block = at[pos] & _MASK[np.minimum(left, 8)]
                x, y = a[own], b[own]
                a[own] = mix((x ^ block) * _LANE[2] + y)
                b[own] = mix(y + (block * _LANE[0] ^ (x >> np.uint64(17))))
                pos, left = pos + 8, left - 8
                done = left <= 0
            names[long] = mix(a ^ (b * _LANE[1]))
            data = memoryview(text)
            for k in np.flatnonzero(size > LONG).tolist():
                names[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return names


def same(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size[k] bytes of the padded text a at a_at[k] and of b at b_at[k] are equal."""
    out = np.ones(len(size), bool)
    x, y = blocks(a), blocks(b)
    long = size > LONG
    own, done = np.arange(len(size)), 0
    own = own[~long]
    while len(own):
        mask = _MASK[np.clip(size[own] - done, 0, 8)]
        out[own] &= ((x[a_at[own] + done] ^ y[b_at[own] + done]) & mask) == 0
        done += 8
        own = own[size[own] > done]
    for k in np.flatnonzero(long).tolist():
        out[k] = np.array_equal(a[a_at[k] : a_at[k] + size[k]], b[b_at[k] : b_at[k] + size[k]])
    return out


def spans(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of rows that touch each other; cuts: where each row begins, and the end of the last."""
    n = len(raw)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(SPACE[raw], out=inside[1:-1])
    edge = inside[1:] != inside[:-1]
    # a row's first byte starts a word even after a word
    inner = cuts[(cuts > 0) & (cuts < n)]
    starts = edge & inside[1:]
    ends = edge & inside[:-1]
    touch = inner[inside[1:-1][inner] & inside[1:-1][inner - 1]]
    starts[touch] = True
    ends[touch] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


def scan(data: np.ndarray, offsets: np.ndarray, i: int, j: int):
    """Of rows i to j: padded lowered bytes, start and end of each word in them, word names, and the first word of each row."""
    raw = data[offsets[i] : offsets[j]]
    cuts = offsets[i : j + 1] - offsets[i]
    text = padded(LOWER[raw])
    starts, ends = spans(raw, cuts)
    return text, starts, ends, names_of(text, starts, ends), np.searchsorted(starts, cuts)
