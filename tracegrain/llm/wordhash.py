"""64-bit hashes of the words of texts, for all words of a block of bytes at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0xC6A4A7935BD1E995)
BLOCK = 1 << 20
#: The bytes between words of running text.
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: A random-looking word for each byte; A-Z have those of a-z, so that hashing folds case.
LETTER = mix(np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint64) + np.uint64(1))
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def _up_to(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, b in enumerate((BASE, inverse)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def _in_block(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of ``data``, which begins and ends between words: a word's polynomial hash is the
    difference of two running sums."""
    begin = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    stop = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1
    up, down = _up_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(LETTER[data] * up[: len(data)], out=sums[1:])
    return mix((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64)), begin


def hash_words(texts: list[str | None], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the words of all ``texts`` in order, A-Z as a-z, and how many each text has. ``parts`` tells for
    each byte whether it parts words; a line feed must. Bytes are worked on in blocks that end between words, so what
    is held beside the texts and their hashes doesn't grow with the longest text, but with the longest word."""
    raw = [(t or "").encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    hashes, starts, at = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not (seam := np.flatnonzero(parts[data[end : end + BLOCK]])[:1]).size:
            end += BLOCK
        end = min(len(data), end + int(seam[0])) if end < len(data) else len(data)
        block = data[at:end]
        h, begin = _in_block(block, ~parts[block])
        hashes.append(h)
        starts.append(begin + at)
        at = end
    owner = np.searchsorted(ends, np.concatenate(starts), side="right")
    return np.concatenate(hashes), np.bincount(owner, minlength=len(texts))


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_places(texts: list[str | None], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, hashes, starts, ends, owners): the texts' bytes with a line feed after each, and for each word its hash, its
    place in these bytes and the number of its text. ``parts`` as for hash_words()."""
    raw = [(t or "").encode() for t in texts]
    stops = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    hashes, starts, ends, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not parts[data[end - 1]]:
            end += 1
        inside = ~parts[data[at:end]]
        h, begin = _in_block(data[at:end], inside)
        hashes.append(h)
        starts.append(begin + at)
        ends.append(np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1 + at)
        at = end
    begin = np.concatenate(starts)
    return data, np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(stops, begin, side="right")


def texts_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The folded words at these places."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = fold(data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())).cast(pa.string())
