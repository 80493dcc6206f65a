"""Sets of hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from graphweave.llm import common

SPACES = b" \t\n\x0b\x0c\r"
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: Words are hashed in pieces of about so many bytes, since each byte takes some forty while it is hashed.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (finaliser of a splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_of_byte = _stream(256, 1)
_of_byte[np.frombuffer(SPACES, np.uint8)] = 0
_is_word = np.ones(256, np.int8)
_is_word[np.frombuffer(SPACES, np.uint8)] = 0
_of_place = _stream(4096, 2) | np.uint64(1)


def word_hashes(data: bytes, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each word of ``data``, which is cut behind white space alone."""
    begins, words, at = [], [], 0
    while not begins or at < len(data):
        found = _SPACE.search(data, at + piece)
        end = found.end() if found else len(data)
        begin, own = _hashes_of(data[at:end])
        begins.append(begin + at), words.append(own)
        at = end
    return np.concatenate(begins), np.concatenate(words)


def _hashes_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    global _of_place
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _is_word[raw]
    edges = np.flatnonzero(np.diff(inside))
    begins, ends = edges[::2], edges[1::2]
    if not len(begins):
        return begins, np.zeros(0, np.uint64)
    length = np.diff(np.append(begins, len(raw)))
    place = np.arange(len(raw), dtype=np.int64)[begins[0] :] - np.repeat(begins, length)
    if length.max() > len(_of_place):
        _of_place = _stream(2 * int(length.max()), 2) | np.uint64(1)
    sums = np.add.reduceat(_of_byte[raw[begins[0] :]] * _of_place[place], begins - begins[0])
    return begins, mix(sums + (ends - begins).astype(np.uint64))


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """For each text its distinct ``width``-word shingles as ascending 64-bit hashes.

    ASCII capitals are lowered; words are what white space of ASCII separates. A text of fewer
    words has its whole sequence as one shingle; one without words has none.
    """
    for first, last in common.by_size(texts):
        parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts[first:last]]
        begins, words = word_hashes(b"\n".join(parts))
        limits = np.searchsorted(begins, np.cumsum([0] + [len(p) + 1 for p in parts]))
        odd = _stream(width, 3) | np.uint64(1)
        n = max(0, len(words) - width + 1)
        joined = np.zeros(n, np.uint64)
        for k in range(width):
            joined += words[k : k + n] * odd[k]
            joined = (joined << np.uint64(7)) | (joined >> np.uint64(57))
        joined = mix(joined)
        for a, b in zip(limits[:-1].tolist(), limits[1:].tolist()):
            if b - a >= width:
                yield np.unique(joined[a : b - width + 1])
            elif b > a:
                whole = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for word in words[a:b]:
                        whole = mix(np.array([whole * np.uint64(0x9E3779B97F4A7C15) + word]))[0]
                yield np.array([whole])
            else:
                yield np.zeros(0, np.uint64)


def identity(found: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit words that stand for a whole set."""
    one = mix(found + np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    two = mix(found ^ np.uint64(0x8CB92BA72F3D8DD7)).sum(dtype=np.uint64)
    n = np.uint64(len(found))
    both = mix(np.array([one + n, two ^ n])).view(np.int64)
    return int(both[0]), int(both[1])
