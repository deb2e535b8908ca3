"""Hashes of the words and 5-word shingles of many texts at a time, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 5
#: Bytes that are hashed at a time; a cut is made at white space, so a longer text is hashed in parts.
BLOCK = 1 << 20


def _draw(name: bytes, n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(name, k) for k in range(n)], np.uint64)


_LETTERS = _draw(b"letter", 256)
_LETTERS[65:91] = _LETTERS[97:123]  # A-Z count as a-z
_PLACES = _draw(b"place", 4096) | np.uint64(1)
_MULTIPLIERS = _draw(b"shingle", WORDS) | np.uint64(1)
_M1, _M2, _SIZE = (_draw(b"mix", 3) | np.uint64(1)).tolist()
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_M1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(_M2)
    return x ^ (x >> np.uint64(32))


def _hashed(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of each word of a piece of bytes; a word also begins where a text does."""
    space = _SPACE[data]
    letters = np.flatnonzero(~space)
    if not len(letters):
        return letters, np.empty(0, np.uint64)
    new = np.empty(len(letters), bool)
    new[0] = True
    np.not_equal(letters[1:], letters[:-1] + 1, out=new[1:])
    new |= begin[letters]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(letters)])
    at = np.arange(len(letters)) - np.repeat(first, size)
    places = _PLACES[at & 4095]
    if len(far := np.flatnonzero(at >= 4096)):  # each place of a long word has a multiplier of its own
        places[far] = mix(places[far] + (at[far] >> 12).astype(np.uint64) * np.uint64(_M1)) | np.uint64(1)
    total = np.add.reduceat(_LETTERS[data[letters]] * places, first)
    return letters[first], mix(total + size.astype(np.uint64) * np.uint64(_SIZE))


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and where each row's begin (one more than rows). Words are those between
    ASCII white space, with A-Z in lower case; nulls have none."""
    column = column.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    begin = np.zeros(len(data) + 1, bool)
    begin[offsets] = True
    places, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not (begin[end] or _SPACE[data[end]]):
            end += 1
        p, h = _hashed(data[at:end], begin[at:end])
        places.append(p + at)
        hashes.append(h)
        at = end
    place = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(place, offsets)


def sequences(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the hash of the shingle that begins at each of its words; a shorter text is one shingle."""
    words, rows = words_of(column)
    n = len(words) - WORDS + 1
    every = np.zeros(max(n, 0), np.uint64)
    for k in range(WORDS):
        every += words[k : k + n] * _MULTIPLIERS[k] if n > 0 else 0
    every = mix(every)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield every[a : b - WORDS + 1]
        elif b > a:
            yield np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes())], np.uint64)
        else:
            yield np.empty(0, np.uint64)


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, sorted."""
    for found in sequences(column):
        found = np.sort(found)
        yield found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found
