"""Word shingles (five words, if not told otherwise) of whole texts, hashed to 64 bits, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_BASE, _MIX, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CHUNK = 1 << 17  # bytes of text hashed at once, so that the arrays stay in a core's cache


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _FOLD
    return x ^ (x >> np.uint64(32))


_tables: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    table = _tables.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 2 * _CHUNK), base, np.uint64)
        table[:1] = 1
        table = _tables[int(base)] = np.cumprod(table, dtype=np.uint64)
    return table[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and its hash. Words are runs without ASCII white space, A-Z as a-z."""
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)])
    # Scaled back by the start's power, equal words hash alike wherever they stand.
    return start, mixed((total[end] - total[start]) * _powers(_BACK, len(data))[start] + (end - start).astype(np.uint64))


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text.encode() + b" ")
        size += len(held[-1])
        if size >= _CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def shingle_sets(texts: list[str], size: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text, in order; too few words are one shingle."""
    for first, chunk in _chunks(texts):
        start, words = word_hashes(np.frombuffer(b"".join(chunk), np.uint8))
        ends = np.cumsum([len(x) for x in chunk])
        owner = np.searchsorted(ends, start, side="right")
        count = np.bincount(owner, minlength=len(chunk))
        n = max(0, len(words) - size + 1)
        value = np.full(n, np.uint64(size))
        for k in range(size):
            value = mixed(value + words[k : n + k])
        inside = owner[:n] == owner[len(owner) - n :]
        value, of = value[inside], owner[:n][inside]
        at = np.searchsorted(of, np.arange(len(chunk) + 1))
        word_at = np.concatenate([[0], np.cumsum(count)])
        for i in range(len(chunk)):
            if 0 < count[i] < size:
                short = np.array([count[i]], np.uint64)
                for w in words[word_at[i] : word_at[i + 1]]:
                    short = mixed(short + w)
                yield first + i, short
            else:
                own = value[at[i] : at[i + 1]]
                own.sort()
                yield first + i, own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def fingerprint(values: np.ndarray) -> bytes:
    """128 bits of a set: equal sets, equal bytes."""
    salt = np.uint64(0x5851F42D4C957F2D)
    return np.array([mixed(values).sum(dtype=np.uint64), mixed(values ^ salt).sum(dtype=np.uint64)], np.uint64).tobytes()
