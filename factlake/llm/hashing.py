"""Vectorised word and n-gram hashing for Arrow batches.

All functions are pure: the 64-bit hashes depend only on the bytes, never on the
process, so hashes made in different tasks can be joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


_VALUE = _byte_values()
_STEP = _U(0xD6E8FEB86659FD93)

#: bytes that separate words when words are runs of non-space: 0x20 and 0x09-0x0D
SPACE_SEPARATORS = np.zeros(256, dtype=bool)
SPACE_SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: bytes that separate words when words are ASCII letters, digits and all bytes >= 0x80
WORD_SEPARATORS = np.ones(256, dtype=bool)
WORD_SEPARATORS[0x30:0x3A] = WORD_SEPARATORS[0x41:0x5B] = WORD_SEPARATORS[0x61:0x7B] = WORD_SEPARATORS[0x80:] = False


def byte_table(lower: bool) -> np.ndarray:
    """Random value of each byte; A-Z share the values of a-z when ``lower``."""
    table = _VALUE.copy()
    if lower:
        table[0x41:0x5B] = table[0x61:0x7B]
    return table


def hash_words(docs: list[bytes], separators: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``docs`` in order, and the number of words of each."""
    if not docs:
        return np.empty(0, _U), np.empty(0, np.int64)
    data = np.frombuffer(b"\n".join(docs) + b"\n", dtype=np.uint8)
    ends_of_docs = np.cumsum([len(d) + 1 for d in docs])
    inside = ~separators[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    counts = np.diff(np.searchsorted(starts, ends_of_docs), prepend=0)
    if not len(starts):
        return np.empty(0, _U), counts
    lengths = ends - starts
    body = np.flatnonzero(inside)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(body), dtype=np.int64) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        power = np.concatenate((np.ones(1, _U), np.cumprod(np.full(int(lengths.max()), _STEP, dtype=_U))))
        values = byte_table(lower)[data[body]] * power[place]
        return _mix(np.add.reduceat(values, first) + lengths.astype(_U)), counts


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words, by doubling; len(words) - n + 1 of them."""
    if len(words) < n:
        return np.empty(0, _U)
    base, have, done, out = _U(0x9FB21C651E98DF25), words, 1, None
    with np.errstate(over="ignore"):
        power, covered, rest = base, 0, n
        while rest:
            if rest & 1:
                if out is None:
                    out, covered = have, done
                else:
                    m = len(words) - covered - done + 1
                    out, covered = out[:m] * power + have[covered : covered + m], covered + done
            rest >>= 1
            if rest:
                m = len(have) - done
                have, done, power = have[:m] * power + have[done : done + m], done * 2, power * power
        return _mix(out + _U(n))


def small_chunks(ids, docs, limit: int = 1_000_000, rows: int = 512) -> Iterator[tuple[list, list[bytes]]]:
    """Rows of two Arrow columns (or lists) in pieces of about ``limit`` bytes, so that what is made of them stays small; null text is empty."""
    a, b, size = [], [], 0
    plain = lambda x, k: x[k : k + rows] if isinstance(x, list) else x.slice(k, rows).to_pylist()
    for k in range(0, len(ids), rows):
        for i, d in zip(plain(ids, k), plain(docs, k), strict=True):
            d = d or b""
            if a and size + len(d) > limit:
                yield a, b
                a, b, size = [], [], 0
            a.append(i)
            b.append(d)
            size += len(d)
    if a:
        yield a, b
