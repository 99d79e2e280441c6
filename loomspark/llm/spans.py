"""Many byte ranges of one array at once: hashes, exact comparison, index runs."""

from __future__ import annotations

import numpy as np

#: Hashes are two polynomials modulo this prime, so that no pair of texts collides whatever the bases are.
_PRIME = (1 << 31) - 1
_BASES = (1_000_003, 1_540_483_477)
_powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, or the prime itself for zero; x below 2 ** 62."""
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(31))
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(31))


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(powers, inverse powers) of each base, at least n of them; doubled until long enough."""
    if len(_powers[0][0]) < n:
        for i, base in enumerate(_BASES):
            tables = []
            for b in (base, pow(base, -1, _PRIME)):
                x = np.ones(1, np.uint64)
                while len(x) < n:
                    x = np.concatenate([x, _reduced(x * np.uint64(pow(b, len(x), _PRIME)))])
                tables.append(x)
            _powers[i] = (tables[0], tables[1])
    return _powers


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each range; equal bytes, equal hash. Compare the bytes where it matters."""
    out = np.zeros(len(start), np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    for power, inverse in _power_tables(len(data) + 1):
        np.cumsum(_reduced((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)]), out=sums[1:])
        h = _reduced(_reduced(sums[end] - sums[start]) * inverse[start]) % np.uint64(_PRIME)
        out = (out << np.uint64(31)) | h
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


_ODD = 0x9E3779B97F4A7C15
_odd_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def quick_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same in half the time, modulo 2 ** 64: some words collide by design of the modulus, so only for use before
    the bytes are compared."""
    if len(_odd_powers[0]) <= len(data):
        for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            x = np.full(len(data) + 1, base, np.uint64)
            x[0] = 1
            _odd_powers[i] = np.cumprod(x, dtype=np.uint64)
    power, inverse = _odd_powers
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def equal(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[a_at:a_at + size] and b[b_at:b_at + size] are the same bytes, for each range."""
    out = np.ones(len(size), bool)
    some = np.flatnonzero(size)
    if len(some):
        count = size[some]
        same = a[gathered(a_at[some], count)] == b[gathered(b_at[some], count)]
        out[some] = np.logical_and.reduceat(same, np.cumsum(count) - count)
    return out


def gathered(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... count[0] of them, then the same for the next, as one array."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)
