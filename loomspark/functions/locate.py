"""Many passages looked up in one text, in one pass of it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base of the rolling sums, odd; sums wrap at 64 bits.
BASE = np.uint64(0x9E3779B97F4A7C15)

#: Windows whose sums are in memory at once.
PART = 1 << 20

#: Characters of the text times needles up to which they are searched plainly, one by one: there the sums' fixed cost is more.
PLAIN = 1 << 22


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def first_hits(whole: str, needles: list[str]) -> list[int]:
    """Where each needle first begins in the text, -1 for none, 0 for an empty one.

    Sums of the text's windows of a needle's length are looked up among the needles' sums, all needles of a length at once,
    so the work is the text's length for each distinct length of needles. What is found is compared by its characters;
    where sums agree and characters don't, the needle is searched plainly. So are all needles
    of a length in which two share a sum.
    A few needles in a short text are searched plainly.
    """
    if len(whole) * len(needles) <= PLAIN:
        return [whole.find(n) for n in needles]
    text, out = _codes(whole), [-1 if n else 0 for n in needles]
    by_length: dict[int, dict[str, list[int]]] = {}
    for i, n in enumerate(needles):
        if 0 < len(n) <= len(text):
            by_length.setdefault(len(n), {}).setdefault(n, []).append(i)
    if not by_length:
        return out
    reach = min(len(text), PART + max(by_length))
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(reach, BASE)]), dtype=np.uint64)
    own = {length: {int(np.sum(_codes(n) * powers[:length], dtype=np.uint64)) * int(powers[-1]) % (1 << 64): n for n in distinct} for length, distinct in by_length.items()}
    alike = [length for length, distinct in by_length.items() if len(own[length]) < len(distinct)]
    places = {n: whole.find(n) for length in alike for n in by_length[length]}
    for begin in range(0, len(text), PART):
        part = text[begin : begin + reach]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers[: len(part)], dtype=np.uint64)])
        for length, known in own.items():
            # every window's sum is brought to one power, so that it doesn't depend on its place
            n_windows = max(0, min(PART, len(part) - length + 1))
            windows = (sums[length : length + n_windows] - sums[:n_windows]) * powers[reach - np.arange(n_windows)]
            at = np.flatnonzero(np.isin(windows, np.array(list(known), np.uint64)))
            found, first = np.unique(windows[at], return_index=True)
            for h, place in zip(found.tolist(), (at[first] + begin).tolist()):
                if whole.startswith(known[h], place):
                    places.setdefault(known[h], place)
                else:
                    places.setdefault(known[h], whole.find(known[h]))
    for distinct in by_length.values():
        for n, rows in distinct.items():
            for i in rows:
                out[i] = places.get(n, -1)
    return out


def next_hits(whole: str, needles: list[str], cursors: list[int]) -> list[int]:
    """Where each needle begins from its cursor on, else anywhere, else -1."""
    out = [whole.find(n, max(0, c)) if c <= len(whole) else -1 for n, c in zip(needles, cursors)]
    left = [i for i, p in enumerate(out) if p < 0]
    for i, p in zip(left, first_hits(whole, [needles[i] for i in left]) if left else []):
        out[i] = p
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def places_of(wholes: pd.Series, asked: pd.Series) -> pd.Series:
    """For each list of passages of a document, where those that the text holds first begin."""
    out = []
    for whole, lists in zip(wholes, asked):
        flat = [p for ps in lists for p in ps]
        hits = iter(first_hits(whole, flat) if whole is not None else [-1] * len(flat))
        out.append([[h for h in (next(hits) for _ in ps) if h >= 0] for ps in lists])
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def places_from(wholes: pd.Series, needles: pd.Series, cursors: pd.Series) -> pd.Series:
    """For each passage of a document where it begins from its cursor on, else anywhere, else its cursor."""
    out = []
    for whole, ns, cs in zip(wholes, needles, cursors):
        cs = [int(c) for c in cs]
        hits = next_hits(whole, list(ns), cs) if whole is not None else [-1] * len(cs)
        out.append([c if h < 0 else h for h, c in zip(hits, cs)])
    return pd.Series(out)


#: Characters of the windows that rule a passage out, and how far from its cursor a passage is looked for before that.
WIDTH, NEAR = 32, 1 << 12


def _window_sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(codes) - WIDTH + 1), np.uint64)
    for j in range(WIDTH):
        out = out * BASE + codes[j : j + len(out)]
    return out


def absence(whole: str):
    """A test whether the text surely doesn't hold a passage: some window of it has a sum that no window of the text has. Sums
    are kept as bits of a table of at most 128 MB; a passage that isn't ruled out may be there or not."""
    bits = min(27, len(whole).bit_length() + 3)
    seen, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
    for at in range(0, len(whole), PART):
        seen[_window_sums(_codes(whole[at : at + PART + WIDTH - 1])) >> shift] = True
    return lambda passage: not seen[_window_sums(_codes(passage)) >> shift].all()


def hits_in_turn(whole: str, needles: list[str]) -> list[tuple[int, bool]]:
    """(start, found) of each passage: after the end of the one before, else anywhere; one that isn't there begins at that end."""
    out, cursor, absent = [], 0, None
    for n in needles:
        hit = whole.find(n, cursor, cursor + len(n) + NEAR)
        if hit < 0:
            absent = absent or absence(whole)
            if not absent(n):
                hit = p if (p := whole.find(n, cursor)) >= 0 else whole.find(n)
        start = hit if hit >= 0 else cursor
        out.append((start, hit >= 0))
        cursor = start + len(n)
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("found", T.BooleanType())))
def places_in_turn(wholes: pd.Series, needles: pd.Series) -> pd.Series:
    """hits_in_turn for the passages of each document."""
    return pd.Series([[{"start": start, "found": found} for start, found in hits_in_turn(whole, list(ns))] for whole, ns in zip(wholes, needles)], dtype=object)
