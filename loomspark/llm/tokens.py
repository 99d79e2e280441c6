"""Token ids of whole texts by the tokenizers library, with a cache of chunks.

Texts are cut where the tokenizer itself always cuts, so that a chunk can be encoded alone. Chunks are found,
hashed and looked up with NumPy, many texts at once; a cached chunk's bytes are compared with the text's, so a
hash that two chunks share changes nothing. A chunk that is not in the worker's cache goes through the library,
hundreds in one call. The cache is a table of fixed size by hash: a newcomer takes its place. Nothing is
truncated: a chunk is as long as the text has it.
"""

from __future__ import annotations

import os

import numpy as np

from . import spans

#: Slots of a worker's cache, the ids that it holds at most before it starts anew, and bytes of text handled at once.
SLOTS, POOL, AT_ONCE = 1 << 21, 4_000_000, 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Marks that end a word of letters in every vocabulary here. Those of special tokens (<|>) and ' are left out.
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?)%&$*#"]] = True


def _wide_space_ends(data: np.ndarray) -> np.ndarray:
    """Places of the last bytes of white space beyond ASCII."""
    some = np.flatnonzero(np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3)))
    padded = np.append(data, (0, 0))
    a, b, c = data[some], padded[some + 1], padded[some + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    e2 = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | e2 | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return np.concatenate([some[two] + 1, some[three] + 2])


def _byte_level_cuts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of chunks. Cuts: before a space that stands between two characters other than white space;
    between a letter and a mark of _STOP; around one line feed between two such characters."""
    n = len(data)
    space = _SPACE[data]
    wide = _wide_space_ends(data)
    ends = space.copy()
    ends[wide] = True
    begins = space.copy()
    begins[wide - np.where(data[wide - 1] == 0xC2, 1, 2)] = True
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    single = space.copy()  # one white space between others, inside a text
    single[1:] &= ~ends[:-1]
    single[:-1] &= ~begins[1:]
    single &= ~edge[:-1] & ~edge[1:]
    cut = single & ((data == 32) | (data == 10))
    cut[1:] |= cut[:-1] & (data[:-1] == 10)
    cut[1:] |= _LETTER[data[:-1]] & _STOP[data[1:]]
    cut |= edge[:-1]
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], n)


def _word_cuts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of chunks without ASCII white space, cut also between a letter and a mark of _STOP."""
    n = len(data)
    ink = ~_SPACE[data]
    cut = ink.copy()
    cut[1:] &= ~ink[:-1]
    cut[1:] |= _LETTER[data[:-1]] & _STOP[data[1:]]
    edge = at[:-1][at[:-1] < n]
    cut[edge] = ink[edge]
    start = np.flatnonzero(cut)
    stop = np.zeros(n + 1, bool)
    stop[1:] = ~cut[np.minimum(np.arange(1, n + 1), n - 1)] & ink
    stop = ink & ~np.append(ink[1:], False)
    stop[:-1] |= cut[1:] & ink[:-1]
    stop[at[1:][at[1:] > 0] - 1] |= ink[at[1:][at[1:] > 0] - 1]
    return start, np.flatnonzero(stop) + 1


class Encoder:
    """encode(data, at): ids of texts that lie one after the other in data, with n + 1 offsets at."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        name = os.path.basename(path)
        #: mark: a character that stands between chunks encoded in one call, with the text around it
        self.cuts, self.mark, self.between = {
            "byte_bpe_50k.json": (_byte_level_cuts, "\n", "\n"),
            "word_bpe_49k.json": (_word_cuts, "|", " | "),
        }.get(name, (lambda data, at: (at[:-1], at[1:]), "", ""))
        if self.mark:
            (self.mark_id,) = self._library([self.mark])[0].tolist()
        self.renew()

    def renew(self) -> None:
        #: of each slot: half of its chunk's hash, place of its bytes in raw and their number (0: free), place and number of its ids
        self.key = np.zeros(SLOTS, np.uint32)
        self.at, self.first = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.size, self.count = np.zeros(SLOTS, np.uint8), np.zeros(SLOTS, np.uint8)
        self.raw, self.pool = _Growing(np.uint8), _Growing(np.uint32)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all chunks one after the other, place and number of each chunk's). Chunks whose ends and marks allow
        it go through the library together, the mark between them."""
        mark = self.mark
        together = [i for i, t in enumerate(chunks) if mark and mark not in t and (core := t[1:] if t[0] == " " else t) and core == core.strip()]
        alone = sorted(set(range(len(chunks))).difference(together))
        groups = [together[i : i + 512] for i in range(0, len(together), 512)]
        order, ids, counts = [], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for group, found in zip(groups, self._library([self.between.join([chunks[i] for i in g]) for g in groups]), strict=True):
            marks = np.flatnonzero(found == self.mark_id)
            if len(marks) == len(group) - 1:
                order += group
                ids.append(np.delete(found, marks))
                counts.append(np.diff(np.concatenate([[-1], marks, [len(found)]])) - 1)
            else:  # a chunk's own ids hold the mark's
                alone += group
        for i, found in zip(alone, self._library([chunks[i] for i in alone]), strict=True):
            order.append(i)
            ids.append(found)
            counts.append(np.array([len(found)]))
        lengths = np.concatenate(counts)
        count, place = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        count[order], place[order] = lengths, np.cumsum(lengths) - lengths
        return np.concatenate(ids), place, count

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets into them)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        start, end = self.cuts(data, at)
        ids, counts, i = [], [], 0
        while i < len(start):  # chunks of a bounded number of bytes at once, however long a text is
            j = max(i + 1, int(np.searchsorted(end, start[i] + AT_ONCE, "right")))
            part = data[start[i] : end[j - 1]]
            found, count = self._ids(part, start[i:j] - start[i], end[i:j] - start[i])
            ids.append(found)
            counts.append(count)
            i = j
        ends = np.concatenate([np.zeros(1, np.int64), *counts]).cumsum()
        return np.concatenate([np.zeros(0, np.uint32), *ids]), ends[np.searchsorted(start, at, "left")]

    def _ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all chunks, and how many each has. A cached chunk counts only if its bytes are the same."""
        size = end - start
        h = spans.quick_hashes(data, start, end)
        slot, key = (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64), h.astype(np.uint32)
        known = (self.key[slot] == key) & (self.size[slot] == size)
        hit = np.flatnonzero(known)
        known[hit] = spans.equal(data, start[hit], self.raw.data, self.at[slot[hit]].astype(np.int64), size[hit])
        first, count = self.first[slot].astype(np.int64), self.count[slot].astype(np.int64)
        miss = np.flatnonzero(~known)
        if len(miss):
            raw, number = data.tobytes(), {}
            back = np.array([number.setdefault(raw[s:e], len(number)) for s, e in zip(start[miss].tolist(), end[miss].tolist(), strict=True)])
            learnt, places, lengths = self._learn([piece.decode() for piece in number])
            places += self.pool.add(learnt)
            first[miss], count[miss] = places[back], lengths[back]
            where = miss[np.unique(back, return_index=True)[1]]
            sizes = size[where]
            kept = self.raw.add(np.frombuffer(b"".join(number), np.uint8)) + np.cumsum(sizes) - sizes
            slots, short = slot[where], np.flatnonzero((sizes < 256) & (lengths < 256))  # longer chunks are not cached
            # one newcomer a slot: of several the last in order, in all columns alike
            last = short[len(short) - 1 - np.unique(slots[short][::-1], return_index=True)[1]]
            for column, values in ((self.key, key[where]), (self.at, kept), (self.size, sizes), (self.first, places), (self.count, lengths)):
                column[slots[last]] = values[last]
        ids = self.pool.data[spans.gathered(first, count)]
        if self.pool.used > POOL or self.raw.used > 4 * POOL:
            self.renew()
        return ids, count


class _Growing:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.used = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> int:
        """The place from which on values stand."""
        at, total = self.used, self.used + len(values)
        if total > len(self.data):
            self.data = np.concatenate([self.data[:at], np.zeros(total + (1 << 20) - at, self.data.dtype)])
        self.data[at:total] = values
        self.used = total
        return at


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
