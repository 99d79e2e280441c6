"""Token counts by finite-state transducers, without running a tokenizer over the text.

Two deterministic transducers stand for the tokenizer. The first reads character classes and marks where a
word begins (the splitting pattern of the byte-level vocabulary). It is run over fixed-length chunks of text
from every start state at once; the chunks' state maps are composed by a parallel prefix scan, which gives
each chunk its true start state. The second reads the bytes of one word and carries, on each transition, the
change in the number of tokens (+1, 0, or less when a byte joins earlier tokens into a longer one); the sum
over a word is its token count. Its state is what later bytes can still depend on: the longest suffix that
begins some token, and for each place where a token may begin, the last token before it. It has too many states for
maps of all of them, so the parts of a long word have maps of the states that they may begin in, and these maps,
with the tokens emitted, are composed by a prefix scan too. It is compiled as the text asks for transitions, and
starts anew when its table is full, also within a word; counts don't depend on that.

Both rest on a property of byte-pair encoding: a sequence of tokens is the encoding of its text if and only if
each neighbouring pair is the encoding of its own text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans

OVER = 1024
#: Characters in a chunk of the first transducer, and states of the second one that a worker holds at most.
CHUNK, MOST_STATES = 256, 150_000
#: Bytes of a part of a long word, and bytes before it from which its first state is guessed.
PART, LEAD = 256, 32

# --- the first transducer: character classes to word starts ---------------------------------------------

_CLASSES = ["letter", "stmd", "r", "v", "l", "e", "number", "space", "white", "quote", "mark", "end", "none"]
_STATES = ["start", "letters", "numbers", "marks", "space1", "spaces", "white1", "whites", "quote", "quote_r", "quote_v", "quote_l", "suffix"]
_C, _S = {c: i for i, c in enumerate(_CLASSES)}, {s: i for i, s in enumerate(_STATES)}
#: What a transition says: a word begins at this character (HERE), at the one before it (BEFORE).
HERE, BEFORE = 1, 2


def _splitting_pattern() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by state and class for
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"""
    to, out = np.zeros((16, 16), np.uint8), np.zeros((16, 16), np.uint8)
    letters = ("letter", "stmd", "r", "v", "l", "e")
    runs = {**dict.fromkeys(letters, "letters"), "number": "numbers", "space": "space1", "white": "white1", "quote": "quote", "mark": "marks"}
    for state in _STATES:
        for c in _CLASSES:
            s, o = runs.get(c, "start"), HERE  # by itself a character begins the run of its kind
            if c == "none":
                s, o = state, 0
            elif c == "end":
                o = BEFORE if state in ("quote_r", "quote_v", "quote_l") else 0
            elif state in ("letters", "numbers") and s == state:
                o = 0
            elif state == "marks" and c in ("mark", "quote"):
                s, o = "marks", 0
            elif state in ("space1", "spaces", "white1", "whites"):
                if c in ("space", "white"):
                    s, o = {"space": "spaces", "white": "whites"}[c], 0
                elif state in ("space1", "spaces"):  # a space belongs to what follows
                    s, o = "marks" if c == "quote" else s, 0 if state == "space1" else BEFORE
                elif state == "whites":
                    o = HERE | BEFORE
            elif state == "quote":
                if c == "stmd":
                    s, o = "suffix", 0
                elif c in ("r", "v", "l"):
                    s, o = f"quote_{c}", 0
                elif c in ("quote", "mark"):
                    s, o = "marks", 0
            elif state in ("quote_r", "quote_v", "quote_l"):
                if c == ("l" if state == "quote_l" else "e"):
                    s, o = "suffix", 0
                else:  # no suffix after all: the letter begins a word
                    o = BEFORE if c in letters else BEFORE | HERE
            to[_S[state], _C[c]], out[_S[state], _C[c]] = _S[s], o
    return to, out


_TO, _OUT = _splitting_pattern()


def _class_table() -> np.ndarray:
    """The class of every code point; letters, numbers and white space by their Unicode properties."""
    import regex

    table = np.full(0x110000, _C["mark"], np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    for name, pattern in (("letter", r"\p{L}+"), ("number", r"\p{N}+"), ("white", r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[points[m.start() : m.end()]] = _C[name]
    for c in "stmd":
        table[ord(c)] = _C["stmd"]
    for c in "rvle":
        table[ord(c)] = _C[c]
    table[32], table[39] = _C["space"], _C["quote"]
    return table


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Flags of the characters at which words begin; texts end with a character of class end."""
    n = len(classes)
    lanes = -(-n // CHUNK)
    grid = np.full(lanes * CHUNK, _C["none"], np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
    to, out, q = _TO.ravel(), _OUT.ravel(), len(_STATES)
    # state maps of all chunks; a map that sends every state to one is followed as that one
    maps = np.repeat(np.arange(q, dtype=np.uint8)[:, None], lanes, axis=1)
    rows, kept = np.arange(lanes), maps
    single, ended = np.zeros(0, np.int64), np.zeros(lanes, np.uint8)
    single_state = np.zeros(0, np.uint8)
    for t in range(CHUNK):
        kept = to[(kept << 4) | grid[t][rows]]
        if len(single):
            single_state = to[(single_state << 4) | grid[t][single]]
        if t % 8 == 7 and len(rows):
            same = (kept == kept[0]).all(axis=0)
            if same.any():
                single = np.concatenate([single, rows[same]])
                single_state = np.concatenate([single_state, kept[0][same]])
                rows, kept = rows[~same], kept[:, ~same]
    ended[single] = single_state
    maps = np.repeat(ended[None, :], q, axis=0)
    maps[:, rows] = kept
    # inclusive prefix scan by doubling: composition of maps is associative
    step = 1
    while step < lanes:
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].copy(), axis=0)
        step *= 2
    state = np.concatenate([[_S["start"]], maps[_S["start"], :-1]]).astype(np.uint8)
    said = np.empty((CHUNK, lanes), np.uint8)
    for t in range(CHUNK):
        at = (state << 4) | grid[t]
        state, said[t] = to[at], out[at]
    said = said.T.ravel()[:n]
    starts = (said & HERE) > 0
    starts[:-1] |= (said[1:] & BEFORE) > 0
    return starts


# --- the second transducer: bytes of a word to token counts ----------------------------------------------


class Merges:
    """The vocabulary: bytes of each token, merge ranks, and whether two tokens stay apart."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)}.difference(plain)))}
        spell = lambda token: bytes(letters[c] for c in token)
        self.special = [t["content"] for t in model["added_tokens"]]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.rank = {(spell(a), spell(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {spell(t) for t in model["model"]["vocab"] if t not in self.special}
        self.apart: dict[tuple, bool] = {}

    def encode(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            joined, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    joined.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
        return parts

    def stay_apart(self, before: bytes | None, token: bytes) -> bool:
        """The token may follow `before` (None: may begin a word)."""
        key = (before, token)
        if key not in self.apart:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            self.apart[key] = self.encode((before or b"") + token) == ([token] if before is None else [before, token])
        return self.apart[key]


class CountTransducer:
    """Next state and change in the token count by state and byte, compiled on demand."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.nodes = {t[:i] for t in self.merges.tokens for i in range(len(t) + 1)}
        self.inner = {t[:i] for t in self.merges.tokens for i in range(len(t))}
        self.renew()

    def renew(self) -> None:
        #: Bytes have columns in order of their first use; the table is as wide as the text needs.
        self.column = np.full(256, -1, np.int64)
        self.bytes_of: list[int] = []
        self.width, self.rows = 64, 1 << 12
        self.to = np.full(self.rows * self.width, -1, np.int32)
        self.change = np.zeros(self.rows * self.width, np.int16)
        #: A state: for each suffix that may grow into a token, longest first, (suffix, last token before it, count there less the count now).
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self._state(((b"", None, 0),))

    def _state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            if len(self.states) > self.rows:
                self._resize(self.rows + self.rows // 2, self.width)
        return self.number[key]

    def _resize(self, rows: int, width: int) -> None:
        for name, fill in (("to", -1), ("change", 0)):
            old = getattr(self, name).reshape(self.rows, self.width)
            new = np.full((rows, width), fill, old.dtype)
            new[: self.rows, : self.width] = old
            setattr(self, name, new.ravel())
        self.rows, self.width = rows, width

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """The column of each byte of data."""
        for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[b] < 0:
                self.column[b] = len(self.bytes_of)
                self.bytes_of.append(b)
        if len(self.bytes_of) > self.width:
            self._resize(self.rows, 2 * self.width if len(self.bytes_of) <= 2 * self.width else 256)
        return self.column[data]

    def compile(self, state: int, column: int) -> None:
        b, grown, change, last = bytes((self.bytes_of[column],)), [], None, None
        for suffix, before, count in self.states[state]:
            longer = suffix + b
            if longer in self.nodes:
                if change is None and longer in self.merges.tokens and self.merges.stay_apart(before, longer):
                    change, last = count + 1, longer
                if longer in self.inner:
                    grown.append((longer, before, count))
        key = (*((s, t, c - change) for s, t, c in grown), (b"", last, 0))
        reached = self._state(key)
        self.to[state * self.width + column] = reached
        self.change[state * self.width + column] = change

    def advance(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after data[start:start+length], change of the count) from a state each; all advance together, one byte a step."""
        order = np.argsort(-length, kind="stable")
        at, size, state = start[order], length[order], state[order].astype(np.int64)
        total = np.zeros(len(at), np.int64)
        living = np.searchsorted(-size, -np.arange(1, (int(size[0]) if len(size) else 0) + 1), "right")
        for step, m in enumerate(living.tolist()):
            if len(self.states) > MOST_STATES:  # anew, with the states that are in use
                used, back = np.unique(state, return_inverse=True)
                keys = [self.states[x] for x in used.tolist()]
                self.renew()
                state = np.array([self._state(k) for k in keys])[back]
            here = self._columns(data[at[:m] + step])
            asked = state[:m] * self.width + here
            reached = self.to[asked]
            missing = np.flatnonzero(reached < 0)
            if len(missing):
                new = np.unique(asked[missing]).tolist()
                for x in new:
                    self.compile(*divmod(x, self.width))
                asked = state[:m] * self.width + here
                reached = self.to[asked]
            total[:m] += self.change[asked]
            state[:m] = reached
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def counts(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start:start+length]; long ones in parts."""
        out = np.zeros(len(start), np.int64)
        short = length <= PART
        out[short] = self.advance(data, start[short], length[short], np.zeros(np.count_nonzero(short), np.int64))[1]
        if not short.all():
            out[~short] = self.composed(data, start[~short], length[~short])
        return out

    def composed(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of long words. Each is cut into parts; a part's map gives, for the states that it may begin in, the
        state it ends in and the tokens it emits. It is first made for the state that the bytes just before the part
        lead to, then for every end of the part before that it lacks, until none is missing; a prefix scan composes
        the maps. All parts of all words run together."""
        parts = -(-length // PART)
        first = np.cumsum(parts) - parts
        at = np.repeat(start, parts) + PART * spans.gathered(np.zeros(len(parts), np.int64), parts)
        size = np.minimum(PART, np.repeat(start + length, parts) - at)
        opens = np.zeros(len(at), bool)
        opens[first] = True
        names: dict[tuple, int] = {}  # states by name, as the table may begin anew in between
        keys: list[tuple] = []

        def named(states: np.ndarray) -> list[int]:
            used, back = np.unique(states, return_inverse=True)
            of = []
            for x in used.tolist():
                key = self.states[x]
                if key not in names:
                    names[key] = len(keys)
                    keys.append(key)
                of.append(names[key])
            return np.array(of, np.int64)[back].tolist()

        before = np.where(opens, 0, LEAD)
        states, _ = self.advance(data, at - before, before, np.zeros(len(at), np.int64))
        asked = list(enumerate(named(states)))
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in at]
        while asked:
            lanes = np.array([k for k, _ in asked])
            begin = np.array([self._state(keys[x]) for _, x in asked])
            ended, emitted = self.advance(data, at[lanes], size[lanes], begin)
            nexts = []
            for (k, x), y, n in zip(asked, named(ended), emitted.tolist(), strict=True):
                maps[k][x] = (y, n)
                if k + 1 < len(at) and not opens[k + 1]:
                    nexts.append((k + 1, y))
            asked = [(k, y) for k, y in dict.fromkeys(nexts) if y not in maps[k]]
        # the scan: each entry points to the entry of the next part that it leads to; pointers are doubled
        place = {(k, x): i for i, (k, x) in enumerate((k, x) for k, m in enumerate(maps) for x in m)}
        over = len(place)
        last = np.append(opens[1:], True)
        to = np.array([over if last[k] else place[k + 1, y] for k, m in enumerate(maps) for y, _ in m.values()] + [over])
        total = np.array([n for m in maps for _, n in m.values()] + [0])
        while (to != over).any():
            total, to = total + total[to], to[to]
        return total[[place[k, named(np.zeros(1, np.int64))[0]] for k in first.tolist()]]


class TokenCounter:
    def __init__(self, path: str):
        self.transducer = CountTransducer(path)
        self.classes = _class_table()
        self.special = [s.encode() for s in self.transducer.merges.special]

    def count(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each of the texts that lie one after the other in data, with n + 1 offsets at."""
        n_texts, raw = len(at) - 1, data.tobytes()
        found = []  # special tokens: one each, and the text is cut there
        for mark in self.special:
            i = raw.find(mark)
            while i >= 0:
                text = int(np.searchsorted(at, i, "right")) - 1
                if i + len(mark) <= at[text + 1]:
                    found.append((i, i + len(mark), text))
                    i += len(mark)
                else:
                    i += 1
                i = raw.find(mark, i)
        # characters, an end after each text and in place of each special token
        first = np.flatnonzero((data & 0xC0) != 0x80)
        points = data[first] if len(first) == len(data) else np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        classes = self.classes[points]
        char_at = np.searchsorted(first, at)
        drop = np.zeros(len(first), bool)
        for s, e, _ in found:
            a, b = np.searchsorted(first, (s, e))
            classes[a], drop[a + 1 : b] = _C["end"], True
            drop[a] = False
        ends = np.zeros(len(first) + n_texts, bool)
        ends[char_at[1:] + np.arange(n_texts)] = True
        full = np.full(len(ends), _C["end"], np.uint8)
        full[~ends] = np.where(drop, _C["none"], classes)
        starts = word_starts(full)[~ends]
        word = first[np.flatnonzero(starts)]
        stops = np.unique(np.concatenate([word, at[1:], np.array([s for s, _, _ in found], np.int64)]))
        length = stops[np.searchsorted(stops, word, "right")] - word
        tokens = self.transducer.counts(data, word, length)
        sums = np.concatenate([[0], np.cumsum(tokens)])
        edges = np.searchsorted(word, at)
        out = sums[edges[1:]] - sums[edges[:-1]]
        np.add.at(out, [t for _, _, t in found], 1)
        return out


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes (UTF-8) and n_tokens of the whole text.

    vocabulary: path of a byte-level BPE file of the tokenizers library. Null and empty texts have no tokens.
    A special token's string inside a text counts as that one token. Rows repeat as they come; null ids stay
    null; other columns are not read. A map over rows: no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            size = pc.cast(pc.fill_null(pc.binary_length(b.column(1)), 0), pa.int64())
            yield common.record(schema, doc_id=b.column(0), n_bytes=size, n_tokens=counter(vocabulary).count(*common.flat(b.column(1))))

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > OVER)
