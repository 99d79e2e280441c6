"""Benchmark decontamination with suffix arrays over the training text.

Each task cuts its training documents into shards of a few MB and sorts the suffixes of a shard's words into a
suffix array, by prefix doubling up to the length of a window. Every suffix of the test items is then searched in
it by bisection: the range of training suffixes that begin with its first word is narrowed word by word until it is
empty or a whole window long. What remains are all places that hold the window. A place whose word before differs
from the test's begins a longest verbatim match, which is followed to its end.

Words have names: their number among the words of the test items, found by hash and compared byte by byte. Words
that no item holds have no name, and no suffix begins with them, since no test suffix could be found there.

The work is a map over documents: no shuffle, and one shard is in memory at a time. The test set is sent to
the tasks in blocks of at most BLOCK_OF_TESTS bytes; with more blocks than one, the hits are united by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans

WINDOW = 10
#: Bytes of test text that are broadcast at once.
BLOCK_OF_TESTS = 16 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: all but 00-2F, 3A-60 and 7B-7F, after A-Z are lower-cased.
_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False


class Words:
    """The words of a run of texts: start, end and text index of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.n_texts = _LOWER[data], len(at) - 1
        is_word = _WORD[self.data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = is_word
        edges = at[(at > 0) & (at < len(data))]
        first = is_word & ~before[:-1]
        first[edges] = is_word[edges]
        last = is_word.copy()
        last[:-1] &= ~is_word[1:]
        last[edges - 1] = is_word[edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(at, self.start, "right") - 1

    def spread(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(names with a gap of no name after each text, the place of each word among them)."""
        place = np.arange(len(names)) + self.text
        out = np.zeros((int(place[-1]) if len(place) else 0) + 2, np.int64)
        out[place] = names
        return out, place


class TestSet:
    """The words of the test items by name, and the window that begins at each of their suffixes."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.ids = [k for k, _ in items]
        lengths = np.array([len(t) for _, t in items], np.int64)
        words = Words(np.frombuffer(b"".join(t for _, t in items), np.uint8), np.concatenate([[0], np.cumsum(lengths)]))
        raw = words.data.tobytes()
        self.number: dict[bytes, int] = {}
        names = np.array([self.number.setdefault(raw[s:e], len(self.number) + 1) for s, e in zip(words.start.tolist(), words.end.tolist(), strict=True)], np.int64)
        self.spelled = np.frombuffer(b"".join(self.number), np.uint8)
        size = np.array([len(w) for w in self.number], np.int64)
        end = np.cumsum(size)
        h = spans.hashes(self.spelled, end - size, end)
        order = np.argsort(h, kind="stable")
        self.hash, self.size, self.at, self.name = h[order], size[order], (end - size)[order], order + 1
        self.base, place = words.spread(names)
        counts = np.bincount(words.text, minlength=len(items))
        left = (np.cumsum(counts)[words.text] if len(place) else place) - np.arange(len(place))  # words from here to the item's end
        length = np.minimum(counts, window)[words.text]
        whole = left >= length
        #: place, length and item of each window
        self.place, self.length, self.row = place[whole], length[whole], words.text[whole]

    def names(self, words: Words) -> np.ndarray:
        """The name of each word; 0 for a word that no item holds."""
        if not len(self.hash) or not len(words.start):
            return np.zeros(len(words.start), np.int64)
        h, size = spans.hashes(words.data, words.start, words.end), words.end - words.start
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        some = np.flatnonzero(self.hash[at] == h)
        out = np.zeros(len(h), np.int64)
        same = self.size[at[some]] == size[some]
        same[same] = spans.equal(words.data, words.start[some[same]], self.spelled, self.at[at[some[same]]], size[some[same]])
        out[some[same]] = self.name[at[some[same]]]
        for i in some[~same].tolist():  # another word of that hash
            out[i] = self.number.get(words.data[words.start[i] : words.end[i]].tobytes(), 0)
        return out


def suffix_array(base: np.ndarray, depth: int) -> np.ndarray:
    """Places of base that hold a name, in order of the depth names from there on; a 0 ends a suffix and follows each."""
    some = np.flatnonzero(base)
    order = some[np.argsort(base[some], kind="stable")]
    slot = np.arange(len(order))
    rank = np.zeros(len(base), np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.append(True, base[order][1:] != base[order][:-1]), slot, 0)) + 1 if len(order) else 0
    k = 1
    while k < depth:
        same = rank[order[1:]] == rank[order[:-1]]
        open_slots = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(open_slots):
            break
        place = order[open_slots]
        key = rank[place] << 32 | rank[np.minimum(place + k, len(base) - 1)]
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        order[open_slots] = place
        rank[place] = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), open_slots, 0)) + 1
        k *= 2
    return order


def _bisected(values: np.ndarray, order: np.ndarray, shift: int, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """For each range low..high of order, where wanted stands (or, right, ends) among values[order + shift]."""
    low, high = low.copy(), high.copy()
    while True:
        open_ones = low < high
        if not open_ones.any():
            return low
        middle = (low + high) >> 1
        found = values[np.minimum(order[np.minimum(middle, len(order) - 1)] + shift, len(values) - 1)]  # a closed range may lie at the end
        below = (found <= wanted) if right else (found < wanted)
        low = np.where(open_ones & below, middle + 1, low)
        high = np.where(open_ones & ~below, middle, high)


def search(tests: TestSet, base: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows found in the suffix array, begin and end of each one's range there)."""
    asked = np.arange(len(tests.place))
    low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(order), np.int64)
    done: list[tuple] = []
    depth = 0
    while len(asked):
        wanted = tests.base[tests.place[asked] + depth]
        begin = _bisected(base, order, depth, low, high, wanted, False)
        end = _bisected(base, order, depth, begin, high, wanted, True)
        depth += 1
        found = end > begin
        asked, low, high = asked[found], begin[found], end[found]
        whole = tests.length[asked] == depth
        done.append((asked[whole], low[whole], high[whole]))
        asked, low, high = asked[~whole], low[~whole], high[~whole]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*done, strict=True)) if done else (none, none, none)


def search_shard(tests: TestSet, data: np.ndarray, at: np.ndarray, keep_matches: bool = True) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, hit flag of each word, (text, item row) pairs, (text, item row, item place, word, words) of each longest match)."""
    words = Words(data, at)
    base, place = words.spread(tests.names(words))
    order = suffix_array(base, int(tests.length.max(initial=0)))
    window, low, high = search(tests, base, order)
    word = np.zeros(len(base), np.int64)
    word[place] = np.arange(len(place))
    # windows of one range and length are the same words: their places count once
    length = tests.length[window]
    groups, first, of = np.unique(np.stack([low, length]), axis=1, return_index=True, return_inverse=True)
    n = high[first] - low[first]
    which, where = np.repeat(np.arange(len(n)), n), word[order[spans.gathered(low[first], n)]]
    edge = np.bincount(where, minlength=len(place) + 1) - np.bincount(where + groups[1][which], minlength=len(place) + 1)
    hit = np.cumsum(edge)[: len(place)] > 0
    # the items of a group of windows
    rows = np.unique(np.stack([of.ravel(), tests.row[window]]), axis=1)
    begin = np.searchsorted(rows[0], np.arange(len(n) + 1))
    both = np.unique(np.stack([words.text[where], which]), axis=1)
    pairs, step = [np.zeros((2, 0), np.int64)], 1 << 18
    for i in range(0, both.shape[1], step):
        text, group = both[:, i : i + step]
        count = begin[group + 1] - begin[group]
        pairs.append(np.unique(np.stack([np.repeat(text, count), rows[1][spans.gathered(begin[group], count)]]), axis=1))
    found = [np.zeros((5, 0), np.int64)]
    if keep_matches:
        total = np.cumsum(high - low)
        i = 0
        while i < len(window):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + step, "right")))
            count = high[i:j] - low[i:j]
            found.append(_longest(tests, base, np.repeat(window[i:j], count), order[spans.gathered(low[i:j], count)], word, words))
            i = j
    return words, hit, np.unique(np.concatenate(pairs, axis=1), axis=1), np.concatenate(found, axis=1)


def _longest(tests: TestSet, base: np.ndarray, window: np.ndarray, there: np.ndarray, word: np.ndarray, words: Words) -> np.ndarray:
    """Matches that begin at these places of test windows in the training text, each to its end."""
    here = tests.place[window]
    before, other = tests.base[np.maximum(here - 1, 0)], base[np.maximum(there - 1, 0)]
    begins = (here == 0) | (there == 0) | (before == 0) | (before != other)
    window, here, there = window[begins], here[begins], there[begins]
    size = tests.length[window].copy()
    going = np.arange(len(size))
    while len(going):
        a, b = tests.base[here[going] + size[going]], base[there[going] + size[going]]
        going = going[(a == b) & (a > 0)]
        size[going] += 1
    row, first = tests.row[window], word[there]
    item_start = np.searchsorted(tests.row, row)  # the item's first window begins at its first word
    return np.stack([words.text[first], row, here - tests.place[item_start], first, size])


_SPANS, _MATCHES = "array<struct<start:bigint,end:bigint>>", "array<struct<item_id:string,item_word:bigint,word:bigint,n_words:bigint>>"
_SCHEMA = f"doc_id bigint, text_key bigint, n_words bigint, item_ids array<string>, spans {_SPANS}, matches {_MATCHES}"


def _search(tests, keep_matches: bool):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    match_type = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("n_words", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", spans_type), ("matches", match_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tests.value
        for b in common.blocks(batches):
            words, hit, pairs, found = search_shard(held, *common.flat(b.column(1)), keep_matches)
            n = b.num_rows
            n_words = np.bincount(words.text, minlength=n)
            begins = np.concatenate([[0], np.cumsum(n_words)])
            items: list[list[str]] = [[] for _ in range(n)]
            for text, row in pairs.T.tolist():
                items[text].append(held.ids[row])
            covered: list[list[dict]] = [[] for _ in range(n)]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                while s < e:  # a run of hits may cross into the next text
                    text = int(words.text[s])
                    stop = min(e, int(begins[text + 1]))
                    covered[text].append({"start": s - int(begins[text]), "end": stop - int(begins[text])})
                    s = stop
            matches: list[list[dict]] = [[] for _ in range(n)]
            for text, row, item_word, word, length in found[:, np.lexsort(found[[2, 3, 1]])].T.tolist():
                matches[text].append({"item_id": held.ids[row], "item_word": item_word, "word": word - int(begins[text]), "n_words": length})
            yield common.record(schema, doc_id=b.column(0), text_key=b.column(2), n_words=n_words, item_ids=[sorted(set(x)) for x in items], spans=covered, matches=matches)

    return run


def _test_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[TestSet]:
    """Test sets of bounded size; items come sorted, one block at a time is on the driver."""
    items, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("k"), F.coalesce("text", F.lit("")).alias("t")).where("k is not null").toLocalIterator():
        items.append((row.k, row.t.encode()))
        held += len(items[-1][1])
        if held >= block_bytes:
            yield TestSet(items, window)
            items, held = [], 0
    yield TestSet(items, window)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_OF_TESTS, keep_matches: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_words, item_ids (sorted strings), spans (hit word ranges), matches (longest ones).

    docs needs doc_id and text; benchmark needs item_id and text; further columns are ignored. A match entry
    names an item, the item's word and the document's word where it begins, and the words matched, at least a window
    (or the whole of a shorter item); there is one for each item and place that can't be made longer. Null texts
    have no words. Items with a null id or without words match nothing. Repeated rows give repeated rows.
    A null doc_id stays null. Empty tables give no rows, or no hits.
    """
    spark, parts = docs.sparkSession, []
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    for tests in _test_blocks(benchmark, window, block_bytes):
        parts.append(source.mapInArrow(_search(spark.sparkContext.broadcast(tests), keep_matches), _SCHEMA))
    if len(parts) == 1:
        return parts[0].drop("text_key")
    return _united(parts)


def _united(parts: list[DataFrame]) -> DataFrame:
    """Hits of several test blocks: only documents with hits are shuffled and united, then joined to the counts."""
    hits = None
    for p in parts:
        p = p.where("size(spans) > 0")
        hits = p if hits is None else hits.unionByName(p)
    hits = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("matches")))).alias("matches"),
    )
    merge = """aggregate(all_spans, cast(array() as array<struct<start:bigint,end:bigint>>), (a, s) ->
        if(size(a) > 0 and s.start <= element_at(a, -1).end,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))),
           concat(a, array(s))))"""
    hits = hits.withColumn("spans", F.expr(merge)).drop("all_spans")
    counts = parts[0].select("doc_id", "text_key", "n_words")
    return counts.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left").select(
        "doc_id", "n_words",
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"),
        F.coalesce("matches", F.array().cast(_MATCHES)).alias("matches"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold any window of a benchmark item; all columns stay.

    One pass over docs, without a shuffle, for a benchmark of one block. Rows with null text stay.
    """
    spark = docs.sparkSession
    kept, names = docs, docs.columns
    for tests in _test_blocks(benchmark, window, BLOCK_OF_TESTS):
        held = spark.sparkContext.broadcast(tests)

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in common.blocks(batches):
                words, hit, _, _ = search_shard(held.value, *common.flat(b.column(b.schema.get_field_index("text"))), False)
                yield b.filter(pa.array(np.bincount(words.text[hit], minlength=b.num_rows) == 0))

        kept = kept.mapInArrow(keep, kept.schema)
    return kept.select(*names)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = longest_matches(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"), keep_matches=False)
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def brute_force(documents: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract of op1 by direct comparison of words, for tests on small tables."""
    import re

    def words_of(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    wanted = []
    for item, text in items:
        w = words_of(text)
        m = min(len(w), window)
        wanted.append((str(item), m, {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()))
    out = []
    for doc, text in documents:
        w, hit, hits = words_of(text), set(), []
        for item, m, windows in wanted:
            at = [i for i in range(len(w) - m + 1) if tuple(w[i : i + m]) in windows] if m else []
            hit |= {i + k for i in at for k in range(m)}
            hits += [item] * bool(at)
        out.append((doc, len(w), len(hit), len(hits), hashlib.sha256(",".join(sorted(hits)).encode()).hexdigest(), bool(hit)))
    return out
