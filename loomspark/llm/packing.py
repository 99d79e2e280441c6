"""Packing of documents into fixed windows by non-negative least squares.

A document's ids are cut into whole windows and a tail. The tails of some thousand documents make a histogram
of lengths. All combinations of two or three lengths that fill a window exactly are the columns of a
matrix; non-negative least squares finds how often to use each so that the histogram is met. The counts are
rounded, never beyond what the histogram holds; what is left is packed greedily, longest first, the last piece
cut where its window is full. A window that is still open goes on with the next group of documents, so that
each task pads one window at most.

The work is a map over documents, without a shuffle; a task holds one group's ids at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans
from .tokens import encoder

WINDOW = 2048
#: A group of documents that is packed together ends at so many documents or ids.
GROUP_DOCS, GROUP_IDS = 16_384, 8_000_000
#: Least squares ends when a step lessens the squared residue by less than this part of it.
CONVERGED = 1e-3


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows of two or three lengths (0 for none) that add up to the window and occur in the histogram."""
    have = np.flatnonzero(histogram)
    have = have[have > 0]
    a = have[(2 * have <= window) & (histogram[np.minimum(window - have, len(histogram) - 1)] > 0) & (have < window)]
    pairs = np.stack([a, window - a, np.zeros_like(a)], axis=1)
    triples = [np.zeros((0, 3), np.int64)]
    for x in have[3 * have <= window].tolist():
        y = have[(have >= x) & (2 * have <= window - x)]
        y = y[histogram[window - x - y] > 0]
        triples.append(np.stack([np.full(len(y), x), y, window - x - y], axis=1))
    return np.concatenate([pairs, *triples]).astype(np.int32)


def repeat_counts(histogram: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """x >= 0 with least || A x - histogram ||, A the counts of lengths in combinations; multiplicative updates."""
    used = np.append(0.0, np.ones(len(histogram) - 1))  # length 0 stands for no length
    want = histogram * used
    of = lambda lengths: lengths[combos[:, 0]] + lengths[combos[:, 1]] + lengths[combos[:, 2]]
    target = of(want)
    x = np.maximum(np.where(combos > 0, want[combos], np.inf).min(axis=1) / 8, 1e-3)
    last = np.inf
    while True:
        met = sum(np.bincount(combos[:, k], x, len(histogram)) for k in range(3)) * used
        residue = float(((met - want) ** 2).sum())
        if residue <= 1 or last - residue < CONVERGED * last:
            return x
        last = residue
        x *= target / np.maximum(of(met), 1e-9)


def rounded(histogram: np.ndarray, combos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole counts near x, the largest first, that together use no length more often than there is."""
    left, out = histogram.copy(), np.zeros(len(combos), np.int64)
    left[0] = len(combos)  # length 0 stands for no length
    for up in (False, True):  # whole parts first, then one more for the largest remainders
        order = np.argsort(-(x - np.floor(x) if up else x), kind="stable")
        order = order if up else order[: np.count_nonzero(x >= 1)]
        for i in range(0, len(order), 4096):
            part = order[i : i + 4096]
            for k in part[(left[combos[part]] > 0).all(axis=1)].tolist():
                lengths = [v for v in combos[k].tolist() if v]
                can = min(1 if up else int(x[k]), *(int(left[v]) // lengths.count(v) for v in lengths))
                if can > 0:
                    out[k] += can
                    for v in lengths:
                        left[v] -= can
    return out


def plan(tails: np.ndarray, window: int, fill: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Pieces of tails: (tail, start in it, sequence, offset), sequences used, and the fill of the one left open.

    Sequence 0 is the open one, filled up to `fill`; new ones count from 1.
    """
    histogram = np.bincount(tails, minlength=window + 1)
    combos = combinations(histogram, window)
    counts = rounded(histogram, combos, repeat_counts(histogram, combos)) if len(combos) else np.zeros(0, np.int64)
    rows = np.repeat(combos, counts, axis=0).astype(np.int64)
    by_length = np.argsort(tails, kind="stable")
    begin = np.cumsum(histogram) - histogram
    slots = rows[rows > 0]
    sequence = np.repeat(np.arange(len(rows)), (rows > 0).sum(axis=1))
    offset = (np.cumsum(rows, axis=1) - rows)[rows > 0]
    order = np.argsort(slots, kind="stable")
    nth = np.arange(len(slots)) - np.searchsorted(slots[order], slots[order], "left")
    filled = by_length[begin[slots[order]] + nth]
    # the rest: one after the other, longest first, cut at full windows
    left = np.ones(len(tails), bool)
    left[filled] = False
    rest = np.flatnonzero(left)
    rest = rest[np.argsort(-tails[rest], kind="stable")]
    ends = fill + np.cumsum(tails[rest])
    starts = ends - tails[rest]
    first, last = starts // window, np.maximum(ends - 1, starts) // window
    n = last - first + 1
    which = np.repeat(np.arange(len(rest)), n)
    cell = spans.gathered(first, n)
    begins = np.maximum(starts[which], cell * window)
    end_fill = int(ends[-1]) if len(rest) else fill
    opened = -(-end_fill // window) - 1 if end_fill else 0  # windows begun after the open one
    return (
        np.concatenate([filled, rest[which]]), np.concatenate([np.zeros(len(filled), np.int64), begins - starts[which]]),
        np.concatenate([sequence[order] + 1 + max(opened, 0), cell]), np.concatenate([offset[order], begins - cell * window]),
        max(opened, 0), end_fill - max(opened, 0) * window,
    )


_SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int | None = 1, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most `window` ids: doc_id, start (ids of the document
    before the piece), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    docs needs doc_id and text; other columns are not read. Each document's ids, with end_id after them, lie in
    exactly one piece each. Null and empty texts have end_id alone (and no piece without one). Repeated rows are
    packed each; null ids stay null. Sequences are numbered within each task's own range, so another division of the
    input into tasks gives other numbers and other neighbours. An empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(vocabulary), TaskContext.get().partitionId() << 40
        held, docs_held, ids_held = [], 0, 0
        open_no, next_no, fill = 0, 0, 0  # the open sequence, the next free number, ids in the open one

        def flush():
            nonlocal held, docs_held, ids_held, open_no, next_no, fill
            ids = np.concatenate([h[0] for h in held])
            n = np.concatenate([h[1] for h in held])
            keys = pa.chunked_array([h[2] for h in held]).combine_chunks()
            held, docs_held, ids_held = [], 0, 0
            if not fill:
                open_no, next_no = next_no, next_no + 1
            begin = np.cumsum(n) - n
            whole, tails = n // window, n % window
            some = np.flatnonzero(tails)
            tail, at, sequence, offset, opened, end_fill = plan(tails[some], window, fill)
            tail = some[tail]
            # a piece ends where the next one of its tail begins
            order = np.lexsort((at, tail))
            goes_on = np.append(tail[order][1:] == tail[order][:-1], False) if len(tail) else np.zeros(0, bool)
            length = np.empty(len(tail), np.int64)
            length[order] = np.where(goes_on, np.append(at[order][1:], 0)[: len(at)], tails[tail[order]]) - at[order]
            block = np.repeat(np.arange(len(n)), whole)
            doc = np.concatenate([block, tail])
            start = np.concatenate([spans.gathered(np.zeros(len(n), np.int64), whole) * window, whole[tail] * window + at])
            size = np.concatenate([np.full(len(block), window), length])
            place = np.concatenate([np.zeros(len(block), np.int64), offset])
            begun = max(int(sequence.max()) if len(sequence) else 0, opened)
            number = np.concatenate([next_no + begun + np.arange(len(block)), np.where(sequence == 0, open_no, next_no + sequence - 1)])
            open_no, fill = (next_no + opened - 1 if opened else open_no), end_fill % window
            next_no += begun + len(block)
            for i in range(0, len(doc), 4096):
                part = slice(i, i + 4096)
                raw = ids[spans.gathered(begin[doc[part]] + start[part], size[part])].astype("<u4")
                ends = (4 * np.concatenate([[0], np.cumsum(size[part])])).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                yield common.record(schema, doc_id=keys.take(pa.array(doc[part])), start=start[part], length=size[part], ids=column, doc_tokens=n[doc[part]], sequence_id=base + number[part], offset=place[part])

        for b in common.blocks(batches, most=min(common.BLOCK_BYTES, 256 * group_docs)):
            ids, at = enc.encode(*common.flat(b.column(1)))
            if end_id is not None:
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
            held.append((ids, np.diff(at), b.column(0)))
            docs_held, ids_held = docs_held + b.num_rows, ids_held + len(ids)
            if docs_held >= group_docs or ids_held >= GROUP_IDS:
                yield from flush()
        if held:
            yield from flush()

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, _SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(pack(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
