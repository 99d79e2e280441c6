"""A quality classifier by positive-unlabelled learning.

Trusted positives (labelled rows of quality 1) and unlabelled web text are enough. With the class prior p and a linear
score g, the risk is p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]): unbiased for p E+[l(g)] + (1 - p) E-[l(-g)] and kept
non-negative. l is the squared loss (1 - g)^2, for which the best g is 2 P(good) - 1, so (1 + g) / 2 is the score. This
risk needs no rows, only the second moments of the features over the positives and over the unlabelled rows: they are
summed up in one pass over all documents, and the minimum is found from them. Where the second term would be
negative, its weight is lowered from 1 until it is zero, which is the minimum of the risk with max(0, .).

The prior is estimated without negatives: rows that lie above a threshold of any score make up a share q+ of the
positives and qu of the unlabelled rows, and p q+ <= qu. The bound qu / q+ is taken where, with an allowance for chance,
it is least (best bin estimation), from histograms of a positives-against-unlabelled score over all documents.

Scores see the text alone: shares of character classes, shapes of words and lines, repeats of words and lines,
and trigrams of character classes, all over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans

#: Labelled ids that are learnt from at most (those of the least hash; unlabelled rows all count); score from which a
#: text counts as good; weight of the penalty on the squared coefficients of many positives (more for few).
MOST_POSITIVES, THRESHOLD, RIDGE = 20_000, 0.3, 0.3
#: Bins of the histograms for the prior; blocks in which moments are summed up.
BINS, BLOCKS = 4096, 16
#: Bytes of text whose features are computed at once; each takes some hundred bytes of scratch memory.
BLOCK = 1 << 20

#: Character classes: each ASCII mark by itself, letters by case, digits, blanks, line ends, controls, the rest.
_CLASS = np.zeros(256, np.int64)
_CLASS[:32] = 5
for _i, _c in enumerate(c for c in range(33, 127) if not chr(c).isalnum()):
    _CLASS[_c] = 8 + _i
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:], _CLASS[127] = 0, 1, 2, 6, 5
_CLASS[[32, 9]], _CLASS[[10, 13]] = 3, 4
N_CLASSES, N_SHAPES = 40, 512
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER_LETTER = np.zeros(256, bool)
_LOWER_LETTER[97:123] = True
N_SHARES = 11
WIDTH = N_CLASSES + N_SHAPES + N_SHARES


def _runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of runs of set flags; a text's edge ends a run."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin, end = at[:-1][at[:-1] < len(inside)], at[1:][at[1:] > 0] - 1
    first[begin], last[end] = inside[begin], inside[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _repeats(data, start, end, owner, n, back: int) -> np.ndarray:
    """Per text: units that equal the one `back` places before."""
    h = spans.hashes(data, start, end)
    again = np.zeros(len(h), bool)
    again[back:] = (h[back:] == h[:-back]) & (owner[back:] == owner[:-back])
    return np.bincount(owner[again], minlength=n)


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of WIDTH features for each text; texts lie one after the other, at holds n + 1 offsets. Empty texts have zeros."""
    n, size = len(at) - 1, np.diff(at)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    text = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    some = np.maximum(size, 1)[:, None]
    out[:, :N_CLASSES] = np.sqrt(np.bincount(text * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, -1) / some)
    if len(data) > 2:
        shape = ((kind[:-2] * 1681 + kind[1:-1] * 41 + kind[2:]) * 2654435761 >> 12) % N_SHAPES
        inside = text[:-2] == text[2:]
        out[:, N_CLASSES : N_CLASSES + N_SHAPES] = np.sqrt(np.bincount(text[:-2][inside] * N_SHAPES + shape[inside], minlength=n * N_SHAPES).reshape(n, -1) / some)
    start, end = _runs(~_BLANK[data], at)
    owner = np.searchsorted(at, start, "right") - 1
    words = np.maximum(np.bincount(owner, minlength=n), 1)
    of = lambda flag: np.bincount(owner[flag], minlength=n) / words
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    lower = np.concatenate([[0], np.cumsum(_LOWER_LETTER[data])])
    n_upper, n_lower = upper[end] - upper[start], lower[end] - lower[start]
    line_start, line_end = _runs(data != 10, at)
    line_owner = np.searchsorted(at, line_start, "right") - 1
    lines = np.maximum(np.bincount(line_owner, minlength=n), 1)
    shares = [
        np.sqrt(_repeats(data, start, end, owner, n, 1) / words), np.sqrt(_repeats(data, start, end, owner, n, 2) / words), np.sqrt(_repeats(data, start, end, owner, n, 3) / words),
        np.sqrt(_repeats(data, line_start, line_end, line_owner, n, 1) / lines), np.sqrt(_repeats(data, line_start, line_end, line_owner, n, 2) / lines),
        of(_UPPER[data[start]] & (n_lower > 0)), of((n_upper > 1) & (n_lower == 0)), of(end - start == 1), of(end - start > 25),
        np.minimum(np.bincount(owner, end - start, n) / words, 50) / 10, np.minimum(size / lines, 2000) / 500,
    ]
    out[:, -N_SHARES:] = np.stack(shares, axis=1)
    out[size == 0] = 0
    return out


@dataclass
class Model:
    """A linear score of standardised features; it lies between 0 and 1 and is 1 where good is certain."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def line(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((1 + self.line(x)) / 2, 0, 1)


def second_moments(x: np.ndarray) -> np.ndarray:
    """Sums of the products of all features and a one, over the rows of x."""
    z = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    return (z.T @ z).astype(np.float64)


def constant(width: int, prior: float) -> Model:
    return Model(np.zeros(width), np.zeros(width), np.zeros(width), 2 * prior - 1, prior)


def _standardised(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, moments of positives, moments of unlabelled rows), the latter two averages of standardised features."""
    u, p = unlabelled / unlabelled[-1, -1], positive / positive[-1, -1]
    mean = u[-1, :-1]
    spread = np.sqrt(np.maximum(np.diag(u)[:-1] - mean**2, 0))
    scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 0.01), 0)
    move = np.diag(np.append(scale, 1.0))
    move[:-1, -1] = -mean * scale
    return mean, scale, move @ p @ move.T, move @ u @ move.T


def _penalty(positive: np.ndarray) -> np.ndarray:
    """The penalty's matrix: it doubles where there are as many coefficients as positive rows; the constant is free."""
    width = len(positive)
    return RIDGE * (1 + width / positive[-1, -1]) * np.diag(np.append(np.ones(width - 1), 0))


def contrast(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Model, float, float]:
    """A score that is high where positives are denser than unlabelled rows, and its mean and spread over the latter."""
    mean, scale, p, u = _standardised(positive, unlabelled)
    w = np.linalg.solve(u + _penalty(positive), p[-1])
    centre = float(w @ u[-1])
    return Model(mean, scale, w[:-1], float(w[-1]), 0.5), centre, float(np.sqrt(max(w @ u @ w - centre**2, 1e-12)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows from histograms of one score (counts by bin, ascending)."""
    above = [np.cumsum(h[::-1])[::-1] / h.sum() for h in (positive, unlabelled)]
    chance = sum(np.sqrt(np.log(4 / 0.1) / (2 * h.sum())) for h in (positive, unlabelled))
    some = above[0] > 0
    bound = (above[1][some] + 1.01 * chance) / above[0][some]
    at = int(np.argmin(bound))
    return float(np.clip(above[1][some][at] / above[0][some][at], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """The minimum of the non-negative risk from the moments of positives and of unlabelled rows."""
    mean, scale, p, u = _standardised(positive, unlabelled)

    def at(theta: float) -> tuple[np.ndarray, float]:
        """(coefficients, risk of the negatives) where that risk counts theta times."""
        w = np.linalg.solve(prior * (1 - theta) * p + theta * u + _penalty(positive), prior * (1 + theta) * p[-1] - theta * u[-1])
        return w, float(w @ u @ w + 2 * w @ u[-1] + 1 - prior * (w @ p @ w + 2 * w @ p[-1] + 1))

    w, negatives = at(1.0)
    if negatives < 0:
        low, high = 0.0, 1.0
        for _ in range(40):  # halving, to the precision of the sums
            middle = (low + high) / 2
            low, high = (middle, high) if at(middle)[1] >= 0 else (low, middle)
        w, _ = at(low)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _flagged(docs: DataFrame, labels: DataFrame, most_positives: int) -> DataFrame:
    """text and positive (its label may be learnt from, and is 1) of all rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("of")).distinct()
    chosen = common.saved(known.orderBy(F.xxhash64("of"), "of").limit(most_positives), "positives")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(~held_out(F.col("doc_id")))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("of"), "left").select("text", F.col("of").isNotNull().alias("positive"))


def _sums(rows: DataFrame) -> list[np.ndarray]:
    """Moments of (all rows, positive rows): each task sums up its own, blocks of those sums are added by as many tasks."""
    upper = np.triu_indices(WIDTH + 1)
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((WIDTH + 1, WIDTH + 1)), np.zeros((WIDTH + 1, WIDTH + 1))]
        for b in common.blocks(batches, most=BLOCK):
            x, positive = features(*common.flat(b.column(0))), np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
            sums[0] += second_moments(x)
            sums[1] += second_moments(x[positive])
        for kind, s in enumerate(sums):
            if s[-1, -1]:
                parts = np.array_split(s[upper], BLOCKS)
                yield common.record(schema, kind=[kind] * BLOCKS, block=list(range(BLOCKS)), sums=[x.tobytes() for x in parts])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for kind, block, data in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                x = np.frombuffer(data)
                total[kind, block] = total[kind, block] + x if (kind, block) in total else x
        for (kind, block), x in total.items():
            yield common.record(schema, kind=[kind], block=[block], sums=[x.tobytes()])

    made = rows.mapInArrow(run, "kind int, block int, sums binary").repartition(2 * BLOCKS, "kind", "block").mapInArrow(add, "kind int, block int, sums binary")
    found = {(r.kind, r.block): np.frombuffer(r.sums) for r in made.collect()}  # 2 * BLOCKS rows
    out = []
    for kind in (0, 1):
        s = np.zeros((WIDTH + 1, WIDTH + 1))
        if (kind, 0) in found:
            s[upper] = np.concatenate([found[kind, k] for k in range(BLOCKS)])
            s = s + np.triu(s, 1).T
        out.append(s)
    return out


def _histograms(rows: DataFrame, model: Model, low: float, high: float) -> list[np.ndarray]:
    """Counts by bin of the model's line between low and high, of (all rows, positive rows)."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("bin", pa.int32()), ("every", pa.int64()), ("positives", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS), np.int64)
        for b in common.blocks(batches, most=BLOCK):
            at = np.clip((held.value.line(features(*common.flat(b.column(0)))) - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int64)
            counts[0] += np.bincount(at, minlength=BINS)
            counts[1] += np.bincount(at[np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)], minlength=BINS)
        some = np.flatnonzero(counts[0])
        yield common.record(schema, bin=some, every=counts[0][some], positives=counts[1][some])

    out = np.zeros((2, BINS))
    for r in rows.mapInArrow(run, "bin int, every bigint, positives bigint").groupBy("bin").agg(F.sum("every").alias("every"), F.sum("positives").alias("positives")).collect():  # BINS rows
        out[:, r["bin"]] = r["every"], r["positives"]
    return [out[0], out[1]]


def train(docs: DataFrame, labels: DataFrame, most_positives: int = MOST_POSITIVES, prior: float | None = None) -> Model:
    """Fits on the documents of trusted positive labels and on all documents, none of them held out.

    docs: doc_id, text; labels: doc_id, quality. Labels with a null id or quality are left out, those that repeat count
    once; documents with a null id are unlabelled; repeated documents count each. At most most_positives labelled ids
    (those of the least hash) go to all tasks; moments and histograms of a fixed size come to the driver, whatever the
    input. Without positives or documents the score is the prior, 0.5 if that isn't given.
    """
    rows = _flagged(docs, labels, most_positives)
    unlabelled, positive = _sums(rows)
    if not positive[-1, -1]:
        return constant(WIDTH, 0.5 if prior is None else prior)
    if prior is None:
        model, centre, spread = contrast(positive, unlabelled)
        every, positives = _histograms(rows, model, centre - 8 * spread, centre + 8 * spread)
        prior = estimated_prior(positives, every)
    return fit(positive, unlabelled, prior)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row; null texts count as empty, rows and null ids stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, most=BLOCK):
            yield common.record(schema, doc_id=b.column(0), score=held.value.score(features(*common.flat(b.column(1)))))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold; all columns stay. Empty texts are scored like others."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, most=BLOCK):
            yield b.filter(pa.array(model.value.score(features(*common.flat(b.column(b.schema.get_field_index("text"))))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    scored = scores(docs, train(docs, common.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
