"""Toxicity by compression distance: windows of words compressed with a dictionary of ordinary and one of toxic text.

Two zstandard dictionaries are trained on labelled rows: one on windows of ordinary rows, one on what toxic rows say and
ordinary rows hardly do, that is on their words that begin with a stem of many toxic rows. A window is compressed twice, with the
ordinary dictionary and with the toxic one in front of it. What ordinary text needs stands in both, nearest to the
window, so that ordinary windows compress alike; a window is shorter with the second where it holds toxic text. Each
byte is written twice first: a byte that no dictionary holds then costs two, and a match is worth more than the
rounding to whole bytes.

A text's score is a logistic function of its windows' differences (the greatest, their sum, how many are large) and of
their number. It is calibrated on rows that the dictionaries haven't seen: each half of the labelled rows is compressed with
dictionaries of the other half. Scoring is a map over all documents; texts are used whole.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, quality, spans

#: Labelled rows of each class that are learnt from at most (those of the least hash), and bytes of their texts.
MOST_ROWS, MOST_BYTES = 3_000, 12 << 20
#: Words of a window; a difference from which a window counts as toxic; score from which a text does.
WINDOW, LARGE, THRESHOLD = 8, 3, 0.5
#: Bytes of the ordinary and of the toxic dictionary; bytes that ordinary windows are trained on at most.
ORDINARY_BYTES, TOXIC_BYTES, TRAINING_BYTES = 110_000, 8_192, 4 << 20
#: Stems: first letters of a word, so many at least; a word may also be its own stem.
STEM_BYTES = range(4, 11)
#: A stem is toxic if so many toxic rows hold it, so many times what is expected of ordinary rows.
LEAST_ROWS, RATIO = 3, 8
RIDGE = 1.0


def _segments(words: decontaminate.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, each twice: the words with a blank around each; offset, size and text of each window in them)."""
    n = len(words.start)
    if not n:
        return np.full(2, 32, np.uint8), *[np.zeros(0, np.int64)] * 3
    size = words.end - words.start + 1
    laid = np.full(int(size.sum()) + 1, 32, np.uint8)
    after = np.cumsum(size)
    laid[1:] = words.data[np.minimum(spans.gathered(words.start, size), len(words.data) - 1)]
    laid[after] = 32
    first_word = np.concatenate([[0], np.cumsum(np.bincount(words.text, minlength=words.n_texts))])[words.text]
    begins = np.flatnonzero((np.arange(n) - first_word) % WINDOW == 0)
    ends = np.append(begins[1:], n) - 1
    low, high = after[begins] - size[begins], after[ends] + 1
    return np.repeat(laid, 2), low * 2, (high - low) * 2, words.text[begins]


@functools.cache
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = zstandard.ZstdCompressionParameters(
        window_log=19, hash_log=16, chain_log=16, search_log=4, min_match=6, target_length=32, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=options)


def compressed_sizes(dictionary: bytes, data: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of the frame of each window data[low:low + size], apart from the others."""
    if not len(low):
        return np.zeros(0, np.int64)
    places = np.stack([low, size], axis=1).astype("<u8")
    frames = _compressor(dictionary).multi_compress_to_buffer(zstandard.BufferWithSegments(data.tobytes(), places.tobytes()), threads=1)
    return np.fromiter((len(frames[i]) for i in range(len(frames))), np.int64, len(frames))


def evidence(ordinary: bytes, toxic: bytes, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each text: greatest difference, log of their sum, large ones by the root of windows and up to 3, log of windows."""
    n = len(at) - 1
    laid, low, size, text = _segments(decontaminate.Words(data, at))
    gain = compressed_sizes(ordinary, laid, low, size) - compressed_sizes(toxic + ordinary, laid, low, size) if toxic else np.zeros(len(low), np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, text, gain)
    windows, large = np.bincount(text, minlength=n), np.bincount(text, gain >= LARGE, minlength=n)
    some = np.maximum(windows, 1)
    return np.stack([most, np.log1p(np.bincount(text, np.maximum(gain, 0), minlength=n)), large / np.sqrt(some), np.minimum(large, 3), np.log(some)], axis=1).astype(float)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        line = (evidence(self.ordinary, self.toxic, data, at) - self.mean) * self.scale @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(line, -500, 500)))


def _words_of(text: str) -> list[bytes]:
    words = decontaminate.Words(*common.flat(pa.array([text])))
    raw = words.data.tobytes()
    return [raw[s:e] for s, e in zip(words.start.tolist(), words.end.tolist(), strict=True)]


def _stems(word: bytes) -> list[bytes]:
    return [word[:n] for n in STEM_BYTES if n < len(word)] + [word]


def _trained(samples: list[bytes], size: int, step: int) -> bytes:
    """A dictionary of the samples; of few samples, which zstandard can't be trained on, the samples themselves."""
    doubled = [np.repeat(np.frombuffer(s, np.uint8), 2).tobytes() for s in samples]
    try:
        return zstandard.train_dictionary(size, doubled, k=step, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(doubled)[-size:]


def dictionaries(rows: list[tuple[list[bytes], bool]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) of rows of words and a label; the toxic one is empty where no stem tells toxic rows apart."""
    n_toxic = sum(t for _, t in rows)
    n_ordinary = len(rows) - n_toxic
    holding: tuple[Counter, Counter] = (Counter(), Counter())
    for words, toxic in rows:
        holding[toxic].update({s for w in set(words) for s in _stems(w)})
    expected = n_toxic / max(n_ordinary, 1)
    told = {s for s, n in holding[True].items() if n >= LEAST_ROWS and n >= RATIO * (e := expected * (holding[False][s] + 1)) and n - e >= LEAST_ROWS * (1 + math.sqrt(e))}
    windows, held = [], 0
    for words, toxic in rows:
        for i in range(0, 0 if toxic else len(words), 2 * WINDOW):
            windows.append(b" " + b" ".join(words[i : i + 2 * WINDOW]) + b" ")
            held += len(windows[-1])
    every = max(1, -(-held // TRAINING_BYTES))  # windows spread over all rows
    lists = [[w for w in dict.fromkeys(words) if not told.isdisjoint(_stems(w))] for words, toxic in rows if toxic]
    marked = [b" " + b" ".join(words) + b" " for words in lists if words]
    return _trained(windows[::every], ORDINARY_BYTES, 128), _trained(marked, TOXIC_BYTES, 32) if marked else b""


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic function by Newton steps, with a ridge."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = RIDGE * np.diag(np.append(np.ones(x.shape[1]), 1e-6))
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def fit(texts: list[str], labels: list[bool]) -> Model:
    """Dictionaries of all rows, calibrated on halves with dictionaries of the other half. Of one class alone, or with no
    rows, the score is the share of toxic rows, or 0.5."""
    y = np.array(labels, bool)
    if len(y) < 4 or y.all() or not y.any():
        share = float(np.clip(y.mean(), 0, 1)) if len(y) else 0.5
        return Model(b" ", b"", np.zeros(5), np.zeros(5), np.zeros(5), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    rows = [(_words_of(t), bool(v)) for t, v in zip(texts, labels, strict=True)]
    half = np.zeros(len(y), int)
    for v in (False, True):
        half[y == v] = np.arange(int((y == v).sum())) % 2
    x = np.zeros((len(y), 5))
    for k in (0, 1):
        ordinary, toxic = dictionaries([r for r, h in zip(rows, half.tolist(), strict=True) if h != k])
        seen = np.flatnonzero(half == k)
        for b in common.blocks([pa.RecordBatch.from_arrays([pa.array(seen), pa.array([texts[i] for i in seen])], names=["i", "text"])]):
            x[b.column(0).to_numpy()] = evidence(ordinary, toxic, *common.flat(b.column(1)))
    mean, scale = x.mean(axis=0), 1 / np.maximum(x.std(axis=0), 1e-6)
    weight, bias = _logistic((x - mean) * scale, y.astype(float))
    return Model(*dictionaries(rows), mean, scale, weight, bias)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Model:
    """Fits on labelled documents that aren't held out.

    docs: doc_id, text; labels: doc_id, toxic. Labels with a null id or class are left out; an id that is marked toxic
    once counts as toxic; of repeated documents each counts; a null text is empty. At most most_rows labelled ids of
    each class (those of the least hash) are looked up, and at most most_bytes of their texts come to the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~quality.held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("of")).agg((F.max("toxic") > 0).alias("label"))
    known = common.saved(known, "toxic-labels")
    chosen = None
    for v in (False, True):
        some = known.where(F.col("label") == v).orderBy(F.xxhash64("of"), "of").limit(most_rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = common.saved(chosen, "chosen-labels")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = common.saved(rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("doc_id", "text", "label"), "labelled-texts")
    texts: dict[bool, list] = {False: [], True: []}
    held = {False: 0, True: 0}
    for r in rows.withColumn("size", F.length("text")).where(F.col("size") <= most_bytes).toLocalIterator():
        if held[r.label] + r.size <= most_bytes:
            texts[r.label].append((r.doc_id, r.text))
            held[r.label] += r.size
    ordered = [(*x, v) for v in (False, True) for x in sorted(texts[v])]
    return fit([t for _, t, _ in ordered], [v for *_, v in ordered])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row; null texts count as empty, rows and null ids stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            yield common.record(schema, doc_id=b.column(0), score=held.value.score(*common.flat(b.column(1))))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            yield b.filter(pa.array(model.value.score(*common.flat(b.column(b.schema.get_field_index("text")))) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    scored = scores(docs, train(docs, common.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
