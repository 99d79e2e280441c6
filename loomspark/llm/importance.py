"""Importance resampling towards a target distribution, by hashed word n-grams.

A table of 256 bytes lower-cases a UTF-8 text and blanks its separators, so that bytes.split yields the words. The checksum
of an n-gram goes on from that of the n-gram without its last word (zlib.crc32 takes the old value as its seed), and
its remainder is the bucket. Tasks count checksums with Counters and reduce them to buckets; the sums over all documents
and over all target texts give each bucket's gain, the logarithm of how much denser the target is there. A document's
weight is the mean gain of its features. Weights with Gumbel noise, drawn from the doc_id, are ranked, and the first
ranks are a sample without replacement.

Documents are read twice, for the counts and for the weights, and only rows of a few numbers are shuffled: candidates at
or above the score that the histogram of all scores gives are dealt out by ranges of scores and ids.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKETS, GRAMS = 10_000, 2
#: Words that a drawn document has at least; documents drawn of a hundred of those; what the noise is derived from.
LEAST_WORDS, SHARE, SEED = 20, 25, 7
#: Bytes of a text whose words are held at once.
PART_BYTES = 1 << 20

#: A-Z to a-z; 00-2F, 3A-60 and 7B-7F, after that, to a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size."""
    clean, low = text.translate(TABLE), 0
    while low < len(clean):
        high = clean.find(b" ", low + PART_BYTES)
        high = len(clean) if high < 0 else high
        yield clean[low:high].split()
        low = high


def checksums(text: bytes, grams: int = GRAMS) -> Iterator[tuple[int, list[list[int]]]]:
    """(words, checksums of the n-grams of one word, of two, ...) for one part of a text after the other; an n-gram
    over the edge of a part belongs to the later one."""
    crc32, kept = zlib.crc32, []
    for part in words(text):
        old, w = len(kept), kept + part
        sums, seeds = [], list(map(crc32, w))
        for k in range(1, grams + 1):
            sums.append(seeds[max(0, old - k + 1) :])
            seeds = list(map(crc32, w[k:], map(crc32, repeat(b" "), seeds)))
        yield len(part), sums
        kept = w[len(w) - min(len(w), grams - 1) :]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS) -> np.ndarray:
    """Features of all rows of texts (text) by bucket."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in common.blocks(batches):
            seen: Counter[int] = Counter()
            for text in common.texts(b.column(0)):
                for _, sums in checksums(text, grams):
                    for s in sums:
                        seen.update(s)
            at = np.fromiter(seen.keys(), np.int64, len(seen)) % buckets
            np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))
        some = np.flatnonzero(total)
        yield common.record(schema, bucket=some, n=total[some])

    out = np.zeros(buckets, np.int64)
    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket at most
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of (target density / source density)) of each bucket, with one feature more in each."""
    n, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """floor(1000 * Gumbel noise) of an id; a null id has the noise of an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    schema = pa.schema([(k, pa.int64()) for k in ("doc_id", "n_words", "n_features", "weight", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, buckets = held.value, len(held.value)
        for b in common.blocks(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), common.texts(b.column(1)), strict=True):
                n_words = n = total = 0
                for count, sums in checksums(text, grams):
                    n_words += count
                    at = np.array([x for s in sums for x in s], np.int64)
                    n += len(at)
                    total += int(gain[at % buckets].sum())
                weight = total // n if n else 0
                rows.append((doc, n_words, n, weight, weight + noise(doc, seed)))
            yield common.record(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, ", ".join(f"{k} bigint" for k in schema.names))


def ranked(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (doc_id, n_words, score, more) with rank: 1, 2, 3... of the drawn ones by falling score and rising doc_id, else null."""
    rows = common.saved(rows.withColumn("row", F.monotonically_increasing_id()), "scored")  # tells repeated rows apart; stored, so it stays
    fits = F.col("n_words") >= least_words
    # Scores are whole numbers of some ten thousands at most, so there are some ten thousands of them, however many rows.
    steps = rows.where(fits).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow()
    score, count = steps["score"].to_numpy(), steps["n"].to_numpy()
    order = np.argsort(-score)
    drawn = share * int(count.sum()) // 100
    if not drawn:
        return rows.select(*[c for c in rows.columns if c != "row"], F.lit(None).cast("bigint").alias("rank"))
    least = int(score[order][np.searchsorted(np.cumsum(count[order]), drawn)])
    chosen = fits & (F.col("score") >= least)
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.where(chosen).repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    sorted_rows = common.saved(sorted_rows, "candidates")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted_rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = sizes.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    placed = sorted_rows.withColumn("part", part).join(F.broadcast(before), F.col("part") == F.col("of")).withColumn("rank", F.col("before") + inside + 1)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~chosen).withColumn("rank", F.lit(None).cast("bigint"))
    names = [c for c in rows.columns if c != "row"] + ["rank"]
    return placed.select(*names).unionByName(rest.select(*names))


def weighed(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_features, weight, score and rank (null where it isn't drawn).

    docs: doc_id, text; target: text; further columns are not read. Null and empty texts have no features, weight 0
    and no rank. Repeated rows count, score and rank each; rows with equal scores rank by doc_id, nulls last. Without
    target texts the weights say how rare a document's features are. An empty table gives no rows.
    """
    gain = gains(bucket_counts(docs, buckets, grams), bucket_counts(target, buckets, grams))
    return ranked(scored(docs, gain, grams, seed), share, least_words)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, all columns; rows that share a doc_id are drawn together if one of them is."""
    drawn = weighed(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    drawn = common.saved(drawn, "drawn")
    return docs.join(drawn, docs["doc_id"].cast("bigint").eqNullSafe(drawn["drawn_id"]), "left_semi")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weighed(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
