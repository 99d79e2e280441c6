"""Exact deduplication with counting quotient filters.

One pass over the texts gives each row's digests (a 64-bit fingerprint, SHA-256, code points). Each partition
builds counting quotient filters of its fingerprints, one per range of quotients: the quotient is implied by
the place, the remainder is stored, runs of equal remainders by a counter. Filters of one range merge without
loss, since all hold their remainders sorted. Fingerprints whose merged count is above one go to byte
verification: their normalised texts themselves are compared, group by group; all other rows are unique.

Shuffled are filters, digests of rows, and one normalised text per task and group; a group of copies is
summed up before it is shuffled, and the rows of a large group are dealt out by a join that Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters that don't count: [\x20\x09-\x0D].
BLANKS = b" \t\n\v\f\r"
#: Fingerprints per filter that are aimed at; bits of the Bloom filter at most (32 MB) and for each fingerprint.
FILTER_ROWS, BLOOM_BITS, BITS_A_KEY = 200_000, 1 << 28, 12


class QuotientFilter:
    """A counting quotient filter of 64-bit fingerprints that share their top `prefix_bits`.

    The next `quotient_bits` of a fingerprint are its quotient and say in which run it stands, the rest is the
    remainder that is stored. `occupied` has a bit for each quotient that has a run, `run_ends` a bit for the last slot
    of each run; runs stand in order of their quotients, without gaps, and hold their remainders sorted, each with a
    counter. A filter of more fingerprints has more quotient bits: bits move from remainders to quotients, nothing
    is lost.
    """

    def __init__(self, prefix_bits: int, quotient_bits: int, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.prefix_bits, self.quotient_bits, self.occupied, self.run_ends, self.remainders, self.counts = prefix_bits, quotient_bits, occupied, run_ends, remainders, counts

    @classmethod
    def of(cls, prefix_bits: int, fingerprints: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """From fingerprints in ascending order, each once, with counts."""
        quotient_bits = min(max(3, len(fingerprints).bit_length()), 64 - prefix_bits - 1)
        low = np.uint64(64 - prefix_bits - quotient_bits)
        quotient = ((fingerprints >> low) & np.uint64((1 << quotient_bits) - 1)).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotient] = True
        run_ends = np.append(quotient[1:] != quotient[:-1], True)[: len(quotient)]
        remainders = fingerprints & np.uint64((1 << int(low)) - 1)
        return cls(prefix_bits, quotient_bits, np.packbits(occupied, bitorder="little"), np.packbits(run_ends, bitorder="little"), remainders, counts.astype(np.uint64))

    def fingerprints(self, prefix: int) -> np.ndarray:
        """All fingerprints in ascending order: the k-th run belongs to the k-th occupied quotient."""
        n = len(self.remainders)
        quotients = np.flatnonzero(np.unpackbits(self.occupied, bitorder="little"))
        ends = np.unpackbits(self.run_ends, bitorder="little", count=n)
        run = np.cumsum(ends) - ends  # runs that ended before each slot
        low = np.uint64(64 - self.prefix_bits - self.quotient_bits)
        top = np.uint64((prefix << (64 - self.prefix_bits)) & ((1 << 64) - 1)) if self.prefix_bits else np.uint64(0)
        return top | (quotients[run].astype(np.uint64) << low) | self.remainders

    @staticmethod
    def merged(filters: list[QuotientFilter]) -> QuotientFilter:
        """All filters' fingerprints with their counts added: one merge of their sorted sequences."""
        every = np.concatenate([np.zeros(0, np.uint64), *[f.fingerprints(0) for f in filters]])
        counts = np.concatenate([np.zeros(0, np.uint64), *[f.counts for f in filters]])
        order = np.argsort(every, kind="stable")
        every, counts = every[order], counts[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        return QuotientFilter.of(filters[0].prefix_bits, every[first], np.add.reduceat(counts, first) if len(first) else counts)

    def dumps(self) -> bytes:
        head = np.array([self.prefix_bits, self.quotient_bits, len(self.remainders)], "<u8").tobytes()
        return head + self.remainders.astype("<u8").tobytes() + self.counts.astype("<u8").tobytes() + self.occupied.tobytes() + self.run_ends.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> QuotientFilter:
        prefix_bits, quotient_bits, n = np.frombuffer(data, "<u8", 3).tolist()
        at, width = 24 + 16 * n, (1 << quotient_bits) // 8
        occupied, run_ends = np.frombuffer(data, np.uint8, width, at), np.frombuffer(data, np.uint8, -1, at + width)
        return cls(prefix_bits, quotient_bits, occupied, run_ends, np.frombuffer(data, "<u8", n, 24), np.frombuffer(data, "<u8", n, 24 + 8 * n))


def row_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, sha (SHA-256 of the text without blanks), fp (its first 64 bits), of each row; null counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("sha", pa.binary()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = [hashlib.sha256(t.translate(None, BLANKS)).digest() for t in common.texts(b.column(1))]
            fp = np.frombuffer(b"".join(s[:8] for s in sha), ">i8").astype(np.int64)
            yield common.record(schema, doc_id=b.column(0), n_chars=b.column(2), sha=sha, fp=fp)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.withColumn("n_chars", F.length("text").cast("bigint")).mapInArrow(run, "doc_id bigint, n_chars bigint, sha binary, fp bigint")


def repeated_fingerprints(fps: DataFrame, n_rows: int) -> DataFrame:
    """Fingerprints (column fp) that occur more than once, by merged quotient filters; n_rows sizes the filters."""
    prefix_bits = max(0, int(n_rows // FILTER_ROWS).bit_length())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("prefix", pa.int64()), ("filter", pa.binary())])
        held, size = [], 0

        def filters():
            fp, count = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
            prefix = (fp >> np.uint64(64 - prefix_bits)).astype(np.int64) if prefix_bits else np.zeros(len(fp), np.int64)
            cuts = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
            for s, e in zip(cuts, np.append(cuts[1:], len(fp)), strict=True):
                yield common.record(schema, prefix=[int(prefix[s])], filter=[QuotientFilter.of(prefix_bits, fp[s:e], count[s:e]).dumps()])

        for b in batches:
            held.append(b.column(0).to_numpy())
            size += b.num_rows
            if size >= 2_000_000:  # bounds a task's memory; the filters of one task merge like any others
                yield from filters()
                held, size = [], 0
        if size:
            yield from filters()

    def merge(key, table):  # a range holds FILTER_ROWS fingerprints or so, and each task's count of it
        whole = QuotientFilter.merged([QuotientFilter.loads(data) for data in table.column("filter").to_pylist()])
        return pa.table({"fp": pa.array(whole.fingerprints(key[0].as_py())[whole.counts > 1].view(np.int64))})

    return fps.select("fp").mapInArrow(build, "prefix bigint, filter binary").groupBy("prefix").applyInArrow(merge, "fp bigint")


def verified_groups(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """sha of groups of two or more rows with equal normalised bytes, with the row that stays and the size.

    Texts travel as bytes: equal ones are summed up in each task first. Two texts of one SHA-256 stop the job.
    """
    suspects = _suspects(docs, repeated)
    order = F.struct((-F.col("n_chars")).alias("fewer"), F.col("doc_id").isNull().alias("last"), F.col("doc_id"))
    groups = suspects.groupBy("sha", "body").agg(F.sum("n").alias("group_size"), F.min(order).alias("best"))
    groups = groups.groupBy("sha").agg(F.count(F.lit(1)).alias("bodies"), F.sum("group_size").alias("group_size"), F.min("best").alias("best"))
    checked = F.when(F.col("bodies") > 1, F.raise_error(F.lit("two texts have one SHA-256")).cast("bigint")).otherwise(F.col("group_size"))
    return groups.select("sha", checked.alias("group_size"), F.col("best.doc_id").alias("keep_id")).where("group_size > 1")


def _suspects(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """sha, body, n, n_chars, doc_id: best row and count of each text in each task, for rows whose fingerprint repeats.

    A Bloom filter of bounded size lets the map drop most unique texts before the exact semi-join. Beyond some
    twenty million repeated fingerprints it passes more and more unique texts, which are then shuffled too; the
    result stays the same.
    """
    spark = docs.sparkSession
    seen = repeated.count()
    bits = 1 << min(BLOOM_BITS.bit_length() - 1, max(10, int(seen * BITS_A_KEY).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        for b in batches:
            for at in _bloom_bits(b.column(0).to_numpy(), bits):
                np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        some = np.flatnonzero(words)
        for i in range(0, len(some), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 65536]), pa.array(words[some[i : i + 65536]].view(np.int64))], names=["at", "word"])

    words = np.zeros(bits // 64, np.uint64)
    parts = repeated.coalesce(8).mapInArrow(mark, "at bigint, word bigint").groupBy((F.col("at") / 4096).cast("bigint").alias("page"))
    for row in parts.agg(F.collect_list("at").alias("at"), F.collect_list("word").alias("word")).toLocalIterator():  # pages of at most 8 * 4096 words
        np.bitwise_or.at(words, np.array(row["at"]), np.array(row["word"], np.int64).view(np.uint64))
    bloom = spark.sparkContext.broadcast(words)
    schema = pa.schema([("fp", pa.int64()), ("sha", pa.binary()), ("body", pa.binary()), ("n", pa.int64()), ("n_chars", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best: dict[bytes, list] = {}
            bodies = [t.translate(None, BLANKS) for t in common.texts(b.column(1))]
            for key, body, n_chars in zip(b.column(0).to_pylist(), bodies, b.column(2).to_pylist(), strict=True):
                row = best.get(body)
                if row is None:
                    best[body] = [1, n_chars, key]
                else:
                    row[0] += 1
                    if (n_chars, key is not None, -(key or 0)) > (row[1], row[2] is not None, -(row[2] or 0)):
                        row[1:] = n_chars, key
            sha = [hashlib.sha256(t).digest() for t in best]
            fp = np.frombuffer(b"".join(s[:8] for s in sha), ">i8").astype(np.int64)
            passed = np.ones(len(fp), bool)
            for at in _bloom_bits(fp, bits):
                passed &= (bloom.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            some = np.flatnonzero(passed).tolist()
            rows = list(best.items())
            yield common.record(schema, fp=fp[some], sha=[sha[i] for i in some], body=[rows[i][0] for i in some], n=[rows[i][1][0] for i in some], n_chars=[rows[i][1][1] for i in some], doc_id=[rows[i][1][2] for i in some])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = source.withColumn("n_chars", F.length("text").cast("bigint")).mapInArrow(run, "fp bigint, sha binary, body binary, n bigint, n_chars bigint, doc_id bigint")
    return found.join(repeated, "fp", "left_semi").drop("fp")


def _bloom_bits(fp: np.ndarray, bits: int) -> list[np.ndarray]:
    h = fp.view(np.uint64)
    return [((h * np.uint64(k)) >> np.uint64(65 - bits.bit_length())).astype(np.int64) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters [\\x20\\x09-\\x0D]; null counts as empty. The
    row with the most code points stays, then the one with the smallest doc_id; a null doc_id comes last, and
    a group of null ids only has a null keep_id, of which each row counts as kept. Repeated rows have one
    verdict: they share their doc_id. Other columns are not read. An empty table gives no rows.
    """
    rows = common.saved(row_digests(docs), "digests")
    repeated = common.saved(repeated_fingerprints(rows, rows.count()), "repeated")
    groups = common.saved(verified_groups(docs, repeated), "groups")
    joined = rows.join(groups, "sha", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_groups drops, and one of the rows that repeat a doc_id and a text without
    blanks, the one with the most code points; all columns stay."""
    groups = common.saved(exact_groups(docs), "exact-groups")
    body = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), BLANKS.decode(), "")
    key = [F.col("doc_id").cast("bigint"), F.sha2(body, 256)]
    dropped = groups.where("not kept").select("doc_id", "text_sha256").distinct()
    return common.without(docs, key, dropped, groups.select("doc_id", "text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.read(spark, sf_dir, "documents"))


#: The contract in DuckDB's SQL.
ORACLE_SQL = {
    "op4_exact_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
k AS (SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM k""",
}
