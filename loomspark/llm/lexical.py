"""Ranked lexical search over bags: equal bags are scored once.

A document is restricted to the vocabulary of the items and becomes a bag: the item terms that it holds, by number,
with how often it holds each. Beside the bag only m, which its length gives, enters a score, so rows of the same bag and
m make up a class. Tasks find the classes of their own rows first; then classes are shuffled by a hash of bag and m,
and rows of one hash that differ in a byte are told apart. Each class is scored once for all items, through the
postings of its terms, and stands for its members: no item can need more than its `top` least ids, since all
members score alike and equal scores go by ascending doc_id. A task keeps the best `top` rows of each item.

The text is read once a block of items (one block up to BLOCK_OF_ITEMS bytes of item text); bags are stored, and hold at most
8 bytes a distinct term.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, decontaminate, spans

TOP = 10
#: Bytes of item text whose vocabulary and postings are broadcast at once; at most half as many terms and postings.
BLOCK_OF_ITEMS = 2 << 20
#: Bytes of bags among which a task finds its own classes before it passes them on.
HELD_BYTES = 32 << 20
#: Products of a term and an item, or scores, that are held at once.
HELD_SCORES = 1 << 21


def bags(docs: DataFrame, items: decontaminate.TestSet) -> DataFrame:
    """doc_id, n (terms with repeats) and bag (pairs of an item term's number and its count, ascending) of rows with a term."""
    held = docs.sparkSession.sparkContext.broadcast(items)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("bag", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            words = decontaminate.Words(*common.flat(b.column(1)))
            names = held.value.names(words)
            n = np.bincount(words.text, minlength=b.num_rows)
            some = np.flatnonzero(names)
            key, tf = np.unique(words.text[some] << 32 | names[some], return_counts=True)
            at = np.searchsorted(key >> 32, np.arange(b.num_rows + 1)).astype(np.int32) * 8
            pairs = np.stack([key & 0xFFFFFFFF, tf], axis=1).astype("<i4")
            bag = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at), pa.py_buffer(pairs)])
            yield common.record(schema, doc_id=b.column(0), n=n, bag=bag).filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n bigint, bag binary")


def _counts(made: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, their terms with repeats, documents that hold each item term by number)."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 2, np.int64)
        for b in batches:
            total[: n_terms + 1] += np.bincount(common.flat(b.column(1))[0].view("<i4")[::2], minlength=n_terms + 1)
            total[0] += b.num_rows
            total[-1] += int(np.sum(b.column(0).to_numpy()))
        some = np.flatnonzero(total)
        yield common.record(schema, term=some, n=total[some])

    found = made.select("n", "bag").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # two rows more than terms
    total = np.zeros(n_terms + 2, np.int64)
    total[found["term"].to_numpy()] = found["n"].to_numpy()
    return int(total[0]), int(total[-1]), total[:-1]


def weights(n_docs: int, holding: np.ndarray) -> np.ndarray:
    """w of each term by number; entry 0 is no term."""
    return np.array([0] + [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holding[1:].tolist()], np.int64)


def classes(made: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """m, bag and members (the least ids, at most top of them, ascending, nulls last) of what each task has of a class.

    Rows of one class lie in one partition, one after the other.
    """
    schema = pa.schema([("m", pa.int64()), ("bag", pa.binary()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def flushed() -> pa.RecordBatch:
            members = [[None if x == math.inf else x for x in v] for v in held.values()]
            return common.record(schema, m=[k[0] for k in held], bag=[k[1] for k in held], members=members)

        for batch in batches:
            for b in common.blocks([batch], "bag"):
                for doc, n, bag in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if not bag:
                        continue  # holds no term of any item
                    m, order = 100 - 90 + (90 * n * n_docs) // n_terms, math.inf if doc is None else doc
                    members = held.get((m, bag))
                    if members is None:
                        held[m, bag] = [order]
                        size += len(bag) + 300
                    elif len(members) < top:
                        insort(members, order)
                    elif order < members[-1]:
                        insort(members, order)
                        members.pop()
                if size > HELD_BYTES:
                    yield flushed()
                    held.clear()
                    size = 0
        yield flushed()

    partial = made.mapInArrow(run, "m bigint, bag binary, members array<bigint>")
    return partial.withColumn("h", F.xxhash64("bag", "m")).repartition("h").sortWithinPartitions("h", "m", "bag").select("m", "bag", "members")


class Postings:
    """The items of each term and the terms' weights."""

    def __init__(self, items: decontaminate.TestSet, weight: np.ndarray):
        self.ids, self.weight = items.ids, weight
        pair = np.unique(items.base[items.place] << 32 | items.row)
        self.item = pair & 0xFFFFFFFF
        self.count = np.bincount(pair >> 32, minlength=len(weight))
        self.first = np.cumsum(self.count) - self.count
        #: No score is beyond this; a term adds w * 1000000 at most.
        self.most = int(np.bincount(self.item, weight[pair >> 32], minlength=1).max(initial=0)) * 1_000_000

    def scores(self, m: np.ndarray, bag: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(first class, scores of classes by items) for a few classes after each other."""
        data = np.frombuffer(b"".join(bag), "<i4").reshape(-1, 2).astype(np.int64)
        term, tf = data[:, 0], data[:, 1]
        owner = np.repeat(np.arange(len(bag)), np.array([len(x) // 8 for x in bag], np.int64))
        value = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        cost = np.cumsum(np.bincount(owner, self.count[term], minlength=len(bag)) + len(self.ids))
        begins = np.searchsorted(owner, np.arange(len(bag) + 1))
        low = 0
        while low < len(bag):
            high = max(low + 1, int(np.searchsorted(cost, (cost[low - 1] if low else 0) + HELD_SCORES, "right")))
            some = slice(int(begins[low]), int(begins[high]))
            count = self.count[term[some]]
            at = np.repeat((owner[some] - low) * len(self.ids), count) + self.item[spans.gathered(self.first[term[some]], count)]
            n = (high - low) * len(self.ids)
            if self.most < 1 << 53:  # doubles add exactly
                out = np.bincount(at, np.repeat(value[some], count), minlength=n).astype(np.int64)
            else:
                out = np.zeros(n, np.int64)
                np.add.at(out, at, np.repeat(value[some], count))
            yield low, out.reshape(high - low, -1)
            low = high


class Best:
    """The best rows of each item so far: highest score, then least doc_id, nulls last."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.ones(n_items, np.int64)  # a score that can still matter
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, scores: np.ndarray, members: list[list]) -> None:
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        size = np.array([len(x) for x in members])
        flat = [x for v in members for x in v]
        at = spans.gathered((np.cumsum(size) - size)[row], size[row])
        null = np.array([x is None for x in flat], bool)
        doc = np.array([x or 0 for x in flat], np.int64)
        item, score = np.repeat(item, size[row]), np.repeat(scores[row, item], size[row])
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        doc, null = np.concatenate([self.doc, doc[at]]), np.concatenate([self.null, null[at]])
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.top]
        self.item, self.score, self.doc, self.null = item[place < self.top], score[order], doc[order], null[order]
        full = np.bincount(self.item, minlength=len(self.least)) >= self.top
        last = np.searchsorted(self.item, np.flatnonzero(full), "right") - 1
        self.least[full] = self.score[last]


def _searched(found: DataFrame, postings: Postings, top: int) -> DataFrame:
    """item (number), item_id, doc_id and score of the best rows of each task."""
    held = found.sparkSession.sparkContext.broadcast(postings)
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, p = Best(len(held.value.ids), top), held.value
        waiting: list[tuple[int, bytes, list]] = []

        def score(rows: list[tuple]) -> None:
            for low, scores in p.scores(np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]):
                best.add(scores, [r[2] for r in rows[low : low + len(scores)]])

        for batch in batches:
            for b in common.blocks([batch], "bag"):
                for m, bag, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if waiting and waiting[-1][0] == m and waiting[-1][1] == bag:  # the same class, from another task
                        members = sorted(waiting.pop()[2] + members, key=lambda x: (x is None, x))[:top]
                    waiting.append((m, bag, members))
                score(waiting[:-1])  # the last class may go on
                waiting = waiting[-1:]
        if waiting:
            score(waiting)
        yield common.record(schema, item=best.item, item_id=[p.ids[i] for i in best.item.tolist()], doc_id=pa.array(best.doc, mask=best.null), score=best.score)

    return found.mapInArrow(run, "item bigint, item_id string, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the best `top` rows of docs for each row of items, scores above 0 only.

    docs: doc_id, text; items: item_id, text; further columns are not read. Null and empty texts have no terms and are
    found by nothing. Items with a null id are left out; an item without terms has no rows; a repeated item is
    answered once a row. Repeated documents count and rank each; a null doc_id comes after all others of its score.
    Empty tables give no rows.
    """
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    parts = []
    for block in decontaminate._test_blocks(items, 1, BLOCK_OF_ITEMS):
        n_terms = len(block.number)
        if not n_terms:
            continue
        made = common.saved(bags(docs, block), "bags")
        n_docs, n_all, holding = _counts(made, n_terms)
        postings = Postings(block, weights(n_docs, holding))
        parts.append(common.saved(_searched(classes(made, n_docs, n_all, top), postings, top), "best"))
    if not parts:
        return spark.createDataFrame([], "item_id string, rank int, doc_id bigint, score bigint").withColumn("item_id", F.col("item_id").cast(kind))
    ranked = None
    for p in parts:  # an item lies in one block
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        p = p.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
        ranked = p if ranked is None else ranked.unionByName(p)
    return ranked


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


#: The contract in DuckDB's SQL.
ORACLE_SQL = {
    "op11_lexical_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
s AS (SELECT count(*)::BIGINT AS big_n, sum(len(terms))::BIGINT AS big_l FROM d WHERE len(terms) > 0),
u AS (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM u WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, big_n),
p AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score FROM f JOIN w USING (term) JOIN i USING (term), s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
