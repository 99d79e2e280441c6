"""SimHash near-duplicates by shingle similarity: wide fingerprint radius, exact similarity of the shingle sets.

At a similarity of 0.8 fingerprints differ in some ten of 64 bits, and masks of agreeing blocks for such a radius
would leave keys of a few bits. So rows meet in other buckets: a row's sketch holds the least of 125 mixed hashes of its
shingles, in 25 bands of five, and rows that agree on a band share a bucket. First each row of a bucket is held against
the bucket's least row; rows that this connects need no more comparison among themselves. Then buckets of three rows or
more that still hold several components are compared bit-sliced (simhash.close_pairs: vertical planes, carry-save
counters, blocks abandoned), only across components and only in the first band that two rows share. What lies within
the radius is compared by its shingle sets in the same task, which returns links, not pairs: products of blocks of a
matrix of rows by the shingles that several rows share count what many pairs have in common. A bucket beyond TILE rows is
dealt out in chunks, and each two chunks meet in a task of their own: rows of a bucket are shuffled as often as it has
chunks.

A link is set only where the shingle sets themselves are similar enough, so no pair is linked by chance; a pair is
missed when no band agrees or its fingerprints lie beyond the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash, spans
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair shares no band in 1 - (1 - 0.8 ** 5) ** 25: 5 of 100,000 pairs.
BANDS, ROWS = 25, 5
#: Bits between fingerprints up to which shingle sets are compared, those of the first, surer pass, too: 9.7 bits are
#: expected at 0.8, with a deviation of 2.9.
RADIUS, SURE = 20, 8
#: Rows, and shingles, of a chunk of a bucket; cells of a matrix of the shingles that rows of a tile share.
TILE, TILE_SHINGLES, CELLS = 8192, 2_000_000, 1 << 24
#: Pairs of a bucket's least row that one task compares.
STAR = 256
#: Candidate pairs that are held at once.
PAIRS = 1 << 19
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_FLIPS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(text: bytes) -> list[bytes]:
    """Shingles of a text's words, lower-cased, with repeats; a shorter text is one shingle, one without words an empty one."""
    w = text.lower().split()
    return [b"%b %b %b %b %b" % s for s in zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)] or [b" ".join(w)]


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the shingles of all texts, how many each has)."""
    digest, out, count = xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        parts = [digest(s, simhash.SEED) for s in shingles(t)]
        out += parts
        count[i] = len(parts)
    return np.array(out, np.uint64), count


def sketches_of(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A row of BANDS * ROWS least hashes for each text."""
    low, first = h.astype(np.uint32), np.cumsum(count) - count
    out = np.empty((len(count), BANDS * ROWS), np.uint32)
    if len(count):
        for k in range(BANDS * ROWS):
            out[:, k] = np.minimum.reduceat((low ^ _FLIPS[k]) * _FACTORS[k], first)
    return out


def _buckets(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit name of each band of each sketch; the band's number is part of it."""
    name = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sketch), 1))
    for k in range(ROWS):
        name = (name ^ sketch[:, k::ROWS]) * np.uint64(0xBF58476D1CE4E5B9)
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


def sketches(rows: DataFrame) -> DataFrame:
    """rows (node, text) to node, buckets, fp (SimHash) and size (shingles)."""
    schema = pa.schema([("node", pa.int64()), ("buckets", pa.list_(pa.int64())), ("fp", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, most=1 << 20):
            h, count = hashed(common.texts(b.column(1)))
            names = pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1, dtype=np.int32) * BANDS), pa.array(_buckets(sketches_of(h, count)).ravel()))
            yield common.record(schema, node=b.column(0), buckets=names, fp=simhash.majority(h, count).view(np.int64), size=count)

    return rows.select("node", "text").mapInArrow(run, "node bigint, buckets array<bigint>, fp bigint, size bigint")


def similar(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The distinct pairs (a, b: nodes of rows) whose shingle sets have at least SIMILARITY of their union in common.

    The pairs of one a are dealt out in chunks of about STAR; a chunk meets a's set once, whatever it holds.
    """
    pairs = pairs.select("a", "b").distinct()
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("chunks"))
    needed = pairs.select(F.col("b").alias("node")).union(chunks.select(F.col("a").alias("node"))).distinct()
    sets = common.saved(shingle_sets(rows.select("node", "text").join(needed, "node", "left_semi").dropDuplicates(["node"])), "star-sets")
    heads = chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("node"), F.lit(0).alias("own"))
    others = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"), F.col("b").alias("node"), F.lit(1).alias("own"))
    met = heads.unionByName(others).join(sets, "node").select("a", "chunk", "own", "node", "shingles")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            for b in common.blocks([batch], "shingles"):
                left, right = [], []
                for a, own, node, shingles in zip(*[b.column(k).to_pylist() for k in (0, 2, 3, 4)], strict=True):
                    mine = np.frombuffer(shingles, np.uint64)
                    if not own:
                        head, held = a, mine
                        continue
                    if a != head:
                        raise ValueError("a chunk without its head")
                    both = np.count_nonzero(held[np.minimum(np.searchsorted(held, mine), len(held) - 1)] == mine)
                    if both >= SIMILARITY * (len(held) + len(mine) - both):
                        left.append(a)
                        right.append(node)
                yield common.record(schema, a=left, b=right)

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(partitions, "a", "chunk").sortWithinPartitions("a", "chunk", "own").mapInArrow(run, "a bigint, b bigint")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """rows (node, text) to node and shingles (the distinct 64-bit hashes, ascending, as bytes)."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            yield common.record(schema, node=b.column(0), shingles=[np.unique(hashed([t])[0]).tobytes() for t in common.texts(b.column(1))])

    return rows.select("node", "text").mapInArrow(run, "node bigint, shingles binary")


def tile_links(bucket: int, chunk, component, fp, names, sets: list[np.ndarray], one_chunk: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a tile whose shingle sets are similar enough, none within what the others connect.

    chunk, component, fp, names: chunk of the bucket, component so far, fingerprint and all bucket names of each row.
    """
    n = len(fp)
    band = int(np.flatnonzero(names[0] == bucket)[0])
    forest, (_, start) = simhash.Forest(n), np.unique(component, return_inverse=True)
    order = np.argsort(start, kind="stable")
    alike = order[1:][start[order[1:]] == start[order[:-1]]]
    forest.union(order[:-1][start[order[1:]] == start[order[:-1]]], alike)
    size = np.array([len(s) for s in sets])
    _, ids, n_of = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    at = np.cumsum(size) - size
    mark, found = np.zeros(len(n_of), bool), []
    shared = np.flatnonzero(n_of > 1)  # others count in no intersection
    matrix = None
    if n * len(shared) <= CELLS and n > 64:
        column = np.full(len(n_of), -1)
        column[shared] = np.arange(len(shared))
        matrix = np.zeros((n, len(shared)), np.float32)  # whole numbers below 2 ** 24 add exactly
        of = column[ids]
        matrix[np.repeat(np.arange(n), size)[of >= 0], of[of >= 0]] = 1

    def one_by_one(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Shingles in common of each pair; pairs of one i lie together."""
        out = np.zeros(len(i), np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, i[1:] != i[:-1])), len(i))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            one, others = int(i[s]), j[s:e]
            mine = ids[at[one] : at[one] + size[one]]
            mark[mine] = True
            out[s:e] = np.add.reduceat(mark[ids[spans.gathered(at[others], size[others])]], np.cumsum(size[others]) - size[others], dtype=np.int64)
            mark[mine] = False
        return out

    def in_common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = int(j.min()), int(j.max()) + 1
        first, last = int(i[0]), int(i[-1]) + 1
        if matrix is None or (last - first) * (high - low) > 64 * len(i):
            return one_by_one(i, j)
        return (matrix[first:last] @ matrix[low:high].T)[i - first, j - low].astype(np.int64)

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        apart = (forest.roots(i) != forest.roots(j)) & (np.minimum(size[i], size[j]) >= SIMILARITY * np.maximum(size[i], size[j]))
        i, j = i[apart], j[apart]
        if band:
            later = ~(names[i, :band] == names[j, :band]).any(axis=1)
            i, j = i[later], j[later]
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]
        for k in range(0, n, 256):  # what a few rows connect needs no comparison later on
            s, e = np.searchsorted(i, (k, k + 256))
            some = np.arange(s, e)
            some = some[forest.roots(i[some]) != forest.roots(j[some])]
            if not len(some):
                continue
            both = in_common(i[some], j[some])
            some = some[both >= SIMILARITY * (size[i[some]] + size[j[some]] - both)]
            while len(some):  # one link for each two components
                x, y = forest.roots(i[some]), forest.roots(j[some])
                _, one = np.unique(np.minimum(x, y) * n + np.maximum(x, y), return_index=True)
                found.extend(zip(i[some[one]].tolist(), j[some[one]].tolist(), strict=True))
                forest.union(i[some[one]], j[some[one]])
                some = some[forest.roots(i[some]) != forest.roots(j[some])]

    for radius in (SURE, RADIUS):
        held, many = [], 0
        group = np.zeros(n, np.int64)
        for i, j in simhash.close_pairs(fp, group, radius, forest.roots(np.arange(n))):
            if not one_chunk:
                mixed = chunk[i] != chunk[j]
                i, j = i[mixed], j[mixed]
            held.append((i, j))
            many += len(i)
            if many >= PAIRS:
                verify(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, many = [], 0
        if held:
            verify(*(np.concatenate(x) for x in zip(*held, strict=True)))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def across(members: DataFrame, partitions: int) -> DataFrame:
    """members (bucket, one, other: chunks that meet; chunk, node, component, fp, buckets, shingles) to links (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links_of(tile, rows: list[tuple]) -> pa.RecordBatch:
        chunk, node, component, fp, names, sets = zip(*rows, strict=True)
        node = np.array(node)
        i, j = tile_links(tile[0], np.array(chunk), np.array(component), np.array(fp).view(np.uint64), np.array(names, np.int64), [np.frombuffer(x, np.uint64) for x in sets], tile[1] == tile[2])
        return common.record(schema, a=np.minimum(node[i], node[j]), b=np.maximum(node[i], node[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for b in batches:
            for key, *row in zip(zip(*[b.column(k).to_pylist() for k in range(3)], strict=True), *[b.column(k).to_pylist() for k in range(3, 9)], strict=True):
                if key != tile:
                    if held:
                        yield links_of(tile, held)
                    tile, held = key, []
                held.append(tuple(row))
        if held:
            yield links_of(tile, held)

    ordered = members.select("bucket", "one", "other", "chunk", "node", "component", "fp", "buckets", "shingles").repartition(partitions, "bucket", "one", "other").sortWithinPartitions("bucket", "one", "other", "node")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def links(rows: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of rows (node, text) so that similar rows are connected."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = common.saved(sketches(rows), "sketches")
    named = made.select("node", "size", F.explode("buckets").alias("bucket"))
    shared = named.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select(F.col("bucket").alias("of"), "least")
    members = common.saved(named.join(shared, named["bucket"] == shared["of"]).select("bucket", "node", "size", "least"), "bucket-members")
    stars = members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    found = common.saved(similar(common.saved(stars, "bucket-stars"), rows), "similar")
    labels = components(found).withColumnRenamed("node", "labelled")
    members = members.join(labels, members["node"] == labels["labelled"], "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("component"))
    members = common.saved(members.distinct(), "labelled-members")
    mixed = members.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    mixed = mixed.where("x <> y and n > 2").select("bucket", F.ceil(F.greatest(F.col("n") / TILE, F.col("shingles") / TILE_SHINGLES)).cast("int").alias("chunks"))
    members = common.saved(members.drop("size").join(mixed, "bucket"), "mixed-members")
    needed = common.saved(members.select("node").distinct(), "mixed-nodes")
    sets = shingle_sets(rows.select("node", "text").join(needed, "node", "left_semi").dropDuplicates(["node"]))
    sets = sets.join(made.select("node", "fp", "buckets").join(needed, "node", "left_semi").dropDuplicates(["node"]), "node")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    met = members.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("met"))
    met = met.select("bucket", F.least("chunk", "met").alias("one"), F.greatest("chunk", "met").alias("other"), "chunk", "node", "component")
    return found.unionByName(common.saved(across(met.join(common.saved(sets, "shingle-sets"), "node"), partitions), "links-across"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of similar texts: the one with the smallest doc_id, null ids last.

    Texts are similar when their sets of five-word shingles share 0.8 of their union. Of fully repeated rows one
    stays; a doc_id with several texts is judged text by text. All columns stay.
    """
    key = F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(key.alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.select(key.alias("node"), F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("node")).alias("order"))
    labels = common.saved(components(links(rows)), "near-components")  # without the least nodes themselves
    labels = labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
    ranked = labels.join(ids, "node")
    best = ranked.groupBy("component").agg(F.min("order").alias("best"))
    dropped = ranked.join(best, "component").where(F.col("node") != F.col("best.node")).select(F.col("node").alias("gone")).distinct()
    return common.without(docs, [key], dropped)
