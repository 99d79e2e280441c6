"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within the radius agree on some choice of blocks of bits, so rows meet in buckets of equal masked
bits (a mask for each choice). In a bucket's sorted run of fingerprints, bit planes are stored vertically: one
bitset per bit. A run is compared with itself shifted by 1, 2, 3, ... places; carry-save counters over whole
planes keep the distances of 64 pairs per machine word, and blocks of words whose pairs all exceed the radius
are abandoned. Buckets with too many fingerprints are split by further masks on their free bits, which loses no
pair, until none is large: a bucket of few free bits can't be. Each task returns links to the least member of what it
found connected, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans
from .components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Distinct fingerprints in a bucket beyond which it is split.
HOT_BUCKET = 4096
#: Machine words (64 pairs each) of a block that is abandoned as a whole.
WORDS = 16


def _bit_counts(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Set bits by place (row of 64, lowest first) in each run h[first:first+count]; runs lie one after the other."""
    lanes = np.unpackbits(h.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)  # 8 counters of one byte in a word
    pieces = -(-count // 255)
    piece_first = np.repeat(first, pieces) + 255 * spans.gathered(np.zeros(len(count), np.int64), pieces)
    sums = np.add.reduceat(lanes, piece_first, axis=0).view(np.uint8).reshape(-1, 64)
    return np.add.reduceat(sums, np.cumsum(pieces) - pieces, axis=0, dtype=np.int64)


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text."""
    hashed, count = [], np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()
        n = len(words)
        if n <= shingle:
            parts = [b" ".join(words)] if n else []
        elif shingle == 3:
            parts = [b"%b %b %b" % w for w in zip(words, words[1:], words[2:], strict=False)]
        else:
            parts = [b" ".join(words[k : k + shingle]) for k in range(n - shingle + 1)]
        hashed += [digest(p, SEED) for p in parts]
        count[i] = len(parts)
    return majority(np.array(hashed, np.uint64), count)


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each run of count hashes the bits that are set in over half of them; none for an empty run."""
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        first = (np.cumsum(count) - count)[some]
        bits = 2 * _bit_counts(h, first, count[some]) > count[some][:, None]
        out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of each row of docs; null texts count as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            yield common.record(schema, doc_id=b.column(0), fp=fingerprints_of(common.texts(b.column(1)), shingle).view(np.int64))

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def split_masks(free: list[int], blocks: int, radius: int) -> list[int]:
    """Masks of all choices of blocks - radius blocks of the free bits: two values within the radius agree on one."""
    parts = [p.tolist() for p in np.array_split(np.array(free), blocks)]
    return [sum(1 << b for p in chosen for b in p) for chosen in combinations(parts, blocks - radius)]


def first_masks(n: int, radius: int) -> list[int]:
    """Masks for n fingerprints: more blocks, and so longer keys, for more of them; none loses a pair."""
    extra = 1
    while extra < 3 and n >> (64 * extra // (radius + extra)) > 64:
        extra += 1
    return split_masks(list(range(64)), radius + extra, radius)


def _shifted(plane: np.ndarray, by: int) -> np.ndarray:
    """Bit i of the result is bit i + by."""
    whole, part = divmod(by, 64)
    out = np.zeros_like(plane)
    moved = plane[..., whole:]
    out[..., : moved.shape[-1]] = moved >> np.uint64(part)
    if part and moved.shape[-1] > 1:
        out[..., : moved.shape[-1] - 1] |= moved[..., 1:] << np.uint64(64 - part)
    return out


def _packed(flags: np.ndarray) -> np.ndarray:
    """Flags (last axis) as 64-bit words, a whole number of blocks of them."""
    bits = np.packbits(flags, axis=-1, bitorder="little")
    short = -bits.shape[-1] % (8 * WORDS)
    return np.ascontiguousarray(np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, short)])).view(np.uint64)


def close_pairs(fp: np.ndarray, group: np.ndarray, radius: int, part: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with group[i] == group[j] and at most `radius` bits between fp[i] and fp[j]; with part, only
    those with part[i] != part[j].

    Equal groups lie together. Yields the pairs of one shift at a time.
    """
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.repeat(np.diff(np.append(edges, len(group))), np.diff(np.append(edges, len(group))))
    kept, planes, shift = np.arange(len(fp)), None, 1
    while True:
        if planes is None or shift & (shift - 1) == 0:  # leave out the groups that are too short for this shift
            kept = kept[size[kept] > shift]
            if not len(kept):
                return
            values, owner = fp[kept], group[kept]
            planes = _packed(np.stack([(values >> np.uint64(b)) & np.uint64(1) for b in range(64)]).astype(bool))
        same = np.zeros(len(kept), bool)
        if shift < len(kept):
            same[:-shift] = owner[shift:] == owner[:-shift]
        if not same.any():
            return
        if part is not None:
            same[:-shift] &= part[kept][shift:] != part[kept][:-shift]
        valid = _packed(same).reshape(-1, WORDS)
        live = np.flatnonzero(valid.any(axis=1))
        over = ~valid[live]
        # counters of just enough bits, begun so high that radius + 1 runs over
        width = max(1, radius.bit_length())
        begin = (1 << width) - 1 - radius
        planes_of = [np.full((len(live), WORDS), np.uint64(0xFFFFFFFFFFFFFFFF if begin >> k & 1 else 0)) for k in range(width)]
        moved = _shifted(planes, shift)
        blocks, others = planes.reshape(64, -1, WORDS), moved.reshape(64, -1, WORDS)
        for b in range(64):
            carry = blocks[b, live] ^ others[b, live]
            for k in range(width):
                grown = planes_of[k] & carry
                planes_of[k] ^= carry
                carry = grown
            over |= carry
            if b % 8 == 7:
                open_blocks = ~(over == np.uint64(0xFFFFFFFFFFFFFFFF)).all(axis=1)
                if not open_blocks.all():
                    live, over = live[open_blocks], over[open_blocks]
                    planes_of = [c[open_blocks] for c in planes_of]
                    if not len(live):
                        break
        if len(live):
            bits = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            row, col = np.nonzero(bits)
            i = live[row] * WORDS * 64 + col
            yield kept[i], kept[i + shift]
        shift += 1


class Forest:
    """Union-find over 0..n-1 with the least index as root, for arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                self.parent[x] = r
                return r
            r = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def bucket_links(rows: DataFrame, radius: int, partitions: int) -> DataFrame:
    """rows (mask, value, fp, node) to links (a, b) that connect what lies within the radius in a bucket."""

    def link(held: list[tuple]) -> pa.RecordBatch:
        mask, value, fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((node, value, mask))
        mask, value, fp, node = mask[order], value[order], fp[order], node[order]
        new = np.append(True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))
        forest = Forest(len(fp))
        for i, j in close_pairs(fp.view(np.uint64), np.cumsum(new), radius):
            forest.union(i, j)
        every = np.arange(len(fp))
        root = forest.roots(every)
        some = root != every
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            part = tuple(b.column(k).to_numpy() for k in range(4))
            if not len(part[0]):
                continue
            if size >= 500_000:
                # all but the last bucket are complete
                mask, value = part[0], part[1]
                last = held[-1]
                cut = np.flatnonzero((mask != last[0][-1]) | (value != last[1][-1]))
                if len(cut):
                    held.append(tuple(x[: cut[0]] for x in part))
                    yield link(held)
                    held, size, part = [], 0, tuple(x[cut[0] :] for x in part)
            held.append(part)
            size += len(part[0])
        if held:
            yield link(held)

    ordered = rows.select("mask", "value", "fp", "node").repartition(partitions, "mask", "value").sortWithinPartitions("mask", "value")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between nodes (fp distinct, node) so that all pairs within the radius (0 to 31) are connected."""
    if not 0 <= radius < 32:
        raise ValueError("a radius lies between 0 and 31 bits")
    spark = nodes.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    masks = first_masks(nodes.count(), radius)

    def masked(df: DataFrame, choices) -> DataFrame:
        return df.withColumn("mask", F.explode(choices)).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))

    rows = masked(nodes.select("fp", "node"), F.array(*[F.lit(_signed(m)) for m in masks]))
    links = None
    while True:
        hot = common.saved(rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HOT_BUCKET, 1 << radius)).select("mask", "value"), "hot-buckets")
        found = bucket_links(rows.join(hot, ["mask", "value"], "left_anti"), radius, partitions)
        links = found if links is None else links.unionByName(found)
        finer = {}
        for (m,) in hot.select("mask").distinct().toLocalIterator():  # as many as masks
            finer[m] = [_signed(m & ((1 << 64) - 1) | s) for s in split_masks([b for b in range(64) if not m >> b & 1], radius + 1, radius)]
        if not finer:
            return links
        table = F.broadcast(spark.createDataFrame(list(finer.items()), "mask long, finer array<long>"))
        split = rows.join(hot, ["mask", "value"], "left_semi").join(table, "mask").select("fp", "node", "finer")
        # rows of several hot buckets may meet again in one finer bucket
        rows = common.saved(masked(split, F.col("finer")).drop("finer").distinct(), "split-buckets")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Words are split at [\\x20\\x09-\\x0D] after A-Z are lower-cased; shingles of `shingle` words count with their
    repeats, a shorter text is one shingle, a text without words has fingerprint zero. component_id is the
    smallest doc_id that links of at most `radius` bits (0 to 31) reach. Rows with a null doc_id link like others but
    never stand for a component; a component of null doc_ids only has a null component_id. Rows repeat as they
    come; other columns are not read; an empty table gives no rows.
    """
    rows = common.saved(fingerprints(docs, shingle), "fingerprints")
    nodes = common.saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = components(near_links(nodes.select("fp", F.col("fp").alias("node")), radius))
    labelled = common.saved(nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "labelled")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    roots = common.saved(labelled.join(least, "component").select(F.col("fp").alias("of"), "component_id"), "roots")
    joined = rows.join(roots, rows["fp"] == roots["of"], "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id; rows with a null doc_id stay."""
    dropped = near_duplicates(docs, radius, shingle).where("doc_id <> component_id").select(F.col("doc_id").alias("dropped_id"))
    return docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))
