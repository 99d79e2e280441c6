"""Binary token files of directly addressable codes.

An id is cut into 8-bit chunks. Level k holds the k-th chunk of every id that has one, in order, and a bitmap
that says which of them continue on level k + 1; a rank directory counts the set bits before each 512-bit
block. Id i is found by one read per level and a rank between levels: no block is decoded, and a file is read
at random by byte ranges alone.

File: magic, version, number of levels, ids and documents; per level the number of chunks and the places of
chunks, bitmap and directory; then those arrays; then the document directory (doc_id, null flag, first id).
All integers are little-endian. Documents stand in ascending doc_id order within and across files (null first,
then by text).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

MAGIC = b"DACTOK01"
#: Bits of a bitmap between two entries of its rank directory.
RANK_BITS = 512
#: Ids after which a task begins a new file.
FILE_IDS = 4_000_000
_HEAD = struct.Struct("<8sIIQQ")
_LEVEL = struct.Struct("<QQQQ")


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, starts: np.ndarray) -> bytes:
    """One file of ids (uint32), its documents and the first id of each."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(8)
        continues = more > 0
        bits = np.packbits(continues, bitorder="little")
        bits = np.append(bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8))
        counts = np.bitwise_count(bits.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.uint64)
        levels.append((len(rest), (rest & np.uint32(255)).astype(np.uint8).tobytes(), bits.tobytes(), (np.cumsum(counts) - counts).astype("<u8").tobytes()))
        rest = more[continues]
        if not len(rest):
            break
    at = _HEAD.size + _LEVEL.size * len(levels)
    head, body = [_HEAD.pack(MAGIC, 1, len(levels), len(ids), len(doc_ids))], []
    for n, chunks, bits, ranks in levels:
        head.append(_LEVEL.pack(n, at, at + len(chunks), at + len(chunks) + len(bits)))
        at += len(chunks) + len(bits) + len(ranks)
        body += [chunks, bits, ranks]
    return b"".join([*head, *body, doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes()])


class TokenFile:
    """Random access to one file through read(offset, size)."""

    def __init__(self, read, size: int):
        self.read = read
        magic, version, levels, self.n_ids, self.n_docs = _HEAD.unpack(read(0, _HEAD.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file of version 1")
        raw = read(_HEAD.size, _LEVEL.size * levels)
        self.levels = [_LEVEL.unpack_from(raw, _LEVEL.size * i) for i in range(levels)]
        self.docs_at = size - 17 * self.n_docs

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc_id, null flag, first id) of each document."""
        raw, n = self.read(self.docs_at, 17 * self.n_docs), self.n_docs
        return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n) > 0, np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i on a level."""
        _, _, bits_at, ranks_at = self.levels[level]
        block = i // RANK_BITS
        (before,) = struct.unpack("<Q", self.read(ranks_at + 8 * block, 8))
        part = self.read(bits_at + block * RANK_BITS // 8, (i % RANK_BITS + 7) // 8)
        return before + int(np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little", count=i % RANK_BITS).sum()) if part else before

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def slice(self, first: int, last: int) -> np.ndarray:
        """ids first..last-1: on each level one range of chunks and one of bits."""
        out = np.zeros(last - first, np.uint32)
        where, shift = np.arange(last - first), 0
        for level, (n, chunks_at, bits_at, ranks_at) in enumerate(self.levels):
            count = last - first
            out[where] |= np.frombuffer(self.read(chunks_at + first, count), np.uint8).astype(np.uint32) << np.uint32(shift)
            part = np.frombuffer(self.read(bits_at + first // 8, (last + 7) // 8 - first // 8), np.uint8)
            on = np.unpackbits(part, bitorder="little")[first % 8 : first % 8 + count].astype(bool)
            where, shift = where[on], shift + 8
            if not len(where):
                break
            first = self._rank(level, first)
            last = first + len(where)
        return out


def open_file(uri: str, size: int) -> TokenFile:
    """Opens a file of the shared folder; only the ranges asked for are read."""
    fs, path = common.filesystem(uri)
    handle = fs.open_input_file(path)
    return TokenFile(lambda at, n: handle.read_at(n, at), size)


_MANIFEST = "part int, file_no int, uri string, bytes bigint, n_docs bigint, n_ids bigint"


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = 2, partitions: int | None = None) -> DataFrame:
    """Writes the ids of docs (doc_id, text) to folder and returns the manifest, one row per file.

    Rows go out in ascending doc_id order (null doc_ids first, equal ones by text), so file order and place in
    the file give a document's place in the corpus. Null and empty texts have only the end id. Other columns
    are not read. Repeated rows are written each. No rows: no files, an empty manifest. A task that is run
    again writes files of other names; only those of the attempt that the manifest names count. partitions: writing
    tasks, 1 at least.
    """
    if partitions is not None and partitions < 1:
        raise ValueError("a corpus is written by one task at least")
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    schema = pa.schema([("part", pa.int32()), ("file_no", pa.int32()), ("uri", pa.string()), ("bytes", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, file_no = encoder(vocabulary), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush():
            nonlocal file_no, held
            ids = np.concatenate([h[0] for h in held])
            lengths = np.concatenate([h[1] for h in held])
            data = encode_file(ids, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), np.cumsum(lengths) - lengths)
            uri = f"{folder}/part-{part:06d}-{file_no:04d}-{uuid.uuid4().hex}.dac"
            fs, path = common.filesystem(uri)
            with fs.open_output_stream(path, compression=None) as out:
                out.write(data)
            row = common.record(schema, part=[part], file_no=[file_no], uri=[uri], bytes=[len(data)], n_docs=[len(lengths)], n_ids=[len(ids)])
            file_no, held = file_no + 1, []
            return row

        for b in common.blocks(batches):
            ids, at = enc.encode(*common.flat(b.column(1)))
            if end_id is not None:
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
            key = b.column(0)
            nulls = np.asarray(key.is_null().to_numpy(zero_copy_only=False), bool)
            held.append((ids, np.diff(at), key.fill_null(0).to_numpy(), nulls))
            if sum(len(h[0]) for h in held) >= FILE_IDS:
                yield flush()
        if held:
            yield flush()

    fs, path = common.filesystem(folder)
    fs.create_dir(path, recursive=True)
    return ordered.mapInArrow(run, _MANIFEST)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest must be a stored table (it is read twice). Each file is read document by document through
    its directory; only one row per task that wrote meets in the running sum.
    """
    from pyspark.sql import Window

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    earlier = Window.unboundedPreceding, -1
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("file_no").rowsBetween(*earlier)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("total"))  # one row per task that wrote
    parts = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("parts_before"))
    files = manifest.withColumn("inside", inside).join(parts, F.col("part") == F.col("of")).withColumn("before", F.col("parts_before") + F.col("inside"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                f = open_file(row["uri"], row["bytes"])
                keys, nulls, first = f.documents()
                ends = np.append(first[1:], f.n_ids)
                i = 0
                while i < len(keys):  # runs of documents of about a million ids
                    j = max(i + 1, int(np.searchsorted(ends, first[i] + 1_000_000, "right")))
                    ids = f.slice(int(first[i]), int(ends[j - 1])).astype("<u4").tobytes()
                    at = (4 * (np.append(first[i:j], ends[j - 1]) - first[i])).tolist()
                    crc = [zlib.crc32(ids[s:e]) for s, e in zip(at, at[1:], strict=False)]
                    yield common.record(schema, doc_id=pa.array(keys[i:j], pa.int64(), mask=nulls[i:j]), start=first[i:j] + row["before"], n_tokens=ends[i:j] - first[i:j], ids_crc32=crc)
                    i = j

    return files.select("uri", "bytes", "before").repartition(n, "uri").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), common.fresh(spark, "token-files"))
    return read_token_files(common.saved(manifest, "token-manifest"))
