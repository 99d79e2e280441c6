"""Shared pieces of the training-data operators: tables, the shared folder, Arrow text blocks."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step handles at once inside a task; bounds a task's scratch memory.
BLOCK_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all machines of a cluster share.

    Only where that setting is absent and all runs on one machine is a local folder made and set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI in the shared folder; works from the driver and from tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n + 1 offsets) of a string or binary array; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Gives memory that this worker has freed back to the system: workers live on from one stage to the next."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `most` bytes of text each; a longer text comes alone and whole."""
    for batch in batches:
        n, first = batch.num_rows, 0
        if not n:
            continue
        upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), dtype=np.int64))
        while first < n:
            before = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, before + most, "right")))
            yield batch.slice(first, last - first)
            first = last
        release()


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)


def without(docs: DataFrame, key: list[Column], dropped: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose key is in dropped (its columns in the key's order; nulls are equal), and one of the
    rows that share a key: the longest text, then the least of all columns. All columns stay. keys has the keys of
    all rows where they are known."""
    own = uuid.uuid4().hex  # names that no column of docs has
    held, row, shorter = [f"key{i}_{own}" for i in range(len(key))], f"row_{own}", f"shorter_{own}"
    keyed = docs.select("*", *[k.alias(h) for k, h in zip(key, held, strict=True)])
    keys = keyed.select(*held) if keys is None else keys.toDF(*held)
    repeated = saved(keys.groupBy(*held).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated-rows")
    dropped = saved(dropped, "dropped-rows")

    def joined(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        other = other.toDF(*[f"{h}_of" for h in held]).hint("merge")  # one plan for any size: disk stays in proportion
        return rows.join(other, functools.reduce(lambda a, b: a & b, [rows[h].eqNullSafe(other[f"{h}_of"]) for h in held]), how)

    stay = joined(keyed, dropped, "left_anti")
    if repeated.isEmpty():
        return stay.drop(*held)
    first = F.struct((-F.coalesce(F.length("text"), F.lit(0))).alias(shorter), *docs.columns)
    once = joined(stay, repeated, "left_semi").groupBy(*held).agg(F.min(first).alias(row))
    return joined(stay, repeated, "left_anti").drop(*held).unionByName(once.select(f"{row}.*").drop(shorter))
