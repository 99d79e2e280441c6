"""Chunking for SQL: SELECT c.* FROM docs, LATERAL chunk(text, 'recursive-512-64') c."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import chunking
from . import ids


def _fixed(text: str, size: int, overlap: int):
    marks = chunking.Marks(text)
    n, step = len(marks.ends), size - overlap
    for first in range(0, max(n - overlap, 1) if n else 0, step):
        yield marks.segment(first, min(first + size, n), "a token window")


class Chunk:
    """position, content, start_offset, end_offset and note of each chunk of one text."""

    def eval(self, text: str, variant: str):
        strategy, size, overlap = ids.parse_variant(variant)
        cut = {"fixed": _fixed, "boundary": chunking.boundary_segments, "recursive": chunking.recursive_segments}.get(strategy)
        if cut is None:
            raise ValueError(f"{strategy} chunks need a document's sections: use chunk_all")
        for i, (content, start, end, note) in enumerate(cut(text or "", size, overlap)):
            yield i, content, start, end, note


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk", udtf(Chunk, returnType="position int, content string, start_offset int, end_offset int, note string"))
