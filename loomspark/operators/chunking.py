"""Cutting documents into chunks. Input: source_key, text; output: one row per chunk.

The fixed strategy is all columns. Boundary and recursive cuts depend on what was emitted before, so they run inside
Arrow batches, in blocks of documents, as searches in the sorted offsets of their words and breaks; chunks are
numbered there. Structural cuts use the sections of sections.py. Nothing is shuffled.
"""

from __future__ import annotations

import functools
import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, locate, text
from .governance import bound, with_sums_before

CHUNK_COLUMNS = ("source_key", "document_id", "chunk_index", "chunk_total", "vector_id", "content", "token_count", "overlap", "start_offset", "end_offset", "note")


def numbered(segments: DataFrame, overlaps: list[int]) -> DataFrame:
    """Chunk columns of segments that the map has numbered; overlaps: of each plan. No shuffle."""
    shared = F.array(*map(F.lit, overlaps))[F.col("plan")]
    out = segments.withColumnRenamed("position", "chunk_index").withColumnRenamed("total", "chunk_total").withColumn("document_id", ids.document_id("source_key"))
    out = out.withColumn("vector_id", ids.vector_id("document_id", "chunk_index")).withColumn("token_count", F.size(text.tokens("content")))
    return out.withColumn("overlap", F.when(F.col("chunk_index") == 0, 0).otherwise(shared)).select("plan", *CHUNK_COLUMNS)


def count_tokens(docs: DataFrame) -> DataFrame:
    """docs with n_tokens; nulls have none."""
    return docs.withColumn("n_tokens", F.coalesce(F.size(text.tokens("text")), F.lit(0)))


def truncate_tokens(docs: DataFrame, n: int) -> DataFrame:
    """docs with their text cut after n tokens."""
    return docs.withColumn("text", F.array_join(F.slice(text.tokens("text"), 1, n), ""))


def fixed_windows(docs: DataFrame, size: int, overlap: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Equal token windows: position, content, its offsets in the stripped text, and the window count; no shuffle. keep: further
    columns of docs. Windows are made inside their document's row, so none carries the document's tokens, and end by running
    sums of the tokens' lengths: the work is the text's length times size / (size - overlap)."""
    step = size - overlap
    length = lambda tokens: F.aggregate(tokens, F.lit(0), lambda a, x: a + F.length(x))

    def cut(t: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(t) - size) / F.lit(step)).cast("int"))
        every = F.when(F.size(t) > 0, F.sequence(F.lit(0), last))

        def placed(before) -> Column:
            def one(w: Column) -> Column:
                def filled(tokens: Column) -> Column:
                    # a window ends with its last token, so white space is in front of it only
                    return F.struct(w.alias("position"), F.ltrim(F.array_join(tokens, ""), F.lit(text.BLANK)).alias("content"), (before(w) + length(tokens)).alias("end_offset"), (last + 1).alias("windows"), F.size(tokens).alias("token_count"))

                return bound(F.slice(t, w * step + 1, size), filled)

            return F.transform(every, one)

        return bound(F.transform(every, lambda w: length(F.slice(t, w * step + 1, step))), lambda steps: with_sums_before(steps, placed))

    # an outer explode: for a plain one the optimizer adds a filter that cuts all windows again
    rows = docs.select("source_key", *keep, F.explode_outer(bound(text.tokens(text.strip("text")), cut)).alias("w")).where("w is not null")
    return rows.select("source_key", *keep, "w.position", "w.content", (F.col("w.end_offset") - F.length("w.content")).alias("start_offset"), "w.end_offset", "w.windows", "w.token_count")


def chunk_fixed(docs: DataFrame, size: int, overlap: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunk columns, and those of docs that are named in keep."""
    ids.parse_variant(ids.variant_id("fixed", size, overlap))
    # a window of tokens is never blank, so positions are indices and no window function is needed
    w = fixed_windows(docs, size, overlap, keep).withColumn("document_id", ids.document_id("source_key"))
    w = w.withColumn("chunk_index", F.col("position").cast("int")).withColumn("chunk_total", F.col("windows").cast("int"))
    w = w.withColumn("vector_id", ids.vector_id("document_id", "chunk_index")).withColumn("overlap", F.when(F.col("position") == 0, 0).otherwise(overlap))
    w = w.withColumn("note", F.when(F.col("position") == F.col("windows") - 1, "the document's tail, taken whole").otherwise("a token window"))
    return w.select(*CHUNK_COLUMNS, *keep)


Segment = tuple[str, int, int, str]
#: Where a window may be trimmed, best first, and what such a cut is called.
_BREAKS = ((re.compile(r"\n\s*\n"), "cut at a blank line"), (re.compile(r"(?<=[.!?])\s"), "cut at a sentence end"))
#: Separators from coarse to fine, and what a cut at each is called.
_LEVELS = (("\n\n", "a blank line"), ("\n", "a line end"), (". ", "a sentence end"), (" ", "a word break"))
#: What other cuts are called.
_WHOLE, _TAIL, _LIMIT, _NO_BREAK = "the whole document fits in one chunk", "the document's tail, taken whole", "the token limit", "no break in reach — cut at the token limit"
#: White space by code; all from the last entry on are ink.
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
#: What parts the texts of a block: white space that is none of the separators above.
_END = "\r"
#: Bytes of text that are cut together, whole documents.
BLOCK = 1 << 20


class Marks:
    """Stripped texts one after another, where each starts, and where the words lie: the first and, after the last, the end character of each, ascending."""

    def __init__(self, *texts: str):
        stripped = [t.strip() for t in texts]
        self.text = _END.join(stripped)
        self.starts = np.cumsum([0, *(len(t) + 1 for t in stripped)])[:-1]
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ink = np.concatenate([[False], ~_SPACE[np.minimum(codes, len(_SPACE) - 1)], [False]])
        turns = np.flatnonzero(ink[1:] != ink[:-1])
        self.heads, self.ends = turns[::2], turns[1::2]

    def upto(self, at) -> np.ndarray:
        """Words that end at or before each offset."""
        return np.searchsorted(self.ends, at, "right")

    def within(self, start: int, end: int) -> int:
        """Words of which some character lies in start..end."""
        return int(np.searchsorted(self.heads, end, "left") - np.searchsorted(self.ends, start, "right"))

    def segment(self, first: int, last: int, note: str, origin: int = 0) -> Segment:
        """Words first..last-1 with what lies between them; offsets from the origin."""
        start, end = int(self.heads[first]), int(self.ends[last - 1])
        return self.text[start:end], start - origin, end - origin, note


def boundary_cuts(marks: Marks, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(first word, last word + 1, note) of windows that end at the last blank line, else sentence end, of their final quarter."""
    n = len(marks.ends)
    breaks = [(np.array([m.end() for m in p.finditer(marks.text)], np.int64), said) for p, said in _BREAKS]
    first = 0
    while first + size < n:
        begin, limit = int(marks.ends[first - 1]) if first else 0, int(marks.ends[first + size - 1])
        least = max(begin + int((limit - begin) * 0.75), begin + 2 if first else 0)
        # the greatest break up to the limit, of the first kind that has one late enough
        reach = [(int(at[k - 1]), said) for at, said in breaks if (k := int(np.searchsorted(at, limit, "right"))) and at[k - 1] >= least]
        last, said = (int(marks.upto(reach[0][0])), reach[0][1]) if reach else (first + size, _NO_BREAK)
        if last > first:
            yield first, last, said
        first += max(1, (last - first or size) - overlap)
    if first < n:
        yield first, n, _TAIL if first else _WHOLE


def boundary_segments(text: str, size: int, overlap: int) -> Iterator[Segment]:
    marks = Marks(text)
    for cut in boundary_cuts(marks, size, overlap):
        yield marks.segment(*cut)


def recursive_pieces(marks: Marks, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets between pieces, level of the cut that made each piece): level by level, the pieces that are too large are
    cut at all separators in them, and what no separator helps is cut every `size` words. All texts are cut together."""
    edges = np.unique(np.append(marks.starts, len(marks.text)))
    levels = np.full(len(edges) - 1, len(_LEVELS))

    def refined(cuts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        piece = np.searchsorted(edges, cuts, "left") - 1  # the piece that a cut falls in, or ends
        large = np.diff(marks.upto(edges)) > size
        inside = large[piece] & (edges[piece + 1] != cuts)
        cut = np.zeros(len(large), bool)
        cut[piece[inside]] = True
        every = np.sort(np.concatenate([edges, cuts[inside]]))
        parent = np.searchsorted(edges, every[:-1], "right") - 1
        return every, np.where(cut[parent], level, levels[parent])

    for level, (separator, _) in enumerate(_LEVELS):
        if (np.diff(marks.upto(edges)) > size).any():
            edges, levels = refined(np.array([m.end() for m in re.finditer(re.escape(separator), marks.text)], np.int64), level)
    counts = marks.upto(edges)
    large = np.flatnonzero(np.diff(counts) > size)
    if len(large):
        every = [marks.ends[k + size - 1 : last - 1 : size] for k, last in zip(counts[large], counts[large + 1], strict=True)]
        edges, levels = refined(np.concatenate(every), len(_LEVELS))
    return edges, levels


def recursive_cuts(marks: Marks, size: int, overlap: int) -> Iterator[list[tuple[int, int, str]]]:
    """(first word, last word + 1, note) of each text's chunks: pieces packed up to the size by running sums of words; the
    next chunk goes back over whole pieces within the overlap."""
    edges, levels = recursive_pieces(marks, size)
    said = [f"cut at {name}" for name in (*(name for _, name in _LEVELS), _LIMIT)]
    upto, levels = marks.upto(edges).tolist(), levels.tolist()
    for first, end in itertools.pairwise(np.searchsorted(edges, np.append(marks.starts, len(marks.text))).tolist()):
        cuts = []
        while first < end:
            last = max(first + 1, bisect_right(upto, upto[first] + size, first, end + 1) - 1)
            if upto[last] > upto[first]:
                cuts.append((upto[first], upto[last], said[levels[last - 1]]))
            if last == end:
                break
            first = min(last, max(first + 1, bisect_left(upto, upto[last] - overlap, first, end + 1)))
        yield cuts


def recursive_blocks(texts: list[str], size: int, overlap: int) -> Iterator[list[Segment]]:
    """The segments of each text of a block."""
    marks = Marks(*texts)
    for origin, cuts in zip(marks.starts.tolist(), recursive_cuts(marks, size, overlap), strict=True):
        yield [marks.segment(*cut, origin) for cut in cuts]


def recursive_segments(text: str, size: int, overlap: int) -> Iterator[Segment]:
    return iter(next(recursive_blocks([text], size, overlap)))


def merged_sections(tokens_from: np.ndarray, tokens_to: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, last + 1) section of each group: sections join forward until they hold `least` tokens, a short tail backward."""
    groups, first = [], 0
    while first < len(tokens_to):
        enough = np.flatnonzero(tokens_to[first:] - tokens_from[first] >= least)
        if not len(enough):
            return [*groups[:-1], (groups[-1][0] if groups else first, len(tokens_to))]
        last = first + int(enough[0]) + 1
        groups.append((first, last))
        first = last
    return groups


def structural_segments(text: str, sections: list[tuple[str, int, int]], size: int, overlap: int) -> Iterator[Segment]:
    """A chunk for each group of sections (title, start, end), under the first one's title; a group beyond the size is cut
    at boundaries, in what the title leaves of it."""
    marks = Marks(text)
    start, end = (np.array([x[i] for x in sections], np.int64) for i in (1, 2))
    groups = merged_sections(np.searchsorted(marks.ends, start, "right"), np.searchsorted(marks.heads, end, "left"), max(1, size // 4))
    for first, last in groups:
        title, begin, stop = sections[first][0], int(start[first]), int(end[last - 1])
        note = f"section: {title}" + (f" (+{last - first - 1} short section(s) merged in)" if last - first > 1 else "")
        head, body = Marks(title), marks.text[begin:stop]
        room = max(1, size - len(head.ends))
        if marks.within(begin, stop) <= room:
            parts = [(body, 0, len(body), "")]
        else:
            parts = list(boundary_segments(body, room, min(overlap, room - 1)))
        for nth, (content, s, e, _) in enumerate(parts, 1):
            under = content if content.lstrip().startswith(head.text) else f"{head.text}\n\n{content}"
            yield under, begin + s, begin + e, note + (f" — part {nth} of {len(parts)}" if len(parts) > 1 else "")


_SEGMENTS = pa.schema([("source_key", pa.string()), ("plan", pa.int32()), ("position", pa.int32()), ("total", pa.int32()), ("content", pa.string()), ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("note", pa.string())])
_SEGMENTS_DDL = "source_key string, plan int, position int, total int, content string, start_offset int, end_offset int, note string"


def each(cut: Callable[..., Iterator[Segment]]) -> Callable[..., Iterator[list[Segment]]]:
    """A cut of one document as a cut of a block, given as columns."""
    return lambda *columns: (list(cut(*row)) for row in zip(*columns, strict=True))


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about BLOCK bytes in the second column, the text."""
    upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
    for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(upto // BLOCK)) + 1).tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def _cut_map(*cuts: Callable[..., Iterator[list[Segment]]]):
    """A map over (source_key, text, further columns) to the segments of each cut in turn, numbered, with their total."""

    def run(batches):
        for block in itertools.chain.from_iterable(map(_blocks, batches)):
            keys, *columns = [c.to_pylist() for c in block.columns]
            for plan, cut in enumerate(cuts):
                rows = [(key, plan, i, len(found), *segment) for key, found in zip(keys, cut(*columns), strict=True) for i, segment in enumerate(found)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SEGMENTS, strict=True)], schema=_SEGMENTS)

    return run


def _segments(docs: DataFrame, *cuts: Callable[[list[str]], Iterator[list[Segment]]]) -> DataFrame:
    return docs.select("source_key", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_cut_map(*cuts), _SEGMENTS_DDL)


def segmented(docs: DataFrame, *cuts: Callable[[str], Iterator[Segment]]) -> DataFrame:
    """Segments of each document's whole text by each cut, in one pass and without a shuffle."""
    return _segments(docs, *map(each, cuts))


def _sequential(docs: DataFrame, plans: list[tuple[str, int, int]]) -> DataFrame:
    """Chunks of boundary and recursive plans (strategy, size, overlap), with a column plan: the place in plans."""
    cut = {"boundary": lambda n, o: each(functools.partial(boundary_segments, size=n, overlap=o)), "recursive": lambda n, o: functools.partial(recursive_blocks, size=n, overlap=o)}
    return numbered(_segments(docs, *[cut[s](n, o) for s, n, o in plans]), [o for _, _, o in plans])


def chunk_boundary(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    return _sequential(docs, [ids.parse_variant(ids.variant_id("boundary", size, overlap))]).select(*CHUNK_COLUMNS)


def chunk_recursive(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    return _sequential(docs, [ids.parse_variant(ids.variant_id("recursive", size, overlap))]).select(*CHUNK_COLUMNS)


def chunk_structural(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    from .sections import with_spans

    ids.parse_variant(ids.variant_id("structural", size, overlap))
    cut = each(lambda text, spans: structural_segments(text, [(x["title"], x["start"], x["end"]) for x in spans], size, overlap))
    rows = with_spans(docs.select("source_key", F.coalesce("text", F.lit("")).alias("text")))
    return numbered(rows.select("source_key", "text", "spans").mapInArrow(_cut_map(cut), _SEGMENTS_DDL), [overlap]).select(*CHUNK_COLUMNS)


STRATEGIES: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {"fixed": chunk_fixed, "boundary": chunk_boundary, "recursive": chunk_recursive, "structural": chunk_structural}
if set(STRATEGIES) != set(ids.STRATEGIES):
    raise ImportError("a chunking strategy has no implementation")


def chunk_all(docs: DataFrame, variants: list[str]) -> DataFrame:
    """Chunks of all variants in one job, with a column variant. Unknown variants are refused before any work; all
    boundary and recursive ones are cut in one pass over the documents."""
    plans = {v: ids.parse_variant(v) for v in variants}
    together = [v for v in variants if plans[v][0] in ("boundary", "recursive")]
    parts = [STRATEGIES[plans[v][0]](docs, *plans[v][1:]).withColumn("variant", F.lit(v)) for v in variants if v not in together]
    if together:
        parts.append(_sequential(docs, [plans[v] for v in together]).withColumn("variant", F.array(*map(F.lit, together))[F.col("plan")]).drop("plan"))
    return functools.reduce(DataFrame.unionByName, parts)


def preview(docs: DataFrame, variant: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, their shape) of one variant; nothing is written."""
    chunks = chunk_all(docs, [variant])
    return chunks, chunk_stats(chunks, docs)


def chunk_stats(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document and variant: count, total, least, median and most tokens, and the share that is repeated. The median is
    taken from counts of each distinct value, which a chunk's size bounds."""
    whole = docs.select("source_key", F.size(text.tokens(text.strip("text"))).alias("doc_tokens"))
    shape = chunks.groupBy("source_key", "variant").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("total_tokens"), F.min("token_count").alias("min_tokens"),
        F.median("token_count").cast("int").alias("median_tokens"), F.max("token_count").alias("max_tokens"),
    )
    repeated = F.greatest(F.lit(0.0), 1 - F.col("doc_tokens") / F.col("total_tokens"))
    return shape.join(whole, "source_key").withColumn("repeated", F.round(repeated, 6)).drop("doc_tokens")


def overlap_check(chunks: DataFrame) -> DataFrame:
    """Tokens of each chunk that the next one of its document and variant repeats: those from the next one's start on."""
    w = Window.partitionBy("source_key", "variant").orderBy("chunk_index")
    rows = chunks.withColumn("next_start", F.lead("start_offset").over(w))
    shared = F.greatest(F.lit(0), F.col("end_offset") - F.col("next_start"))
    return rows.withColumn("shared_tokens", F.when(F.col("next_start").isNotNull(), F.size(text.tokens(F.right("content", shared)))))


def locate_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """start and end of each chunk in its stripped document: first hit from the cursor, else any hit, else the cursor. A document is
    one row with all its chunks, so its text meets them once. A chunk without content, or of a null text, is at its cursor;
    one without a cursor at any hit."""
    held = chunks.groupBy("source_key").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in chunks.columns])).alias("cs"))
    both = held.join(docs.select("source_key", text.strip("text").alias("doc_text")), "source_key")
    part = lambda c, other: F.transform("cs", lambda x: F.coalesce(x[c], other))
    both = both.select("cs", locate.places_from("doc_text", part("content", F.lit("")), part("cursor", F.lit(-1))).alias("at"))
    rows = both.select(F.explode(F.arrays_zip("cs", "at")).alias("r"))
    start = F.when(F.col("r.cs.content").isNull(), F.col("r.cs.cursor")).when(F.col("r.at") >= 0, F.col("r.at"))
    return rows.select("r.cs.*", start.cast("int").alias("start")).withColumn("end", F.col("start") + F.length("content"))
