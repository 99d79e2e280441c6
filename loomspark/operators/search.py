"""Embedding, exact similarity search inside a space, and what becomes of the matches.

Questions of a checked size are broadcast, more of them meet the vectors in a grid of partitions; each task keeps its own
best k per question with NumPy, over all its batches, so that only k rows per question and task go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Questions, and vectors, whose scores are in memory at once; bytes of questions in a task; vectors of a slice of the grid
#: at least; bounds of k; sparse width.
BLOCK, TILE, QUESTION_BYTES, SLICE, K = 1024, 1024, 64 << 20, 4096, (1, 50)
BUCKETS = 1024


def bag_of_words(rows: DataFrame, key: str, body: str = "content") -> DataFrame:
    """The offline embedding in sparse form: key, bucket (hash of the word), weight (counts, unit length)."""
    words = F.filter(F.split(F.lower(F.col(body)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    bucket = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % BUCKETS
    counts = rows.select(key, F.explode(words).alias("word")).groupBy(key, bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    length = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return counts.join(length, key).select(key, "bucket", (F.col("n") / F.col("length")).alias("weight"))


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str, batch: int = 64) -> DataFrame:
    """chunks with an embedding column by the caller's batch function, so many texts a call; order is kept."""
    schema = chunks.withColumn("embedding", F.lit(None).cast("array<float>")).schema

    def run(frames):
        for f in frames:
            made: list = []
            for i in range(0, len(f), batch):
                made += [[float(x) for x in v] for v in embedder(f["content"].iloc[i : i + batch].tolist())]
            f["embedding"] = made
            yield f

    return chunks.mapInPandas(run, schema).withColumn("embedding_model", F.lit(model))


def packed(rows: DataFrame, key: str) -> DataFrame:
    """Sparse rows (key, bucket, weight) as one row a key: buckets and weights, BUCKETS of them at most."""
    held = F.array_sort(F.collect_list(F.struct("bucket", "weight")))
    return rows.groupBy(key).agg(held.alias("e")).select(key, F.col("e.bucket").alias("buckets"), F.col("e.weight").alias("weights"))


def _matrix(columns: list[pa.Array]) -> np.ndarray:
    """Rows of dense embeddings, or of buckets and weights, as a matrix."""
    lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    values = lists[-1].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lists) == 1:
        return values.reshape(len(lists[0]), -1)
    out = np.zeros((len(lists[0]), BUCKETS))
    count = lists[0].value_lengths().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(count)), count), lists[0].flatten().to_numpy(zero_copy_only=False)] = values
    return out


class _Best:
    """The k best vectors so far of each question, by score in millionths, then by id, nulls first."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.place, self.ids = k, np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64), None

    def add(self, ids: pa.Array, score: np.ndarray) -> None:
        """score: millionths by question and vector, -1 for no match."""
        held = 0 if self.ids is None else len(self.ids)
        every = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        rank = np.empty(len(every), np.int64)
        rank[pc.sort_indices(every, null_placement="at_start").to_numpy()] = np.arange(len(every))
        place = np.concatenate([self.place, np.broadcast_to(held + np.arange(len(ids)), score.shape)], axis=1)
        score = np.concatenate([self.score, score], axis=1)
        order = np.where(score < 0, -1, score * len(every) + (len(every) - 1 - rank[place]))
        if order.shape[1] > self.k:
            top = np.argpartition(-order, self.k - 1, axis=1)[:, : self.k]
            score, place = np.take_along_axis(score, top, 1), np.take_along_axis(place, top, 1)
        used, back = np.unique(place, return_inverse=True)
        self.score, self.place, self.ids = score, back.reshape(place.shape), every.take(pa.array(used))

    def rows(self, asked: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
        at = np.nonzero(self.score >= 0)
        ids = self.ids.take(pa.array(self.place[at]))
        return pa.RecordBatch.from_arrays([asked.take(pa.array(at[0])), ids, pa.array(self.score[at] / 1e6)], schema=schema)


class _Scan:
    """Questions in memory, in blocks, and the vectors that go by them."""

    def __init__(self, asked: pa.Array, matrix: np.ndarray, k: int, matched_only: bool):
        self.matched_only = matched_only
        self.blocks = [(asked[i : i + BLOCK], matrix[i : i + BLOCK], _Best(len(matrix[i : i + BLOCK]), k)) for i in range(0, len(matrix), BLOCK)]
        self.some = False

    def add(self, ids: pa.Array, payload: list[pa.Array]) -> None:
        for i in range(0, len(ids), TILE):
            x, self.some = _matrix([c.slice(i, TILE) for c in payload]).T, True
            for _, m, found in self.blocks:
                dots = m @ x
                score = np.rint(np.clip(dots, 0, 1) * 1e6).astype(np.int64)
                found.add(ids.slice(i, TILE), np.where(dots > 0, score, -1) if self.matched_only else score)

    def results(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for asked, _, found in self.blocks if self.some else []:
            yield found.rows(asked, schema)


def _nearest(questions: DataFrame, vectors: DataFrame, payload: list[str], k: int, matched_only: bool, question_bytes: int, tile_bytes: int) -> DataFrame:
    """The k best of each question; ids of any type. Questions of at most question_bytes are broadcast, and vectors go by
    them where they lie; more of them meet the vectors in a grid (_grid). Questions are read more than once: store what is costly."""
    if not K[0] <= k <= K[1]:
        raise ValueError(f"k must lie in {K[0]}..{K[1]}")
    q, v = questions.select("question_id", *payload).where(F.col(payload[-1]).isNotNull()), vectors.select("vector_id", *payload).where(F.col(payload[-1]).isNotNull())
    kinds = [q.schema["question_id"].dataType, v.schema["vector_id"].dataType]
    schema = pa.schema([("question_id", to_arrow_type(kinds[0])), ("vector_id", to_arrow_type(kinds[1])), ("score", pa.float64())])
    ddl = f"question_id {kinds[0].simpleString()}, vector_id {kinds[1].simpleString()}, score double"
    first = q.first()
    if first is None:
        return best(q.sparkSession.createDataFrame([], ddl), k)
    width = BUCKETS if len(payload) > 1 else max(1, len(first[payload[0]]))
    most = max(1, question_bytes // (8 * width))
    rows = q.limit(most + 1).collect()
    if len(rows) > most:
        return best(_grid(q, v, payload, k, matched_only, max(1, tile_bytes // (8 * width)), schema, ddl), k)
    matrix = _matrix([pa.array([r[p] for r in rows], pa.list_(pa.float64() if p != "buckets" else pa.int32())) for p in payload])
    sent = q.sparkSession.sparkContext.broadcast((pa.array([r.question_id for r in rows], schema.field(0).type), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(*sent.value, k, matched_only)
        for b in batches:
            scan.add(b.column(0), b.columns[1:])
        yield from scan.results(schema)

    return best(v.mapInArrow(run, ddl), k)


def _grid(q: DataFrame, v: DataFrame, payload: list[str], k: int, matched_only: bool, most: int, schema: pa.Schema, ddl: str) -> DataFrame:
    """A cell of the grid is a partition: at most about `most` questions, which it holds, and a slice of the vectors, which go by.
    Vectors are sent to each tile of questions, questions to each slice. A tile is as large as a task may hold, so vectors
    are shuffled once for each `most` questions; a slice has as many vectors as a tile has questions, SLICE at least, so
    questions are shuffled no more than vectors. Nothing passes the driver but the numbers of questions and vectors.

    Of repeated questions (id and embedding) k stay, which is all that the k best of their id can need, so that no tile
    grows with copies; vectors don't have to fit in memory, and copies of one in different files go to different slices.
    """
    copies = q.groupBy("question_id", *payload).agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    q = copies.select("question_id", *payload, F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    n = q.count()
    tiles = -(-n // most)
    slices = min(-(-v.count() // max(SLICE, -(-n // tiles))), -(-int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")) // tiles))
    slices = max(1, slices)
    tile = F.pmod(F.xxhash64("question_id", *payload, "copy"), F.lit(tiles)).cast("int")
    place = F.pmod(F.xxhash64("vector_id", *payload, F.spark_partition_id()), F.lit(slices)).cast("int")
    to_slices = F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: F.col("tile") * slices + s))
    to_tiles = F.explode(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda t: t * slices + F.col("slice")))
    asked = q.withColumn("tile", tile).select(to_slices.alias("cell"), F.lit(0).alias("side"), "question_id", F.lit(None).cast(v.schema["vector_id"].dataType).alias("vector_id"), *payload)
    held = v.withColumn("slice", place).select(to_tiles.alias("cell"), F.lit(1).alias("side"), F.lit(None).cast(q.schema["question_id"].dataType).alias("question_id"), "vector_id", *payload)
    cells = asked.unionByName(held).repartitionById(tiles * slices, F.col("cell")).sortWithinPartitions("cell", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, matrices, scan = None, [], [], None
        for b in batches:
            cell = b.column(0).to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist()] if len(cell) else []
            for i, j in zip(starts, [*starts[1:], len(cell)]):
                if cell[i] != now:
                    yield from scan.results(schema) if scan else ()
                    now, ids, matrices, scan = cell[i], [], [], None
                part = b.slice(i, j - i)
                n = pc.sum(pc.equal(part.column(1), 0)).as_py()
                if n:
                    ids.append(part.column(2).slice(0, n))
                    matrices.append(_matrix([c.slice(0, n) for c in part.columns[4:]]))
                if n < part.num_rows and ids:
                    scan = scan or _Scan(pa.concat_arrays(ids), np.concatenate(matrices), k, matched_only)
                    scan.add(part.column(3).slice(n), [c.slice(n) for c in part.columns[4:]])
        yield from scan.results(schema) if scan else ()

    return cells.mapInArrow(run, ddl)


def search_sparse(questions: DataFrame, corpus: DataFrame, k: int, question_bytes: int = QUESTION_BYTES, tile_bytes: int = QUESTION_BYTES) -> DataFrame:
    """Sparse rows (question_id | vector_id, bucket, weight) to the k best per question among vectors that share a bucket
    with it: vectors are packed to a row each, then scored in blocks like dense ones."""
    return _nearest(packed(questions, "question_id"), packed(corpus, "vector_id"), ["buckets", "weights"], k, True, question_bytes, tile_bytes)


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each question: scores clamped to 0..1 and rounded, then by vector id."""
    if not K[0] <= k <= K[1]:
        raise ValueError(f"k must lie in {K[0]}..{K[1]}")
    rows = scored.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))), 6))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "vector_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def search(questions: DataFrame, vectors: DataFrame, k: int, space: str | None = None, question_bytes: int = QUESTION_BYTES, tile_bytes: int = QUESTION_BYTES) -> DataFrame:
    """question_id, vector_id, score, rank: the k nearest vectors by dot product, exactly, in one space (a partition).

    questions: question_id, embedding; vectors: vector_id, embedding (and space, if one is named). Ids keep their types;
    rows without an embedding are left out. Questions beyond question_bytes aren't broadcast; a task then holds tile_bytes of them.
    """
    return _nearest(questions, vectors if space is None else vectors.where(F.col("space") == space), ["embedding"], k, False, question_bytes, tile_bytes)


def apply_threshold(matches: DataFrame, threshold: float) -> DataFrame:
    """Matches below the threshold are marked dropped, not removed."""
    return matches.withColumn("dropped", F.col("score") < threshold)


def rank_matches(matches: DataFrame) -> DataFrame:
    """0-based rank per question, kept ones first; dropped ones go on in the same ranking."""
    order = Window.partitionBy("question_id").orderBy("dropped", F.col("score").desc(), "vector_id")
    return matches.withColumn("rank", F.row_number().over(order) - 1)


def retrieve(questions: DataFrame, vectors: DataFrame, k: int, threshold: float, space: str | None = None) -> DataFrame:
    """Search, threshold and rank. Questions with use_rag false get no matches; those with own chunks are left out (see answer_matches)."""
    asked = questions.where("use_rag") if "use_rag" in questions.columns else questions
    return rank_matches(apply_threshold(search(asked, vectors, k, space), threshold))


def answer_matches(questions: DataFrame, vectors: DataFrame, pointer: DataFrame, k: int, threshold: float, model: str, embedder: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Matches of questions (question_id, question, and, if given, use_rag and own_chunks: array<struct<vector_id,content,
    source>>) in the space that answers come from: question_id, vector_id, content, source_key, score, dropped, rank, embedding_model.

    pointer: the one-row table of status.production; a space that holds nothing fails the job. Questions are embedded by
    `embedder` (adds embedding) unless they have one; a match of another model fails the job. Questions that don't ask
    for a search get no rows; those with chunks of their own get these, in their order, with score 1, and no search.
    """
    row = pointer.select("space", "state").first()
    if row is None or row.state == "missing":
        raise ValueError("the space that answers come from holds no vectors")
    own = F.col("own_chunks") if "own_chunks" in questions.columns else F.lit(None).cast("array<struct<vector_id:string,content:string,source:string>>")
    has_own = F.coalesce(F.size(own) > 0, F.lit(False))
    asks = F.coalesce(F.col("use_rag"), F.lit(True)) if "use_rag" in questions.columns else F.lit(True)
    given = questions.where(asks & has_own).select("question_id", F.posexplode(own).alias("rank", "c"))
    given = given.select("question_id", F.col("c.vector_id").cast("string").alias("vector_id"), F.col("c.content").alias("content"), F.col("c.source").alias("source_key"), F.lit(1.0).alias("score"), F.lit(False).alias("dropped"), "rank")
    searched = questions.where(asks & ~has_own)
    searched = embedder(searched) if embedder and "embedding" not in searched.columns else searched
    inside = vectors.where(F.col("space") == row.space)
    found = retrieve(searched.select("question_id", "embedding"), inside, k, threshold)
    found = assert_same_model(found.join(inside.select("vector_id", "content", "source_key", "embedding_model"), "vector_id"), model)
    found = found.select("question_id", F.col("vector_id").cast("string").alias("vector_id"), "content", "source_key", "score", "dropped", "rank", "embedding_model")
    return found.unionByName(given.withColumn("embedding_model", F.lit(model)))


def assert_same_model(matches: DataFrame, model: str) -> DataFrame:
    """matches; the job fails where a stamped model differs from the query's. Unstamped rows pass."""
    other = (F.coalesce("embedding_model", F.lit("")) != "") & (F.col("embedding_model") != model)
    said = F.concat(F.lit("match embedded with "), F.col("embedding_model"), F.lit(f", query with {model}"))
    return matches.withColumn("embedding_model", F.when(other, F.raise_error(said).cast("string")).otherwise(F.col("embedding_model")))


def pick_field(metadata: Column, names: list[str]) -> Column:
    """The first name that has a value that isn't blank."""
    return F.coalesce(*[F.when(metadata[n] != "", metadata[n]) for n in names])


def compare_variants(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Two variants' matches on one question set side by side: score_a, score_b, and which side has the row."""
    left, right = a.groupBy(*on).agg(F.max("score").alias("score_a")), b.groupBy(*on).agg(F.max("score").alias("score_b"))
    both = left.join(right, on, "full_outer")
    return both.withColumn("side", F.when(F.col("score_b").isNull(), "a").when(F.col("score_a").isNull(), "b").otherwise("both"))


# --- prompts

#: Fixed value: how one chunk is shown.
CHUNK_FORMAT = "[Chunk {chunk_id} | score={score}]\n{content}"


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template's text with {names} replaced; unknown names stay."""
    import re

    parts = [values[p[1:-1]] if p[:1] == "{" and p[1:-1] in values else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts]) if parts else F.lit("")


def shown_score(score: str) -> Column:
    """A score of 0..1 to three decimals, rounded from its exact binary value as C and Python do it. format_string rounds the
    shortest decimal form instead; format_number is exact, but for the one digit of 0.0005."""
    return F.when(F.col(score).between(0.0005, 0.001), "0.001").otherwise(F.format_number(score, 3))


def context_block(matches: DataFrame, template: str = CHUNK_FORMAT) -> DataFrame:
    """question_id, context: kept matches through the template, best first, a blank line between."""
    names = {"content": F.col("content"), "chunk_id": F.col("vector_id").cast("string"), "score": shown_score("score"), "source": F.col("source"), "document_id": F.col("document_id"), "rank": (F.col("rank") + 1).cast("string")}
    rows = matches.where("not dropped").select("question_id", "rank", rendered(template, names).alias("part"))
    return rows.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda r: r["part"]), "\n\n").alias("context"))


def messages(questions: DataFrame, contexts: DataFrame, prompts: dict[str, str]) -> DataFrame:
    """question_id, messages (role, content): system unless blank, then context, or the no-context text where a search
    was meant to run, the question last. prompts: system, context_block ({chunks}), no_context ({query})."""
    rows = questions.join(contexts, "question_id", "left")
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    system = F.coalesce(F.col("system_prompt"), F.lit(prompts["system"]))
    has = F.col("context").isNotNull()
    middle = F.when(has, rendered(prompts["context_block"], {"chunks": F.col("context")})).when(F.col("use_rag"), rendered(prompts["no_context"], {"query": F.col("question")})).otherwise("")
    every = F.array(say("system", system), say("system", middle), say("user", F.col("question")))
    return rows.select("question_id", F.filter(every, lambda m: (m["role"] == "user") | (F.trim(m["content"]) != "")).alias("messages"))


def active_prompts(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """prompt_id, template, overridden: an override, where there is one, over the default."""
    o = overrides.select("prompt_id", F.col("template").alias("own"))
    return defaults.join(o, "prompt_id", "left").select("prompt_id", F.coalesce("own", "template").alias("template"), F.col("own").isNotNull().alias("overridden"))


def splice_tables(docs: DataFrame, tables: DataFrame, descriptions: DataFrame) -> DataFrame:
    """docs (document_id, text, spans) with each described table replaced by description and link; warnings listed.

    A table that is not in the text is warned of and its description not used. Tables are replaced in order of
    table_id, by a fold over the document's own tables; page spans move along.
    """
    label = F.coalesce(F.when(F.col("caption") != "", F.col("caption")), F.when(F.col("page") > 0, F.concat(F.lit("Table on page "), F.col("page").cast("string"))), F.initcap(F.replace("table_id", F.lit("-"), F.lit(" "))))
    t = tables.join(descriptions, ["document_id", "table_id"], "left")
    link = F.concat(F.lit("["), label, F.lit("](table://"), "document_id", F.lit("/"), "table_id", F.lit(")"))
    t = t.withColumn("put", F.when(F.coalesce("description", F.lit("")) != "", F.concat("description", F.lit("\n\n"), link)))
    t = t.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("table_id", "markdown", "put"))).alias("ts"))
    fold = """aggregate(coalesce(ts, cast(array() as array<struct<table_id:string,markdown:string,put:string>>)),
      named_struct('text', text, 'spans', spans, 'warnings', cast(array() as array<string>)),
      (a, t) -> if(locate(t.markdown, a.text) = 0, named_struct('text', a.text, 'spans', a.spans, 'warnings', concat(a.warnings, array(concat(t.table_id, ': not found in the document text; left as-is.')))),
        if(t.put is null, named_struct('text', a.text, 'spans', a.spans, 'warnings', concat(a.warnings, array(concat(t.table_id, ': no description; the raw table stays embedded.')))),
          element_at(transform(array(locate(t.markdown, a.text) - 1), s -> named_struct(
            'text', concat(substring(a.text, 1, s), t.put, substring(a.text, s + length(t.markdown) + 1)),
            'spans', transform(a.spans, p -> named_struct('page', p.page,
              'start', if(p.start <= s, p.start, if(p.start >= s + length(t.markdown), p.start + length(t.put) - length(t.markdown), s + length(t.put))),
              'end', if(p.end <= s, p.end, if(p.end >= s + length(t.markdown), p.end + length(t.put) - length(t.markdown), s + length(t.put))))),
            'warnings', a.warnings)), 1))))"""
    return docs.join(t, "document_id", "left").withColumn("r", F.expr(fold)).select("document_id", F.col("r.text").alias("text"), F.col("r.spans").alias("spans"), F.col("r.warnings").alias("warnings"))
