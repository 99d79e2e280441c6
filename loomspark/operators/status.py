"""Stored files against their vectors: states, copies, orphans, rollups, and the plan of a re-index.

sources: source_key, last_modified, size, etag. vectors: space, vector_id, source_key, document_id, chunk_index,
chunk_total, content, source_etag, embedded_at, embedding_model. Embeddings are never read here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text

SUPPORTED = (".txt", ".md", ".pdf")
DERIVED = "derived/"


def supported(key) -> Column:
    return text.extension(key).isin(*SUPPORTED)


def indexed_documents(vectors: DataFrame) -> DataFrame:
    """Per space and document: its vector count, and what its first vector says of its source."""
    first = F.struct("source_key", "source_etag", "chunk_total", "embedded_at", "embedding_model")
    rolled = vectors.groupBy("space", "document_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.min_by(first, "vector_id").alias("first"))
    return rolled.select("space", "document_id", "chunk_count", "first.*").where(F.col("source_key") != "")


def state(etag="etag", model: str = "") -> Column:
    """The first rule that holds: orphaned, unsupported, not_indexed, interrupted, stale_content, stale_model, current."""
    differs = lambda a, b: (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (a != b)
    return (
        F.when(~F.col("stored"), "orphaned").when(~supported("source_key"), "unsupported").when(F.col("chunk_count").isNull(), "not_indexed")
        .when((F.coalesce("chunk_total", F.lit(0)) != 0) & (F.col("chunk_count") != F.col("chunk_total")), "interrupted")
        .when(differs(F.col("source_etag"), F.col(etag)), "stale_content").when(differs(F.col("embedding_model"), F.lit(model)), "stale_model").otherwise("current")
    )


def reason(model: str) -> Column:
    """What is said of each state (fixed values)."""
    said = {
        "orphaned": F.lit("Vectors exist for a file that is no longer in object storage."),
        "unsupported": F.lit("No extractor for this file type; it will be skipped during indexing."),
        "not_indexed": F.lit("This file has never been embedded."),
        "interrupted": F.format_string("A previous run left %d of %d chunks indexed; re-index to complete it.", "chunk_count", "chunk_total"),
        "stale_content": F.lit("The file changed in object storage after it was embedded."),
        "stale_model": F.format_string("Embedded with '%s', but '%s' is configured now.", F.col("embedding_model"), F.lit(model)),
    }
    out = F.when(F.lit(False), "")
    for k, v in said.items():
        out = out.when(F.col("state") == k, v)
    return out.otherwise("Embeddings match the file in object storage.")


def _listed(sources: DataFrame, prefix: str) -> DataFrame:
    return sources.where(F.col("source_key").startswith(prefix) & ~F.col("source_key").startswith(DERIVED))


def orphans(sources: DataFrame, vectors: DataFrame, prefix: str = "") -> DataFrame:
    """Keys that any space holds and storage does not."""
    held = vectors.where((F.col("source_key") != "") & F.col("source_key").startswith(prefix)).select("source_key").distinct()
    return held.join(_listed(sources, prefix), "source_key", "left_anti")


def sync_status(sources: DataFrame, vectors: DataFrame, space: str, model: str, prefix: str = "") -> DataFrame:
    """Every stored file and every orphan, judged against one space. Full outer on the key; an orphan of another space is listed too."""
    target = indexed_documents(vectors.where(F.col("space") == space)).drop("space", "document_id")
    rest = orphans(sources, vectors, prefix).withColumn("stored", F.lit(False))
    files = _listed(sources, prefix).select("source_key", "last_modified", "size", "etag").withColumn("stored", F.lit(True))
    both = files.unionByName(rest, allowMissingColumns=True).join(target, "source_key", "left")
    return both.withColumn("state", state(model=model)).withColumn("reason", reason(model)).drop("stored")


def order_statuses(statuses: DataFrame) -> DataFrame:
    """Newest change first, orphans last by key."""
    return statuses.orderBy(F.col("state") == "orphaned", F.col("last_modified").desc(), "source_key")


def copies(sources: DataFrame, vectors: DataFrame, active: str, model: str) -> DataFrame:
    """Per key: every space that holds it, each judged by itself, newest first (an unknown time counts as newest)."""
    held = indexed_documents(vectors).join(_listed(sources, "").select("source_key", "etag", F.lit(True).alias("stored")), "source_key", "left")
    held = held.withColumn("stored", F.coalesce("stored", F.lit(False))).withColumn("state", state(model=model))
    order = Window.partitionBy("source_key").orderBy(F.col("embedded_at").desc_nulls_first(), "space")
    held = held.withColumn("nth", F.row_number().over(order))
    copy = F.struct("nth", F.col("space").alias("variant_id"), ids.variant_label("space").alias("label"), "state", "chunk_count", "embedded_at", (F.col("space") == active).alias("active"))
    return held.groupBy("source_key").agg(F.array_sort(F.collect_list(copy)).alias("copies"))


def reindexable(statuses: DataFrame, only_stale: bool = True) -> DataFrame:
    out = statuses.where(~F.col("state").isin("orphaned", "unsupported"))
    return out.where("state <> 'current'") if only_stale else out


def filter_status(statuses: DataFrame, prefix: str = "", states: list[str] | None = None) -> DataFrame:
    out = statuses.where(F.col("source_key").startswith(prefix))
    return out.where(F.col("state").isin(*states)) if states else out


def select_work(statuses: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """source_key and outcome: asked keys (missing ones reported), or all that is worth a re-index."""
    if keys is None:
        return reindexable(statuses).select("source_key", F.lit("queued").alias("outcome"))
    found = keys.select("source_key").distinct().join(statuses.select("source_key", "state"), "source_key", "left")
    return found.select("source_key", F.when(F.col("state").isNull() | (F.col("state") == "orphaned"), "missing").otherwise("queued").alias("outcome"))


def variants(vectors: DataFrame) -> DataFrame:
    """Spaces whose name is a chunking variant: vectors, expected total, number of files, whether interrupted, latest time,
    first model. The files themselves are rows of indexed_keys."""
    docs = indexed_documents(vectors).where(ids.variant_struct("space").isNotNull())
    return docs.groupBy("space").agg(
        F.sum("chunk_count").alias("vectors"), F.sum(F.coalesce("chunk_total", F.lit(0))).cast("bigint").alias("expected"), F.count_distinct("source_key").alias("files"),
        F.bool_or((F.coalesce("chunk_total", F.lit(0)) != 0) & (F.col("chunk_count") < F.col("chunk_total"))).alias("interrupted"),
        F.max("embedded_at").alias("embedded_at"), F.min_by("embedding_model", "source_key").alias("embedding_model"),
    )


def space_stats(vectors: DataFrame) -> DataFrame:
    """Vectors per space, and in all (null space)."""
    return vectors.rollup("space").agg(F.count(F.lit(1)).alias("vectors"))


def indexed_keys(vectors: DataFrame, space: str) -> DataFrame:
    return vectors.where((F.col("space") == space) & (F.col("source_key") != "")).select("source_key").distinct()


def all_spaces(production: DataFrame, variant_vectors: DataFrame) -> DataFrame:
    return production.unionByName(variant_vectors)


def forget_source(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """vectors without those of the keys in variant spaces; spaces of other names are left alone."""
    gone = keys.select(F.col("source_key").alias("gone")).distinct()
    return vectors.join(gone, (F.col("source_key") == F.col("gone")) & ids.variant_struct("space").isNotNull(), "left_anti")


def document_detail(statuses: DataFrame, vectors: DataFrame, space: str) -> DataFrame:
    """Status of each key with its chunks in order; an index that is missing is read from the id."""
    index = F.coalesce("chunk_index", ids.parsed_vector_id("vector_id")[1])
    chunks = vectors.where(F.col("space") == space).groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct(index.alias("chunk_index"), F.col("vector_id"), F.length("content").alias("n_chars")))).alias("chunks"))
    return statuses.select("source_key", "state").join(chunks, "source_key", "left")


def index_plan(chunks: DataFrame, vectors: DataFrame, space: str, model: str, force: bool = False) -> DataFrame:
    """Per position: embed, reuse or prune, by equality of text and model. One full outer join and one window.

    An unreadable vector id is pruned. Chunk 0 is embedded whenever anything of its document changes, since it
    carries the total. With force, all is embedded and nothing pruned.
    """
    document, parsed = ids.parsed_vector_id("vector_id")
    held = vectors.where((F.col("space") == space) & F.col("document_id").isNotNull()).select(F.col("document_id").alias("d"), parsed.alias("i"), F.col("vector_id").alias("held_id"), F.col("content").alias("held"), F.col("embedding_model").alias("held_model"))
    want = chunks.select("document_id", "chunk_index", "vector_id", "content")
    held = held.join(chunks.select(F.col("document_id").alias("d")).distinct(), "d", "left_semi")
    both = want.join(held, (F.col("document_id") == F.col("d")) & (F.col("chunk_index") == F.col("i")), "full_outer")
    same = F.coalesce((F.col("held") == F.col("content")) & (F.col("held_model") == model), F.lit(False)) & F.lit(not force)
    action = F.when(F.col("content").isNull(), "prune").when(same, "reuse").otherwise("embed")
    both = both.select(F.coalesce("document_id", "d").alias("document_id"), F.coalesce("chunk_index", "i").alias("chunk_index"), F.coalesce("vector_id", "held_id").alias("vector_id"), "content", action.alias("action"))
    if force:
        return both.where("action <> 'prune'")
    changed = F.max((F.col("action") != "reuse").cast("int")).over(Window.partitionBy("document_id")) == 1
    return both.withColumn("action", F.when(changed & (F.col("chunk_index") == 0) & (F.col("action") == "reuse"), "embed").otherwise(F.col("action")))


def reconcile(vectors: DataFrame, texts: DataFrame) -> DataFrame:
    """Vector ids without a text row and text rows without a vector."""
    v, t = vectors.select("vector_id", F.lit(1).alias("v")).distinct(), texts.select("vector_id", F.lit(1).alias("t")).distinct()
    return v.join(t, "vector_id", "full_outer").where("v is null or t is null").select("vector_id", F.when(F.col("v").isNull(), "no_vector").otherwise("no_text").alias("problem"))


def production(pointer: DataFrame, variant_rollup: DataFrame) -> DataFrame:
    """Where answers come from: the pointer's space, or `missing` where its space holds nothing; '' is the original."""
    joined = pointer.select("space").join(variant_rollup.select("space", "vectors", "interrupted"), "space", "left")
    return joined.withColumn("state", F.when(F.col("space") == "", "original").when(F.coalesce("vectors", F.lit(0)) == 0, "missing").otherwise("ready"))


def point_at(variant_rollup: DataFrame, space: str) -> DataFrame:
    """The new one-row pointer; ValueError where the space is no variant, holds nothing or is interrupted."""
    spark = variant_rollup.sparkSession
    if space:
        ids.parse_variant(space)
        row = variant_rollup.where(F.col("space") == space).select("vectors", "interrupted").first()
        if row is None or not row.vectors:
            raise ValueError(f"{space} holds no vectors")
        if row.interrupted:
            raise ValueError(f"{space} was interrupted")
    return spark.createDataFrame([(space,)], "space string")


def listing_stale(meta: DataFrame, current: DataFrame) -> DataFrame:
    """One row: reason why a stored listing can't be used again, or null. Both: epoch, vectors, model."""
    m, c = meta.select(*[F.col(x).alias(f"m_{x}") for x in ("epoch", "vectors", "model")]), current.select("epoch", "vectors", "model")
    why = F.when(F.col("m_epoch").isNull(), "never stored").when(F.col("m_epoch") != F.col("epoch"), "epoch changed").when(F.col("m_vectors") != F.col("vectors"), "vector count changed").when(F.col("m_model") != F.col("model"), "model changed")
    return c.join(m, F.lit(True), "left").select(why.alias("reason"))
