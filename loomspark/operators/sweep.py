"""One indexing sweep over a space, from the status of files to the vectors and run rows after it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources import stored
from . import chunking, governance, status


def index_sweep(sources: DataFrame, vectors: DataFrame, space: str, variant: str, model: str, policy: dict | None = None, embed=None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors after, run_files): stale files are screened, cut, compared position by position, and only changed
    chunks are embedded (by `embed`, a transform that adds an embedding column). A blocked file leaves no new
    chunks; a file without text loses its old ones. run_files: source_key, outcome, chunks, reused, pruned.

    keep(df, label) stores the stale files' chunks and plan, which are used more than once, in a folder that all
    machines share, and reads them back; without it they are computed again. Other files' vectors are not read beyond
    their status.
    """
    keep = keep or (lambda df, label: df)
    todo = status.reindexable(status.sync_status(sources, vectors, space, model)).select("source_key")
    stale = sources.join(todo, "source_key", "left_semi").select("source_key", "text")
    screened = governance.screen(stale, policy) if policy else stale.withColumn("verdict", F.lit("unscreened"))
    blank = F.length(text.strip(F.coalesce("text", F.lit("")))) == 0
    outcome = F.when(F.col("verdict") == "blocked", "blocked").when(blank, "empty").otherwise("indexed")
    files = screened.select("source_key", "text", outcome.alias("outcome"))
    # both are used more than once below; only stale files are in them
    chunks = keep(chunking.chunk_all(files.where("outcome = 'indexed'"), [variant]), "sweep-chunks")
    plan = keep(status.index_plan(chunks, vectors, space, model), "sweep-plan")
    counts = plan.groupBy("document_id").agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("embed", "chunks"), ("reuse", "reused"), ("prune", "pruned"))])
    run_files = files.select("source_key", "outcome", status.ids.document_id("source_key").alias("document_id")).join(counts, "document_id", "left")
    run_files = run_files.select("source_key", "outcome", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "reused", "pruned")])
    new = chunks.join(plan.where("action = 'embed'").select("vector_id"), "vector_id", "left_semi")
    new = new.join(sources.select("source_key", F.col("etag").alias("source_etag")), "source_key").select("vector_id", "source_key", "document_id", "chunk_index", "chunk_total", "content", "source_etag")
    new = embed(new) if embed else new
    kept = stored.delete_vectors(vectors, plan.where("action = 'prune'").select("vector_id"), space)
    cleared = files.where("outcome <> 'indexed'").select(status.ids.document_id("source_key").alias("document_id"))
    return stored.upserted(stored.delete_documents(kept, cleared, space), new, space, model), run_files
