"""Queries of the indexing sweep, of history tables and of the streaming jobs (files of a table as the stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sweep
from ..registry import registered
from ..sources import stored
from ..streaming import jobs
from .corpus import _STATE
from .scratch import fresh
from .screening import MASK, ONLY_MAIL
from .tables import MODEL, VARIANT, sources, table, vectors, with_cte

_BASE = ("files", "sources", "allchunks", "chunks", "vectors", "rollup")
_TODO = f"""stale AS (SELECT s.source_key, s.doc_id FROM sources s LEFT JOIN (SELECT * FROM firsts WHERE space = '') r USING (source_key) WHERE {_STATE} <> 'current'),
w AS (SELECT c.* FROM chunks c JOIN stale USING (doc_id)), v AS (SELECT * FROM vectors WHERE space = '' AND document_id IN (SELECT document_id FROM w)),
b AS (SELECT coalesce(c.document_id, v.document_id) AS document_id, coalesce(c.vector_id, v.vector_id) AS vector_id, coalesce(c.chunk_index, v.chunk_index) AS k, CASE WHEN c.content IS NULL THEN 'prune' WHEN v.content = c.content AND v.embedding_model = '{MODEL}' THEN 'reuse' ELSE 'embed' END AS a FROM w c FULL JOIN v ON c.document_id = v.document_id AND c.chunk_index = v.chunk_index),
p AS (SELECT document_id, vector_id, CASE WHEN k = 0 AND a = 'reuse' AND max((a <> 'reuse')::INT) OVER (PARTITION BY document_id) = 1 THEN 'embed' ELSE a END AS a FROM b)"""


@registered("t9_index_sweep_files", with_cte(*_BASE, then=f", {_TODO} SELECT source_key, CASE WHEN n > 0 THEN 'indexed' ELSE 'empty' END AS outcome, coalesce(chunks, 0) AS chunks, coalesce(reused, 0) AS reused, coalesce(pruned, 0) AS pruned FROM (SELECT source_key, (SELECT count(*) FROM w WHERE w.source_key = stale.source_key) AS n FROM stale) LEFT JOIN (SELECT source_key, count(*) FILTER (WHERE a = 'embed') AS chunks, count(*) FILTER (WHERE a = 'reuse') AS reused, count(*) FILTER (WHERE a = 'prune') AS pruned FROM p JOIN (SELECT DISTINCT document_id, source_key FROM w) USING (document_id) GROUP BY 1) USING (source_key)").replace("\n, stale", ",\nstale"))
def t9(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(spark, d)[1]


def _sweep(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A sweep over the stored index."""
    return sweep.index_sweep(sources(spark, d), vectors(spark, d), "", VARIANT, MODEL, keep=kept)


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written in the shared folder and read back."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@registered("t9_index_sweep_vectors", with_cte(*_BASE, then=f", {_TODO} SELECT vector_id, md5(content) AS content_md5 FROM vectors WHERE space = '' AND vector_id NOT IN (SELECT vector_id FROM p WHERE a <> 'reuse') AND source_key NOT IN (SELECT source_key FROM stale WHERE source_key NOT IN (SELECT source_key FROM w)) UNION ALL SELECT c.vector_id, md5(content) FROM chunks c JOIN p ON c.vector_id = p.vector_id AND p.a = 'embed'").replace("\n, stale", ",\nstale"))
def t9b(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(spark, d)[0].where("space = ''").select("vector_id", F.md5("content").alias("content_md5"))


@registered("io17_history_upsert", "SELECT user_id AS job_id, event_id AS cursor, CASE WHEN event_id % 3 = 0 THEN 'again' ELSE event_type END AS event FROM events")
def io17(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("cursor"), F.col("event_type").alias("event"))
    return stored.merged(e, e.where("cursor % 3 = 0").withColumn("event", F.lit("again")), ["job_id", "cursor"])


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream; the folder's other files are not matched."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")


def finished(df: DataFrame, label: str, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns its sink's last state, written in the shared folder."""
    spark = df.sparkSession
    out, cp = fresh(spark, label), fresh(spark, f"{label}-checkpoint")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@registered("r1_stream_index", with_cte("files", "allchunks", then="SELECT vector_id, md5(content) AS content_md5 FROM allchunks"))
def r1(spark: SparkSession, d: str) -> DataFrame:
    f = stream(spark, d, "documents")
    f = f.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_key"), "text", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("last_modified"))
    out = fresh(spark, "stream-index")
    jobs.stream_index(f, out, fresh(spark, "stream-index-checkpoint"), VARIANT, MODEL).awaitTermination()
    return jobs.index_table(spark, out).read().select("vector_id", F.md5("content").alias("content_md5"))


@registered("r2_dedupe_requests", "SELECT DISTINCT user_id::VARCHAR AS source_key, event_type AS variant FROM events")
def r2(spark: SparkSession, d: str) -> DataFrame:
    e = stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("source_key"), F.col("event_type").alias("variant"))
    return finished(jobs.dedupe_requests(e, "3650 days"), "requests", "append").select("source_key", "variant")


@registered("r3_stream_screen", r"SELECT doc_id, 'allowed' AS verdict, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g')) AS text_md5 FROM documents")
def r3(spark: SparkSession, d: str) -> DataFrame:
    """All documents, screened for addresses; r3_stream_screen_all looks for all kinds."""
    out = fresh(spark, "screened")
    jobs.stream_screen(stream(spark, d, "documents").select("doc_id", "text"), MASK, out, fresh(spark, "audit"), fresh(spark, "screen-checkpoint"), ONLY_MAIL).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "verdict", F.md5("text").alias("text_md5"))


@registered("r3_stream_screen_all")
def r3_all(spark: SparkSession, d: str) -> DataFrame:
    """All documents through all recognizers."""
    out = fresh(spark, "screened")
    mask = {"actions": {"personal": "mask", "business": "mask", "ambiguous": "mask", "infra": "mask"}}
    jobs.stream_screen(stream(spark, d, "documents").select("doc_id", "text"), mask, out, fresh(spark, "audit"), fresh(spark, "screen-checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "verdict", F.md5("text").alias("text_md5"))


@registered("r4_stream_totals", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def r4(spark: SparkSession, d: str) -> DataFrame:
    e = stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t = finished(jobs.stream_totals(e, "1 day", "3650 days"), "totals", "complete")
    return t.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")
