"""Tables of the retrieval corpus, derived from the driver's, in Spark and in SQL.

sources: documents as files, a 23rd of them no longer stored. chunks: fixed windows of 64 tokens, 16 shared.
vectors: an index of all documents with known drift: doc_id % 7 lost its last chunk, % 11 was changed since, % 13
has a chunk too many, % 17 is of another model, % 19 was never indexed; every third document is also in the
variant space. pages_of: the documents of a source as pages. conversations give questions and answers (traces),
labels verdicts, events runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import chunking
from .scratch import stored

SIZE, OVERLAP, MODEL, OLD_MODEL, VARIANT = 64, 16, "hash-1024", "hash-512", "fixed-64-16"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    """All documents as files, stored or not: doc_id, source_key, etag, size, last_modified, text."""
    return as_files(table(spark, d, "documents"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files; they may be a stream."""
    key = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", key.alias("source_key"), F.md5("text").alias("etag"), F.octet_length("text").cast("bigint").alias("size"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("last_modified"), "text")


def sources(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where("doc_id % 23 <> 0")


def chunks(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    f = files(spark, d) if every else sources(spark, d)
    return chunking.chunk_fixed(f, SIZE, OVERLAP).withColumn("variant", F.lit(VARIANT))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The index as it lies in its store."""
    return stored(spark, d, "vectors", lambda: _indexed(spark, d))


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """One pass over the documents: a chunk's row and those that the drift adds to it come from one row of its document."""
    n = F.col("n")
    changed = n % 11 == 0
    f = files(spark, d).withColumn("n", F.regexp_extract("source_key", r"(\d+)\.txt$", 1).cast("bigint")).where("n % 19 <> 0")
    f = f.withColumn("source_etag", F.when(changed, F.md5(F.concat("text", F.lit("!")))).otherwise(F.col("etag")))
    c = chunking.chunk_fixed(f, SIZE, OVERLAP, ("n", "source_etag"))
    c = c.where("not (n % 7 = 0 and chunk_index = chunk_total - 1 and chunk_total > 1)")
    extra = F.when((n % 13 == 0) & (F.col("chunk_index") == 0), F.col("chunk_total"))
    c = c.withColumn("index", F.explode(F.array_compact(F.array("chunk_index", extra))))
    c = c.withColumn("space", F.explode(F.array_compact(F.array(F.lit(""), F.when(n % 3 == 0, VARIANT)))))
    return c.select(
        "space", ids.vector_id("document_id", "index").alias("vector_id"), "source_key", "document_id", F.col("index").alias("chunk_index"), "chunk_total",
        F.when(changed, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"), "source_etag", F.timestamp_seconds(F.lit(1706745600) + n * 60).alias("embedded_at"),
        F.when((n % 17 == 0) & (F.col("space") == ""), OLD_MODEL).otherwise(MODEL).alias("embedding_model"),
    )


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
CTE = {
    "files": r"files AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS source_key, md5(text) AS etag, strlen(text)::BIGINT AS size, 1704067200 + doc_id * 3600 AS modified, text FROM documents)",
    "sources": "sources AS (SELECT * FROM files WHERE doc_id % 23 <> 0)",
    "allchunks": rf"""toks AS (SELECT *, regexp_extract_all({_STRIP.format('text')}, '\s*\S+') AS t FROM files),
wins AS (SELECT *, greatest(0, ceil((len(t) - {SIZE}) / {SIZE - OVERLAP}.0))::INT + 1 AS n FROM toks WHERE len(t) > 0),
allchunks AS (SELECT doc_id, source_key, substr(sha1(source_key), 1, 16) AS document_id, k::INT AS chunk_index, n AS chunk_total,
  substr(sha1(source_key), 1, 16) || '#' || lpad(k::VARCHAR, 5, '0') AS vector_id,
  {_STRIP.format(f"array_to_string(t[k*{SIZE - OVERLAP}+1:k*{SIZE - OVERLAP}+{SIZE}], '')")} AS content, length(array_to_string(t[1:k*{SIZE - OVERLAP}+{SIZE}], '')) AS end_offset, least({SIZE}, len(t) - k*{SIZE - OVERLAP})::INT AS token_count, len(t) AS doc_tokens, text FROM wins, unnest(range(n)) AS u(k))""",
    "chunks": "chunks AS (SELECT * FROM allchunks WHERE doc_id % 23 <> 0)",
    "vectors": f"""held AS (SELECT * FROM allchunks WHERE doc_id % 19 <> 0 AND NOT (doc_id % 7 = 0 AND chunk_index = chunk_total - 1 AND chunk_total > 1)),
drift AS (SELECT * FROM held UNION ALL SELECT * REPLACE (chunk_total AS chunk_index, document_id || '#' || lpad(chunk_total::VARCHAR, 5, '0') AS vector_id) FROM held WHERE doc_id % 13 = 0 AND chunk_index = 0),
prod AS (SELECT doc_id, vector_id, source_key, document_id, chunk_index, chunk_total, CASE WHEN doc_id % 11 = 0 THEN content || '!' ELSE content END AS content, CASE WHEN doc_id % 11 = 0 THEN md5(text || '!') ELSE md5(text) END AS source_etag, 1706745600 + doc_id * 60 AS embedded, CASE WHEN doc_id % 17 = 0 THEN '{OLD_MODEL}' ELSE '{MODEL}' END AS embedding_model FROM drift),
vectors AS (SELECT '' AS space, * FROM prod UNION ALL SELECT '{VARIANT}' AS space, * REPLACE ('{MODEL}' AS embedding_model) FROM prod WHERE doc_id % 3 = 0)""",
    "rollup": """firsts AS (SELECT space, document_id, count(*) AS chunk_count, arg_min(source_key, vector_id) AS source_key, arg_min(source_etag, vector_id) AS source_etag, arg_min(chunk_total, vector_id) AS chunk_total, arg_min(embedded, vector_id) AS embedded, arg_min(embedding_model, vector_id) AS embedding_model FROM vectors GROUP BY ALL)""",
}


def with_cte(*names: str, then: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n" + then


def seconds(c: str):
    return F.unix_timestamp(c)


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    """source_key, page, text: the documents of a source and language as pages 1, 2, ... by doc_id, thirty a file.

    Ids are ranked without their texts, in ranges of ids: a range's rows are ranked in it, and counts of the ranges
    before it are added, so that a source of many documents is ranked by many tasks.
    """
    docs, group = table(spark, d, "documents"), ["source", "lang"]
    keys = docs.select(*group, "doc_id", F.floor(F.col("doc_id") / 10_000).alias("range"))
    before = F.sum("c").over(Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = keys.groupBy(*group, "range").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(before, F.lit(0))).drop("c")
    ranked = keys.withColumn("nth", F.row_number().over(Window.partitionBy(*group, "range").orderBy("doc_id")) - 1)
    ranked = ranked.join(counts, [*group, "range"]).select("doc_id", (F.col("nth") + F.col("before")).alias("n"))
    docs = docs.join(ranked, "doc_id")
    key = F.concat("source", F.lit("-"), "lang", F.lit("-"), F.floor(F.col("n") / 30).cast("string"), F.lit(".pdf"))
    return docs.select(key.alias("source_key"), (F.col("n") % 30 + 1).cast("int").alias("page"), "text")


CTE["pages_of"] = "pages_of AS (SELECT source || '-' || lang || '-' || (n // 30) || '.pdf' AS source_key, (n % 30 + 1)::INT AS page, text FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS n FROM documents))"
