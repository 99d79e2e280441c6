"""Queries of listings, chunks, stored vectors and their states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import chunking, status
from ..registry import registered
from ..sources import listing, stored
from .tables import MODEL, VARIANT, chunks, files, pages_of, seconds, sources, table, vectors, with_cte

BASE = ("files", "sources", "allchunks", "chunks")
ALL = ("files", "allchunks")
INDEX = (*BASE, "vectors")


@registered("io1_scan_sources", with_cte("files", then="SELECT source_key, modified AS last_modified, size, etag FROM files WHERE starts_with(source_key, 'src1')"))
def io1(spark: SparkSession, d: str) -> DataFrame:
    return listing.scan_table(files(spark, d), "src1").withColumn("last_modified", seconds("last_modified"))


@registered("io3_route_by_type", r"""SELECT page_id, lower(regexp_extract(url, '\.[^./]+$', 0)) AS extension, CASE WHEN lower(regexp_extract(url, '\.[^./]+$', 0)) IN ('.txt', '.md', '.pdf') THEN 'supported' ELSE 'unsupported' END AS route FROM pages""")
def io3(spark: SparkSession, d: str) -> DataFrame:
    return listing.route_by_type(table(spark, d, "pages").select("page_id", F.col("url").alias("source_key"))).drop("source_key")


@registered("io4_assemble_pages", with_cte("pages_of", then=r"""SELECT source_key, md5(string_agg('<!-- page ' || page || ' -->' || chr(10) || text, chr(10) || chr(10) ORDER BY page)) AS text_md5, count(*) AS n_pages, sum(length('<!-- page ' || page || ' -->' || chr(10) || text))::BIGINT + 2 * (count(*) - 1) AS n_chars FROM pages_of GROUP BY source_key"""))
def io4(spark: SparkSession, d: str) -> DataFrame:
    out = listing.assemble_pages(pages_of(spark, d))
    return out.select("source_key", F.md5("text").alias("text_md5"), F.size("spans").cast("bigint").alias("n_pages"), F.expr("element_at(spans, -1).end").cast("bigint").alias("n_chars"))


@registered("io5_needs_extraction", with_cte("files", "sources", then="SELECT source_key FROM sources WHERE doc_id % 5 = 0 OR doc_id % 11 = 0"))
def io5(spark: SparkSession, d: str) -> DataFrame:
    kept = files(spark, d).where("doc_id % 5 <> 0").select("source_key", F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("etag")).alias("source_etag"))
    return listing.needs_extraction(sources(spark, d), kept).select("source_key")


@registered("io8_validate_uploads", r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^.*://', ''), '[?#].*$', '') AS k, coalesce(strlen(html), 0) AS size FROM pages),
b AS (SELECT *, regexp_extract(k, '[^/]*$', 0) AS name FROM u), e AS (SELECT *, lower(regexp_extract(name, '\.[^./]+$', 0)) AS x FROM b)
SELECT page_id, name, CASE WHEN name = '' THEN 'empty name' WHEN list_contains(string_split(k, '/'), '..') THEN 'path traversal' WHEN starts_with(k, 'derived/') THEN 'reserved prefix' WHEN x NOT IN ('.txt', '.md', '.pdf', '.html') THEN 'unsupported type' WHEN size = 0 THEN 'empty file' WHEN size > 20000 THEN 'too large' END AS reject_reason,
CASE x WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/markdown' WHEN '.pdf' THEN 'application/pdf' WHEN '.html' THEN 'text/html' ELSE 'application/octet-stream' END AS content_type FROM e""")
def io8(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    key = F.regexp_replace(F.regexp_replace("url", "^.*://", ""), "[?#].*$", "")
    up = p.select("page_id", key.alias("source_key"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    return listing.validate_uploads(up, most_bytes=20000, types={".html": "text/html"}).select("page_id", "name", "reject_reason", "content_type")


@registered("io9_classify_uploads", with_cte("files", "sources", then="SELECT f.source_key, CASE WHEN f.doc_id % 23 = 0 THEN 'created' WHEN f.doc_id % 4 = 0 THEN 'conflict' ELSE 'identical' END AS outcome FROM files f"))
def io9(spark: SparkSession, d: str) -> DataFrame:
    incoming = files(spark, d).select("source_key", F.when(F.col("doc_id") % 4 == 0, F.md5(F.concat("text", F.lit("+")))).otherwise(F.md5("text")).alias("md5"))
    return listing.classify_uploads(incoming, sources(spark, d)).select("source_key", "outcome")


@registered("io14_upsert_vectors", with_cte(*INDEX, then=f"""SELECT vector_id, md5(content) AS content_md5, embedding_model FROM vectors v WHERE space = '' AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.vector_id = v.vector_id AND c.doc_id % 11 = 0)
UNION ALL SELECT vector_id, md5(content), '{MODEL}' FROM chunks WHERE doc_id % 11 = 0"""))
def io14(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).where("space = ''")
    new = chunks(spark, d).where(F.regexp_extract("source_key", r"(\d+)\.txt$", 1).cast("bigint") % 11 == 0).select("vector_id", "source_key", "document_id", "chunk_index", "chunk_total", "content")
    return stored.upserted(v, new, "", MODEL).select("vector_id", F.md5("content").alias("content_md5"), "embedding_model")


@registered("io15_delete_vectors", with_cte(*INDEX, then="SELECT space, vector_id FROM vectors WHERE NOT (space = '' AND doc_id % 10 = 0) AND NOT (space = '' AND chunk_index >= 3)"))
def io15(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    gone = files(spark, d).where("doc_id % 10 = 0").select(ids.document_id("source_key").alias("document_id"))
    return stored.pruned(stored.delete_documents(v, gone, ""), "", 3).select("space", "vector_id")


@registered("io15_drop_space", with_cte(*INDEX, then="SELECT space, vector_id FROM vectors WHERE space = ''"))
def io15b(spark: SparkSession, d: str) -> DataFrame:
    return stored.drop_space(vectors(spark, d), VARIANT).select("space", "vector_id")


@registered("io16_fetch_vectors", with_cte(*INDEX, then="SELECT vector_id, md5(content) AS content_md5 FROM vectors WHERE space = '' AND chunk_index = 1"))
def io16(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    wanted = files(spark, d).select(ids.vector_id(ids.document_id("source_key"), F.lit(1)).alias("vector_id"))
    return stored.fetch(v, wanted, "").select("vector_id", F.md5("content").alias("content_md5"))


@registered("io19_document_detail", with_cte(*INDEX, then="""SELECT s.source_key, c.n, c.ids FROM sources s LEFT JOIN (SELECT source_key, count(*) AS n, string_agg(vector_id, ',' ORDER BY chunk_index) AS ids FROM vectors WHERE space = '' GROUP BY 1) c USING (source_key)"""))
def io19(spark: SparkSession, d: str) -> DataFrame:
    s, v = sources(spark, d), vectors(spark, d)
    st = status.sync_status(s, v, "", MODEL).where("state <> 'orphaned'")
    out = status.document_detail(st, v.withColumn("chunk_index", F.when(F.col("chunk_index") % 2 == 0, F.col("chunk_index"))), "")
    return out.select("source_key", F.expr("cast(if(chunks is null, null, size(chunks)) as bigint)").alias("n"), F.array_join(F.transform("chunks", lambda c: c["vector_id"]), ",").alias("ids"))


_STATE = f"""CASE WHEN s.source_key IS NULL THEN 'orphaned' WHEN r.chunk_count IS NULL THEN 'not_indexed' WHEN r.chunk_total <> 0 AND r.chunk_count <> r.chunk_total THEN 'interrupted' WHEN r.source_etag <> s.etag THEN 'stale_content' WHEN r.embedding_model <> '{MODEL}' THEN 'stale_model' ELSE 'current' END"""
_STATUS = f"keys AS (SELECT source_key FROM sources UNION SELECT source_key FROM vectors), st AS (SELECT k.source_key, {_STATE} AS state, r.chunk_count, r.chunk_total, r.embedding_model FROM keys k LEFT JOIN sources s USING (source_key) LEFT JOIN (SELECT * FROM firsts WHERE space = '') r USING (source_key))"


def _status_sql(then: str) -> str:
    return with_cte(*INDEX, "rollup", then=", " + _STATUS + "\n" + then).replace("\n, keys AS", ",\nkeys AS")


@registered("j1_sync_status", _status_sql(f"""SELECT source_key, state, CASE state WHEN 'orphaned' THEN 'Vectors exist for a file that is no longer in object storage.' WHEN 'not_indexed' THEN 'This file has never been embedded.' WHEN 'interrupted' THEN 'A previous run left ' || chunk_count || ' of ' || chunk_total || ' chunks indexed; re-index to complete it.' WHEN 'stale_content' THEN 'The file changed in object storage after it was embedded.' WHEN 'stale_model' THEN 'Embedded with ''' || embedding_model || ''', but ''{MODEL}'' is configured now.' ELSE 'Embeddings match the file in object storage.' END AS reason FROM st"""))
def j1(spark: SparkSession, d: str) -> DataFrame:
    return status.sync_status(sources(spark, d), vectors(spark, d), "", MODEL).select("source_key", "state", "reason")


@registered("p3_reindexable", _status_sql("SELECT source_key, state FROM st WHERE state NOT IN ('orphaned', 'unsupported', 'current') AND starts_with(source_key, 'src1')"))
def p3(spark: SparkSession, d: str) -> DataFrame:
    return status.filter_status(status.reindexable(status.sync_status(sources(spark, d), vectors(spark, d), "", MODEL)), "src1").select("source_key", "state")


@registered("p4_no_derived", "SELECT CASE WHEN doc_id % 9 = 0 THEN 'derived/' ELSE '' END || source || '/' || doc_id AS source_key FROM documents WHERE doc_id % 9 <> 0")
def p4(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 9 == 0, "derived/").otherwise(""), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_key"))
    return listing.without_derived(k)


@registered("j2_orphans", with_cte(*INDEX, then="SELECT DISTINCT source_key FROM vectors WHERE source_key NOT IN (SELECT source_key FROM sources)"))
def j2(spark: SparkSession, d: str) -> DataFrame:
    return status.orphans(sources(spark, d), vectors(spark, d))


@registered("j3_copies", with_cte(*INDEX, "rollup", then=f"""SELECT r.source_key, count(*) AS n, string_agg(r.space || ':' || {_STATE}, ',' ORDER BY r.embedded DESC NULLS FIRST, r.space) AS held FROM firsts r LEFT JOIN sources s USING (source_key) GROUP BY r.source_key"""))
def j3(spark: SparkSession, d: str) -> DataFrame:
    c = status.copies(sources(spark, d), vectors(spark, d), "", MODEL)
    return c.select("source_key", F.size("copies").cast("bigint").alias("n"), F.array_join(F.transform("copies", lambda x: F.concat(x["variant_id"], F.lit(":"), x["state"])), ",").alias("held"))


_PLAN = f"""v AS (SELECT * FROM vectors WHERE space = '' AND document_id IN (SELECT document_id FROM chunks)),
b AS (SELECT coalesce(c.document_id, v.document_id) AS document_id, coalesce(c.chunk_index, v.chunk_index) AS chunk_index, CASE WHEN c.content IS NULL THEN 'prune' WHEN v.content = c.content AND v.embedding_model = '{MODEL}' THEN 'reuse' ELSE 'embed' END AS a FROM chunks c FULL JOIN v ON c.document_id = v.document_id AND c.chunk_index = v.chunk_index)"""


@registered("j4_index_plan", with_cte(*INDEX, then=f", {_PLAN} SELECT document_id, chunk_index, CASE WHEN chunk_index = 0 AND a = 'reuse' AND max((a <> 'reuse')::INT) OVER (PARTITION BY document_id) = 1 THEN 'embed' ELSE a END AS action FROM b").replace("\n, v AS", ",\nv AS"))
def j4(spark: SparkSession, d: str) -> DataFrame:
    return status.index_plan(chunks(spark, d), vectors(spark, d), "", MODEL).select("document_id", "chunk_index", "action")


@registered("j16_forget_source", with_cte(*INDEX, then="SELECT space, vector_id FROM vectors WHERE NOT (space <> '' AND doc_id % 2 = 0)"))
def j16(spark: SparkSession, d: str) -> DataFrame:
    return status.forget_source(vectors(spark, d), files(spark, d).where("doc_id % 2 = 0")).select("space", "vector_id")


@registered("j19_reconcile", with_cte(*INDEX, then="SELECT coalesce(v.vector_id, c.vector_id) AS vector_id, CASE WHEN v.vector_id IS NULL THEN 'no_vector' ELSE 'no_text' END AS problem FROM (SELECT vector_id FROM vectors WHERE space = '') v FULL JOIN chunks c ON v.vector_id = c.vector_id WHERE v.vector_id IS NULL OR c.vector_id IS NULL"))
def j19(spark: SparkSession, d: str) -> DataFrame:
    return status.reconcile(vectors(spark, d).where("space = ''"), chunks(spark, d))


@registered("a1_indexed_documents", with_cte(*INDEX, "rollup", then="SELECT space, document_id, chunk_count, source_key, source_etag, chunk_total, embedding_model FROM firsts"))
def a1(spark: SparkSession, d: str) -> DataFrame:
    return status.indexed_documents(vectors(spark, d)).drop("embedded_at")


@registered("a2_variants", with_cte(*INDEX, "rollup", then=f"""SELECT space, sum(chunk_count)::BIGINT AS vectors, sum(chunk_total)::BIGINT AS expected, count(DISTINCT source_key) AS n_files, bool_or(chunk_total <> 0 AND chunk_count < chunk_total) AS interrupted, max(embedded)::BIGINT AS embedded, arg_min(embedding_model, source_key) AS embedding_model FROM firsts WHERE space = '{VARIANT}' GROUP BY space"""))
def a2(spark: SparkSession, d: str) -> DataFrame:
    return status.variants(vectors(spark, d)).select("space", "vectors", "expected", F.col("files").alias("n_files"), "interrupted", seconds("embedded_at").alias("embedded"), "embedding_model")


@registered("a3_space_stats", with_cte(*INDEX, then="SELECT space, count(*) AS vectors FROM vectors GROUP BY ROLLUP (space)"))
def a3(spark: SparkSession, d: str) -> DataFrame:
    return status.space_stats(vectors(spark, d))


@registered("a18_indexed_keys", with_cte(*INDEX, then=f"SELECT DISTINCT source_key FROM vectors WHERE space = '{VARIANT}'"))
def a18(spark: SparkSession, d: str) -> DataFrame:
    return status.indexed_keys(vectors(spark, d), VARIANT)


@registered("u2_statuses", _status_sql("SELECT source_key, state = 'orphaned' AS orphan FROM st"))
def u2(spark: SparkSession, d: str) -> DataFrame:
    return status.sync_status(sources(spark, d), vectors(spark, d), "", MODEL).select("source_key", (F.col("state") == "orphaned").alias("orphan"))


@registered("u4_all_spaces", with_cte(*INDEX, then="SELECT space, count(*) AS n FROM vectors GROUP BY space"))
def u4(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return status.all_spaces(v.where("space = ''"), v.where("space <> ''")).groupBy("space").agg(F.count(F.lit(1)).alias("n"))


@registered("l3_order_statuses", _status_sql("SELECT st.source_key, state, modified FROM st LEFT JOIN sources USING (source_key) ORDER BY state = 'orphaned', modified DESC, source_key"))
def l3(spark: SparkSession, d: str) -> DataFrame:
    ordered = status.order_statuses(status.sync_status(sources(spark, d), vectors(spark, d), "", MODEL))
    return ordered.select("source_key", "state", seconds("last_modified").alias("modified"))


@registered("t8_select_work", _status_sql("SELECT f.source_key, CASE WHEN st.state IS NULL OR st.state = 'orphaned' THEN 'missing' ELSE 'queued' END AS outcome FROM files f LEFT JOIN st USING (source_key) WHERE f.doc_id % 4 = 0"))
def t8(spark: SparkSession, d: str) -> DataFrame:
    st = status.sync_status(sources(spark, d), vectors(spark, d), "", MODEL)
    return status.select_work(st, files(spark, d).where("doc_id % 4 = 0"))


@registered("v4_production", with_cte(*INDEX, "rollup", then=f"SELECT p.space, CASE WHEN p.space = '' THEN 'original' WHEN n IS NULL THEN 'missing' ELSE 'ready' END AS state, n AS vectors FROM (VALUES (''), ('{VARIANT}'), ('fixed-999-0')) p(space) LEFT JOIN (SELECT space, sum(chunk_count)::BIGINT AS n FROM firsts WHERE space <> '' GROUP BY 1) USING (space)"))
def v4(spark: SparkSession, d: str) -> DataFrame:
    pointer = spark.createDataFrame([("",), (VARIANT,), ("fixed-999-0",)], "space string")
    return status.production(pointer, status.variants(vectors(spark, d))).select("space", "state", "vectors")


@registered("t10_listing_stale", with_cte(*INDEX, then="SELECT CASE WHEN count(*) <> count(*) FILTER (WHERE space = '') THEN 'vector count changed' END AS reason FROM vectors"))
def t10(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    row = lambda x: x.agg(F.lit(1).alias("epoch"), F.count(F.lit(1)).alias("vectors"), F.lit(MODEL).alias("model"))
    return status.listing_stale(row(v.where("space = ''")), row(v))


# --- chunks


@registered("c1_count_tokens", r"SELECT doc_id, len(regexp_extract_all(text, '\s*\S+'))::INT AS n_tokens, md5(array_to_string(regexp_extract_all(text, '\s*\S+')[1:50], '')) AS head_md5 FROM documents")
def c1(spark: SparkSession, d: str) -> DataFrame:
    docs = chunking.count_tokens(table(spark, d, "documents").select("doc_id", "text"))
    return chunking.truncate_tokens(docs, 50).select("doc_id", "n_tokens", F.md5("text").alias("head_md5"))


@registered("c2_chunk_fixed", with_cte(*ALL, then="SELECT source_key, chunk_index, md5(content) AS content_md5, token_count, end_offset - length(content) AS start_offset, end_offset FROM allchunks"))
def c2(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, every=True)
    return c.select("source_key", "chunk_index", F.md5("content").alias("content_md5"), F.col("token_count"), F.col("start_offset").cast("bigint"), F.col("end_offset").cast("bigint"))


@registered("w4_chunk_identity", with_cte(*ALL, then="SELECT vector_id, document_id, chunk_index, chunk_total, CASE WHEN chunk_index = 0 THEN 0 ELSE 16 END AS overlap FROM allchunks"))
def w4(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, every=True).select("vector_id", "document_id", "chunk_index", "chunk_total", "overlap")


@registered("a4_chunk_stats", with_cte(*ALL, then="SELECT source_key, count(*) AS n_chunks, sum(token_count)::BIGINT AS total_tokens, min(token_count) AS min_tokens, floor(median(token_count))::INT AS median_tokens, max(token_count) AS max_tokens, round(greatest(0.0, 1 - any_value(doc_tokens) / sum(token_count)), 6) AS repeated FROM allchunks GROUP BY source_key"))
def a4(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_stats(chunks(spark, d, every=True), files(spark, d)).drop("variant")


@registered("c6_parse_variant", r"""WITH v AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'recursive-512-64' WHEN 1 THEN 'wobbly-512-64' WHEN 2 THEN 'fixed-128-128' WHEN 3 THEN 'structural-' || (64 + doc_id) || '-0' ELSE 'nonsense' END AS variant FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'recursive · 512/64' WHEN doc_id % 5 = 3 AND 64 + doc_id <= 8000 THEN 'structural · ' || (64 + doc_id) || '/0' END AS label FROM v""")
def c6(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 5
    v = F.when(n == 0, "recursive-512-64").when(n == 1, "wobbly-512-64").when(n == 2, "fixed-128-128").when(n == 3, F.concat(F.lit("structural-"), (F.col("doc_id") + 64).cast("string"), F.lit("-0"))).otherwise("nonsense")
    docs = table(spark, d, "documents").select("doc_id", v.alias("variant"))
    return docs.select("doc_id", F.when(ids.variant_struct("variant").isNotNull(), ids.variant_label("variant")).alias("label"))


@registered("c7_chunk_all", with_cte(*ALL, then="""SELECT 'fixed-64-16' AS variant, source_key, count(*) AS n, sum(token_count)::BIGINT AS tokens FROM allchunks GROUP BY source_key UNION ALL SELECT 'fixed-96-0', source_key, ceil(len(t) / 96.0)::BIGINT, len(t)::BIGINT FROM wins"""))
def c7(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_all(files(spark, d), ["fixed-64-16", "fixed-96-0"]).groupBy("variant", "source_key").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"))


@registered("c8_preview", with_cte(*ALL, then="SELECT source_key, ceil(len(t) / 128.0)::BIGINT AS n_chunks, len(t)::BIGINT AS total_tokens, least(128, (len(t) - 1) % 128 + 1)::INT AS min_tokens, least(128, len(t))::INT AS max_tokens FROM wins"))
def c8(spark: SparkSession, d: str) -> DataFrame:
    return chunking.preview(files(spark, d), "fixed-128-0")[1].select("source_key", "n_chunks", "total_tokens", "min_tokens", "max_tokens")


@registered("c3_chunk_boundary")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_all(files(spark, d), ["boundary-64-16"])


@registered("c4_chunk_recursive")
def c4(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_all(files(spark, d), ["recursive-64-16"])


_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@registered("c9_locate_chunks", with_cte(*ALL, then=f""", c AS (SELECT vector_id, content, {_STRIPPED} AS doc, coalesce(lag(end_offset - length(content)) OVER (PARTITION BY source_key ORDER BY chunk_index) + 1, 0) AS cursor FROM allchunks)
SELECT vector_id, CASE WHEN strpos(substr(doc, cursor + 1), content) > 0 THEN cursor + strpos(substr(doc, cursor + 1), content) - 1 WHEN strpos(doc, content) > 0 THEN strpos(doc, content) - 1 ELSE cursor END AS start FROM c""").replace("\n, c AS", ",\nc AS"))
def c9(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk is searched from one character after the start of the chunk before it."""
    before = F.lag("start_offset").over(Window.partitionBy("source_key").orderBy("chunk_index"))
    c = chunks(spark, d, every=True).select("vector_id", "source_key", "content", F.coalesce(before + 1, F.lit(0)).alias("cursor"))
    return chunking.locate_chunks(c, files(spark, d)).select("vector_id", F.col("start").cast("bigint").alias("start"))


@registered("w10_overlap_check", with_cte(*ALL, then=r"""SELECT source_key, coalesce(sum(len(regexp_extract_all(substr(content, length(content) - (end_offset - nxt) + 1), '\s*\S+'))), 0)::BIGINT AS shared_tokens FROM (SELECT *, lead(end_offset - length(content)) OVER (PARTITION BY source_key ORDER BY chunk_index) AS nxt FROM allchunks) GROUP BY source_key"""))
def w10(spark: SparkSession, d: str) -> DataFrame:
    return chunking.overlap_check(chunks(spark, d, every=True)).groupBy("source_key").agg(F.coalesce(F.sum("shared_tokens"), F.lit(0)).alias("shared_tokens"))


@registered("j8_stamp_pages", with_cte("pages_of", then=r"""
, m AS (SELECT source_key, page, length('<!-- page ' || page || ' -->' || chr(10) || text) AS n FROM pages_of),
sp AS (SELECT source_key, page, coalesce(sum(n + 2) OVER (PARTITION BY source_key ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, n FROM m),
tot AS (SELECT source_key, max(s + n) AS total FROM sp GROUP BY 1),
c AS (SELECT source_key, k AS chunk_index, k * 500 AS a, least(k * 500 + 600, total) AS b FROM tot, unnest(range(ceil(total / 500)::BIGINT)) u(k))
SELECT c.source_key, c.chunk_index::INT AS chunk_index, min(page) AS page_start, max(page) AS page_end FROM c LEFT JOIN (SELECT *, CASE WHEN lead(s) OVER (PARTITION BY source_key ORDER BY page) IS NULL THEN s + n ELSE lead(s) OVER (PARTITION BY source_key ORDER BY page) END AS e FROM sp) p ON c.source_key = p.source_key AND s < b AND e > a GROUP BY 1, 2""").replace("\n\n, m", ",\nm"))
def j8(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import sections

    whole = listing.assemble_pages(pages_of(spark, d))
    spans = whole.select("source_key", F.explode("spans").alias("s")).select("source_key", "s.*")
    total = F.expr("element_at(spans, -1).end")
    cut = whole.select("source_key", total.alias("total"), F.explode(F.sequence(F.lit(0), F.ceil(total / 500).cast("int") - 1)).alias("chunk_index"))
    cut = cut.withColumn("start_offset", F.col("chunk_index") * 500).withColumn("end_offset", F.least(F.col("chunk_index") * 500 + 600, F.col("total")))
    return sections.stamp_pages(cut, spans).select("source_key", "chunk_index", "page_start", "page_end")
