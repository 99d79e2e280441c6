"""Files of a store: listing, decoding, routing, page assembly, uploads, extraction work lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text

#: Content types by extension, the pipeline's own prefix, the largest upload.
TYPES = {".txt": "text/plain", ".md": "text/markdown", ".pdf": "application/pdf"}
DERIVED, MOST_BYTES = "derived/", 50 * 1024 * 1024


def scan_sources(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Files under path, newest first: source_key (relative), last_modified, size, etag (md5 of the content)."""
    root = path.rstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    key = F.expr(f"substring_index(path, '{root}/', -1)")
    f = f.select(key.alias("source_key"), F.col("modificationTime").alias("last_modified"), F.col("length").alias("size"), F.md5("content").alias("etag"))
    return f.where(F.col("source_key").startswith(prefix)).orderBy(F.col("last_modified").desc(), "source_key")


def scan_table(files: DataFrame, prefix: str = "") -> DataFrame:
    """The same of a table of files with text; quotes are taken off etags."""
    return files.where(F.col("source_key").startswith(prefix)).select("source_key", "last_modified", "size", F.btrim("etag", F.lit('"')).alias("etag")).orderBy(F.col("last_modified").desc(), "source_key")


def without_derived(files: DataFrame) -> DataFrame:
    return files.where(~F.col("source_key").startswith(DERIVED))


def decode_text(files: DataFrame) -> DataFrame:
    """content (binary) to text: UTF-8 without its mark; bytes that aren't UTF-8 as Windows-1252, else Latin-1."""

    @F.pandas_udf("string")
    def other(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(b):
            if b is None:
                return None
            try:
                return b.decode("cp1252")
            except UnicodeDecodeError:
                return b.decode("latin-1")

        for p in parts:
            yield p.map(one)

    plain = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^﻿", "")
    return files.withColumn("text", F.coalesce(plain, other(F.when(~F.is_valid_utf8(F.col("content").cast("string")), F.col("content")))))


#: How the text of a format is got: extension -> a transform of (source_key, content, ...) that adds text. A format more is
#: a row more; formats that are known but not listed here (.pdf) are routed and left without text.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {".txt": decode_text, ".md": decode_text, ".markdown": decode_text}


def extract_text(files: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """files (source_key, content) with extension, text and extracted (whether there was an extractor for the extension)."""
    table = EXTRACTORS | (extractors or {})
    rows = files.withColumn("extension", text.extension("source_key"))
    out = rows.where(~F.col("extension").isin(*table)).withColumn("text", F.lit(None).cast("string")).withColumn("extracted", F.lit(False))
    for extract in dict.fromkeys(table.values()):
        kinds = [x for x, f in table.items() if f is extract]
        out = out.unionByName(extract(rows.where(F.col("extension").isin(*kinds))).withColumn("extracted", F.lit(True)))
    return out


def route_by_type(files: DataFrame) -> DataFrame:
    """files with extension and route; unsupported ones stay, labelled."""
    return files.withColumn("extension", text.extension("source_key")).withColumn("route", F.when(F.col("extension").isin(*TYPES), "supported").otherwise("unsupported"))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """source_key, text and spans: pages in order, each after its marker; the spans tile the text. Empty pages keep their number."""
    marked = pages.withColumn("part", F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->\n"), F.coalesce("text", F.lit(""))))
    order = Window.partitionBy("source_key").orderBy("page")
    start = F.coalesce(F.sum(F.length("part") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    marked = marked.withColumn("start", start)
    end = F.coalesce(F.lead("start").over(order), F.col("start") + F.length("part"))
    rows = marked.withColumn("end", end).groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("page", "start", "end", "part"))).alias("ps"))
    return rows.select("source_key", F.array_join(F.transform("ps", lambda p: p["part"]), "\n\n").alias("text"), F.transform("ps", lambda p: F.struct(p["page"].alias("page"), p["start"].alias("start"), p["end"].alias("end"))).alias("spans"))


def needs_extraction(sources: DataFrame, extractions: DataFrame) -> DataFrame:
    """Sources whose stored extraction is of another etag, or that have none."""
    kept = extractions.select(F.col("source_key").alias("k"), "source_etag")
    return sources.join(kept, (sources["source_key"] == kept["k"]) & sources["etag"].eqNullSafe(kept["source_etag"]), "left_anti")


def table_artifacts(extractions: DataFrame, document_id: str | None = None, table_id: str | None = None) -> DataFrame:
    """Tables of extractions: document_id, table_id, markdown, page, caption; of one document or table if asked."""
    out = extractions.select("document_id", F.explode("tables").alias("t")).select("document_id", "t.*")
    out = out.where(F.col("document_id") == document_id) if document_id else out
    return out.where(F.col("table_id") == table_id) if table_id else out


def validate_uploads(uploads: DataFrame, most_bytes: int = MOST_BYTES, types: dict[str, str] | None = None) -> DataFrame:
    """uploads (source_key, size) with name, accepted, reject_reason (the first that holds) and content_type."""
    known = TYPES | (types or {})
    parts = F.split("source_key", "/")
    kind = F.col("__ext")
    why = (
        F.when(F.col("name") == "", "empty name").when(F.array_contains(parts, ".."), "path traversal").when(F.col("source_key").startswith(DERIVED), "reserved prefix")
        .when(~kind.isin(*known), "unsupported type").when(F.col("size") == 0, "empty file").when(F.col("size") > most_bytes, "too large")
    )
    mime = F.lit("application/octet-stream")
    for x, m in known.items():
        mime = F.when(kind == x, m).otherwise(mime)
    out = uploads.withColumn("name", F.element_at(parts, -1)).withColumn("__ext", text.extension("name"))
    return out.withColumn("reject_reason", why).withColumn("accepted", F.col("reject_reason").isNull()).withColumn("content_type", mime).drop("__ext")


def classify_uploads(incoming: DataFrame, sources: DataFrame) -> DataFrame:
    """incoming (source_key, md5) with outcome: created, identical (md5 is the stored etag; a multipart etag never is), conflict."""
    stored = sources.select(F.col("source_key").alias("k"), F.btrim("etag", F.lit('"')).alias("e"))
    both = incoming.join(stored, F.col("source_key") == F.col("k"), "left")
    return both.withColumn("outcome", F.when(F.col("k").isNull(), "created").when(F.coalesce(F.col("e") == F.col("md5"), F.lit(False)), "identical").otherwise("conflict")).drop("k", "e")


def replace_sources(sources: DataFrame, incoming: DataFrame, vectors: DataFrame, *derived: DataFrame) -> tuple[DataFrame, ...]:
    """(sources with incoming rows in place of theirs, vectors without any of the replaced keys, and each derived table,
    extractions and table artifacts by document_id, without what was made of the replaced files)."""
    keys = incoming.select("source_key").distinct()
    documents = keys.select(ids.document_id("source_key").alias("document_id"))
    kept = sources.join(keys, "source_key", "left_anti").unionByName(incoming), vectors.join(keys, "source_key", "left_anti")
    return (*kept, *(d.join(documents, "document_id", "left_anti") for d in derived))
