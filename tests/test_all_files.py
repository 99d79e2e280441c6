"""Queries that compare nothing with an index read every file."""

from loomspark import registry


def test_every_document_is_chunked_and_sectioned(spark, tmp_path):
    spark.createDataFrame([(k, "Some words of a text. " * 20, "s") for k in (0, 1, 23, 46)], "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("c3_chunk_boundary", "c4_chunk_recursive", "c10_split_text", "s4_sections_of_documents"):
        found = {r.source_key for r in registry.queries()[name](spark, str(tmp_path)).select("source_key").collect()}
        assert found == {f"s/{k}.txt" for k in (0, 1, 23, 46)}, name
